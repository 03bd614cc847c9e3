"""Recurring refresh of a dataset from landed CSV, on Structured Streaming (R2).

Landings arrive as new folders ``<base>/input/<name>/<time>-<id>/`` (see ``sinks.files.land_csv``). A
file-source stream over them feeds ``foreachBatch``:

* ``mode="append"``: every landing is added once;
* ``mode="replace"``: the dataset becomes the newest landing of the batch, as a scheduled full reload
  would do.

Each micro-batch is written to ``<sink>/epoch=<batch id>`` and then committed by a marker under
``<sink>/_commits`` (``sinks.commits``). Readers see committed epochs only: one that is being written, failed
or was refused by ``check`` is invisible. A batch that is retried rewrites its folder unless it is committed;
then it is left alone, so no reader loses files. In replace mode the epochs before the newest ``keep`` + 1
are deleted after each commit. The checkpoint, ``<sink>/_checkpoint`` unless given, records which files were
consumed. A sink with epochs and no checkpoint is refused: its epochs would be written over from 0.

Columns go by the header: a landing whose columns stand in another order is read by name in replace mode
and fails the stream in append mode, never by position. Text that does not fit its column's type fails.
``schedule`` maps "@once" to ``availableNow`` and an interval to a processing-time trigger.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..names import col
from ..sinks import commits
from ..sinks.files import landing_name, unmarked
from ..small import small_table
from ..sources.text import CSV_OPTIONS, cast_text, infer_types

# Schedule words (fixed values) -> processing-time intervals.
SCHEDULES = {
    "@hourly": "1 hour",
    "@daily": "1 day",
    "*/5 * * * *": "5 minutes",
}


def trigger_for(schedule: str) -> dict:
    s = schedule.strip()
    if s in ("@once", "once", "now"):
        return {"availableNow": True}
    if s in SCHEDULES:
        return {"processingTime": SCHEDULES[s]}
    if re.match(r"^\d+\s*(second|minute|hour|day)s?$", s):
        return {"processingTime": s}
    raise ValueError(f"Unsupported schedule {schedule!r}; use @once, @hourly, @daily, */5 * * * * "
                     "or an interval such as '5 minutes'")


LANDING_COLUMN = "__landing__"        # reserved: a dataset may not have a column of this name


def _input(base: str, name: str) -> str:
    landing_name(name)                                            # checks the name
    return f"{base.rstrip('/')}/input/{name}"


def _reader_options(multiline: bool) -> dict[str, str]:
    """Cells as they stand: no null tokens, every header checked, ragged rows fail."""
    return {**CSV_OPTIONS, "header": "true", "multiLine": str(bool(multiline)).lower(), "mode": "FAILFAST",
            "enforceSchema": "false", "emptyValue": "", "nullValue": "\u0000"}


def _boolean(c):
    word = F.lower(F.trim(c))
    return (F.when(word.isin("true", "t", "1", "yes", "y"), True).when(word.isin("false", "f", "0", "no", "n"), False)
            .when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean")))


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    out = []
    for f in schema.fields:
        text = unmarked(col(f.name))
        typed = _boolean(text) if isinstance(f.dataType, T.BooleanType) else cast_text(text, f.dataType.simpleString(), strict=True)
        out.append(typed.alias(f.name))
    return df.select(*out)


def _landing(spark: SparkSession, folder: str, multiline: bool) -> DataFrame:
    """One landing as text, with the columns of its own header."""
    return spark.read.options(**_reader_options(multiline), inferSchema="false").csv(folder)


def start_refresh(spark: SparkSession, base: str, name: str, sink: str,
                  schema: T.StructType | None = None, mode: str = "replace", schedule: str = "@once",
                  checkpoint: str | None = None, archive: bool = False, multiline: bool = True,
                  keep: int = 1, check: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the refresh stream for dataset ``name``; returns the running query.

    ``check(rows, epoch)`` sees each epoch as it was written, before it is committed; what it raises fails
    the stream, and readers stay with the epochs they have. ``keep`` is how many replaced epochs stay for
    readers that have begun (replace mode; append mode keeps all).

    ``archive=True`` lets the file source move consumed landings under ``<base>/archive/`` once their
    batch is committed, so the listing each trigger does stays proportional to new landings.
    ``multiline=False`` lets big landing files split across tasks; texts must then hold no line breaks.
    """
    if mode not in ("replace", "append"):
        raise ValueError("mode must be 'replace' or 'append'")
    source, sink_root = _input(base, name), sink.rstrip("/")
    own_checkpoint = f"{sink_root}/_checkpoint"
    if keep < 0:
        raise ValueError("keep must not be negative")
    if checkpoint is None and _epochs(spark, sink_root) and "_checkpoint" not in commits.sub_folders(spark, sink_root):
        raise ValueError(f"{sink} holds epochs of another checkpoint; pass checkpoint=")
    if schema is None:
        # Types come from the newest landing only: inferring over all of them would rescan history.
        newest = _newest_landing(spark, base, name)
        if newest is None:
            raise ValueError(f"no landing for {name!r} under {base}/input yet; pass schema=")
        text = _landing(spark, newest, multiline)
        text = text.select(*[unmarked(col(c)).alias(c) for c in text.columns])
        types = infer_types(text)
        schema = T.StructType([T.StructField(f.name, T._parse_datatype_string(types.get(f.name, "string"))) for f in text.schema.fields])
    if LANDING_COLUMN in schema.fieldNames():
        raise ValueError(f"column name {LANDING_COLUMN} is reserved")
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.readStream.schema(text_schema).options(**_reader_options(multiline))
    if archive:
        reader = (reader.option("cleanSource", "archive")
                  .option("sourceArchiveDir", f"{base.rstrip('/')}/archive"))
    landing = F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]*$", 1).alias(LANDING_COLUMN)
    if mode == "replace":      # the batch only names the landings; the newest is read by its own header
        reader = reader.option("enforceSchema", "true").option("mode", "PERMISSIVE")
    stream = reader.csv(f"{source}/*").select(*([] if mode == "replace" else ["*"]), landing)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        if epoch_id in committed_epochs(spark, sink_root):              # a retry of a batch that made it
            return
        newest = None
        if mode == "replace":
            # The landings' names come with the plan's file list where it has one: no data is read then.
            names = {m.group(1) for f in batch.inputFiles() if (m := re.search(r"/([^/]+)/[^/]*$", f))}
            newest = max(names) if names else batch.agg(F.max(LANDING_COLUMN)).first()[0]
            if newest is None:
                return
            batch = _landing(spark, f"{source}/{newest}", multiline)
            if set(batch.columns) != set(schema.fieldNames()):
                raise ValueError(f"landing {newest} has columns {batch.columns}, not {schema.fieldNames()}")
        else:
            batch = batch.drop(LANDING_COLUMN)
        counter = Observation(f"epoch-{epoch_id}")
        place = f"{sink_root}/epoch={epoch_id}"
        _typed(batch, schema).observe(counter, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(place)
        if check is not None:
            check(spark.read.schema(schema).parquet(place), epoch_id)
        commits.commit(spark, sink_root, f"epoch={epoch_id}", {"rows": counter.get["rows"], "mode": mode, "landing": newest})
        if mode == "replace":
            for old in committed_epochs(spark, sink_root)[:-1 - keep]:
                commits.forget(spark, sink_root, f"epoch={old}")

    writer = (stream.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint or own_checkpoint)
              .trigger(**trigger_for(schedule)))
    return writer.start()


def _newest_landing(spark: SparkSession, base: str, name: str) -> str | None:
    names = commits.sub_folders(spark, _input(base, name))
    return f"{_input(base, name)}/{max(names)}" if names else None


def _numbers(names: list[str]) -> list[int]:
    return sorted(int(m.group(1)) for n in names if (m := re.match(r"^epoch=(\d+)$", n)))


def _epochs(spark: SparkSession, sink: str) -> list[int]:
    """Epoch folders present under the sink, committed or not."""
    return _numbers(commits.sub_folders(spark, sink))


def committed_epochs(spark: SparkSession, sink: str) -> list[int]:
    """Epochs that readers may see, rising (a listing of markers, no data read)."""
    return _numbers(commits.committed(spark, sink))


def adopt_epochs(spark: SparkSession, sink: str) -> list[int]:
    """Commit the finished epochs of a sink that was written without markers; returns their numbers."""
    sink, known = sink.rstrip("/"), set(committed_epochs(spark, sink))
    found = [e for e in _epochs(spark, sink) if e not in known and commits.exists(spark, f"{sink}/epoch={e}/_SUCCESS")]
    for e in found:
        commits.commit(spark, sink, f"epoch={e}", {"rows": None, "mode": None, "landing": None})
    return found


def read_refreshed(spark: SparkSession, sink: str, mode: str = "replace") -> DataFrame:
    """The refreshed dataset: the newest committed epoch (replace) or all of them (append)."""
    epochs = committed_epochs(spark, sink)
    if not epochs:
        raise ValueError(f"nothing refreshed yet under {sink}")
    if mode == "replace":
        return spark.read.parquet(f"{sink.rstrip('/')}/epoch={epochs[-1]}")
    # The folders by name: their epoch number is no column, a dataset may have one of its own.
    return spark.read.parquet(*[f"{sink.rstrip('/')}/epoch={e}" for e in epochs])


def refresh_log(spark: SparkSession, sink: str) -> DataFrame:
    """One row per committed epoch: ``epoch, rows, mode, landing`` (short files, one per epoch kept)."""
    said = [(e, commits.content(spark, sink, f"epoch={e}")) for e in committed_epochs(spark, sink)]
    return small_table(spark, [(e, c["rows"], c["mode"], c["landing"]) for e, c in said],
                       "epoch bigint, rows bigint, mode string, landing string")


def refresh_once(spark: SparkSession, base: str, name: str, sink: str, schema: T.StructType | None = None,
                 mode: str = "replace", checkpoint: str | None = None, archive: bool = False,
                 multiline: bool = True, keep: int = 1,
                 check: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run one ``availableNow`` refresh to completion and return the result."""
    q = start_refresh(spark, base, name, sink, schema, mode, "@once", checkpoint, archive, multiline, keep, check)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_refreshed(spark, sink, mode)
