"""Packing: documents into sequences of at most ``SEQUENCE`` tokens, shortest pack first.

A document's ids and the closing id are cut every ``SEQUENCE`` tokens. The pieces are then placed by the
histogram of their lengths alone: lengths go longest first, each into the shortest open pack (the one with
most room) that holds it, all equal packs at once, and open a new pack where none does. The histogram has
``SEQUENCE`` bars at most, so the driver plans it whatever the number of documents; its plan is a table of
intervals "the pieces of this length with ranks from a to b go to sequences from s on, at this offset".

Pieces get their rank among equal lengths without a task that sees a whole length: rows of a length are
hashed into chunks of about ``CHUNK`` rows, counted, and numbered within each chunk from its first rank.

Defined results: a null or empty text has one piece, the closing id alone. Repeated rows are packed each.
Special strings inside a text count as the library's default reads them, one id each. Very long texts are cut
like others. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import stage

SEQUENCE, CLOSING_ID, CHUNK = 2048, 1, 20_000


def pieces(df: DataFrame, tokenizer: str, pattern: str, key: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens and, if asked for, its ids.

    ``tokenizer`` is a JSON file of byte-level merges. Its vocabulary is read by the driver; tasks merge with
    a compiled encoder of the same merges, which gives the ids the ``tokenizers`` library gives (tested),
    those of special strings inside a text included.
    """
    ranks, special = encoder_tables(tokenizer)
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            import tiktoken
            made.append(tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special))
        for batch in batches:
            keys, rows = batch.column(0), {k: [] for k in ("at", "start", "length", "crc", "total", "ids")}
            for i, value in enumerate(batch.column(1)):
                ids = np.append(made[0].encode_to_numpy(value.as_py() or "", allowed_special="all"), CLOSING_ID).astype("<u4")
                for start in range(0, len(ids), SEQUENCE):
                    own = ids[start:start + SEQUENCE]
                    for k, v in (("at", i), ("start", start), ("length", len(own)),
                                 ("crc", zlib.crc32(own.tobytes())), ("total", len(ids))):
                        rows[k].append(v)
                    if with_ids:
                        rows["ids"].append(own.astype(np.int32))
            out = [keys.take(pa.array(rows["at"], pa.int64())), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc", "total"))]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def encoder_tables(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token ids by bytes, which must also be the order of merges, and special strings with their ids."""
    with open(path, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}
    vocab = bpe.from_merges(path)
    if np.any(np.diff(vocab.merged[np.argsort(vocab.ranks)]) <= 0):
        raise ValueError(f"{path}: its merges do not come in the order of their ids")
    return {t: i for i, t in enumerate(vocab.tokens) if t and i not in special.values()}, special


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Intervals ``(length, first rank, count, first sequence, offset)`` by shortest-pack-first."""
    open_packs: list[list[list[int]]] = [[] for _ in range(size + 1)]    # by room left: [first sequence, count]
    out, sequences, most = [], 0, 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while most and not open_packs[most]:
                most -= 1
            if most < length:                                           # no open pack holds it
                first, count, room = sequences, left, size
                sequences += left
            else:
                room = most
                group = open_packs[room][-1]
                first, count = group[0], min(left, group[1])
                group[0], group[1] = group[0] + count, group[1] - count
                if not group[1]:
                    open_packs[room].pop()
            out.append((length, rank, count, first, size - room))
            if room - length:
                open_packs[room - length].append([first, count])
                most = max(most, room - length)
            rank, left = rank + count, left - count
    return out


def pack(cut: DataFrame) -> DataFrame:
    """Place the rows of :func:`pieces`; adds ``sequence_id`` and ``offset``."""
    cut = stage(cut, "pieces")
    sizes = cut.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in sizes.collect()}           # at most SEQUENCE rows
    chunks = max(1, -(-sum(histogram.values()) // CHUNK))
    steps = sorted(plan(histogram))
    shift = 44
    found = np.array([(s[0] << shift) + s[1] for s in steps], np.int64)
    ranks, firsts, offsets = (np.array([s[k] for s in steps], np.int64) for k in (1, 3, 4))

    chunked = cut.withColumn("chunk", F.pmod(F.xxhash64("key", "start"), F.lit(chunks)))
    before = (chunked.groupBy("length", "chunk").agg(F.count("*").alias("n"))
              .select("length", "chunk", (F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).alias("before")))
    own = Window.partitionBy("length", "chunk").orderBy("key", "start", "ids_crc32")
    ranked = (chunked.withColumn("place", F.row_number().over(own) - 1).join(before, ["length", "chunk"])
              .withColumn("piece_rank", F.col("before") + F.col("place")))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(found, (length << shift) + rank, side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[at] + rank - ranks[at], "offset": offsets[at]})

    rest = [c for c in cut.columns]
    return ranked.select(*rest, placed("length", "piece_rank").alias("p")).select(*rest, "p.sequence_id", "p.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of each sequence, from pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
