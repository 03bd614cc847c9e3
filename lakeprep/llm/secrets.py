"""Secret scan in DataFrame expressions only: fixed patterns, and character Markov models.

Base spans are the leftmost non-overlapping matches of three patterns. Beyond them, each maximal run of
16 or more characters of ``[A-Za-z0-9+/_=-]`` that holds a letter and a digit is compared under two
first-order character models, one of random strings and one of ordinary words; where the log-likelihood
ratio reaches ``LEAST_RATIO`` nats and ``LEAST_MEAN`` per character, and the run overlaps no base span, it
is added as a ``markov`` span.

The models are trained from strings that the patterns label: values of base matches are random strings,
other words of under 16 characters ordinary ones. A pair's
probability falls back on its second character's where its first is rare (weight ``BACKOFF``). Random strings
come from all texts, however rare they are; ordinary words from the ``SAMPLE_DOCS`` ids with the smallest hash
(a parameter). The counts are one row per pair of characters, so the driver holds a few thousand.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated
rows give equal results; where no text holds a random string to learn from, as in an empty table, the method
adds no span. Very long texts are read whole, their cost grows with their matches to the power 1.5 at most.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# The base patterns and the alphabet of candidate runs.
VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""" + VALUE
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + VALUE + ")"
ACCESS = r"AKIA[A-Z0-9]{12,}"            # the whole run has 16 characters or more
HEX = r"[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{3,14}(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
BASE = "|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX))
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": RUN}

SAMPLE_DOCS, SMOOTHING, BACKOFF, LEAST_RATIO, LEAST_MEAN, LEAST_VALUE = 5_000, 0.5, 20.0, 12.0, 0.6, 8

_SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,match:string>"


def _empty() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind's pattern, with positions.

    ``\\G.*?(pattern)`` matched again and again yields each gap with its match, so running sums of
    lengths are positions; ``\\G`` ties each try to the end of the last, so a text is read once. Appending
    to an array copies it, so the sums run over pieces of about the square root of the matches, and then
    over the pieces: no step appends to a long array.
    """
    gapped = F.lit(rf"(?s)\G.*?({KINDS[kind]})")
    parts = F.zip_with(F.regexp_extract_all(text, gapped, F.lit(0)), F.regexp_extract_all(text, gapped, F.lit(1)),
                       lambda whole, own: F.struct(F.length(whole).cast("long").alias("step"),
                                                   F.length(own).cast("long").alias("size"), own.alias("match")))

    def add(state: Column, part: Column) -> Column:
        end = state["at"] + part["step"]
        span = F.struct((end - part["size"]).alias("start"), F.lit(list(KINDS).index(kind)).alias("rank"),
                        F.lit(kind).alias("kind"), end.alias("end"), part["match"].alias("match")).cast(_SPAN)
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def piece(own: Column) -> Column:
        return F.aggregate(own, F.struct(F.lit(0).cast("long").alias("at"), _empty().alias("out")), add)

    def starts(pieces: Column) -> Column:
        """Where each piece begins."""
        def ahead(state: Column, own: Column) -> Column:
            return F.struct((state["at"] + own["at"]).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), ahead, lambda s: s["out"])

    def shifted(own: Column, first: Column) -> Column:
        return F.transform(own["out"], lambda s: F.struct((s["start"] + first).alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"),
                                                          (s["end"] + first).alias("end"), s["match"].alias("match")).cast(_SPAN))

    def cut(own: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own)))).cast("int")
        places = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / size).cast("int"))
        return F.when(F.size(own) > 0, F.transform(places, lambda k: piece(F.slice(own, k * size + 1, size)))).otherwise(
            F.array().cast(f"array<struct<at:bigint,out:array<{_SPAN}>>>"))

    pieces = _once(parts, cut)
    found = _once(pieces, lambda own: F.flatten(F.zip_with(own, starts(own), shifted)))
    return F.when(text.rlike(KINDS[kind]), found).otherwise(_empty())


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, "assign"), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= LEAST_VALUE)
    return F.concat(assign, matches(text, "access"), matches(text, "hex"))


def _apart(span: Column, base: Column) -> Column:
    return ~F.exists(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, key: str = "doc_id", text: str = "text") -> list[float]:
    """Log-likelihood ratio of each pair of characters, row by row of ``ALPHABET``."""
    ids = docs.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = F.col("text")
    values = F.transform(F.col("base"), lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["match"], ASSIGN_VALUE, 1)).otherwise(s["match"]))
    secret = texts.where(body.rlike(BASE)).select(base_spans(body).alias("base")).select(F.lit(1).alias("random"), F.explode(values).alias("s"))
    picked = stage(texts.join(F.broadcast(ids), "id").withColumn("base", base_spans(body)), "secret-sample")     # sample_docs ids at most
    outside = F.aggregate(F.col("base"), body, lambda t, s: F.replace(t, s["match"], F.lit(" ")))
    words = F.regexp_extract_all(outside, F.lit(WORD), F.lit(0))
    strings = secret.unionByName(picked.select(F.lit(0).alias("random"), F.explode(words).alias("s")))
    pairs = strings.select("random", F.explode(F.when(F.length("s") >= 2, F.transform(
        F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr(F.col("s"), i, F.lit(2))))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    if not any(random for random, _ in counts):
        return []
    models = []
    for y in (1, 0):
        total = {b: sum(counts.get((y, a + b), 0) for a in ALPHABET) + SMOOTHING for b in ALPHABET}
        plain = {b: n / sum(total.values()) for b, n in total.items()}         # the second character alone
        rows = {a: sum(counts.get((y, a + b), 0) for b in ALPHABET) for a in ALPHABET}
        models.append({a + b: (counts.get((y, a + b), 0) + BACKOFF * plain[b]) / (rows[a] + BACKOFF) for a in ALPHABET for b in ALPHABET})
    return [math.log(models[0][a + b] / models[1][a + b]) for a in ALPHABET for b in ALPHABET]


def _numbers(values: list, kind: str) -> Column:
    """An array constant as one foldable expression."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def log_ratio(string: Column, table: list[float]) -> Column:
    """Summed log-likelihood ratio of a string's character pairs."""
    ratios = _numbers(table, "double")
    places = _numbers([max(0, ALPHABET.find(chr(i))) if i else 0 for i in range(128)], "int")
    codes = F.transform(F.split(string, ""), lambda c: F.get(places, F.ascii(c) % 128))

    def add(state: Column, code: Column) -> Column:
        step = F.when(state["prev"] < 0, F.lit(0.0)).otherwise(F.get(ratios, state["prev"] * len(ALPHABET) + code))
        return F.struct(code.alias("prev"), (state["sum"] + step).alias("sum"))

    return F.aggregate(codes, F.struct(F.lit(-1).alias("prev"), F.lit(0.0).alias("sum")), add, lambda s: s["sum"])


def scan(docs: DataFrame, table: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, base, spans)``: base spans and all spans of every whole text, each in order of kind and place."""
    body = F.coalesce(F.col(text), F.lit(""))
    anything = "|".join(f"(?:{p})" for p in KINDS.values())
    found = docs.select(F.col(key).alias("key"), body.alias("body"))
    found = found.withColumn("any", F.col("body").rlike(anything))
    found = found.withColumn("base", F.when(F.col("any"), base_spans(F.col("body"))).otherwise(_empty()))
    added = _empty()
    if table:
        runs = F.filter(matches(F.col("body"), "markov"), lambda s: _apart(s, F.col("base")))
        added = F.when(F.col("any"), F.filter(runs, lambda s: log_ratio(s["match"], table) >= F.greatest(
            F.lit(LEAST_RATIO), F.lit(LEAST_MEAN) * F.length(s["match"])))).otherwise(_empty())
    found = found.select("key", "base", F.concat("base", added).alias("spans"))
    return found.select(F.col("key").alias(key), F.array_sort("base").alias("base"), F.array_sort("spans").alias("spans"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(key, count("assign"), count("access"), count("hex"),
                        F.sha2(spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
