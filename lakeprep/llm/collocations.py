"""Phrase collocations: contiguous phrases of 2 to ``DEPTH`` words that occur often, with scores, per language.

A suffix pointer is a word's place; its key is the word and the up to ``DEPTH - 1`` words that follow in the
same piece of text. Counting goes in three passes over the texts and one sort:

1. words: occurrences per language and word, added up by Spark. Words are known by 64-bit hashes; two words
   of one hash are looked for in the whole table, and another seed is taken if there are any.
2. leads: occurrences of the two leading words of each pointer. Pairs below the least count are abandoned:
   no candidate holds them.
3. pointers: those with a frequent lead, cut before the first word whose pair with its predecessor is
   infrequent. Equal ones of a block of text leave the task as one row with a count, so copies of a passage
   never pile up. They are routed by their two leading words; where a lead has more than its share of rows,
   by all their words.
4. each routed partition runs multikey three-way quicksort, breadth first: every open partition compares the
   word at its depth with its pivot; the equal part goes one word deeper, and its size is the count of the
   phrase so far; parts lighter than the least count are abandoned. Partitions of split leads keep their
   light parts, as theirs are only shares; Spark adds the shares up.

Frequent words, frequent leads and split leads reach the tasks as Bloom filters of a fixed size
(``FILTER_BITS``): a false positive lets an infrequent pointer through or splits a lead without need, and
changes no count, since a phrase is kept by its exact count only.

Scores and the removal of phrases inside longer ones are joins on the counted phrases; arithmetic is on
decimals of 38 digits.

Defined results: null and empty texts have no words. A null language is ``und``. Repeated rows count each.
Very long texts are read block by block. Ties of a score go by count, then by the phrase's bytes. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stage

DEPTH, LEAST, TOP = 4, 30, 2000
FILTER_BITS, FILTER_HASHES = 1 << 26, 4
BLOCK, POINTERS_AT_ONCE, ROWS_A_PARTITION, SALTS = 1 << 20, 1 << 20, 500_000, 64
_PIECE_END, _END = b".,;:!?\n\x0b\x0c\r", b"\xff"                # a byte that no text in UTF-8 holds
_TABLE = bytes.maketrans(_PIECE_END + b"\t", _END * len(_PIECE_END) + b" ")
_GAP = re.compile(rb"[ \xff]")
KEYS = [f"k{i}" for i in range(DEPTH)]


class _Numbered(dict):
    """Numbers a language's words in the order they are met; all languages share the numbers."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]) -> None:
        super().__init__({_END: -1})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append((self.lang, word))
        return n


class _Reader:
    """Word numbers of texts, -1 between pieces, handed out in blocks that share one numbering.

    A block that ends inside a text leaves its last ``DEPTH - 1`` places to the next block, which starts with
    them: here they only complete the phrases of the places before.
    """

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.words, self.langs, self.buffer = [], {}, []

    def numbers(self, lang: str) -> _Numbered:
        if lang not in self.langs:
            self.langs[lang] = _Numbered(lang, self.words)
        return self.langs[lang]

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, list[tuple[str, bytes]]]]:
        """(numbers, how many of them are pointers, the (lang, word) of each number)."""
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode().lower().translate(_TABLE)    # bytes: A-Z alone
                at = 0
                while at < len(data):
                    end = at + BLOCK
                    gap = _GAP.search(data, end) if end < len(data) else None
                    end = gap.start() if gap else len(data)
                    words = data[at:end].replace(_END, b" " + _END + b" ").split()
                    self.buffer.extend(map(self.numbers(lang).__getitem__, words))
                    at = end
                    if len(self.buffer) >= POINTERS_AT_ONCE:
                        yield self._block(lang, DEPTH - 1 if at < len(data) else 0)
                self.buffer.append(-1)
        if self.buffer:
            yield self._block("", 0)

    def _block(self, lang: str, keep: int):
        numbers, known = np.array(self.buffer, np.int64), self.words
        tail = [None if n < 0 else known[n][1] for n in self.buffer[len(self.buffer) - keep:]] if keep else []
        self._reset()
        self.buffer = [-1 if w is None else self.numbers(lang)[w] for w in tail]
        return numbers, len(numbers) - len(tail), known


def _hashes(known: list[tuple[str, bytes]], seed: int) -> np.ndarray:
    """A 64-bit hash of each (language, word); never 0, which marks the end of a phrase."""
    found = np.array([xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word, seed) for lang, word in known], np.uint64)
    return np.maximum(found, np.uint64(1))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first.view(np.uint64) * np.uint64(3) + mix64(second.view(np.uint64)))


class Filter:
    """A Bloom filter of 64-bit keys of a fixed size."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def places(keys: np.ndarray) -> np.ndarray:
        low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
        return (low[:, None] + high[:, None] * np.arange(FILTER_HASHES, dtype=np.uint64)) & np.uint64(FILTER_BITS - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def build_filter(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray]) -> Filter:
    """The filter of ``keys`` of all rows; at most ``FILTER_BITS / 64`` words reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Filter.places(keys(batch)))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], ["word", "bits"])

    found = df.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(words)


def _column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.asarray(batch.column(i), np.int64).view(np.uint64)


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """``(lang, word, key, n)`` of every word of ``(lang, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, done, known in _Reader().blocks(batches):
            own = numbers[:done]
            counts = np.bincount(own[own >= 0], minlength=len(known))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in known], pa.string()), pa.array([word.decode() for _, word in known], pa.string()),
                 pa.array(_hashes(known, seed).view(np.int64)), pa.array(counts)], ["lang", "word", "key", "n"])

    return texts.mapInArrow(run, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def _grouped(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of an even number of columns of numbers from 0 to 2**31, sorted, and how often each occurs."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    pairs = [(a << 31) | b for a, b in zip(columns[::2], columns[1::2])]
    order = np.lexsort(pairs[::-1]) if len(pairs) > 1 else np.argsort(pairs[0])
    new = np.zeros(len(order), bool)
    new[0] = True
    for pair in pairs:
        own = pair[order]
        new[1:] |= own[1:] != own[:-1]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.diff(np.append(first, len(order)))


def _following(numbers: np.ndarray, done: int, depth: int) -> list[np.ndarray]:
    """For each pointer its word and the ``depth - 1`` next of its piece, as numbers from 1; 0 where it ends."""
    whole = np.append(numbers, np.full(depth, -1)) + 1
    out = [whole[:done]]
    for k in range(1, depth):
        out.append(np.where(out[-1] > 0, whole[k:k + done], 0))
    keep = out[min(1, depth - 1)] > 0                               # two words at least
    return [c[keep] for c in out]


def lead_counts(texts: DataFrame, frequent: Filter, seed: int) -> DataFrame:
    """``(k0, k1, n)`` of every pair of neighbours that are frequent words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, done, known in _Reader().blocks(batches):
            key = _hashes(known, seed)
            good = np.append(False, frequent.has(key))
            first, second = _following(numbers, done, 2)
            keep = good[first] & good[second]
            (first, second), n = _grouped([first[keep], second[keep]])
            key = np.append(np.uint64(0), key).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(key[second]), pa.array(n)], ["k0", "k1", "n"])

    return texts.mapInArrow(run, "k0 long, k1 long, n long").groupBy("k0", "k1").agg(F.sum("n").alias("n"))


def pointers(texts: DataFrame, leads: Filter, seed: int) -> DataFrame:
    """``(k0 .. , n)``: pointers with a frequent lead, cut before an infrequent pair, equal ones of a block as one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, done, known in _Reader().blocks(batches):
            key = np.append(np.uint64(0), _hashes(known, seed))
            columns = _following(numbers, done, DEPTH)
            good = np.ones(len(columns[0]), bool)
            for k in range(1, DEPTH):
                good &= columns[k] > 0
                at = np.flatnonzero(good)
                good[at] = leads.has(_pair(key[columns[k - 1][at]], key[columns[k][at]]))
                columns[k] = np.where(good, columns[k], 0)
                if k == 1:                                          # the lead itself
                    columns = [c[good] for c in columns]
                    good = good[good]
            columns, n = _grouped(columns)
            hashed = [pa.array(key[c].view(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([*hashed, pa.array(n)], [*KEYS, "n"])

    return texts.mapInArrow(run, ", ".join(f"{k} long" for k in KEYS) + ", n long")


def quicksort_counts(columns: list[np.ndarray], weight: np.ndarray, least: int, seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of rows to the full depth: ``(depth, a row of each phrase, its weight)``.

    Columns hold words, 0 after the last. All open partitions take a step together: pivot, three-way split by
    the word at the partition's depth, the equal part one word deeper. Parts lighter than ``least`` are dropped,
    so at most ``total / least`` partitions are open. Phrases have two words or more.
    """
    words, random = np.stack(columns) if len(weight) else np.zeros((len(columns), 0), np.int64), np.random.default_rng(seed)
    rows = np.arange(len(weight))
    sizes, depth = np.array([len(weight)]), np.zeros(1, np.int64)
    if weight.sum() < least:
        return
    while len(rows):
        part = np.repeat(np.arange(len(sizes)), sizes)
        start = np.cumsum(sizes) - sizes
        word = words[depth[part], rows]
        # the median of three random members
        draws = np.sort(word[start[:, None] + (random.random((len(sizes), 3)) * sizes[:, None]).astype(np.int64)], axis=1)
        pivot = draws[:, 1]
        side = (word > pivot[part]).astype(np.int8) - (word < pivot[part])
        kept = []
        for which in (-1, 0, 1):
            here = side == which
            own, of = rows[here], part[here]
            size = np.bincount(of, minlength=len(sizes))
            heavy = np.zeros(len(sizes), np.int64)
            np.add.at(heavy, of, weight[own])
            good = (size > 0) & (heavy >= least)
            deeper = depth + (which == 0)
            if which == 0:
                good &= pivot != 0                                  # the phrase has ended
                said = good & (deeper >= 2)
                first = np.cumsum(size) - size
                for d in np.unique(deeper[said]):
                    of_depth = said & (deeper == d)
                    yield int(d), own[first[of_depth]], heavy[of_depth]
                good &= deeper < len(words)
            kept.append((own[good[of]], size[good], deeper[good]))
        rows, sizes, depth = (np.concatenate(x) for x in zip(*kept))


def phrase_counts(routed: DataFrame, least: int) -> DataFrame:
    """``(k0 .., m, f)``: phrases of ``m`` words of the routed pointers ``(k0 .., n, split)``, least count and up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = [table.column(k).to_numpy().astype(np.int64) for k in KEYS]
        weight, split = table.column("n").to_numpy().astype(np.int64), table.column("split").to_numpy()
        for whole in (True, False):
            at = np.flatnonzero(split != whole)
            mine = [c[at] for c in columns]
            for depth, row, f in quicksort_counts(mine, weight[at], least if whole else 1):
                out = [pa.array(c[row] if k < depth else np.zeros(len(row), np.int64)) for k, c in enumerate(mine)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.full(len(row), depth, np.int32)), pa.array(f)], [*KEYS, "m", "f"])

    shares = routed.mapInArrow(run, ", ".join(f"{k} long" for k in KEYS) + ", m int, f long")
    return shares.groupBy(*KEYS, "m").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def counted_phrases(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All words ``(lang, word, key, n)`` and all phrases ``(k0 .., m, f)`` with at least ``least`` occurrences."""
    seed = 0
    while True:
        words = stage(word_counts(texts, seed), "words")
        clash = words.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > 1).limit(1).count()
        if not clash:
            break
        seed += 1                                                   # two words of one hash: take another
    frequent = build_filter(words.where(F.col("n") >= least).select("key"), lambda b: _column(b, 0))
    leads = lead_counts(texts, frequent, seed)
    leads = stage(leads.where(F.col("n") >= least), "leads")
    lead_filter = build_filter(leads.select("k0", "k1"), lambda b: _pair(_column(b, 0), _column(b, 1)))
    found = stage(pointers(texts, lead_filter, seed), "pointers")
    rows = found.count()
    partitions = max(1, -(-rows // ROWS_A_PARTITION), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a lead with more rows than an eighth of a mean partition is split by all its words
    crowded = found.groupBy("k0", "k1").agg(F.count("*").alias("c")).where(F.col("c") > max(64, rows // (8 * partitions)))
    split_filter = build_filter(crowded.select("k0", "k1"), lambda b: _pair(_column(b, 0), _column(b, 1)))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = split_filter.has(_pair(_column(batch, 0), _column(batch, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(split)], [*KEYS, "n", "split"])

    routed = found.mapInArrow(marked, ", ".join(f"{k} long" for k in KEYS) + ", n long, split boolean")
    rest = [F.when(F.col("split"), F.col(k)) for k in KEYS[2:]]
    return words, stage(phrase_counts(routed.repartition(partitions, F.xxhash64(*KEYS[:2], *rest)), least), "phrases")


def mine(df: DataFrame, least: int = LEAST, top: int = TOP, inside: int = 80, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of its lowest-scoring cut, ``n`` the words of
    the language. A phrase goes if a longer one that holds it has ``inside`` per cent of its count.
    """
    texts = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words, phrases = counted_phrases(texts, least)
    parts = F.array(*KEYS)
    zeros = F.array(*[F.lit(0).cast("long")] * DEPTH)

    def piece(start, length):
        """The key of some words of a phrase, filled up with zeros."""
        return F.slice(F.concat(F.slice("p", start, length), zeros), 1, DEPTH)

    def wide(c: str) -> Column:
        return F.col(c).cast("decimal(30,0)")

    spread = phrases.select(parts.alias("p"), "m", "f")
    counts = phrases.select(parts.alias("part"), "f").unionByName(
        words.where(F.col("n") >= least).select(F.slice(F.concat(F.array("key"), zeros), 1, DEPTH).alias("part"), F.col("n").alias("f")))
    counts = stage(counts, "phrase-parts")

    # phrases inside longer ones, by the heaviest of these
    spans = [(s, k) for k in range(2, DEPTH) for s in range(1, DEPTH - k + 2)]
    held = spread.where(F.col("m") > 2).select("f", F.explode(F.array(*[
        F.when(F.lit(s + k - 1) <= F.col("m"), F.when(F.lit(k) < F.col("m"), piece(s, k))) for s, k in spans])).alias("part"))
    longer = held.where(F.col("part").isNotNull()).groupBy("part").agg(F.max("f").alias("most"))
    rest = (spread.withColumn("part", F.col("p")).join(longer, "part", "left")
            .where(F.col("most").isNull() | (wide("most") * 100 < wide("f") * inside)).select("p", "m", "f"))

    # every cut with the counts of both parts
    cuts = rest.select("p", "m", "f", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("cut"))
    cuts = cuts.select("*", piece(F.lit(1), F.col("cut")).alias("lp"), piece(F.col("cut") + 1, F.col("m") - F.col("cut")).alias("rp"))
    cuts = (cuts.join(counts.select(F.col("part").alias("lp"), F.col("f").alias("l")), "lp")
            .join(counts.select(F.col("part").alias("rp"), F.col("f").alias("r")), "rp"))
    score = F.expr("(2000000 * cast(f as decimal(30,0))) div (cast(l as decimal(30,0)) + cast(r as decimal(30,0)))")
    best = (cuts.select("p", "m", "f", "cut", "l", "r", score.alias("score")).groupBy("p", "m", "f")
            .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")))
    best = stage(best.select("p", F.col("f").alias("a"), "best.l", "best.r", "best.score"), "scored")

    # words in place of their hashes
    placed = best.select("p", F.posexplode("p").alias("place", "key")).where(F.col("key") != 0)
    spelled = (placed.join(words.select("key", "lang", "word"), "key").groupBy("p")
               .agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
               .select("p", "lang", F.concat_ws(" ", F.transform("w", lambda x: x["word"])).alias("phrase")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    named = best.join(spelled, "p").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = (named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top))
    return few.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
