"""N-gram Jaccard join with set-relation skipping.

Documents become sets of word shingles; equal sets are one class from the start (the nearest relation two
sets can have: their answers are the same). Then:

1. *Index.* Shingles are ordered by how many texts hold them, in powers of two, the rarest first. The counts
   are of all texts, of the share of the hash space that prefixes are taken from; those from ``LEAST_COUNT``
   on reach the tasks as a table of ``PLACES`` bytes, which takes the ``RANKED`` most frequent shingles (in a
   larger corpus only more frequent ones). They only shape the order, any order gives the same links. Two sets
   at the threshold share one of the first ``n - ceil(0.8 n) + 1`` shingles of each. An index list holds the
   sets of one such shingle with their size and the shingle's position. It is read in blocks of ``LIST_BLOCK``
   entries sorted by size; a block whose least position already leaves too few shingles behind is skipped whole.
2. *Candidates.* Short lists give pairs. The sets of a long list (a shingle counted ``HOT`` times, spread over
   salted keys, or a list that grows past ``LONG_LIST``) meet with their parity bits, and give edges that join
   those whose bits leave room for a link; so do the pairs. The components of these edges are groups of related
   sets; sets in different groups cannot link. A shingle alone relates no sets, so groups do not grow together
   with the corpus.
3. *Answers.* Each group's sets meet in one task, in blocks of bounded weight (all pairs of blocks for a
   larger group). One set's overlaps with the block are counted from the block's lists; a highly similar
   set's overlaps are derived from these by the few shingles in which the two differ. Links are decided
   exactly, and those that first join two parts leave the task.
4. The components of the links, by stars, are the result.

Set identities are 64-bit hashes of the whole set, classes compare 128 bits and the size.

Defined results: null, empty and blank texts have no shingles and link with nothing. Repeated rows are
equal sets and are told apart by id and text, so an id may have several texts; each set is fetched from one of
its rows, once a task. Rows with a null id take no part and keep a null component. Very long texts are read
whole. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stage
from .components import components
from .shingles import shingle_set, signature

WORDS, RANKED, PLACES, LEAST_COUNT, HOT, SALTS, CHUNK = 5, 1 << 21, 1 << 24, 8, 64, 16, 4_000_000
LIST_BLOCK, LONG_LIST, BLOCK_SETS, BLOCK_SHINGLES = 16, 64, 2048, 400_000


def enough(overlap, size_a, size_b, percent: int):
    """``100 * overlap >= percent * union``, in whole numbers."""
    return (100 + percent) * overlap >= percent * (size_a + size_b)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parity(shingles: np.ndarray) -> bytes:
    """A bit per place that is set where an odd number of shingles fall; as many places as shingles, or more.

    Two sets differ in at least as many shingles as their bits differ.
    """
    size = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def may_link(bits_a: bytes, bits_b: bytes, size_a: int, size_b: int, percent: int) -> bool:
    """Whether the parity bits leave room for a link; the longer ones are folded to the shorter's length."""
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8)) for x in (bits_a, bits_b))
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, size), axis=0) for x in (a, b))
    return bool(enough((size_a + size_b - int((a ^ b).sum())) // 2, size_a, size_b, percent))


def counted_below(percent: int) -> np.uint64:
    """Shingles below this hash are counted: half as many again as a prefix takes."""
    return np.uint64(min((1 << 64) - 1, (150 - 3 * percent // 2) * (1 << 64) // 100))


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of 44-bit shingle keys in the table of levels."""
    mask = np.uint64(PLACES - 1)
    return (keys & mask).astype(np.int64), (mix64(keys) & mask).astype(np.int64)


def levels(table: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Powers of two of the shingles' counts, 0 for rare ones; a few rare ones pass for frequent."""
    a, b = _places(shingles >> np.uint64(20))
    return np.minimum(table[a], table[b])


def _profiles(percent: int):
    """A row per document (size, signature, parity), and packed counts of shingles: 12 bits of the key, 32 bits of each."""
    names, below = ["id", "th", "n", "s1", "s2", "bits", "bucket", "tokens", "counts"], counted_below(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0

        def counted():
            keys, times = np.unique(np.concatenate(seen) >> np.uint64(20), return_counts=True)
            seen.clear()
            bucket = (keys >> np.uint64(32)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            first = bucket[np.concatenate([[0], cuts])]
            own = [x.tobytes() for x in np.split(keys.astype(np.uint32), cuts)]
            many = [x.tobytes() for x in np.split(np.minimum(times, 65535).astype(np.uint16), cuts)]
            none = pa.nulls(len(first), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(len(first), pa.binary()), pa.array(first, pa.int32()),
                                               pa.array(own, pa.binary()), pa.array(many, pa.binary())], names)

        for batch in batches:
            n, s1, s2, bits = [], [], [], []
            ids, hashes = batch.column(0), batch.column(2)
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), WORDS)
                n.append(len(shingles))
                a, b = signature(shingles)
                s1.append(a)
                s2.append(b)
                bits.append(parity(shingles))
                seen.append(shingles[:np.searchsorted(shingles, below)])
                held += len(seen[-1])
                if held > CHUNK:
                    yield counted()
                    held = 0
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), hashes, *(pa.array(c, pa.int64()) for c in (n, s1, s2)),
                                               pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), none, none], names)
        if held:
            yield counted()
    return run


def _ranked(group: pd.DataFrame) -> pd.DataFrame:
    """The shingles of a bucket that are counted often, by the power of two of their counts."""
    tokens, at = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in group["tokens"]]), return_inverse=True)
    count = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint16) for x in group["counts"]]))
    level = np.where(count >= LEAST_COUNT, np.frexp(count)[1] - 1, 0)
    out = [(int(group["bucket"].iloc[0]), int(x), int((level == x).sum()), tokens[level == x].tobytes()) for x in np.unique(level[level > 0])]
    return pd.DataFrame(out, columns=["bucket", "level", "n", "tokens"])


def _table(profiles: DataFrame) -> np.ndarray:
    """Levels of the frequent shingles by place; ``RANKED`` of them reach the driver at most."""
    ranked = stage(profiles.where("bucket is not null").select("bucket", "tokens", "counts").groupBy("bucket")
                   .applyInPandas(_ranked, "bucket int, level int, n long, tokens binary"), "ranked")
    sizes = {r["level"]: r["n"] for r in ranked.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    table, least, held = np.zeros(PLACES, np.uint8), max(sizes, default=0) + 1, 0
    for level in sorted(sizes, reverse=True):
        held += sizes[level]
        if held > RANKED:
            break
        least = level
    for r in ranked.where(F.col("level") >= least).select("bucket", "level", "tokens").collect():
        for at in _places((np.uint64(r["bucket"]) << np.uint64(32)) | np.frombuffer(r["tokens"], np.uint32).astype(np.uint64)):
            table[at] = np.maximum(table[at], r["level"])
    return table


def _prefixes(table: np.ndarray, percent: int):
    """Index entries of each distinct set of a batch: shingle, salt, set, size, position."""
    below, hot = counted_below(percent), HOT.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, known = [], 0, set()

            def flush():
                cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3].astype(np.int32)),
                                                   pa.array(cols[4].astype(np.int32))], ["token", "salt", "s", "size", "pos"])

            for text in batch.column(0):
                shingles = shingle_set(text.as_py(), WORDS)
                n = len(shingles)
                if not n:
                    continue
                s, _ = signature(shingles)
                if s in known:
                    continue
                known.add(s)
                inside = int(np.searchsorted(shingles, below))
                level = np.zeros(n, np.uint8)                             # those that were not counted come last
                level[:inside] = levels(table, shingles[:inside])
                order = np.concatenate([np.argsort(level[:inside], kind="stable"), np.arange(inside, n)])[:prefix_size(n, percent)]
                salt = np.where(level[order] >= hot, 1 + s % SALTS, 0)
                out.append((shingles[order].view(np.int64), salt, np.full(len(order), s), np.full(len(order), n), np.arange(len(order))))
                held += len(order)
                if held > 500_000:
                    yield flush()
                    held = 0
            yield flush()
    return run


def list_pairs(sets: np.ndarray, sizes: np.ndarray, positions: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of a list sorted by size that length and position allow, skipping whole blocks."""
    found, n = [], len(sets)
    first = range(0, n, LIST_BLOCK)
    least = [int(positions[b:b + LIST_BLOCK].min()) for b in first]
    biggest = [int(sizes[min(n, b + LIST_BLOCK) - 1]) for b in first]
    for x in range(1, n):
        size, left = int(sizes[x]), int(sizes[x] - positions[x])
        for k, b in enumerate(first):
            if b >= x:
                break
            if 100 * biggest[k] < percent * size:
                continue                                                # all too short
            smallest = max(int(sizes[b]), -(-percent * size // 100))
            if not enough(min(left, biggest[k] - least[k]), size, smallest, percent):
                continue                                                # too few shingles behind any position
            y = np.arange(b, min(b + LIST_BLOCK, x))
            ok = (100 * sizes[y] >= percent * size) & enough(np.minimum(left, sizes[y] - positions[y]), size, sizes[y], percent)
            found += [(int(sets[x]), int(sets[i])) for i in y[ok & (sets[y] != sets[x])]]
    return found


def _edges(percent: int):
    """Candidate pairs of short index lists that arrive sorted by shingle and size, and the entries (set, shingle) of long ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, long = None, None               # the last, unfinished list; the shingle of a long one

        def solve(cols: list[np.ndarray]) -> tuple[tuple[list, list], tuple[list, list]]:
            token, _, s, size, pos = cols
            a, b, member, of = [], [], [], []
            cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
            lengths = np.diff(cuts)
            two = cuts[:-1][lengths == 2]
            if len(two):
                i, j = two, two + 1
                ok = ((100 * size[i] >= percent * size[j]) & (s[i] != s[j])
                      & enough(np.minimum(size[i] - pos[i], size[j] - pos[j]), size[i], size[j], percent))
                a += s[i][ok].tolist()
                b += s[j][ok].tolist()
            for k in np.flatnonzero(lengths > 2):
                u, v = cuts[k], cuts[k + 1]
                if v - u > LONG_LIST:
                    member += s[u:v].tolist()
                    of += [int(token[u])] * int(v - u)
                else:
                    for x, y in list_pairs(s[u:v], size[u:v], pos[u:v], percent):
                        a.append(x)
                        b.append(y)
            return (a, b), (member, of)

        def out(a, b, pair=False):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([pair] * len(a), pa.bool_())],
                                              ["a", "b", "pair"])

        def solved(cols):
            for pair, found in zip((True, False), solve(cols)):
                yield out(*found, pair)

        for batch in batches:
            cols = [np.asarray(batch.column(k)).astype(np.int64) for k in range(5)]
            salted = cols[1] > 0
            if salted.any():
                yield out(cols[2][salted], cols[0][salted])
                cols = [c[~salted] for c in cols]
            if carry is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(carry, cols)]
            if not len(cols[0]):
                continue
            if long is not None:                                          # rows of a long list that goes on
                same = cols[0] == long
                yield out(cols[2][same], cols[0][same])
                cols = [c[~same] for c in cols]
                if len(cols[0]):
                    long = None
            carry = None
            if len(cols[0]):
                last = int(np.searchsorted(cols[0], cols[0][-1])) if (np.diff(cols[0]) >= 0).all() else int(np.flatnonzero(cols[0] != cols[0][-1])[-1] + 1)
                yield from solved([c[:last] for c in cols])
                carry = [c[last:] for c in cols]
                if len(carry[0]) > LONG_LIST:
                    long = int(carry[0][0])
                    yield out(carry[2], carry[0])
                    carry = None
        if carry is not None and len(carry[0]):
            yield from solved(carry)
    return run


def near_sets(ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Edges that join the sets of a list, sorted by size, whose parities leave room for a link.

    A set is compared with the whole list unless it lies in the largest part, so two sets of different parts
    were compared; copies of one text take one round.
    """
    n = len(ids)
    part, left, found = np.arange(n), np.ones(n, bool), []
    width = np.array([len(x) for x in bits])
    heads = np.concatenate([[0], np.flatnonzero(np.diff(width)) + 1, [n]])                # wider bits belong to larger sets
    rows = [np.frombuffer(b"".join(bits[u:v]), np.uint8).reshape(v - u, -1) for u, v in zip(heads[:-1], heads[1:])]

    def folded(x: np.ndarray, size: int) -> np.ndarray:
        return np.bitwise_xor.reduce(x.reshape(len(x), -1, size), axis=1)
    while True:
        todo = np.flatnonzero(left & (part != np.bincount(part).argmax()))
        if not len(todo):
            return found
        x = int(todo[0])
        left[x] = False
        own = np.frombuffer(bits[x], np.uint8)[None, :]
        lo, hi = np.searchsorted(100 * sizes, percent * sizes[x]), np.searchsorted(percent * sizes, 100 * sizes[x], "right")
        odd = np.zeros(hi - lo, np.int64)
        for u, v, some in zip(heads[:-1], heads[1:], rows):
            a, b = max(u, lo), min(v, hi)
            if a < b:
                size = min(some.shape[1], own.shape[1])
                odd[a - lo:b - lo] = np.bitwise_count(folded(some[a - u:b - u], size) ^ folded(own, size)).sum(axis=1, dtype=np.int64)
        y = lo + np.flatnonzero(enough((sizes[lo:hi] + sizes[x] - odd) // 2, sizes[lo:hi], sizes[x], percent) & (part[lo:hi] != part[x]))
        others, first = np.unique(part[y], return_index=True)
        if len(others):
            found += [(int(ids[x]), int(ids[i])) for i in y[first]]
            part[np.isin(part, others)] = part[x]


def _near(percent: int):
    """Edges between sets of long lists that arrive sorted by shingle and size; holds one list at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            ids, sizes = (np.asarray(rows.column(k)).astype(np.int64) for k in (1, 2))
            found = near_sets(ids, sizes, rows.column(3).to_pylist(), percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        last, held = None, []
        for batch in batches:
            token = np.asarray(batch.column(0))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1, [len(token)]]).tolist()
            for u, v in zip(cuts[:-1], cuts[1:]):
                if u == v:
                    continue
                if held and token[u] != last:
                    yield solved(held)
                    held = []
                last = token[u]
                held.append(batch.slice(u, v - u))
        if held:
            yield solved(held)
    return run


def block_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join a block's sets into their parts, from exact overlaps of all of them."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    part, found = np.arange(n), []
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = times[token] > 1
    token, owner = token[shared], owner[shared]
    by_token = np.argsort(token, kind="stable")
    lists, heads = owner[by_token], np.searchsorted(token[by_token], np.arange(len(times) + 1))
    rows = np.searchsorted(owner, np.arange(n + 1))

    def counts(tokens: np.ndarray) -> np.ndarray:
        """In how many of the tokens' lists each set stands."""
        if not len(tokens):
            return np.zeros(n, np.int64)
        size = heads[tokens + 1] - heads[tokens]
        ends = np.cumsum(size)
        at = np.repeat(heads[tokens] - (ends - size), size) + np.arange(ends[-1])
        return np.bincount(lists[at], minlength=n)

    leader, base = -1, np.zeros(n, np.int64)
    for x in np.argsort(sizes, kind="stable").tolist():
        if (part == part[x]).all():
            break                                                        # the whole block is one part
        own = token[rows[x]:rows[x + 1]]
        if leader >= 0 and 4 * base[x] > 3 * max(len(own), rows[leader + 1] - rows[leader]):
            theirs = token[rows[leader]:rows[leader + 1]]
            overlap = base + counts(np.setdiff1d(own, theirs)) - counts(np.setdiff1d(theirs, own))
        else:
            leader, base = x, counts(own)
            overlap = base
        hits = np.flatnonzero(enough(overlap, sizes[x], sizes, percent) & (part != part[x]))
        for other in np.unique(part[hits]):
            y = hits[part[hits] == other][0]
            found.append((ids[x], ids[y]))
            part[part == other] = part[x]
    return found


def _plausible(percent: int):
    """Candidate pairs whose parities leave room for a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xa, xb = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [i for i in range(batch.num_rows) if may_link(xa[i], xb[i], na[i], nb[i], percent)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])
    return run


def _solve(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby("component"):
            part = part.drop_duplicates("s")
            if len(part) > 1:
                out += block_links(part["s"].tolist(), [np.frombuffer(x, np.uint64) for x in part["shingles"]], percent)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of related sets, each once a task."""
    known: set[int] = set()
    for batch in batches:
        rows, ids, sets = [], [], []
        for i, text in enumerate(batch.column(0)):
            own = shingle_set(text.as_py(), WORDS)
            s = signature(own)[0]
            if s not in known:
                known.add(s)
                rows.append(i)
                ids.append(s)
                sets.append(own.tobytes())
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(1).take(at), batch.column(2).take(at), pa.array(sets, pa.binary())],
                                         ["s", "component", "blocks", "shingles"])


def text_hash(text: str = "text"):
    """By what rows of one id are told apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def jaccard_components(df: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """``(key, n_shingles, component_id)`` of every row; links are ``100 * |A n B| >= percent * |A u B|``.

    ``groups=True`` adds ``text_hash`` and ``group_id``, which tells components apart where rows of one id lie
    in several; it is null for rows that take no part.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), text_hash(text).alias("th"))
    profiles = stage(docs.mapInArrow(_profiles(percent), "id long, th long, n long, s1 long, s2 long, bits binary, bucket int, tokens binary, counts binary"), "profiles")
    rows = profiles.where("n is not null").select("id", "th", "n", "s1", "s2")
    classes = stage(profiles.where("n is not null").where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "th")).alias("row"), F.min("bits").alias("bits"))
                    .select("n", "s1", "s2", F.col("row.id").alias("first"), F.col("row.th").alias("th"), "bits"), "classes")

    entries = docs.where("id is not null").select("text").mapInArrow(
        _prefixes(_table(profiles), percent), "token long, salt int, s long, size int, pos int")
    weight = classes.agg(F.sum("n").alias("w")).first()["w"] or 0
    lists = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / 5_000_000))
    candidates = (entries.repartition(lists, "token", "salt").sortWithinPartitions("token", "salt", "size", "s")
                  .mapInArrow(_edges(percent), "a long, b long, pair boolean").distinct())
    candidates = stage(candidates, "candidates")
    of = {x: classes.select(F.col("s1").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"x{x}")) for x in "ab"}
    pairs = (candidates.where("pair").select("a", "b").join(of["a"], "a").join(of["b"], "b").select("a", "b", "na", "nb", "xa", "xb")
             .mapInArrow(_plausible(percent), "a long, b long"))
    lists_of = candidates.where("not pair").select("a", F.col("b").alias("token")).join(of["a"], "a").select("token", "a", "na", "xa")
    near = (lists_of.repartition(lists, "token").sortWithinPartitions("token", "na", "a")
            .mapInArrow(_near(percent), "a long, b long"))
    related = components(near.unionByName(pairs))

    # one row of each related set, found again by its id and text
    member = classes.select(F.col("s1").alias("id"), "n", F.xxhash64("first", "th").alias("row")).join(related, "id")
    heavy = member.groupBy("component").agg(F.sum("n").alias("weight"), F.count("*").alias("sets")).where("sets > 1")
    member = member.join(heavy, "component").withColumn("blocks", F.greatest(
        F.ceil(F.col("weight") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS)).cast("long"))
    member = stage(member.withColumnRenamed("id", "s"), "related-sets")
    total = max(1, math.ceil((member.agg(F.sum("n").alias("w")).first()["w"] or 0) / BLOCK_SHINGLES))
    wanted = member.select("row", "component", "blocks")
    sets = (docs.select("text", F.xxhash64("id", "th").alias("row")).join(wanted, "row").select("text", "component", "blocks")
            .mapInArrow(_sets, "s long, component long, blocks long, shingles binary"))
    own = F.pmod(F.xxhash64("s"), F.col("blocks"))
    other = F.explode(F.expr("transform(sequence(0L, blocks - 1), x -> x)")).alias("other")
    placed = (sets
              .select("component", "s", "shingles", "blocks", own.alias("own"), other)
              .where("blocks = 1 or own != other")
              .select("component", "s", "shingles",
                      F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(total))).otherwise(F.col("component")).alias("g"),
                      F.when(F.col("blocks") == 1, F.lit(-1)).otherwise(F.least("own", "other")).alias("i"), F.greatest("own", "other").alias("j")))
    placed = placed.withColumn("j", F.when(F.col("i") < 0, F.lit(-1)).otherwise(F.col("j")))
    links = placed.groupBy("g", "i", "j").applyInPandas(_solve(percent), "a long, b long")
    linked = components(links)

    named = classes.join(linked.withColumnRenamed("id", "s1"), "s1", "left")
    smallest = (named.where("component is not null").groupBy("component").agg(F.min("first").alias("least")))
    named = (named.join(smallest, "component", "left")
             .select("n", "s1", "s2", F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "s1").alias("group_id")))
    named = stage(named, "set-components")
    full = rows.where("n > 0 and id is not null").join(named, ["n", "s1", "s2"]).select("id", "th", "n", "component_id", "group_id")
    rest = rows.where("n = 0 or id is null").select("id", "th", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group_id"))
    more = [F.col("th").alias("text_hash"), F.col("group_id")] if groups else []
    return full.unionByName(rest).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", *more)
