"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece (one match of the splitting pattern) starts as single bytes. Leaf ``i`` of the tree holds the rank
of the pair that starts at live position ``i`` and its right neighbour, together with ``i``; inner nodes hold
the minimum, so the root is the leftmost pair of least rank. A merge changes three leaves (the merged node,
the one it swallowed, its left neighbour), each a point update up one path.

Most pieces are short, so trees of one size are kept as rows of an array and all of them take their next
merge together; a piece longer than ``LONG`` bytes gets a tree of its own. Each distinct piece of a batch is
encoded once, and a bounded memory of encoded pieces (``REMEMBERED``) serves later batches of the task.

The driver reads the vocabulary (its size is fixed) and ships it with the task's code.

Defined results: a null or empty text has no ids and decodes to no bytes; lone surrogates cannot occur in
Spark strings. Repeated rows give equal results. Very long texts are encoded whole, a piece at a time. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, REMEMBERED, CHARS_AT_ONCE = 128, 600_000, 1_500_000
_NONE = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """Token bytes by id, and which adjacent ids may merge, with what rank and into which id."""
    tokens: list[bytes]
    pairs: np.ndarray                     # left * size + right, sorted
    ranks: np.ndarray
    merged: np.ndarray
    whole: bool                           # a piece that is itself a token is that token
    _cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.size = len(self.tokens)
        self.by_bytes = {t: i for i, t in enumerate(self.tokens)}
        self.first = np.array([self.by_bytes[bytes([b])] for b in range(256)], np.int64)
        self.into = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int64)
        self.into[self.ranks] = self.merged
        self.byte_rank = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, ``_NONE`` where it may not merge."""
        if not len(self.pairs):
            return np.full(len(left), _NONE)
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.ranks[at], _NONE)


def _vocabulary(tokens: list[bytes], merges: list[tuple[int, int, int, int]], whole: bool) -> Vocabulary:
    table = np.array(merges, np.int64).reshape(-1, 4)
    keys = table[:, 0] * len(tokens) + table[:, 1]
    order = np.argsort(keys)
    return Vocabulary(tokens, keys[order], table[order, 2], table[order, 3], whole)


def from_ranks(path: str) -> Vocabulary:
    """A rank file (base64 token, rank): two ids may merge if their bytes together are a token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    merges = [(ranks[t[:k]], ranks[t[k:]], rank, rank) for t, rank in ranks.items() for k in range(1, len(t))
              if t[:k] in ranks and t[k:] in ranks]
    return _vocabulary(tokens, merges, whole=True)


def from_merges(path: str) -> Vocabulary:
    """A JSON file of byte-level merges: only the listed pairs merge, in the listed order."""
    with open(path, encoding="utf-8") as file:
        return from_model(json.load(file)["model"])


def from_model(model: dict) -> Vocabulary:
    """The same from the file's ``model``."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]     # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        if all(c in byte_of for c in word):
            tokens[i] = bytes(byte_of[c] for c in word)
    merges = []
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[a], vocab[b], rank, vocab[a + b]))
    return _vocabulary(tokens, merges, whole=bool(model.get("ignore_merges")))


def _merge_rows(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """Packed ids of pieces of at most ``width`` bytes, ``width`` a power of two; one tree a row."""
    rows = len(pieces)
    data = np.zeros((rows, width), np.uint8)
    size = np.array([len(p) for p in pieces])
    inside = np.arange(width) < size[:, None]
    data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = vocab.first[data]
    nxt = np.tile(np.arange(1, width + 1), (rows, 1))
    nxt[nxt >= size[:, None]] = width
    prv = np.tile(np.arange(-1, width - 1), (rows, 1))
    live = inside.copy()
    tree = np.full((rows, 2 * width), _NONE)
    rank = vocab.byte_rank[data[:, :-1], data[:, 1:]]
    here = np.arange(width)
    can = inside[:, 1:] & (rank < _NONE)
    tree[:, width:2 * width - 1] = np.where(can, np.where(can, rank, 0) * width + here[:-1], _NONE)
    level = width
    while level > 1:
        level //= 2
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])

    def put(r: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        node = leaf + width
        tree[r, node] = key
        while node[0] > 1:
            node = node >> 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    def key_of(left: np.ndarray, right: np.ndarray, leaf: np.ndarray, there: np.ndarray) -> np.ndarray:
        found = vocab.rank(left, right)
        ok = there & (found < _NONE)
        return np.where(ok, np.where(ok, found, 0) * width + leaf, _NONE)

    r = np.flatnonzero(tree[:, 1] < _NONE)
    while len(r):
        key = tree[r, 1]
        left = key % width
        right = nxt[r, left]
        after = nxt[r, right]
        ids[r, left] = vocab.into[key // width]
        live[r, right] = False
        nxt[r, left] = after
        inner = after < width
        prv[r[inner], after[inner]] = left[inner]
        put(r, right, np.full(len(r), _NONE))
        put(r, left, key_of(ids[r, left], ids[r, np.minimum(after, width - 1)], left, inner))
        before = prv[r, left]
        has = before >= 0
        if has.any():
            rb, lb = r[has], before[has]
            put(rb, lb, key_of(ids[rb, lb], ids[rb, left[has]], lb, np.ones(len(rb), bool)))
        r = r[tree[r, 1] < _NONE]
    counts = live.sum(1)
    packed = ids[live].astype("<u4").tobytes()
    ends = np.cumsum(counts) * 4
    return [packed[e - 4 * c:e] for e, c in zip(ends.tolist(), counts.tolist())]


def merges_give_tokens(vocab: Vocabulary, ids: Iterable[int]) -> bool:
    """Whether the bytes of each token merge to that token, which makes looking whole pieces up right."""
    by_width: dict[int, list[int]] = {}
    for i in ids:
        if len(vocab.tokens[i]) > 1:
            by_width.setdefault(1 << (len(vocab.tokens[i]) - 1).bit_length(), []).append(i)
    return all(_merge_rows(vocab, [vocab.tokens[i] for i in own], width) == [i.to_bytes(4, "little") for i in own]
               for width, own in by_width.items())


def _merge_long(vocab: Vocabulary, piece: bytes) -> bytes:
    """The same for one long piece, on lists."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = (1 << 62, 0)
    data = np.frombuffer(piece, np.uint8)
    ids, nxt, prv = vocab.first[data].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    start = vocab.byte_rank[data[:-1], data[1:]].tolist()
    for i, rank in enumerate(start):
        if rank != _NONE:
            tree[width + i] = (rank, i)
    for at in range(width - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    table = vocab._cache
    if not table:
        table.update(zip(vocab.pairs.tolist(), vocab.ranks.tolist()))

    def put(leaf: int, value: tuple[int, int]) -> None:
        at = leaf + width
        tree[at] = value
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def pair(leaf: int) -> tuple[int, int]:
        if leaf < 0 or nxt[leaf] >= n:
            return none
        rank = table.get(ids[leaf] * vocab.size + ids[nxt[leaf]])
        return none if rank is None else (rank, leaf)

    while tree[1] < none:
        rank, left = tree[1]
        right = nxt[left]
        ids[left], nxt[left] = int(vocab.into[rank]), nxt[right]
        if nxt[left] < n:
            prv[nxt[left]] = left
        put(right, none)
        put(left, pair(left))
        if prv[left] >= 0:
            put(prv[left], pair(prv[left]))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = nxt[at]
    return np.array(out, "<u4").tobytes()


def encode_pieces(vocab: Vocabulary, pieces: Iterable[str]) -> dict[str, bytes]:
    """Packed little-endian 32-bit ids of distinct pieces."""
    out: dict[str, bytes] = {}
    by_width: dict[int, list[tuple[str, bytes]]] = {}
    for piece in pieces:
        data = piece.encode("utf-8")
        known = vocab.by_bytes.get(data) if vocab.whole or len(data) == 1 else None
        if known is not None:
            out[piece] = known.to_bytes(4, "little")
        elif len(data) > LONG:
            out[piece] = _merge_long(vocab, data)
        elif data:
            by_width.setdefault(max(2, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
    for width, group in by_width.items():
        step = max(1, (1 << 20) // width)
        for at in range(0, len(group), step):
            part = group[at:at + step]
            out.update(zip((p for p, _ in part), _merge_rows(vocab, [d for _, d in part], width)))
    return out


def encode_texts(vocab: Vocabulary, pattern: str, texts: Iterable[str | None],
                 memory: dict[str, bytes] | None = None) -> Iterator[bytes]:
    """Packed ids of each whole text, in order."""
    split, memory = regex.compile(pattern).findall, {} if memory is None else memory
    held: list[list[str]] = []
    chars = 0

    def flush() -> Iterator[bytes]:
        new = [p for p in {p for pieces in held for p in pieces} if p not in memory]
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            new = {p for pieces in held for p in pieces}
        memory.update(encode_pieces(vocab, new))
        for pieces in held:
            yield b"".join(map(memory.__getitem__, pieces))
        held.clear()

    for text in texts:
        held.append(split(text or ""))
        chars += len(text or "")
        if chars > CHARS_AT_ONCE:
            yield from flush()
            chars = 0
    yield from flush()


def decode(vocab: Vocabulary, packed: bytes) -> bytes:
    """The bytes that packed ids stand for."""
    ids = np.frombuffer(packed, "<u4").astype(np.int64)
    lengths = vocab.lengths[ids]
    ends = np.cumsum(lengths)
    if not len(ids):
        return b""
    at = np.repeat(vocab.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
    return vocab.blob[at].tobytes()


def token_ids(df: DataFrame, vocab: Vocabulary, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)`` of every row: the whole text's ids as an array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, bytes] = {}
        for batch in batches:
            done = [np.frombuffer(x, "<u4").astype(np.int32) for x in
                    encode_texts(vocab, pattern, batch.column(1).to_pylist(), memory)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(pa.int32()))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key))


def digests(df: DataFrame, vocab: Vocabulary, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every row; ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, bytes] = {}
        for batch in batches:
            n, ids, back = [], [], []
            for packed in encode_texts(vocab, pattern, batch.column(1).to_pylist(), memory):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(decode(vocab, packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(back, pa.string())],
                                             ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return (df.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("key", key))
