"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``STRIDE + OVERLAP`` characters is encoded in one piece. A longer one is cut every ``STRIDE``
characters into chunks that overlap by ``OVERLAP``; the chunks become rows, are dealt over all tasks and are
encoded with offsets on their own. Two neighbours are spliced at the first place of their overlap that both
encodings start a word at and that is proven to be a boundary of the whole text's encoding:

* JSON files (``tokenizers``): the splitting pattern looks at no character before a match, so two runs that
  both start a match at one place agree from there on. The left chunk is right up to ``guard`` characters
  before its end (the longest special string, and what a pattern may look ahead); by induction over the chunks
  its word starts are the whole text's. Where the file normalises, the place must also follow white space and
  hold a character that no normal form joins to its predecessor.
* Models (``sentencepiece``): no piece of the vocabulary holds a space mark after another character, so no
  merge crosses a place where a space follows a visible ASCII character.

Texts whose code points lie below ``PLAIN`` are counted by a compiled encoder of the same merges where the file
is plain byte-level BPE (``plain_tables``): all classes of the splitting pattern agree there (tested for each
code point), and the driver checks that the bytes of every token merge to that token. Other texts, other files
and all chunks go through the library itself.

A tokenizer without such a proof (unknown normalisers, patterns that look behind, special strings that take
white space with them) is never cut. Where an overlap holds no common boundary (a word of thousands of
characters), stride and overlap of that document grow by ``WIDEN`` and it is tried again, until the text is
one chunk; nothing is estimated. Chunks report boundaries and counts only, so a document of any length meets
in sums of numbers, one row per seam.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each, whatever
their key; a null key stays null. Very long texts are cut as above. Extra columns are ignored, whatever their
names. An empty table gives an empty result. Special strings inside a text count as the library's default
reads them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import stage, worker_cache

STRIDE, OVERLAP, WIDEN, CHARS_AT_ONCE = 32_768, 1_024, 4, 400_000
#: First code point that is left to the library, and the library's own splitting pattern (fixed value).
PLAIN = 0x250
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
#: Chunks a task encodes, while there are fewer than ``MOST_TASKS`` tasks' worth.
CHUNKS_A_TASK, MOST_TASKS = 32, 20_000

#: Places where a chunk's encoding starts a word: (offset, tokens before it), and all its tokens. The encoders'
#: ``spans`` need only tell those up to character ``head`` and from character ``tail`` on.
Spans = tuple[list[tuple[int, int]], int]


class JsonEncoder:
    """The ``tokenizers`` library on one JSON file. Offsets are characters."""

    def __init__(self, content: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"              # a task has one core
        from tokenizers import Tokenizer
        config = json.loads(content)
        config |= {"post_processor": None, "truncation": None, "padding": None}
        self._tokenizer = Tokenizer.from_str(json.dumps(config))
        self.normalised = config.get("normalizer") is not None
        self.can_cut = json_can_cut(config)
        self.guard = 8 + max((len(t["content"]) for t in config.get("added_tokens", [])), default=0)
        self._plain = None
        if plain:
            import tiktoken
            ranks, special = plain_tables(config)
            self._plain = tiktoken.Encoding("plain", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    def size(self, text: str) -> int:
        return len(text)

    def counts(self, texts: list[str]) -> list[int]:
        rest = texts if self._plain is None else [t for t in texts if _BEYOND.search(t)]
        others = iter(self._tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        if self._plain is None:
            return [len(e) for e in others]
        return [len(next(others)) if _BEYOND.search(t) else len(self._plain.encode_to_numpy(t, allowed_special="all")) for t in texts]

    def spans(self, text: str, head: int, tail: int) -> Spans:
        found = self._tokenizer.encode(text, add_special_tokens=False)
        total, starts = len(found), []

        def walk(i: int, until: int) -> None:
            last = found.token_to_word(i - 1) if i else None
            while i < total and (at := found.token_to_chars(i)[0]) <= until:
                word = found.token_to_word(i)
                if word != last and self._stable(text, at):
                    starts.append((at, i))
                last, i = word, i + 1

        walk(0, min(head, tail - 1))
        # the first token at or after the tail's start; white space may belong to none
        first = next((i for p in range(tail, len(text)) if (i := found.char_to_token(p)) is not None), total)
        walk(first, len(text))
        return starts, total

    def _stable(self, text: str, at: int) -> bool:
        return not self.normalised or (at > 0 and text[at - 1].isspace() and not text[at].isspace() and text[at] < "̀")


class ModelEncoder:
    """The ``sentencepiece`` library on one model. Offsets are UTF-8 bytes."""

    guard = 4

    def __init__(self, content: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        self._model = SentencePieceProcessor(model_proto=content)
        pieces = (self._model.id_to_piece(i) for i in range(self._model.get_piece_size()))
        self.can_cut = not any("▁" in p.lstrip("▁") or " " in p for p in pieces)

    def size(self, text: str) -> int:
        return len(text.encode())

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self._model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]

    def spans(self, text: str, head: int, tail: int) -> Spans:
        data = text.encode()
        pieces = self._model.encode(text, add_bos=False, add_eos=False, return_type="proto").pieces
        visible = range(0x21, 0x7F)
        starts = [(p.begin, i) for i, p in enumerate(pieces) if 0 < p.begin < len(data) - 1 and data[p.begin] == 0x20
                  and data[p.begin - 1] in visible and data[p.begin + 1] in visible]
        return starts, len(pieces)


def json_can_cut(config: dict) -> bool:
    """Whether two encodings that start a word at one place provably agree from there on."""
    def parts(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else [y for z in x[inner] for y in parts(z, inner)] if x["type"] == "Sequence" else [x]

    def plain(pattern: str) -> bool:                                # no look-behind, anchor or word boundary
        return not re.search(r"\(\?<[=!]|\\[bBAGzZK]|(?<![\\\[])\^|(?<!\\)\$", pattern)

    for x in parts(config.get("normalizer"), "normalizers"):
        if not (x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")
                or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "):
            return False
    splits = parts(config.get("pre_tokenizer"), "pretokenizers")
    for x in splits:
        if x["type"] == "ByteLevel":
            if x["add_prefix_space"]:
                return False
        elif not (x["type"] == "Split" and "Regex" in x["pattern"] and plain(x["pattern"]["Regex"])):
            return False
    for x in config.get("added_tokens", []):
        if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]:
            return False
    return bool(splits) and not (config["model"].get("dropout") or 0)


def plain_tables(config: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Token ids by bytes and special strings of a file that is plain byte-level BPE with merges in order of ids."""
    split, model, added = config.get("pre_tokenizer") or {}, config["model"], config.get("added_tokens", [])
    if (config.get("normalizer") is not None or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]
            or not json_can_cut(config) or model["type"] != "BPE" or model.get("ignore_merges")
            or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback"))
            or any(a is not b and a["content"].startswith(b["content"]) for a in added for b in added)):
        return None
    vocab, special = bpe.from_model(model), {t["content"]: t["id"] for t in added}
    if np.any(np.diff(vocab.merged[np.argsort(vocab.ranks)]) <= 0):
        return None
    return {t: i for i, t in enumerate(vocab.tokens) if t and i not in special.values()}, special


def plain_holds(content: str) -> bool:
    """Whether a compiled encoder gives this JSON file's counts; takes a second or two, once on the driver."""
    config = json.loads(content)
    tables = plain_tables(config)
    return tables is not None and bpe.merges_give_tokens(bpe.from_model(config["model"]), tables[0].values())


def encoder(path: str) -> Callable[[], JsonEncoder | ModelEncoder]:
    """A maker of the file's encoder; the driver reads the file, Python workers build the encoder once each."""
    with open(path, "rb") as file:
        content = file.read()
    mark = hashlib.sha256(content).hexdigest()
    plain = not path.endswith(".model") and plain_holds(content.decode())

    def make() -> JsonEncoder | ModelEncoder:
        made = worker_cache()
        if mark not in made:
            made[mark] = ModelEncoder(content) if path.endswith(".model") else JsonEncoder(content.decode(), plain)
        return made[mark]
    return make


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``CHARS_AT_ONCE`` characters, so that encodings stay small."""
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= CHARS_AT_ONCE:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _counted_or_cut(df: DataFrame, make: Callable, stride: int, overlap: int) -> DataFrame:
    """``(key, text)`` to one row per short text with its count, and one per chunk of each longer text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = make()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            whole = [i for i, x in enumerate(texts) if len(x) <= stride + overlap or not tool.can_cut]
            distinct = list(dict.fromkeys(texts[i] for i in whole))      # copies in a batch are encoded once
            counts = dict(zip(distinct, (n for part in _slices(distinct) for n in tool.counts(part))))
            rows = [(i, len(texts[i].encode()), counts[texts[i]], None, None, None, None) for i in whole]
            for i in sorted(set(range(len(texts))) - set(whole)):
                text, name = texts[i], uuid.uuid4().hex
                last = -(-(len(text) - overlap) // stride) - 1
                for k in range(last + 1):
                    rows.append((i, len(text.encode()) if not k else None, None, name, k, k == last,
                                 text[k * stride:(k + 1) * stride + overlap]))
            for at in range(0, len(rows), 1024):
                part = list(zip(*rows[at:at + 1024]))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part[0], pa.int64())), *map(pa.array, part[1:], kinds)],
                                                 ["key", "n_bytes", "n_tokens", "name", "place", "last", "chunk"])

    kind = df.schema["key"].dataType.simpleString()
    return df.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, name string, place long, last boolean, chunk string")


def _ends(chunks: DataFrame, make: Callable, stride: int, overlap: int) -> DataFrame:
    """Encode chunks: for each seam a chunk touches, its word starts in the overlap with the tokens before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = make()
        for batch in batches:
            rows = []
            for name, place, last, chunk in zip(*(batch.column(i).to_pylist() for i in range(4))):
                starts, total = tool.spans(chunk, overlap, stride)
                most = tool.size(chunk) - tool.guard                # beyond it the cut may show
                if place:
                    edge = min(most, tool.size(chunk[:overlap]))
                    found = [s for s in starts if s[0] <= edge]
                    rows.append((name, place, False, [p for p, _ in found], [n for _, n in found], total if last else 0))
                if not last:
                    base = tool.size(chunk[:stride])
                    found = [(p - base, n) for p, n in starts if base <= p <= most]
                    rows.append((name, place + 1, True, [p for p, _ in found], [n for _, n in found], 0))
            part = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays(list(map(pa.array, part, kinds)), ["name", "seam", "left", "starts", "before", "total"])

    return (chunks.select("name", "place", "last", "chunk")
            .mapInArrow(run, "name string, seam long, left boolean, starts array<long>, before array<long>, total long"))


def _spliced(ends: DataFrame) -> DataFrame:
    """``(name, n_tokens)``; no count where a seam has no common boundary.

    At a common boundary the left chunk has ``before`` tokens in front of it and the right one its own, so the
    whole text has, summed over the seams, left minus right, and the last chunk's total.
    """
    def side(left: bool, what: str):
        return F.max(F.when(F.col("left") == left, F.col(what)))

    seams = ends.groupBy("name", "seam").agg(side(True, "starts").alias("ls"), side(True, "before").alias("lb"),
                                             side(False, "starts").alias("rs"), side(False, "before").alias("rb"),
                                             F.max("total").alias("total"))
    at = F.array_min(F.array_intersect("ls", "rs"))
    step = (F.element_at("lb", F.array_position("ls", at).cast("int")) - F.element_at("rb", F.array_position("rs", at).cast("int")))
    steps = seams.select("name", F.when(at.isNotNull(), step + F.col("total")).alias("step"))
    return steps.groupBy("name").agg(F.when(F.bool_and(F.col("step").isNotNull()), F.sum("step")).alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024,
                 stride: int = STRIDE, overlap: int = OVERLAP) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row; ``tokenizer`` is a ``.json`` or ``.model`` file."""
    make = encoder(tokenizer)
    if not make().guard < overlap <= stride:
        raise ValueError(f"overlap {overlap} must exceed {make().guard} characters and not the stride {stride}")
    first = stage(_counted_or_cut(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, stride, overlap), "token-counts")
    chunks, counts = first.where(F.col("name").isNotNull()), None
    left = chunks.count()
    while left:
        tasks = min(MOST_TASKS, -(-left // CHUNKS_A_TASK))
        done = stage(_spliced(_ends(chunks.repartition(tasks, "name", "place"), make, stride, overlap)), "token-seams")
        good = done.where(F.col("n_tokens").isNotNull())
        counts = good if counts is None else counts.unionByName(good)
        failed = done.where(F.col("n_tokens").isNull()).select("name")
        # Alignment failed: these texts again, put together from their chunks, with wider overlaps.
        own = F.when(F.col("last"), F.col("chunk")).otherwise(F.substring("chunk", 1, stride))
        texts = (chunks.join(failed, "name", "left_semi").groupBy("name")
                 .agg(F.array_sort(F.collect_list(F.struct("place", own.alias("own")))).alias("parts"))
                 .select(F.col("name").alias("key"), F.concat_ws("", F.transform("parts", lambda p: p["own"])).alias("text")))
        stride, overlap = stride * WIDEN, overlap * WIDEN
        again = stage(_counted_or_cut(texts, make, stride, overlap), "token-again")
        counts = counts.unionByName(again.where(F.col("name").isNull()).select(F.col("key").alias("name"), "n_tokens"))
        chunks = again.where(F.col("name").isNotNull()).select(F.col("key").alias("name"), "place", "last", "chunk")
        left = chunks.count()
    found = first.where(F.col("name").isNull()).select("key", "n_bytes", "n_tokens")
    if counts is not None:
        heads = first.where(F.col("place") == 0).select("key", "n_bytes", "name")
        found = found.unionByName(heads.join(counts, "name").select("key", "n_bytes", "n_tokens"))
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
