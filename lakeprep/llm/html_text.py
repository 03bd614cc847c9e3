"""Main text of web pages: markup first guesses, a host's repeated passages by suffix arrays decide.

Every page takes the same way. Its markup is cut into blocks with zones; blocks inside ``article`` or ``main`` are
the article and are kept whole; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are dropped by element, role or class. A class, id or role only guesses: an ``article`` or ``main``
inside such a container is the article all the same, unless the container stands in an article itself, or the word
is its whole class and the page has another article (a list of teasers). Two kinds of blocks are left to the suffix
arrays: open ones, which stand in neither on pages that mark no article, or in ``main`` but outside every
``article`` of a page that has one; and listed ones, in the article but in a container whose class has a word that
may mean either (``EITHER``) as a part, such as "menu-items" or "related-work".

The token streams of what all of a host's pages hold outside articles are concatenated, and suffixes are
ranked by their first ``LONG`` tokens (prefix doubling). A rank that two different pages share
is a long substring repeated across pages; tokens it covers are boilerplate. Open blocks keep their unique runs.
The listed blocks of a container are one section (parted by what else stands in it): it goes if half of its tokens are covered and stays whole if
not; a section shorter than ``LONG`` is one substring of its own, ended by marks. ``n_repeated`` counts the covered
tokens of a page, those of blocks that markup drops too.

Pages are different if what they may keep (article, open and listed blocks) differs: dropped adverts and menus do
not count, and near copies with such blocks are one page. Near copies share 80 % of their 5-word shingles, as in the
Jaccard join; texts of up to ``SHORT`` words, where one changed word costs more, share 50 %. So a passage is
boilerplate only if it recurs beside a text of its own.

A host is cut into shards of about ``SHARD_PAGES`` pages and ``SHARD_BYTES`` of html. Each shard ranks its own
suffixes and sends one row per distinct rank, with its first and last stream; a host's shards meet in an aggregate of
these rows, so a host of any size is spread out, and only the repeated ones come back to the shards.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated rows give
equal results, and copies and near copies of a page count as one page for repetition.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stage
from .components import components
from .jaccard import jaccard_components

LONG, SHARD_PAGES, SHARD_BYTES = 8, 2000, 64 << 20
NEAR_PERCENT, SHORT, SHORT_PERCENT = 80, 60, 50

# Names of elements, and words of class, id or role that mark what is no article.
CONTAINERS = frozenset("div section article main nav header footer aside form table ul ol dl figure dialog menu details fieldset span".split())
BLOCKS = CONTAINERS - {"span"} | frozenset("html head body p h1 h2 h3 h4 h5 h6 li tr td th thead tbody caption blockquote pre hr dt dd figcaption address option legend summary".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select button".split())
OUTSIDE = frozenset("nav header footer aside form dialog menu".split())
WORDS = frozenset("""ad ads advert adverts advertisement banner promo sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs
pagination header masthead footer sidebar aside widget related cookie cookies consent notice gdpr newsletter popup modal subscribe
comment comments disqus respond replies reply share sharing social contentinfo complementary search""".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies reply".split())
#: Words that name sections of articles too, when they are a part of the class only.
EITHER = frozenset("menu navigation banner header aside widget related notice search complementary".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_MARKUP = re.compile(r"""(<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*>)""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
#: Raw elements that end at their closing tag only, or with the page; the others' contents are markup.
TEXT_ONLY = frozenset("script style textarea title iframe noscript".split())
#: First parts of a class name that tell about the page, not the element: "has-sidebar".
FLAGS = frozenset("has have with without no".split())
#: Zones of blocks; listed blocks have two letters, so that containers that follow each other differ.
ARTICLE, OPEN, LISTED, DROPPED = "m", "b", "wy", "x"
# Only while a page is read: dropped by a class word, by one that may mean either, or by one that is the whole class; an
# article inside the latter; in main, but in no article, and there listed.
GUESSED, VAGUE, NAMED, TEASER, MAIN, SIDE = "g", "v", "n", "r", "a", "s"


def _kind(name: str, tag: str, inside: bool) -> str:
    """What a container is: the article, dropped, dropped by a class word, its heading part, or nothing special."""
    words: set[str] = set()
    whole: set[str] = set()
    if "=" in tag:
        for found in _MARKS.findall(tag):
            for own in "".join(found).lower().split():
                parts = _PARTS.split(own)
                if parts[0] not in FLAGS:
                    words.update(parts)
                    whole.add(own)
    if name in ("article", "main"):
        return DROPPED if words & COMMENT_WORDS else ARTICLE
    if name == "header" and inside:
        return "h"
    if name in OUTSIDE or words & COMMENT_WORDS:
        return DROPPED
    if inside and words & WORDS == {"header"}:
        return "h"
    if words & WORDS:
        return NAMED if whole & WORDS else VAGUE if words & WORDS <= EITHER and name != "span" else GUESSED
    return OPEN


def blocks(page: str | None) -> list[tuple[str, str]]:
    """``(zone, text)`` of the blocks of a whole page, in order."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    zone, heading, sections = OPEN, False, 0

    def where() -> str:
        now, fixed, listed = OPEN, False, False
        for name, kind in stack:
            if kind == DROPPED or (kind == "h" and not heading):
                return DROPPED
            if kind in (GUESSED, VAGUE, NAMED):
                if fixed and kind != VAGUE:
                    return DROPPED                                # inside an article a clear class word decides
                if fixed:
                    listed = True
                elif now in (ARTICLE, SIDE) and kind == VAGUE:
                    now = SIDE
                elif now != NAMED:
                    now = NAMED if kind == NAMED else GUESSED
            elif kind == ARTICLE:
                if listed:
                    return DROPPED                                # teasers
                now = TEASER if now in (NAMED, TEASER) else ARTICLE
                fixed = fixed or name == "article"
        if now in (GUESSED, NAMED) or (listed and now != ARTICLE):
            return DROPPED
        if listed:
            return LISTED[0]
        return MAIN if now == ARTICLE and not fixed else now

    def close() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((zone, joined, sections))

    page, at = page or "", 0
    while at < len(page):
        tag = _MARKUP.search(page, at)
        if not tag:
            text.append(page[at:])
            break
        if tag.start() > at:
            text.append(page[at:tag.start()])
        at, part = tag.end(), tag[0]
        found = _NAME.match(part)
        if not found:
            continue                                              # a comment or declaration
        name, ends = found[1].lower(), part[1] == "/"
        if name == "br":
            text.append(" ")
            continue
        if name in RAW and not ends:
            if not part.endswith("/>"):
                closing = _CLOSE[name].search(page, at)
                if closing:
                    at = closing.end()
                elif name in TEXT_ONLY:
                    break
            continue
        if name in BLOCKS:
            close()
        if name[0] == "h" and name[1:].isdigit():
            heading = not ends
            zone = where()
        if name in CONTAINERS:
            if ends:
                own = max((i for i, (other, _) in enumerate(stack) if other == name), default=None)
                if own is not None:
                    if name == "span" and stack[own][1] not in (OPEN, ARTICLE):
                        close()
                    del stack[own:]
            elif not part.endswith("/>"):
                kind = _kind(name, part, any(z == ARTICLE for _, z in stack))
                if name == "span" and kind != OPEN:
                    close()
                if kind == VAGUE and all(other != VAGUE for _, other in stack):
                    sections += 1
                stack.append((name, kind))
            zone = where()
    close()
    seen = {z for z, _, _ in out}
    if seen & {ARTICLE, LISTED[0]}:
        turn = {MAIN: OPEN, SIDE: DROPPED, OPEN: DROPPED, TEASER: DROPPED}
    elif seen & {MAIN, SIDE}:
        turn = {MAIN: ARTICLE, SIDE: LISTED[0], OPEN: DROPPED, TEASER: DROPPED}
    else:
        turn = {TEASER: ARTICLE} | ({OPEN: DROPPED} if TEASER in seen else {})
    zoned = [(turn.get(z, z), t, k) for z, t, k in out]
    return [(LISTED[k % 2] if z in LISTED else z, t) for z, t, k in zoned]


def host(url: str = "url") -> Column:
    """Host of a url: its authority in lower case, or the whole url where it has none; never null."""
    authority = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return F.when(authority != "", authority).otherwise(F.coalesce(F.col(url), F.lit("")))


def _hash(words: list[str], seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest
    return np.array([xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words], np.uint64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page's blocks, one a line (their white space is single spaces), and their zones, one a letter."""
    for batch in batches:
        found = [blocks(page.as_py()) for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in (0, 1, 3)], pa.array(["\n".join(t for _, t in f) for f in found], pa.string()),
             pa.array(["".join(z for z, _ in f) for f in found], pa.string())], ["id", "url", "host", "blocks", "zones"])


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What pages hold outside articles, in the form of ``_read``, a hash of what they may keep, and that text where
    the suffix arrays decide a part of it."""
    for batch in batches:
        keep, texts, zones, undecided, owns, names = [], [], [], [], [], []
        for i, page in enumerate(batch.column(2)):
            found = blocks(page.as_py())
            if all(z == ARTICLE for z, _ in found):
                continue
            keep.append(i)
            texts.append("\n".join("" if z == ARTICLE else t for z, t in found))
            zones.append("".join(z for z, _ in found))
            undecided.append(any(z == OPEN or z in LISTED for z, _ in found))
            own = "\n".join(t for z, t in found if z != DROPPED)
            owns.append(own if undecided[-1] else None)
            names.append(own)
        own = [batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 3)]
        yield pa.RecordBatch.from_arrays(
            [*own, pa.array(texts, pa.string()), pa.array(zones, pa.string()), pa.array(undecided, pa.bool_()),
             pa.array(owns, pa.string()), pa.array(_hash(names, 1).view(np.int64))],
            ["id", "host", "blocks", "zones", "undecided", "own", "page"])


def _stream(texts: str, zones: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a page's blocks outside articles, the block of each token, and whether a substring may start there.

    Marks of block -1 fill listed sections up to ``LONG``; only the whole of such a section is a substring.
    """
    words: list[str] = []
    owner: list[int] = []
    starts: list[bool] = []
    first = 0
    for b, (zone, text) in enumerate(zip(zones, texts.split("\n"))):
        if zone in LISTED and zones[b - 1:b] != zone:
            first = len(words)
        if zone != ARTICLE:
            own = text.split()
            words += own
            owner += [b] * len(own)
            starts += [True] * len(own)
        size = len(words) - first
        if zone in LISTED and zones[b + 1:b + 2] != zone and size < LONG:
            starts[first + 1:] = [False] * (LONG - 1)
            words += [" "] * (LONG - size)
            owner += [-1] * (LONG - size)
    return _hash(words, 0), np.array(owner, np.int64), np.array(starts, bool)


def suffix_ranks(tokens: np.ndarray, ends: np.ndarray, depth: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix by its first ``depth`` tokens, and a hash of these; -1 where its page ends sooner.

    ``ends`` is the end of the page a token belongs to. Ranks of ``2k`` tokens are those of the pairs of
    ranks ``k`` apart, so ``log2(depth)`` sorts suffice.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    prints, size, alive = mix64(tokens), 1, np.ones(n, bool)
    while size < depth:
        step = min(size, depth - size)
        at = np.arange(n) + step
        alive = alive & (at + size <= ends)
        at = np.minimum(at, max(0, n - 1))
        pair = rank * (n + 1) + rank[at]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        prints = mix64(prints * np.uint64(0x9E3779B97F4A7C15) + prints[at] + np.uint64(size))
        size += step
    return np.where(alive, rank, -1), prints


def _shard(group: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Streams of a shard's pages, one after the other, with ranks."""
    pages = [_stream(ts, zs) for ts, zs in zip(group["blocks"], group["zones"])]
    sizes = np.array([len(t) for t, _, _ in pages], np.int64)
    tokens, starts = (np.concatenate([p[k] for p in pages]) if len(pages) else np.zeros(0, kind) for k, kind in ((0, np.uint64), (2, bool)))
    ends = np.repeat(np.cumsum(sizes), sizes)
    rank, prints = suffix_ranks(tokens, ends)
    return pages, sizes, np.where(starts, rank, -1), prints


def _distinct(group: pd.DataFrame) -> pd.DataFrame:
    """One row per distinct long prefix of a shard's suffixes."""
    _, sizes, rank, prints = _shard(group)
    alive = np.flatnonzero(rank >= 0)
    table = pd.DataFrame({"print": prints[alive].view(np.int64), "page": np.repeat(group["page"].to_numpy(np.int64), sizes)[alive]})
    out = table.groupby("print")["page"].agg(lo="min", hi="max").reset_index()
    for name in ("host", "shard"):
        out[name] = pd.Series([group[name].iloc[0]] * len(out), dtype=object)
    return out[["host", "shard", "print", "lo", "hi"]]


def _kept(texts: str, zones: str, owner: np.ndarray, covered: np.ndarray) -> str:
    """The text of a page, by the tokens that repeated substrings cover."""
    out: list[str] = []
    section: list[str] = []
    size = gone = 0
    for b, (zone, text) in enumerate(zip(zones, texts.split("\n"))):
        if zone == ARTICLE:
            out.append(text)
        elif zone == OPEN:
            words = [w for w, c in zip(text.split(), covered[owner == b]) if not c]
            if words:
                out.append(" ".join(words))
        elif zone in LISTED:
            mine = covered[owner == b]
            section, size, gone = section + [text], size + len(mine), gone + int(mine.sum())
            if zones[b + 1:b + 2] != zone:
                out += section if 2 * gone < size else []
                section, size, gone = [], 0, 0
    return "\n".join(out)


def _decided(group: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
    """Text of a shard's pages, without what repeated substrings cover of open and listed blocks."""
    if not len(group):
        return pd.DataFrame({"id": [], "url": [], "text": [], "n_repeated": []}, dtype=object)
    pages, sizes, rank, prints = _shard(group)
    known = np.unique(repeated["print"].to_numpy(np.int64)) if len(repeated) else np.zeros(0, np.int64)
    hit = (rank >= 0) & np.isin(prints.view(np.int64), known)
    change = np.zeros(len(rank) + LONG + 1, np.int64)
    np.add.at(change, np.flatnonzero(hit), 1)
    np.add.at(change, np.flatnonzero(hit) + LONG, -1)
    covered, out, start = np.cumsum(change)[:len(rank)] > 0, [], 0
    for row, (_, owner, _), size in zip(group.itertuples(), pages, sizes):
        mask = covered[start:start + size]
        start += size
        out.append((row.id, row.url, _kept(row.blocks, row.zones, owner, mask), int((mask & (owner >= 0)).sum())))
    return pd.DataFrame(out, columns=["id", "url", "text", "n_repeated"], dtype=object)


def _copies(pages: DataFrame) -> DataFrame:
    """``(page, copy_of)`` of the pages whose undecided text is a near copy of others: the smallest of these."""
    texts = stage(pages.where("undecided and own != ''").groupBy("page").agg(F.min("own").alias("own")), "page-texts")
    if texts.isEmpty():
        return texts.select("page", F.col("page").alias("copy_of"))
    short = texts.where(F.size(F.split("own", r"\s+")) <= SHORT)
    near = [jaccard_components(t, percent, "page", "own") for t, percent in ((texts, NEAR_PERCENT), (short, SHORT_PERCENT))]
    links = near[0].unionByName(near[1]).select(F.col("page").alias("a"), F.col("component_id").alias("b"))
    return components(links).select(F.col("id").alias("page"), F.col("component").alias("copy_of"))


def main_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(key, url, text, n_chars, n_repeated)`` of every page."""
    source = df.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(page).alias("html"))
    source = source.withColumn("host", host())                         # all sides of the joins below take this column
    # hosts of several shards, at most one a SHARD_PAGES pages or SHARD_BYTES: few enough to broadcast, so pages move once
    large = source.groupBy("host").agg(F.greatest(
        F.ceil(F.count("*") / SHARD_PAGES), F.ceil(F.coalesce(F.sum(F.octet_length("html")), F.lit(0)) / SHARD_BYTES)).cast("int").alias("shards")).where("shards > 1")

    def sharded(pages: DataFrame) -> DataFrame:
        number = F.pmod(F.xxhash64("id"), F.coalesce("shards", F.lit(1))).cast("string")
        return pages.join(F.broadcast(large), "host", "left").withColumn("shard", F.concat_ws(" ", "host", number)).drop("shards")

    other = stage(source.mapInArrow(
        _outside, "id long, host string, blocks string, zones string, undecided boolean, own string, page long"), "page-blocks")
    # only pages that can be near copies of others meet the table of copies; empty ones would be one key
    asked = F.col("undecided") & (F.col("own") != "")
    found = other.where(asked).drop("own").join(_copies(other), "page", "left").withColumn("page", F.coalesce("copy_of", "page")).drop("copy_of")
    other = found.unionByName(other.where(~asked).drop("own"))
    seen = sharded(other).groupBy("shard").applyInPandas(_distinct, "host string, shard string, print long, lo long, hi long")
    repeated = (seen.groupBy("host", "print").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("shard").alias("at"))
                .where("lo != hi").select(F.explode("at").alias("shard"), "print"))
    pages = sharded(source.mapInArrow(_read, "id long, url string, host string, blocks string, zones string"))
    decided = (pages.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInPandas(
        lambda own, back: _decided(own, back), "id long, url string, text string, n_repeated long"))
    return decided.select(F.col("id").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
