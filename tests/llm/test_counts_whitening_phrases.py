"""Token counts, whitening and collocations against the libraries, numpy and brute-force versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakeprep.llm import collocations, queries, token_count, whitening

SF = "/root/testdata/sf0.001"
CLASH = ("key", "name", "place", "last", "chunk", "n_tokens", "n_bytes", "id", "vector", "whitened", "word", "n", "k0", "p", "rank")


def with_clashes(df, taken=()):
    for name in CLASH:
        if name not in taken:
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


# ------------------------------------------------------------------ token counts

def odd_text(n, seed):
    rng, out = random.Random(seed), ""
    parts = ["abc ", "  \n", " the word, and.", "日本語", "é́ ", "<|endoftext|>", "'ll don't ", "1234 ", "x" * 30, "▁ ", "\t\r\n", "<s></s>", "🙂"]
    while len(out) < n:
        out += rng.choice(parts)
    return out


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


COUNT_TEXTS = [None, "", " \n\t", "one two", "a <|endoftext|> b", "日本語 😀 é", "word " * 900, "x" * 5000, "<|endoftext|>" * 300, " " * 3000,
               "日" * 3000, *[odd_text(n, n) for n in (150, 310, 700, 1500, 4000, 9000)]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, name):
    rows = [*enumerate(COUNT_TEXTS), (3, "one two"), (6, "word " * 900), (None, "no id " * 200), (None, None)]
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    want, count = Counter(), library(name)
    for i, t in rows:
        n = count(t or "")
        want[(i, len((t or "").encode()), n, n > 500)] += 1
    got = token_count.count_tokens(df, public_tokenizers.path(name), limit=500, stride=200, overlap=80)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert token_count.count_tokens(df.limit(0), public_tokenizers.path(name)).count() == 0


def test_token_counts_of_random_cuts_never_guess():
    """Splicing by hand: a seam with a common boundary gives the whole text's count, others say so."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        tool, spliced = token_count.encoder(public_tokenizers.path(name))(), 0
        assert tool.can_cut
        for seed in range(60):
            text, stride, overlap = odd_text(900, seed), 150, 70
            last = -(-(len(text) - overlap) // stride) - 1
            chunks = [text[k * stride:(k + 1) * stride + overlap] for k in range(last + 1)]
            assert "".join(c[:stride] for c in chunks[:-1]) + chunks[-1] == text
            found, total = [tool.spans(c, overlap, stride) for c in chunks], 0
            for k in range(last):
                base, most = tool.size(chunks[k][:stride]), tool.size(chunks[k]) - tool.guard
                left = {p - base: n for p, n in found[k][0] if base <= p <= most}
                edge = min(tool.size(chunks[k + 1]) - tool.guard, tool.size(chunks[k + 1][:overlap]))
                right = {p: n for p, n in found[k + 1][0] if p <= edge}
                both = sorted(set(left) & set(right))
                if not both:
                    break
                total += left[both[0]] - right[both[0]]
            else:
                spliced += 1
                assert total + found[-1][1] == tool.counts([text])[0]
        assert spliced > 5


def test_compiled_counts_equal_the_library_at_every_code_point():
    tool, count = token_count.encoder(public_tokenizers.path("byte_bpe_50k.json"))(), library("byte_bpe_50k.json")
    assert tool._plain is not None and token_count.encoder(public_tokenizers.path("word_bpe_49k.json"))()._plain is None
    texts = [t for c in map(chr, range(token_count.PLAIN + 20)) for t in (c, f"a{c}b", f" {c}{c} x", f"{c}'s {c}", f"1{c}2 {c}\n {c}", f"é{c}<|endoftext|>{c} ")]
    rng = random.Random(5)
    texts += ["".join(rng.choice([chr(rng.randrange(token_count.PLAIN)), " ", "'ll", "the", "\n"]) for _ in range(60)) for _ in range(3000)]
    assert tool.counts(texts) == [count(t) for t in texts]
    assert sum(bool(token_count._BEYOND.search(t)) for t in texts) == 6 * 20


def test_files_that_are_not_plain_go_to_the_library():
    import json
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        config = json.load(file)
    assert token_count.plain_holds(json.dumps(config))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": config["pre_tokenizer"] | {"add_prefix_space": True}}):
        assert not token_count.plain_holds(json.dumps(config | change))
    swapped = config["model"] | {"merges": config["model"]["merges"][1:2] + config["model"]["merges"][:1] + config["model"]["merges"][2:]}
    assert not token_count.plain_holds(json.dumps(config | {"model": swapped}))
    fewer = config["model"] | {"merges": config["model"]["merges"][1:]}          # a token that no merge gives
    assert not token_count.plain_holds(json.dumps(config | {"model": fewer}))


def test_tokenizers_without_a_proof_are_not_cut():
    import json
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        config = json.load(file)
    assert token_count.json_can_cut(config)
    assert not token_count.json_can_cut(config | {"normalizer": {"type": "BertNormalizer"}})
    assert not token_count.json_can_cut(config | {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": r"(?<=a)b"}, "behavior": "Isolated"}})
    assert not token_count.json_can_cut(config | {"pre_tokenizer": None})
    assert not token_count.json_can_cut(config | {"added_tokens": [config["added_tokens"][0] | {"lstrip": True}]})


def test_token_count_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_token_counts(spark, SF).collect()}
    docs, count = spark.read.parquet(f"{SF}/documents.parquet").collect(), library("byte_bpe_50k.json")
    assert len(got) == len(docs)
    for d in docs:
        n = count(d["text"] or "")
        assert tuple(got[d["doc_id"]]) == (d["doc_id"], len((d["text"] or "").encode()), n, n > 1024)


# ------------------------------------------------------------------ whitening

def embedding_rows(n=400, size=12, seed=1):
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((size, size)) * np.linspace(2, 0.1, size)[:, None]
    rows = [(i, [float(v) for v in np.float32(rng.standard_normal(size) @ basis + 3)]) for i in range(n)]
    rows += [(1000, None), (1001, []), (1002, [float("nan")] * size), (1003, [float("inf")] + [0.0] * (size - 1)), (1004, [None] * size),
             (1005, [1.0, 2.0]), (1006, [1e30] * size), (None, rows[3][1]), rows[5], rows[5]]
    return rows


def integers(rows, size):
    keep = [(i, v) for i, v in rows if v and len(v) == size and all(x is not None and abs(x) < whitening.LARGEST for x in v)]
    return [i for i, _ in keep], [[math.floor(1024 * np.float64(np.float32(x))) + 100_000 for x in v] for _, v in keep]


def test_whitening_matches_numpy(spark):
    rows, size = embedding_rows(), 12
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = whitening.whiten(df.repartition(5)).collect()
    ids, x = integers(rows, size)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * v - s) for v, s in zip(row, sums)] for row in x], float) / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    want_deviation = Counter((i, sum((n * v - s) ** 2 for v, s in zip(row, sums))) for i, row in zip(ids, x))
    assert Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1) == want_deviation
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    for k in range(8):
        mine = np.array([by_id[i][k + 1]["whitened"] for i in ids])
        true = centred @ vectors[:, k] / np.sqrt(values[k])
        assert min(np.abs(mine - true).max(), np.abs(mine + true).max()) < 1e-8
        assert abs(by_id[ids[0]][k + 1]["explained"] - values[k] / np.trace(cov)) < 1e-12


@pytest.mark.parametrize("rows, components", [
    ([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0),
    ([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], 1), ([(i, [float(i)]) for i in range(5)], 1),
    ([(i, [float(i == 1), float(i == 2), float(i == 3)]) for i in range(4)], 3)])
def test_whitening_of_few_rows(spark, rows, components):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == components * len(rows)
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_products_beyond_doubles_stay_exact():
    big = np.array([[2 ** 39, -(2 ** 38) + 1], [2 ** 39 - 7, 12345]], np.int64)
    want = [[sum(int(a) * int(b) for a, b in zip(big[:, i], big[:, j])) for j in range(2)] for i in range(2)]
    assert whitening._dot(big, big).tolist() == want


@pytest.mark.parametrize("values", [[9, 9, 9, 5, 5, 1, 1, 1, 1, 0.5], [3] * 10, list(range(10, 0, -1)), [1, 1 - 1e-9, 1 - 2e-9] + [0] * 7])
def test_eigenvectors_of_repeated_values(values):
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((10, 10)))
    matrix = (q * np.array(values, float)) @ q.T
    found, vectors = whitening.leading((matrix + matrix.T) / 2, 8)
    assert np.allclose(found, sorted(values, reverse=True)[:8], atol=1e-13 * 10)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-12 * 10)


def test_sturm_counts():
    rng = np.random.default_rng(2)
    diagonal, off = rng.standard_normal(15), rng.standard_normal(14) * (rng.random(14) > 0.2)
    all_values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-4, 4, 41)
    assert whitening.below(diagonal, off, at).tolist() == [(all_values < x).sum() for x in at]


# ------------------------------------------------------------------ collocations

def brute_phrases(rows, least, top):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang, low = lang if lang is not None else "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    key = (lang, tuple(words[i:i + m]))
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    often = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    for (lang, w), a in often.items():
        if any(q_lang == lang and len(q) > len(w) and 100 * f >= 80 * a and any(q[i:i + len(w)] == w for i in range(len(q) - len(w) + 1))
               for (q_lang, q), f in often.items()):
            continue
        cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    out = []
    for lang, items in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(items)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "times", "of", "a", "é", "É", "x\x1fy", "日本", "a b"]
    rows = [(None, None), ("en", ""), ("en", " \t"), ("en", "new york times, new york times; new\nyork"), (None, "one two one two one two")]
    for _ in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [("en", "hot pair " + w) for w in ("a", "b", "c", "d") for _ in range(40)] + [("en", "same passage again and again")] * 60


@pytest.mark.parametrize("seed", range(3))
def test_collocations_match_brute_force(spark, seed, monkeypatch):
    if seed:                                                        # blocks that end inside texts
        monkeypatch.setattr(collocations, "POINTERS_AT_ONCE", 7)
        monkeypatch.setattr(collocations, "BLOCK", 20)
    rows = phrase_rows(seed)
    df = with_clashes(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    for least, top in ((3, 2000), (8, 5)):
        got = collocations.mine(df, least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, top)
    assert collocations.mine(df.limit(0)).count() == 0


def test_quicksort_counts_equal_a_counter():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 5, (3000, 4)) * np.int64(2) ** 61 + rng.integers(0, 3, (3000, 4))
    for k in (2, 3):
        rows[rng.random(3000) < 0.2, k:] = 0
    weight = rng.integers(1, 9, 3000)
    want = Counter()
    for row, w in zip(rows.tolist(), weight.tolist()):
        for m in (2, 3, 4):
            if row[m - 1]:
                want[tuple(row[:m])] += w
    for least in (1, 30, 200):
        got = {}
        for depth, at, heavy in collocations.quicksort_counts([rows[:, k].copy() for k in range(4)], weight, least):
            for i, f in zip(at, heavy.tolist()):
                key = tuple(rows[i, :depth].tolist())
                assert key not in got
                got[key] = f
        assert got == {k: f for k, f in want.items() if f >= least}
    assert list(collocations.quicksort_counts([np.zeros(0, np.int64)] * 4, np.zeros(0, np.int64), 1)) == []


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    honest = collocations._hashes

    def clashing(known, seed):                                      # the first seed gives all words few hashes
        return honest(known, seed) % np.uint64(7) + np.uint64(1) if seed == 0 else honest(known, seed)
    monkeypatch.setattr(collocations, "_hashes", clashing)
    rows = [("en", "red green blue red green")] * 5
    got = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), least=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 3, 2000)


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)            # every key seems present
    rows = phrase_rows(9)
    got = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), least=4)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 4, 2000)


def test_filter_has_no_false_negatives(spark):
    keys = np.random.default_rng(1).integers(1, 2 ** 62, 5000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    found = collocations.build_filter(df, lambda b: collocations._column(b, 0))
    assert found.has(keys.view(np.uint64)).all()
    assert found.has(np.random.default_rng(2).integers(1, 2 ** 62, 5000).view(np.uint64)).sum() < 50
