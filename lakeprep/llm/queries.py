"""Registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lake import read_table
from . import bpe, collocations, html_text, jaccard, knn, near_vectors, packing, pii, quality, secrets, token_count, toxicity, whitening
from .common import held_out

QUALITY_CUT, TOXIC_CUT = 0.7, 0.3
#: The registered query's key for surrogates; a real job passes its own secret.
PII_KEY = b"lakeprep demonstration key"


def _scored(docs: DataFrame, score, cut: float) -> DataFrame:
    scored = docs.select("doc_id", held_out().alias("held_out"), score.alias("score"))
    return scored.select("*", (F.col("score") >= cut).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _scored(docs, quality.score(quality.train(docs, labels)), QUALITY_CUT)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, PII_KEY, count="n_replaced")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = bpe.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(read_table(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    data = read_table(spark, sf_dir, "embeddings").where(finite).select(F.col("vec_id").cast("long").alias("id"), whole.alias("vec"))
    found = knn.top_k(data, data.where(F.col("id") % 50 == 0), 5)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return _scored(docs, toxicity.score(toxicity.train(docs, labels)), TOXIC_CUT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                         public_tokenizers.PATTERN)
    return packing.pack(cut).withColumnRenamed("key", "doc_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return whole.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_main_text": op4_main_text,
    "op5_voronoi_knn": op5_voronoi_knn,
    "op6_secret_scan": op6_secret_scan,
    "op7_near_vectors": op7_near_vectors,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op5_voronoi_knn": """WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
            FROM good q JOIN good x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored) WHERE place <= 5""",
    "op13_collocations": r"""WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        runs AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
        grams AS (
            SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
            FROM runs, (VALUES (1), (2), (3), (4)) sizes(m) WHERE len(ws) >= m),
        counted AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang),
        often AS (SELECT *, string_split(phrase, ' ') AS ws FROM counted WHERE f >= 30),
        candidates AS (SELECT * FROM often WHERE m > 1),
        held AS (
            SELECT c.lang, c.f, array_to_string(c.ws[s:s + k - 1], ' ') AS phrase
            FROM candidates c, (VALUES (2), (3)) sizes(k), (VALUES (1), (2), (3)) starts(s) WHERE k < c.m AND s + k - 1 <= c.m),
        longest AS (SELECT lang, phrase, max(f) AS most FROM held GROUP BY ALL),
        rest AS (
            SELECT c.* FROM candidates c LEFT JOIN longest l ON c.lang = l.lang AND c.phrase = l.phrase
            WHERE l.most IS NULL OR 100 * l.most < 80 * c.f),
        cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (2000000 * c.f) // (l.f + r.f) AS score
            FROM rest c JOIN (VALUES (1), (2), (3)) places(k) ON k < c.m
            JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
            JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:c.m], ' ')),
        best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place_in_lang FROM best WHERE place = 1)
        SELECT lang, CAST(place_in_lang AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
            CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE place_in_lang <= 2000""",
}
