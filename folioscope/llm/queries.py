"""The operators over the whole given tables, as named queries, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    embedding_dedup, hard_negatives, jaccard_join, language, lexical_search, packing, pieces, pii, quality, secret_scan,
    spotsigs, token_counts, toxicity,
)
from folioscope.llm.common import documents, labels, lean_batches, remainder
from folioscope.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(ship_package(spark), sf_dir)
        return fn

    return register


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(n: int, fold: int) -> Column:
    return F.coalesce(remainder("doc_id", n) == fold, F.lit(False)).alias("held_out")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in secret_scan.KINDS],
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("found").alias("spans"),
    )


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = language.fit(docs, remainder("doc_id", 4) != 2)
    return language.predict(docs, learned).select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


@query("op3_ngram_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(documents(lean_batches(spark), sf_dir), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op3_ngram_jaccard_links")
def op3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(documents(lean_batches(spark), sf_dir), words=4, percent=85).select("doc_id", "n_links")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = toxicity.fit(docs, labels(spark, sf_dir))
    scored = toxicity.score(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_piece_encoding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@query("op7_spotsigs")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    anchors = spotsigs.common_words(docs)
    both = spotsigs.with_next(docs, {"own": spotsigs.signatures("text", anchors)})
    both = both.withColumn("changed", spotsigs.edited("text", "next_text"))
    both = both.withColumn("other", spotsigs.signatures("changed", anchors))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"),
        spotsigs.fingerprint("own").alias("fingerprint"), spotsigs.fingerprint("other").alias("edited_fingerprint"),
        spotsigs.likeness("own", "other").alias("near_edited"),
        F.coalesce(spotsigs.likeness("own", "next_own"), F.lit(0.0)).alias("near_next"),
    )


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = quality.fit(docs, labels(spark, sf_dir))
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_embedding_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op11_lexical_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


@query("op12_hard_negatives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # The given labels are the vectors' own clusters; moving every seventh row makes near rows of other labels.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


@query("op13_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


ORACLES["op3_ngram_jaccard_join"] = """
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM worded),
each AS (SELECT doc_id, unnest(s) AS t FROM shingled),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM each x JOIN each y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN shingled x ON x.doc_id = a JOIN shingled y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION
  SELECT id, b FROM reach JOIN both_ways ON a = r)
SELECT d.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.component_id
FROM shingled d JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id
"""

_LINKS = ORACLES["op3_ngram_jaccard_join"].partition("both_ways AS")[0].rstrip().rstrip(",")
ORACLES["op3_ngram_jaccard_links"] = f"""{_LINKS}
SELECT d.doc_id, count(l.a) AS n_links
FROM documents d LEFT JOIN links l ON d.doc_id IN (l.a, l.b) GROUP BY d.doc_id
"""

ORACLES["op10_embedding_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach(id, r) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT id, b FROM reach JOIN links ON a = r)
SELECT e.vec_id, coalesce(n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) m ON m.id = e.vec_id
"""

ORACLES["op11_lexical_search"] = """
WITH worded AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
held AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
parts AS (
  SELECT h.doc_id, h.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS part
  FROM held h JOIN weights USING (term) JOIN sizes USING (doc_id), totals),
scored AS (
  SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score
  FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 50
"""

ORACLES["op12_hard_negatives"] = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
anchors AS (SELECT * FROM good WHERE vec_id % 100 = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, g.vec_id AS other_id, a.label = g.label AS same,
         CAST(list_dot_product(a.x, g.x) AS BIGINT) AS score
  FROM anchors a JOIN good g ON a.vec_id <> g.vec_id AND len(a.x) = len(g.x)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM scores WHERE same)
  WHERE r <= 5),
fitting AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM fitting WHERE rank <= 10
"""
