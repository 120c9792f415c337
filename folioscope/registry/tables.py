"""Reading, writing and set operations on the corpus."""

from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.operators import prepare, topics
from folioscope.operators.embedding import HashedWords, embed_papers
from folioscope.plans import incremental
from folioscope.registry import base as B
from folioscope.registry.base import query
from folioscope.schemas import KEYED_PAPER, KEYS
from folioscope.session import new_path
from folioscope.sources import corpus, manifest, snapshots, subjects

_SHOWN = ("arxiv_id", "title", *KEYS)
_LIST = ", ".join(_SHOWN)


def _landed(spark, sf):
    return corpus.read_corpus(spark, B.landed_path(spark, sf))


@query(
    "scan_subject_month",
    f"SELECT {_LIST} FROM keyed WHERE subject = 'cs.AI' AND year = '2023' AND month = '03'",
)
def _(spark, sf):
    return corpus.scan_subject_month(_landed(spark, sf), "cs.AI", "2023", "03").select(*_SHOWN)


@query(
    "scan_subjects_month",
    f"""SELECT {_LIST} FROM keyed
    WHERE subject IN ('cs.LG', 'gr-qc', 'no-such') AND year = '2024' AND month = '01'""",
)
def _(spark, sf):
    rows = corpus.scan_subjects_month(
        _landed(spark, sf), ["cs.LG", "gr-qc", "no-such"], "2024", "01"
    )
    return rows.select(*_SHOWN)


@query(
    "scan_subject_year",
    f"""SELECT {_LIST} FROM keyed
    WHERE subject = 'gr-qc' AND year = '2023' AND month IN ('01', '02', '12')""",
)
def _(spark, sf):
    rows = corpus.scan_subject_year(_landed(spark, sf), "gr-qc", "2023", ["01", "02", "12"])
    return rows.select(*_SHOWN)


_CHOSEN = ["cs.AI", "cs.LG", "astro-ph.EP"]
_MONTHS = [("2023", "11"), ("2023", "12"), ("2024", "01"), ("2024", "02")]
_CHOSEN_SQL = f"""subject IN {tuple(_CHOSEN)}
    AND year || '-' || month IN ('2023-11', '2023-12', '2024-01', '2024-02')"""


@query("scan_selection", f"SELECT {_LIST} FROM keyed WHERE {_CHOSEN_SQL}")
def _(spark, sf):
    return corpus.scan_selection(_landed(spark, sf), _CHOSEN, _MONTHS).select(*_SHOWN)


@query(
    "scan_partitions",
    f"""SELECT k.arxiv_id, k.subject, k.year, k.month FROM keyed k JOIN manifest m
    ON m.subject = k.subject AND m.year = k.year AND m.month = k.month WHERE m.embedded""",
)
def _(spark, sf):
    chosen = B.manifest(spark, sf).where("embedded")
    return corpus.scan_partitions(_landed(spark, sf), chosen).select("arxiv_id", *KEYS)


_FIRST = """SELECT * EXCLUDE (rn) FROM (SELECT *,
    row_number() OVER (PARTITION BY arxiv_id ORDER BY subject, year, month) AS rn FROM {0}) d
    WHERE rn = 1"""


@query(
    "load_month_all_subjects",
    f"""SELECT {_LIST} FROM ({_FIRST.format("crosslisted")}) f WHERE year = '2024' AND month = '01'""",
)
def _(spark, sf):
    path = new_path(spark, "month")
    month = corpus.materialise_month(B.crosslisted(spark, sf), path, "2024", "01", B.NOW)
    return month.select(*_SHOWN)


@query("scan_raw_corpus", f"SELECT {_LIST}, cast(length(abstract) AS int) AS chars FROM keyed")
def _(spark, sf):
    path = new_path(spark, "raw")
    B.papers(spark, sf).write.parquet(path)
    keyed = prepare.prepare(corpus.scan_raw_corpus(spark, path))
    return keyed.select(*_SHOWN, F.length("abstract").alias("chars"))


@query(
    "write_partitioned_corpus",
    f"""SELECT {_LIST}, abstract, array_to_string(authors, ';') AS authors, primary_subject FROM keyed""",
)
def _(spark, sf):
    path = new_path(spark, "corpus")
    corpus.write_partitioned(B.keyed(spark, sf), path)
    rows = corpus.read_corpus(spark, path)
    return rows.select(
        *_SHOWN, "abstract", F.array_join("authors", ";").alias("authors"), "primary_subject"
    )


@query(
    "write_embeddings",
    """SELECT subject, year, month, count(*) AS n_rows,
    count(title || abstract) AS n_vectors FROM keyed GROUP BY subject, year, month""",
)
def _(spark, sf):
    path = new_path(spark, "embedded")
    embedded = embed_papers(_landed(spark, sf), HashedWords())
    incremental.write_embeddings(embedded, path)
    rows = incremental.read_embeddings(spark, path)
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.count("embedding").alias("n_vectors")
    )


@query("publish_current_dataset", "SELECT arxiv_id, year_month, x, y FROM current_")
def _(spark, sf):
    root = new_path(spark, "published")
    rows = B.current(spark, sf, vectors=False)
    snapshots.publish(rows.where("year_month IS NOT NULL"), root)
    snapshots.publish(rows, root, cluster_by=("year_month", "arxiv_id"))
    return snapshots.read_published(spark, root).select("arxiv_id", "year_month", "x", "y")


@query(
    "land_partitions",
    "SELECT subject, year, month, n_rows, NOT downloaded AS landed_now FROM manifest",
)
def _(spark, sf):
    path = new_path(spark, "landing")
    staged = _landed(spark, sf)
    before = B.manifest(spark, sf).where("downloaded")
    corpus.write_partitioned(corpus.scan_partitions(staged, before), path)
    landed = manifest.partition_manifest(spark, path, KEYED_PAPER)
    new = corpus.land_partitions(staged, path, landed).withColumn("landed_now", F.lit(True))
    counts = manifest.partition_manifest(spark, path, KEYED_PAPER)
    joined = counts.join(new, list(KEYS), "left")
    return joined.select(*KEYS, "n_rows", F.coalesce("landed_now", F.lit(False)).alias("landed_now"))


@query(
    "load_subject_codes",
    """SELECT subject AS code, min(trim(regexp_extract(primary_subject, '^[^(]*'))) AS name
    FROM keyed GROUP BY subject""",
)
def _(spark, sf):
    name = F.trim(F.regexp_extract("primary_subject", "^[^(]*", 0))
    keyed = B.keyed(spark, sf)
    names = keyed.groupBy(F.col("subject").alias("code")).agg(F.min(name).alias("name"))
    path = new_path(spark, "subject-codes")
    subjects.save_subject_codes(subjects.subject_codes_from(keyed, names), path)
    return subjects.load_subject_codes(spark, path)


@query("save_topics", "SELECT arxiv_id, dominant_topic FROM weighed")
def _(spark, sf):
    rows = B.weighed(spark, sf)
    root = new_path(spark, "topics")
    record = rows.agg(F.count("*").alias("paper_count"))
    result = topics.TopicResult(topics.topic_terms(rows, 5), topics.assign_topics(rows), record)
    topics.save_topics(result, root, "head")
    return topics.load_topics(spark, root, "head").assignments.select("arxiv_id", "dominant_topic")


@query(
    "topic_record",
    """SELECT 'all' AS cache_key, 10 AS n_components, count(*) AS paper_count,
    count(embedding) AS valid_embedding_count, true AS converged FROM current_""",
)
def _(spark, sf):
    """What is stored about fitted topics, read back."""
    rows = B.current(spark, sf).select("arxiv_id", "title", "abstract", "embedding")
    root = new_path(spark, "topics")
    topics.save_topics(topics.extract_topics(rows, 10, key="all"), root, "all")
    return topics.load_topics(spark, root, "all").record.drop("passes")


@query("partition_manifest", "SELECT subject, year, month, n_rows, true AS has_files FROM manifest")
def _(spark, sf):
    listed = manifest.partition_manifest(spark, B.landed_path(spark, sf), KEYED_PAPER)
    sized = (F.col("size_bytes") > 0) & (F.col("n_files") > 0) & F.col("modified_at").isNotNull()
    return listed.select(*KEYS, "n_rows", sized.alias("has_files"))


@query(
    "partition_listing",
    "SELECT subject, year, month, true AS has_files FROM manifest",
)
def _(spark, sf):
    listed = manifest.partition_manifest(
        spark, B.landed_path(spark, sf), KEYED_PAPER, with_counts=False
    )
    return listed.select(*KEYS, (F.col("size_bytes") > 0).alias("has_files"))


@query(
    "sample_rows",
    "SELECT arxiv_id, primary_subject FROM papers ORDER BY md5(arxiv_id || ':42'), arxiv_id LIMIT 150",
)
def _(spark, sf):
    return prepare.sample_rows(B.papers(spark, sf), 150).select("arxiv_id", "primary_subject")


@query("dedupe_by_id", f"SELECT {_LIST} FROM ({_FIRST.format('crosslisted')}) f")
def _(spark, sf):
    return prepare.dedupe(B.crosslisted(spark, sf)).select(*_SHOWN)


@query(
    "union_partitions",
    """SELECT arxiv_id, subject, subjects, title FROM keyed UNION ALL
    SELECT arxiv_id, subject, NULL AS subjects, title FROM crosslisted""",
)
def _(spark, sf):
    shown = ("arxiv_id", "subject", "subjects", "title")
    both = corpus.union_partitions(B.keyed(spark, sf), B.crosslisted(spark, sf).drop("subjects"))
    return both.select(*shown)


@query(
    "normalise_vectors",
    """SELECT arxiv_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 3) AS norm
    FROM current_ WHERE embedding IS NOT NULL""",
)
def _(spark, sf):
    rows = B.current(spark, sf).where("embedding IS NOT NULL")
    return rows.select("arxiv_id", F.round(V.norm(V.normalise("embedding")), 3).alias("norm"))
