"""Projections and filters."""

from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.functions.calendar import ym
from folioscope.operators import catalog, filters, listing, prepare, reuse, search
from folioscope.registry import base as B
from folioscope.registry.base import query
from folioscope.sources.corpus import with_year_month


@query("subject_code", "SELECT arxiv_id, subject FROM dated")
def _(spark, sf):
    return B.papers(spark, sf).select("arxiv_id", X.subject_code("primary_subject").alias("subject"))


@query("partition_year_month", "SELECT arxiv_id, year, month FROM all_keyed")
def _(spark, sf):
    return prepare.add_keys(B.papers(spark, sf)).select("arxiv_id", "year", "month")


@query("year_month", "SELECT arxiv_id, submission_date, year_month FROM current_")
def _(spark, sf):
    return B.papers(spark, sf).select(
        "arxiv_id", "submission_date", X.year_month("submission_date").alias("year_month")
    )


@query("ensure_year_month", "SELECT arxiv_id, year_month FROM current_")
def _(spark, sf):
    return with_year_month(with_year_month(B.papers(spark, sf))).select("arxiv_id", "year_month")


@query(
    "subject_codes",
    r"""SELECT arxiv_id, subjects,
    array_to_string(regexp_extract_all(subjects, '[(]([a-z-]+[.][A-Z]+)[)]', 1), ',') AS subject_codes
    FROM papers""",
)
def _(spark, sf):
    coded = prepare.subject_codes_column(B.papers(spark, sf))
    return coded.select(
        "arxiv_id", "subjects", F.array_join("subject_codes", ",").alias("subject_codes")
    )


_TEXT = "substring(title || ' ' || abstract, 1, 512)"


@query("embed_text", f"SELECT arxiv_id, {_TEXT} AS text FROM papers")
def _(spark, sf):
    return B.papers(spark, sf).select("arxiv_id", X.embed_text().alias("text"))


@query(
    "paper_projection",
    f"""SELECT arxiv_id, title, array_to_string(authors, ';') AS authors, submission_date,
    primary_subject,
    array_to_string(regexp_extract_all(subjects, '[(]([a-z-]+[.][A-Z]+)[)]', 1), ',') AS subject_codes,
    abstract, {_TEXT} AS text, subject, year, month FROM keyed""",
)
def _(spark, sf):
    joined = {
        "authors": F.array_join("authors", ";"),
        "subject_codes": F.array_join("subject_codes", ","),
    }
    return prepare.paper_projection(B.keyed(spark, sf)).withColumns(joined)


@query(
    "paper_listing",
    """SELECT arxiv_id,
    CASE WHEN length(title) > 100 THEN substring(title, 1, 100) || '...' ELSE title END AS title,
    primary_subject, submission_date, year_month, round(x, 4) AS x, round(y, 4) AS y FROM current_""",
)
def _(spark, sf):
    return listing.paper_listing(B.current(spark, sf, vectors=False))


_HIT = """arxiv_id, title, array_to_string(authors[1:3], ';') AS authors, submission_date,
    year_month, primary_subject,
    CASE WHEN length(abstract) > 500 THEN substring(abstract, 1, 500) || '...' ELSE abstract END
    AS abstract, round(similarity, 4) AS score, round(x, 4) AS x, round(y, 4) AS y"""


@query("search_hit_projection", f"SELECT {_HIT} FROM scored")
def _(spark, sf):
    scored = B.current(spark, sf).where("embedding IS NOT NULL")
    scored = scored.withColumn("similarity", search.similarity(B.query_vector(spark, sf)))
    hits = listing.search_hit_projection(scored)
    return hits.withColumn("authors", F.array_join("authors", ";"))


@query(
    "subject_group",
    """SELECT DISTINCT subject, CASE WHEN instr(subject, '.') > 1 THEN split_part(subject, '.', 1)
    ELSE subject END AS prefix FROM keyed""",
)
def _(spark, sf):
    subjects = B.keyed(spark, sf).select("subject").distinct()
    return subjects.select("subject", X.subject_group("subject").alias("prefix"))


@query(
    "selection_hash",
    """SELECT year AS selection_id, substring(md5('{"categories": ["' ||
      string_agg(DISTINCT subject, '", "' ORDER BY subject) || '"], "year_months": ["' ||
      string_agg(DISTINCT year || '-' || month, '", "' ORDER BY year || '-' || month) ||
      '"]}'), 1, 12) AS key
    FROM manifest GROUP BY year""",
)
def _(spark, sf):
    chosen = B.manifest(spark, sf).withColumn("selection_id", F.col("year"))
    return reuse.selection_hash(chosen)


@query(
    "topics_key",
    """SELECT year, cast(count(DISTINCT subject) AS int) AS n_components,
      substring(md5('{"cat": null, "n": ' || count(DISTINCT subject) || ', "ym": ["' ||
      string_agg(DISTINCT year || '-' || month, '", "' ORDER BY year || '-' || month) ||
      '"]}'), 1, 12) AS key
    FROM manifest GROUP BY year""",
)
def _(spark, sf):
    wanted = B.manifest(spark, sf).groupBy("year").agg(
        F.count_distinct("subject").cast("int").alias("n_components"),
        F.collect_set(ym()).alias("months"),
    )
    nothing = F.lit(None).cast("array<string>")
    key = reuse.topics_key(F.col("n_components"), F.col("months"), nothing)
    return wanted.select("year", "n_components", key.alias("key"))


@query(
    "status_label",
    """SELECT subject, CASE
      WHEN emb > 0 AND emb = (SELECT count(*) FROM known_months) THEN n || ' embedded'
      WHEN emb > 0 THEN emb || ' mo' WHEN land > 0 THEN land || ' mo cached' ELSE 'New' END AS label
    FROM (SELECT subject, count(*) FILTER (embedded) AS emb, count(*) FILTER (downloaded) AS land,
            sum(n_rows) FILTER (embedded) AS n FROM status GROUP BY subject) s""",
)
def _(spark, sf):
    months = len(catalog.known_months(B.manifest(spark, sf)))
    return catalog.status_label(catalog.category_status(B.status(spark, sf)), months)


@query(
    "filter_year_months",
    "SELECT arxiv_id, year_month FROM current_ WHERE year_month IN ('2023-11', '2024-01', '2024-02')",
)
def _(spark, sf):
    rows = B.current(spark, sf, vectors=False)
    return filters.filter_year_months(rows, ["2023-11", "2024-01", "2024-02"]).select(
        "arxiv_id", "year_month"
    )


_CATEGORIES = ["Physics (General) (physics.gen-ph)", "Machine Learning (cs.LG)"]


@query(
    "filter_categories",
    f"SELECT arxiv_id, primary_subject FROM current_ WHERE primary_subject IN {tuple(_CATEGORIES)}",
)
def _(spark, sf):
    rows = B.current(spark, sf, vectors=False)
    return filters.filter_categories(rows, _CATEGORIES).select("arxiv_id", "primary_subject")


@query("drop_unkeyed", "SELECT arxiv_id, subject, year, month FROM keyed")
def _(spark, sf):
    keyed = prepare.drop_unkeyed(prepare.add_keys(B.papers(spark, sf)))
    return keyed.select("arxiv_id", "subject", "year", "month")


@query("valid_embeddings", "SELECT arxiv_id FROM current_ WHERE embedding IS NOT NULL")
def _(spark, sf):
    return filters.valid_embeddings(B.current(spark, sf)).select("arxiv_id")


@query(
    "restrict_to_hits",
    """SELECT arxiv_id, primary_subject FROM current_ WHERE arxiv_id IN
    (SELECT arxiv_id FROM scored ORDER BY similarity DESC, arxiv_id LIMIT 200)""",
)
def _(spark, sf):
    rows = B.current(spark, sf)
    hits = search.top_k(rows, B.query_vector(spark, sf))
    shown = B.current(spark, sf, vectors=False).select("arxiv_id", "primary_subject")
    return filters.restrict_to_hits(shown, hits)


@query("filter_topic", "SELECT arxiv_id, x, y FROM current_ WHERE dominant_topic = 2")
def _(spark, sf):
    rows = B.current(spark, sf, vectors=False)
    assigned = rows.select("arxiv_id", "dominant_topic")
    return filters.filter_topic(rows.select("arxiv_id", "x", "y"), assigned, 2)


@query(
    "drop_future_months",
    f"SELECT subject, year, month, n_rows FROM manifest WHERE year || '-' || month <= '{B.NOW}'",
)
def _(spark, sf):
    rows = B.manifest(spark, sf).select("subject", "year", "month", "n_rows")
    return filters.drop_future_months(rows, B.NOW)


@query(
    "last_n_months",
    f"""SELECT arxiv_id, year, month FROM keyed
    WHERE year || '-' || month BETWEEN '2023-07' AND '{B.NOW}'""",
)
def _(spark, sf):
    rows = B.keyed(spark, sf).select("arxiv_id", "year", "month")
    return filters.last_n_months(rows, B.NOW)
