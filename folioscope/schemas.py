"""Table schemas. Partition keys are strings, months have two digits."""

from pyspark.sql import types as T

KEYS = ("subject", "year", "month")

_KEY_FIELDS = [T.StructField(k, T.StringType()) for k in KEYS]

RAW_PAPER = T.StructType(
    [
        T.StructField("arxiv_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("submission_date", T.StringType()),
        T.StructField("primary_subject", T.StringType()),
        T.StructField("subjects", T.StringType()),
        T.StructField("abstract", T.StringType()),
    ]
)

KEYED_PAPER = T.StructType(RAW_PAPER.fields + _KEY_FIELDS)

EMBEDDED_PAPER = T.StructType(
    [
        T.StructField("arxiv_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.ArrayType(T.StringType())),
        T.StructField("submission_date", T.StringType()),
        T.StructField("primary_subject", T.StringType()),
        T.StructField("subject_codes", T.ArrayType(T.StringType())),
        T.StructField("abstract", T.StringType()),
        T.StructField("year_month", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *_KEY_FIELDS,
    ]
)

MANIFEST = T.StructType(
    [
        *_KEY_FIELDS,
        T.StructField("n_rows", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("downloaded", T.BooleanType()),
        T.StructField("embedded", T.BooleanType()),
        T.StructField("embedded_at", T.LongType()),
    ]
)

TOPIC_TERM = "topic_id int, rank int, term string, weight double, doc_count bigint"
TOPIC_ASSIGNMENT = "arxiv_id string, topic_weights array<double>, dominant_topic int"
