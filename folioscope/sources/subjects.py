"""Subject codes and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_subject_codes(spark: SparkSession, path: str) -> DataFrame:
    """(code, name) rows of a JSON object that maps codes to names."""
    text = spark.read.text(path, wholetext=True)
    names = F.from_json("value", "map<string,string>")
    return text.select(F.explode(names).alias("code", "name"))


def subject_codes_from(papers: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(code, name) rows for the subjects of a table; an unknown name is the code itself."""
    codes = papers.select(F.col("subject").alias("code")).distinct()
    if names is None:
        return codes.withColumn("name", F.col("code"))
    joined = codes.join(names, "code", "left")
    return joined.select("code", F.coalesce("name", "code").alias("name"))


def save_subject_codes(codes: DataFrame, path: str) -> None:
    """Write (code, name) rows as one JSON object; there are as many rows as subjects."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "name"))))
    codes.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)
