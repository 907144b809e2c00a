"""Topics, relevance judgements and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse

TOPIC = "_number string, summary string, description string, text string, _VALUE string"


def read_topics(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(query_id, raw_description) of an XML topic file: summary, else description, else text, else the body."""
    rows = spark.read.schema(TOPIC).option("rowTag", "topic").format("xml").load(path)
    parts = [F.nullif(collapse(c), F.lit("")) for c in ("summary", "description", "text", "_VALUE")]
    return rows.select(F.concat(F.lit(prefix), F.trim("_number")).alias("query_id"), F.coalesce(*parts).alias("raw_description")).filter("raw_description is not null")


def read_local_topics(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, raw_description) of JSON files, named by their query."""
    rows = spark.read.schema("raw_description string").option("multiLine", True).json(folder)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("query_id"), "raw_description").filter("raw_description is not null")


def read_qrels(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(query_id, nct_id, grade) of ``topic iter id grade`` lines; others are skipped and the last of equal keys holds."""
    line = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), F.monotonically_increasing_id().alias("at"))
    rows = line.filter(F.size("t") >= 4).select(F.concat(F.lit(prefix), F.col("t")[0]).alias("query_id"), F.col("t")[2].alias("nct_id"), F.col("t")[3].try_cast("int").alias("grade"), "at")
    out = rows.filter("grade is not null").groupBy("query_id", "nct_id").agg(F.max_by("grade", "at").alias("grade"))
    if out.limit(1).count() == 0:
        raise ValueError(f"no judgements in {path}")
    return out


def corpus_pool(qrels: DataFrame) -> DataFrame:
    return qrels.select("nct_id").distinct()


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None) -> DataFrame:
    """Training rows; a malformed line fails the read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if limit is None else df.limit(limit)


def chat_rows(df: DataFrame, system: str = "") -> DataFrame:
    """prompt and response columns to a list of messages."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    head = [turn("system", F.lit(system))] if system else []
    return df.select(F.array(*head, turn("user", F.col("prompt")), turn("assistant", F.col("response"))).alias("messages"))


def reranker_rows(df: DataFrame) -> DataFrame:
    """(query, text, label) to yes and no answers."""
    prompt = F.concat(F.lit("Query: "), "query", F.lit("\nText: "), "text", F.lit("\nRelevant?"))
    return chat_rows(df.select(prompt.alias("prompt"), F.when(F.col("label") > 0, "Yes").otherwise("No").alias("response")))


def ner_rows(df: DataFrame) -> DataFrame:
    """(text, annotations) to one record per text with its entities by group."""
    groups = F.array_distinct(F.transform("annotations", lambda a: a["entity_group"]))
    by = F.map_from_arrays(groups, F.transform(groups, lambda g: F.transform(F.filter("annotations", lambda a: a["entity_group"] == g), lambda a: a["text"])))
    return df.select("text", by.alias("entities"))
