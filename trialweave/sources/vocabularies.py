"""Concept vocabularies: OMOP tables, dictionaries, OBO and gene tables, to one concept schema."""

from __future__ import annotations

import urllib.request
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import distinct_terms

#: Open vocabularies that can be fetched where there is a network: url, format, prefix.
OPEN_SOURCES = {
    "genes": ("https://ftp.ncbi.nlm.nih.gov/gene/DATA/GENE_INFO/Mammalia/Homo_sapiens.gene_info.gz", "gene_info", "EntrezGene"),
    "diseases": ("http://purl.obolibrary.org/obo/doid.obo", "obo", "DOID"),
    "chemicals": ("https://ftp.ebi.ac.uk/pub/databases/chebi/ontology/chebi_lite.obo.gz", "obo", "CHEBI"),
    "cell_lines": ("https://ftp.expasy.org/databases/cellosaurus/cellosaurus.obo", "obo", "CVCL"),
    "cell_types": ("http://purl.obolibrary.org/obo/cl.obo", "obo", "CL"),
    "phenotypes": ("http://purl.obolibrary.org/obo/hp.obo", "obo", "HP"),
}


def _concepts(df: DataFrame) -> DataFrame:
    """The common columns, with names for full-text search."""
    columns = ["concept_id", "vocabulary_id", "concept_code", "concept_name", "domain_id", "concept_class_id", "standard_concept", "synonyms"]
    names = F.concat(F.array("concept_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).withColumn("fts_text", F.array_join(names, " "))


def omop_concepts(spark: SparkSession, concept: str, synonym: str | None = None, vocabularies: list | None = None) -> DataFrame:
    """Valid rows of a tab-separated CONCEPT table, with synonyms in file order, each once but for case."""
    read = lambda p: spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(p)
    rows = read(concept)
    rows = rows.toDF(*[c.lstrip("﻿").lower() for c in rows.columns])
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    rows = rows.filter(filled("concept_id") & filled("concept_name") & filled("concept_code") & ~filled("invalid_reason"))
    if vocabularies:
        rows = rows.filter(F.lower("vocabulary_id").isin([v.lower() for v in vocabularies]))
    if synonym:
        s = read(synonym)
        s = s.toDF(*[c.lstrip("﻿").lower() for c in s.columns]).withColumn("_at", F.monotonically_increasing_id())
        lists = s.groupBy("concept_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "concept_synonym_name"))), lambda x: x["concept_synonym_name"]).alias("synonyms"))
        rows = rows.join(lists.withColumn("synonyms", distinct_terms("synonyms")), "concept_id", "left")
    else:
        rows = rows.withColumn("synonyms", F.array().cast("array<string>"))
    return _concepts(rows.withColumn("synonyms", F.filter(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: F.lower(x) != F.lower("concept_name"))))


def _bare(code: Column, vocabulary: str) -> Column:
    prefix = f"{vocabulary}:".lower()
    return F.when(F.lower(F.substring(code, 1, len(prefix))) == prefix, F.substring(code, F.lit(len(prefix) + 1), F.length(code))).otherwise(code)


def dictionary_concepts(spark: SparkSession, path: str, vocabulary: str, domain: str = "", concept_class: str = "") -> DataFrame:
    """Lines ``id1,id2||name|synonym...``: a row per id, without the vocabulary's own prefix."""
    lines = spark.read.text(path).filter(F.col("value").contains("||"))
    at = F.instr("value", "||")
    names = F.filter(F.transform(F.split(F.substring(F.col("value"), at + 2, F.length("value")), r"\|"), lambda n: F.trim(n)), lambda n: n != "")
    rows = lines.select(F.explode(F.split(F.substring(F.col("value"), F.lit(1), at - 1), ",")).alias("id"), distinct_terms(names).alias("names"))
    rows = rows.select(F.trim("id").alias("id"), "names").filter((F.col("id") != "") & (F.size("names") > 0))
    code = _bare(F.col("id"), vocabulary)
    return _concepts(rows.select(F.concat(F.lit(f"{vocabulary}:"), code).alias("concept_id"), F.lit(vocabulary).alias("vocabulary_id"), code.alias("concept_code"), F.element_at("names", 1).alias("concept_name"), F.lit(domain).alias("domain_id"), F.lit(concept_class).alias("concept_class_id"), F.lit("").alias("standard_concept"), F.slice("names", F.lit(2), F.size("names")).alias("synonyms")))


def obo_terms(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """(id, names) of the [Term] stanzas that aren't obsolete, synonyms after the name; stanzas are split by the reader."""
    stanzas = spark.read.option("lineSep", "\n[").text(path).select(F.concat(F.lit("\n"), "value").alias("s")).filter(F.col("s").rlike(r"^\n\[?Term\]"))
    tag = lambda t: F.trim(F.regexp_extract("s", rf"\n{t}: ([^\n]*)", 1))
    synonyms = F.regexp_extract_all("s", F.lit(r'\nsynonym: "((?:[^"\\]|\\.)*)"'), F.lit(1))
    rows = stanzas.filter(tag("is_obsolete") != "true").select(tag("id").alias("id"), distinct_terms(F.concat(F.array(tag("name")), synonyms)).alias("names"))
    rows = rows.filter((F.col("id") != "") & (F.size("names") > 0))
    return rows.filter(F.col("id").startswith(f"{prefix}:")) if prefix else rows


def gene_terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, names) of a gene table: symbol, authoritative symbol, full name, synonyms, other designations; "-" is none."""
    cells = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 14)
    one = lambda i: F.array(F.col("c")[i])
    many = lambda i: F.split(F.col("c")[i], r"\|")
    names = F.filter(F.concat(one(2), one(10), one(11), many(4), many(13)), lambda n: n != "-")
    return cells.select(F.col("c")[1].alias("id"), distinct_terms(names).alias("names")).filter(F.size("names") > 0)


def write_dictionary(terms: DataFrame, path: str) -> None:
    """``id||name|synonym...`` lines, by Spark's committer."""
    terms.select(F.concat("id", F.lit("||"), F.array_join(F.transform("names", lambda n: F.replace(n, F.lit("|"), F.lit("/"))), "|")).alias("value")).write.mode("overwrite").text(path)


def fetch(name: str, folder: str, force: bool = False) -> str:
    """Downloads an open vocabulary (needs a network); the file's path."""
    url = OPEN_SOURCES[name][0]
    target = Path(folder) / url.rsplit("/", 1)[1]
    if force or not target.exists():
        part = target.with_suffix(target.suffix + ".part")
        urllib.request.urlretrieve(url, part)  # noqa: S310
        part.replace(target)
    return str(target)
