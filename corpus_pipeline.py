"""A training corpus from ``documents`` in five stages, each by one operator of ``trialweave.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of ``documents``.

toxicity
    Rows whose score reaches the threshold go. The classifier learns from ``labels`` and the stage's input.
    Null and empty texts get the intercept's score; equal rows are decided alike.
near_duplicates
    Of each group of linked rows the one with the smallest doc_id stays, in one row if it was repeated. Rows
    that share a doc_id, or have none (which counts as the largest), are told apart by their sets of shingles.
    Null and empty texts, which are linked with nothing, stay, however often they repeat.
repeated_passages
    Windows of 50 words that a smaller doc_id has are cut from the text and n_chars is set anew; documents
    that lose all their words go. Texts without a repeat are untouched; rows of one doc_id never cut each other.
decontamination
    Documents in which a benchmark item leaks go; of an item of fewer than 5 words, those that are nothing else.
    Null and empty texts stay.
mixing
    The last stage keeps the documents that the mix takes and says how often (copies, taken). Null and empty
    texts have size 0 and go with the rest of their source; a null source is one of its own. Columns of the
    names that it adds (size, source_size, target, copies, taken) are replaced.

An empty table passes all stages. Extra columns pass the first four unchanged, whatever their names (but for
names that begin with ``__tw_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm.common import Scratch, is_small, table
from trialweave.llm.jaccard import jaccard_rows, with_label
from trialweave.llm.leaks import mark_leaks
from trialweave.llm.mixing import apply_mix
from trialweave.llm.queries import held_out
from trialweave.llm.repeats import remove_repeats
from trialweave.llm.toxicity import fit_toxicity, score_toxicity

#: Ids (8 bytes each) up to which a list of documents is broadcast.
_IDS = 400_000
#: Stands for a null doc_id, which comes after all others.
_LAST = 2**63 - 1
#: Words from which a benchmark item inside a text is a leak; a shorter one is only if it is the whole text.
_TELLING = 5


def _names(columns) -> list[str]:
    return [f"`{c}`" for c in columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    clash = {c: f"__tw_{c}" for c in docs.columns if c in ("score", "predicted")}  # their names are the classifier's
    scored = score_toxicity(docs.withColumnsRenamed(clash), model).filter("predicted = 0").drop("score", "predicted")
    return scored.withColumnsRenamed({v: k for k, v in clash.items()}).select(*_names(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "near")
    key = lambda c: F.coalesce(c, F.lit(_LAST))
    found = scratch.keep(jaccard_rows(docs).select(key("doc_id").alias("__tw_id"), F.col("label").alias("__tw_label"), "part"), "groups")
    me = F.struct("__tw_id", "__tw_label")
    first = found.filter("part is not null").groupBy("part").agg(F.min(me).alias("first"))
    found = found.join(first, "part", "left").select("__tw_id", "__tw_label", (F.col("part").isNull() | (me == F.col("first"))).alias("stays"))
    found = scratch.keep(found, "marked")
    # most ids are of one row, which the id decides about; rows of a repeated or null id are told apart by their class
    again = found.groupBy("__tw_id").count().filter((F.col("count") > 1) | (F.col("__tw_id") == _LAST)).select("__tw_id")
    again = scratch.keep(again, "again")
    gone = scratch.keep(found.filter("not stays").select("__tw_id").unionByName(again).distinct(), "gone")
    kept = docs.join(F.broadcast(gone) if is_small(gone, _IDS) else gone, key(docs["doc_id"]) == F.col("__tw_id"), "left_anti")
    if again.isEmpty():
        return kept
    rows = docs.join(again, key(docs["doc_id"]) == F.col("__tw_id"), "left_semi").withColumn("__tw_id", key("doc_id"))
    rows = with_label(rows, "__tw_label").join(found.filter("stays").drop("stays").distinct(), ["__tw_id", "__tw_label"], "left_semi")
    once = rows.filter("__tw_label <> 0").dropDuplicates(["__tw_id", "__tw_label"])
    return kept.unionByName(once.unionByName(rows.filter("__tw_label = 0")).select(*_names(docs.columns)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clash = {c: f"__tw_{c}" for c in docs.columns if c in ("n_words", "n_removed")}  # their names are the operator's
    cut = remove_repeats(docs.withColumnsRenamed(clash)).filter("n_removed = 0 or n_removed < n_words")
    size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    cut = cut.withColumn("n_chars", size).drop("n_words", "n_removed")
    return cut.withColumnsRenamed({v: k for k, v in clash.items()}).select(*_names(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clash = {c: f"__tw_{c}" for c in docs.columns if c == "leaks"}
    words = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    leak = F.exists("leaks", lambda x: (x["item_words"] >= _TELLING) | (x["item_words"] == words))
    clean = mark_leaks(docs.withColumnsRenamed(clash), table(spark, sf_dir, "benchmark")).filter(~leak).drop("leaks")
    return clean.withColumnsRenamed({v: k for k, v in clash.items()}).select(*_names(docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: SQL can't express a trained classifier or LSH; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
