"""Eligibility reasoning around a model: worklist, prompts, batches by length, answers to verdicts.

The model itself is a plug-in (:func:`.entities.apply_model`); everything before and after it is relational.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import col
from ..functions.text import collapse, strip_thinking

#: Fields of an answer.
VERDICTS = "array<struct<Criterion:string,Classification:string,Justification:string>>"
ANSWER = f"struct<Inclusion_Criteria_Evaluation:{VERDICTS},Exclusion_Criteria_Evaluation:{VERDICTS},Recap:string,`Final Decision`:string>"


def first_object(text: str | None) -> str | None:
    """The first complete JSON object in a text, or null: braces are tried in order with a real decoder."""
    decoder, at = json.JSONDecoder(), (text or "").find("{")
    while at >= 0:
        try:
            _, end = decoder.raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def extract_json(df: DataFrame, answer: str, out: str = "json") -> DataFrame:
    @F.pandas_udf("string")
    def pick(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return df.withColumn(out, pick(strip_thinking(answer)))


def worklist(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """(patient_id, nct_id) pairs without a result, or whose last result is an error."""
    good = results.filter("error is null").select("patient_id", "nct_id").distinct()
    return pairs.join(good, ["patient_id", "nct_id"], "left_anti")


def prompts(pairs: DataFrame, criteria: DataFrame, narratives: DataFrame, limit: int = 12_000) -> DataFrame:
    """(patient_id, nct_id, prompt): a trial's criteria by type and a patient's sentences, each cut at a blank within ``limit`` characters."""
    line = F.concat(F.lit("- "), collapse("criterion"))
    section = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("eligibility_type") == kind, F.struct("ordinal", line.alias("t"))))), lambda x: x["t"]), "\n")
    trial = criteria.groupBy("nct_id").agg(section("inclusion").alias("inc"), section("exclusion").alias("exc"))
    cut = lambda c: F.when(F.length(c) > limit, F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*$", "")).otherwise(c)
    rows = pairs.join(trial, "nct_id", "left").join(narratives, "patient_id", "left")
    text = F.concat(F.lit("Judge each criterion by the patient's facts only and answer as JSON.\nInclusion:\n"), cut(F.coalesce("inc", F.lit(""))), F.lit("\nExclusion:\n"), cut(F.coalesce("exc", F.lit(""))), F.lit("\nPatient:\n"), cut(F.coalesce(F.array_join("sentences", "\n"), F.lit(""))))
    return rows.select("patient_id", "nct_id", text.alias("prompt"))


def length_batches(df: DataFrame, text: str, size: int, keys: list | None = None) -> DataFrame:
    """Adds ``batch``: rows of similar length side by side, ``size`` to a batch, within the keys (or 1,024 hashed shares, so no task sorts all)."""
    share = [F.col(k) for k in keys] if keys else [F.pmod(F.xxhash64(text), F.lit(1024))]
    w = Window.partitionBy(*share).orderBy(F.length(text), text)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def parse_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdict rows (patient_id, nct_id, section, criterion, classification, justification) and (patient_id, nct_id, decision, error)."""
    rows = extract_json(answers, "answer").withColumn("a", F.from_json("json", ANSWER))
    bad = F.col("json").isNull() | (F.col("a.Inclusion_Criteria_Evaluation").isNull() & F.col("a.Exclusion_Criteria_Evaluation").isNull())
    status = rows.select("patient_id", "nct_id", F.col("a.`Final Decision`").alias("decision"), F.when(bad, "no verdicts in the answer").alias("error"))

    def part(section: str, field: str) -> DataFrame:
        v = rows.select("patient_id", "nct_id", F.explode(f"a.{field}").alias("v"))
        return v.select("patient_id", "nct_id", F.lit(section).alias("section"), F.col("v.Criterion").alias("criterion"), F.col("v.Classification").alias("classification"), F.col("v.Justification").alias("justification"))

    return part("inclusion", "Inclusion_Criteria_Evaluation").unionByName(part("exclusion", "Exclusion_Criteria_Evaluation")), status


def bands_with_errors(bands: DataFrame, status: DataFrame, disqualified: float = -1.0) -> DataFrame:
    """Bands of answered trials; trials whose answer is an error are disqualified."""
    out = status.join(bands, ["patient_id", "nct_id"], "left")
    return out.select("patient_id", "nct_id", F.when(F.col("band").isNull() & F.col("error").isNotNull(), disqualified).otherwise(F.coalesce("band", F.lit(0.0))).alias("band"))


def enrich(summary: DataFrame, expansion: DataFrame, max_main: int = 11, max_other: int = 50) -> DataFrame:
    """A model's lists over a summary's: those that aren't empty replace it, cut to their caps."""
    e = expansion.select("patient_id", F.col("main_conditions").alias("_m"), F.col("other_conditions").alias("_o"), F.col("expanded_sentences").alias("_s"))
    pick = lambda new, old, cap=None: F.when(F.size(F.coalesce(F.col(new), F.array().cast("array<string>"))) > 0, F.slice(new, 1, cap) if cap else F.col(new)).otherwise(F.col(old))
    out = summary.join(e, "patient_id", "left")
    return out.withColumns({"main_conditions": pick("_m", "main_conditions", max_main), "other_conditions": pick("_o", "other_conditions", max_other), "patient_narrative": pick("_s", "patient_narrative")}).drop("_m", "_o", "_s")


def entity_defaults(entities) -> Column:
    """Entities with every field present: no text, ids, synonyms or candidates are empty, not null."""
    none = F.array().cast("array<string>")
    return F.transform(col(entities), lambda e: F.struct(F.coalesce(e["entity_group"], F.lit("")).alias("entity_group"), F.coalesce(e["text"], F.lit("")).alias("text"), F.coalesce(e["normalized_id"], none).alias("normalized_id"), F.coalesce(e["synonyms"], none).alias("synonyms")))
