"""Final ranking: eligibility bands from verdicts, blended with the reranker inside a band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_classification

#: The score of a disqualified trial, of an unclear verdict, and the share of a band gap that blending may use.
DISQUALIFIED, UNCLEAR, HEADROOM = -1.0, 0.5, 0.9


def eligibility_scores(verdicts: DataFrame, keys: list) -> DataFrame:
    """Bands from (keys, section, classification): any violated exclusion disqualifies; else the mean over met, not met and unclear."""
    c = norm_classification("classification")
    value = F.when(c == "met", 1.0).when(c == "not met", 0.0).when(c == "unclear", UNCLEAR)
    violated = F.max(((F.col("section") == "exclusion") & (c == "violated")).cast("int"))
    inclusion = F.when(F.col("section") == "inclusion", value)
    return verdicts.groupBy(*keys).agg(F.when(violated == 1, DISQUALIFIED).otherwise(F.coalesce(F.avg(inclusion), F.lit(0.0))).alias("band"))


def blend_ranks(rows: DataFrame, patient: str = "patient_id", trial: str = "nct_id") -> DataFrame:
    """Scores and ranks rows of (patient, trial, band, reranker, first_level).

    Inside a band the reranker, scaled over the patient's list, adds up to 0.9 of the smallest gap between
    the patient's distinct bands (1 if there is one), so no trial leaves its band.
    """
    mine = Window.partitionBy(patient)
    bands = rows.select(patient, "band").distinct()
    gap = bands.withColumn("gap", F.col("band") - F.lag("band").over(mine.orderBy("band"))).groupBy(patient).agg(F.coalesce(F.min("gap"), F.lit(1.0)).alias("gap"))
    low, high = F.min("reranker").over(mine), F.max("reranker").over(mine)
    span = F.when(high > low, high - low).otherwise(1.0)
    scored = rows.join(gap, patient).withColumn("score", F.bround(F.col("band") + (F.col("reranker") - low) / span * (HEADROOM * F.col("gap")), 10))
    order = [F.col("score").desc(), F.col("reranker").desc(), F.col("first_level").desc(), F.col(trial)]
    return scored.withColumn("rank", F.row_number().over(mine.orderBy(*order))).drop("gap")


def with_scores(verdict_bands: DataFrame, reranker: DataFrame, first_level: DataFrame, keys: list) -> DataFrame:
    """Left lookups of both scores, 0 where missing."""
    out = verdict_bands.join(reranker, keys, "left").join(first_level, keys, "left")
    return out.withColumns({"reranker": F.coalesce("reranker", F.lit(0.0)), "first_level": F.coalesce("first_level", F.lit(0.0))})
