"""Retrieval and linking metrics over all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import discount

CUTOFFS, NDCG_CUTOFFS, PRECISION_CUTOFF = (10, 50, 100, 200, 300, 500, 1000), (5, 10, 20), 10


def recall_at(ranked: DataFrame, qrels: DataFrame, cutoffs: tuple = CUTOFFS, least_grade: int = 1) -> DataFrame:
    """recall_k per query of (query_id, nct_id, rank) against (query_id, nct_id, grade); null without relevant ids."""
    relevant = qrels.filter(F.col("grade") >= least_grade).select("query_id", "nct_id").distinct()
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.join(relevant, ["query_id", "nct_id"]).groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cutoffs])
    queries = ranked.select("query_id").distinct()
    rows = queries.join(total, "query_id", "left").join(hits, "query_id", "left")
    return rows.select("query_id", *[F.when(F.col("n") > 0, F.coalesce(F.col(f"h{k}"), F.lit(0)) / F.col("n")).alias(f"recall_{k}") for k in cutoffs])


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked rows that were judged, with their grade, and ranks closed up."""
    rows = ranked.join(qrels.select("query_id", "nct_id", "grade"), ["query_id", "nct_id"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "nct_id")))


def precision_at(rows: DataFrame, k: int = PRECISION_CUTOFF, least_grade: int = 1) -> DataFrame:
    """precision (hits over k) and graded precision (grades up to 2 over 2k) of judged rows."""
    head = F.col("rank") <= k
    return rows.groupBy("query_id").agg((F.count_if(head & (F.col("grade") >= least_grade)) / k).alias("precision"), (F.sum(F.when(head, F.least("grade", F.lit(2))).otherwise(0)) / (2.0 * k)).alias("graded_precision"))


def ndcg_tie_aware(rows: DataFrame, k: int = 10, pool: DataFrame | None = None) -> DataFrame:
    """nDCG@k per query of (query_id, nct_id, score, grade), the members of a tie sharing its mean discount.

    The ideal is over the ranked rows, or over all judged rows if ``pool`` (query_id, grade) is given.
    """
    q = Window.partitionBy("query_id")
    at = rows.withColumn("r", F.row_number().over(q.orderBy(F.col("score").desc(), "nct_id")))
    at = at.withColumn("d", F.when(F.col("r") <= k, discount("r")).otherwise(0.0))
    tie = Window.partitionBy("query_id", "score")
    gain = at.withColumn("g", F.col("grade") * F.sum("d").over(tie) / F.count("*").over(tie)).groupBy("query_id").agg(F.sum("g").alias("dcg"))
    best = (pool if pool is not None else rows).select("query_id", "grade")
    best = best.withColumn("r", F.row_number().over(q.orderBy(F.col("grade").desc()))).filter(F.col("r") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(F.col("grade") * discount("r")).alias("ideal"))
    return gain.join(ideal, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def means(per_query: DataFrame, columns: list) -> DataFrame:
    """Macro means; nulls don't count."""
    return per_query.agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in columns])


def link_metrics(rows: DataFrame, keys: list | None = None) -> DataFrame:
    """Accuracy and precision, recall and F1 for links and for no-links of (gold, predicted); null or CUI-less is no link."""
    nil = lambda c: F.col(c).isNull() | F.col(c).isin("", "CUI-less")
    r = rows.withColumns({"gn": nil("gold"), "pn": nil("predicted")})
    right = (F.col("gn") & F.col("pn")) | (~F.col("gn") & ~F.col("pn") & (F.col("gold") == F.col("predicted")))
    sums = r.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.count_if(right).alias("ok"), F.count_if(right & ~F.col("gn")).alias("tp"), F.count_if(~F.col("pn")).alias("pp"), F.count_if(~F.col("gn")).alias("gp"),
        F.count_if(F.col("gn") & F.col("pn")).alias("tn"), F.count_if(F.col("pn")).alias("pnil"), F.count_if(F.col("gn")).alias("gnil"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    f1 = lambda p, q: F.when(F.col(p) + F.col(q) > 0, 2 * F.col(p) * F.col(q) / (F.col(p) + F.col(q))).otherwise(0.0)
    out = sums.withColumns({"accuracy": ratio("ok", "n"), "link_precision": ratio("tp", "pp"), "link_recall": ratio("tp", "gp"), "nil_precision": ratio("tn", "pnil"), "nil_recall": ratio("tn", "gnil")})
    out = out.withColumns({"link_f1": f1("link_precision", "link_recall"), "nil_f1": f1("nil_precision", "nil_recall")})
    return out.withColumn("macro_f1", (F.col("link_f1") + F.col("nil_f1")) / 2).drop("ok", "tp", "pp", "gp", "tn", "pnil", "gnil")


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Link metrics of (gold, candidate, quality) at every accept threshold: a short list, exploded beside each row."""
    grid = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return link_metrics(grid.withColumn("predicted", F.when(F.col("quality") >= F.col("threshold"), F.col("candidate"))), ["threshold"])


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the best macro F1, the lowest of equals."""
    return sweep.agg(F.max_by("threshold", F.struct(F.col("macro_f1"), -F.col("threshold"))).alias("threshold"))
