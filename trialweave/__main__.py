"""``python -m trialweave``: stages, import, index, search, eval and health."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("trialweave").getOrCreate()


def main(argv: list[str] | None = None) -> None:
    from .operators import fusion, metrics, retrieval
    from .plans import config, stages
    from .sources import evaluation, patients, registry, sinks

    parser = argparse.ArgumentParser(prog="trialweave", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("stages", help="list the stages that a selection runs")
    p.add_argument("--only", nargs="*")
    p.add_argument("--skip", nargs="*", default=[])
    p.add_argument("--from", dest="first")
    p.add_argument("--to", dest="last")
    p = sub.add_parser("import-patient", help="patients of any known format to Parquet")
    p.add_argument("path")
    p.add_argument("out")
    p.add_argument("--today", required=True)
    p.add_argument("--format")
    p = sub.add_parser("prepare", help="registry studies (JSON lines) to trials and criteria")
    p.add_argument("studies")
    p.add_argument("out")
    p = sub.add_parser("search", help="ranked trials for one text")
    p.add_argument("trials")
    p.add_argument("query")
    p.add_argument("--size", type=int, default=20)
    p = sub.add_parser("eval", help="metrics of ranked results (query_id, nct_id, score) against judgements")
    p.add_argument("results")
    p.add_argument("qrels")
    sub.add_parser("healthcheck", help="settings and engine")
    a = parser.parse_args(argv)
    if a.command == "stages":
        print("\n".join(stages.select(a.only, tuple(a.skip), a.first, a.last)))
        return
    spark = _session()
    if a.command == "import-patient":
        got = patients.import_patients(spark, a.path, a.today, a.format)
        if isinstance(got, patients.Patients):
            got.patients.write.mode("overwrite").parquet(f"{a.out}/patients")
            got.facts.write.mode("overwrite").parquet(f"{a.out}/facts")
        else:
            got.write.mode("overwrite").parquet(f"{a.out}/notes")
    elif a.command == "prepare":
        trials = registry.prepare_trials(registry.normalize_studies(registry.read_studies(spark, a.studies)))
        sinks.trial_records(trials).write.mode("overwrite").parquet(f"{a.out}/trials")
        registry.prepare_criteria(trials).write.mode("overwrite").parquet(f"{a.out}/criteria")
    elif a.command == "search":
        trials = spark.read.parquet(a.trials)
        channel = spark.createDataFrame([("query", 0, "primary_condition", 1.0, [a.query])], "patient_id string, channel_idx int, kind string, weight double, terms array<string>")
        hits = retrieval.search_channels(trials, channel, retrieval.build_bm25(trials, "nct_id", "search_text"), a.size)
        for row in hits.orderBy("rank").limit(a.size).toLocalIterator():
            print(json.dumps({"rank": row.rank, "nct_id": row.nct_id, "score": round(row.score, 6)}))
    elif a.command == "eval":
        ranked = fusion.ranked(spark.read.parquet(a.results), ["query_id"], [F.col("score").desc(), "nct_id"])
        qrels = evaluation.read_qrels(spark, a.qrels)
        rows = metrics.judged(ranked, qrels)
        per = metrics.recall_at(ranked, qrels).join(metrics.precision_at(rows), "query_id", "left")
        for k in metrics.NDCG_CUTOFFS:
            per = per.join(metrics.ndcg_tie_aware(rows, k).withColumnRenamed("ndcg", f"ndcg_{k}"), "query_id", "left")
        print(json.dumps(metrics.means(per, per.columns[1:]).first().asDict(), indent=2))
    else:
        print(json.dumps({"spark": spark.version, "settings": config.load()}, indent=2))


if __name__ == "__main__":
    main()
