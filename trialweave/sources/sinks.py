"""Results, reports and exports."""

from __future__ import annotations

import hashlib
import json
import os
import tarfile
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import TRIAL_VECTOR_WEIGHTS
from ..functions.text import flatten_text
from ..functions.vectors import mean_vector
from ..operators.upsert import VersionedTable, replaced


def trial_records(trials: DataFrame) -> DataFrame:
    """Index columns of trials: search_text of the six text fields in order, and the mean of the four vectors."""
    order = ("condition", "eligibility_criteria", "brief_title", "brief_summary", "detailed_description", "official_title")
    texts = [c for c in order if c in trials.columns]
    vectors = [c for c in TRIAL_VECTOR_WEIGHTS if c in trials.columns]
    out = trials.withColumn("search_text", flatten_text(*texts))
    return out.withColumn("search_vector", mean_vector(*vectors)) if vectors else out


def criteria_records(criteria: DataFrame, least: float = 0.6) -> DataFrame:
    """Index columns of criteria: entity texts, and synonyms with the names of candidates that score enough or have no score."""
    entities = F.coalesce("entities", F.array().cast(criteria.schema["entities"].dataType))
    texts = F.transform(entities, lambda e: e["text"])
    good = lambda e: F.transform(F.filter(e["concept_candidates"], lambda c: c["score"].isNull() | (c["score"] >= least)), lambda c: c["concept_name"])
    names = F.flatten(F.transform(entities, lambda e: F.concat(F.coalesce(e["synonyms"], F.array().cast("array<string>")), F.coalesce(good(e), F.array().cast("array<string>")))))
    return criteria.withColumns({"entity_text": flatten_text(texts), "entity_synonyms_text": flatten_text(names)})


def write_results(stages: dict[str, DataFrame], path: str) -> None:
    """One table of results, partitioned by stage; each stage is overwritten on its own."""
    for stage, df in stages.items():
        df.select("patient_id", F.to_json(F.struct(*[c for c in df.columns if c != "patient_id"])).alias("result")).write.mode("overwrite").parquet(f"{path}/stage={stage}")


def append_manifest(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def export_fhir(patients: DataFrame, facts: DataFrame) -> DataFrame:
    """(patient_id, bundle): a JSON bundle per patient; family history and notes are not exported."""
    kinds = F.create_map(*[F.lit(x) for kv in {"conditions": "Condition", "phenotypes": "Condition", "cancer_profile": "Condition", "medications": "MedicationStatement", "procedures": "Procedure"}.items() for x in kv])
    kind = F.coalesce(kinds[F.col("bucket")], F.lit("Observation"))
    status = F.when(F.col("negated"), "refuted").otherwise("confirmed")
    entry = F.struct(F.struct(kind.alias("resourceType"), F.col("fact_id").alias("id"), F.struct(F.col("label").alias("text")).alias("code"), F.struct(F.concat(F.lit("Patient/"), "patient_id").alias("reference")).alias("subject"), F.struct(status.alias("text")).alias("verificationStatus")).alias("resource"))
    lists = facts.filter("bucket <> 'family_history'").groupBy("patient_id").agg(F.sort_array(F.collect_list(F.to_json(entry))).alias("entries"))
    head = F.to_json(F.struct(F.struct(F.lit("Patient").alias("resourceType"), F.col("patient_id").alias("id"), F.lower("sex").alias("gender")).alias("resource")))
    both = patients.join(lists, "patient_id", "left").withColumn("all", F.concat(F.array(head), F.coalesce("entries", F.array().cast("array<string>"))))
    return both.select("patient_id", F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join("all", ","), F.lit("]}")).alias("bundle"))


def export_phenopacket(patients: DataFrame, facts: DataFrame) -> DataFrame:
    """(patient_id, packet): phenotypes and diseases as terms with their exclusion."""
    term = lambda: F.struct(F.struct(F.get("codes", F.lit(0)).alias("id"), F.col("label").alias("label")).alias("term"), F.col("negated").alias("excluded"))
    pick = lambda *b: F.sort_array(F.collect_list(F.when(F.col("bucket").isin(*b), term())))
    lists = facts.groupBy("patient_id").agg(pick("phenotypes").alias("phenotypicFeatures"), pick("conditions", "cancer_profile").alias("diseases"))
    rows = patients.join(lists, "patient_id", "left")
    packet = F.struct(F.col("patient_id").alias("id"), F.struct(F.col("patient_id").alias("id"), F.upper("sex").alias("sex")).alias("subject"), "phenotypicFeatures", "diseases")
    return rows.select("patient_id", F.to_json(packet).alias("packet"))


def json_payload(*columns: str) -> Column:
    """The columns as one JSON object, with its keys in order; the columns of a row that are null are left out."""
    return F.to_json(F.struct(*sorted(columns)))


def write_prepared(trials: DataFrame, criteria: DataFrame, path: str, key: str = "nct_id") -> None:
    """Puts prepared trials and all their criteria in place of what was there for those ids, criteria first.

    A trial's row is the mark that its criteria are written; criteria of an older text of the trial go. Both
    tables are versions, so that readers see no half of a write.
    """
    spark = trials.sparkSession
    rows = VersionedTable(spark, f"{path.rstrip('/')}/criteria")
    now = rows.read()
    rows.write(criteria if now is None else replaced(now, trials, criteria, key))
    VersionedTable(spark, f"{path.rstrip('/')}/trials").upsert(trials, key)


def report_rows(ranked: DataFrame, eligibility: DataFrame, metadata: DataFrame) -> DataFrame:
    """Ranked trials with verdicts and metadata, vectors left out.

    A list that carries no rank gets its position by score, where it has one, then id.
    """
    meta = metadata.select([c for c in metadata.columns if not c.endswith("_vector")])
    if "rank" not in ranked.columns:
        order = [F.col("score").desc()] if "score" in ranked.columns else []
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("patient_id").orderBy(*order, "nct_id")))
    return ranked.join(eligibility, ["patient_id", "nct_id"], "left").join(meta, "nct_id", "left")


#: Statuses of the summary in order, their titles, and how many lines each has at most.
SUMMARY, SUMMARY_LINES = (("matched", "Matched"), ("violated", "Violated"), ("unknown", "Unknown")), 8


def constraint_summaries(evaluations: DataFrame, top: DataFrame) -> DataFrame:
    """(patient_id, markdown): the effect of constraints on each trial, ranked trials first, then others by id.

    ``evaluations``: patient_id, nct_id, criteria_id, at, label, kind, status, signal, evidence_text, and the fact that answered.
    ``top``: patient_id, nct_id, rank, score. Each trial shows the first lines of a status; the evaluations keep them all.
    """
    patient = F.coalesce(F.col("fact.evidence_text"), F.col("fact.label"), F.lit("no patient evidence"))
    line = F.concat(F.lit("  - "), F.coalesce("label", "kind"), F.lit(". Patient: "), patient, F.lit(". Trial: "), F.coalesce("evidence_text", F.lit("")), F.lit("."))
    w = Window.partitionBy("patient_id", "nct_id", "status").orderBy("criteria_id", "at")
    few = evaluations.withColumn("_n", F.row_number().over(w)).withColumn("_line", F.when(F.col("_n") <= SUMMARY_LINES, line))
    lists = {s: F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == s) & F.col("_line").isNotNull(), F.struct("_n", "_line")))), lambda x: x["_line"]) for s, _ in SUMMARY}
    per = few.groupBy("patient_id", "nct_id").agg(F.sum("signal").alias("_signal"), *[v.alias(f"_{s}") for s, v in lists.items()])
    rows = per.join(top.select("patient_id", "nct_id", "rank", "score"), ["patient_id", "nct_id"], "full_outer")
    shift = F.when(F.col("_signal") > 0.05, "boosted").when(F.col("_signal") < -0.05, "penalized").when(F.col("_signal").isNotNull(), "unchanged")
    block = [F.concat(F.lit("## "), F.col("nct_id").cast("string")), F.concat(F.lit("- Retrieval score: "), F.format_string("%.4f", F.col("score").cast("double"))), F.concat(F.lit("- Constraint ranking effect: "), shift)]
    block[1] = F.when(F.col("score").isNotNull(), block[1])
    for s, title in SUMMARY:
        block.append(F.when(F.size(f"_{s}") > 0, F.concat(F.lit(f"- {title}:\n"), F.array_join(f"_{s}", "\n"))))
    rows = rows.withColumn("_text", F.concat_ws("\n", *block))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank").isNull().alias("_late"), F.coalesce("rank", F.lit(0)).alias("_rank"), F.col("nct_id").alias("_id"), "_text")))
    return rows.groupBy("patient_id").agg(F.concat(F.lit("# Constraints and ranking\n\n"), F.array_join(F.transform(ordered, lambda x: x["_text"]), "\n\n"), F.lit("\n")).alias("markdown"))


def render_html(rows: list[dict], title: str) -> str:
    """A page with the rows as a JSON island, safe to embed."""
    island = json.dumps(rows, default=str).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{safe}</title></head><body><h1>{safe}</h1><script type="application/json" id="data">{island}</script></body></html>'


def atomic_write(path: str, content: str) -> None:
    """Writes a file beside the target, syncs it and moves it in place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, target)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def valid_json(path: str) -> bool:
    try:
        json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return False
    return True


def unpack(archive: str, folder: str, sha256: str | None = None) -> bool:
    """Unpacks an archive once: checks its digest, refuses members that would leave the folder, then marks completion."""
    done = Path(folder) / ".complete"
    if done.exists():
        return False
    if sha256 and hashlib.sha256(Path(archive).read_bytes()).hexdigest() != sha256:
        raise ValueError("digest of the archive differs")
    root = Path(folder).resolve()
    opened = zipfile.ZipFile(archive) if archive.endswith(".zip") else tarfile.open(archive)
    with opened as a:
        for name in a.namelist() if isinstance(a, zipfile.ZipFile) else a.getnames():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} leaves the folder")
        a.extractall(root) if isinstance(a, zipfile.ZipFile) else a.extractall(root, filter="data")
    done.touch()
    return True
