"""Registry studies: paged source, normalisation and preparation of trials."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import age_to_years, parse_date, to_iso_date
from ..functions.text import collapse
from ..operators.chunking import chunk_criteria

# Request limits of the registry.
RETRY_CODES, RETRIES, PER_SECOND, MAX_PAGE = (408, 425, 429, 500, 502, 503, 504), 4, 2.0, 1000
DEFAULT_SINCE_DAYS, FAILURE_THRESHOLD = 7, 0.25

_NAMED = "array<struct<name:string,type:string,description:string>>"
_DATE = "struct<date:string>"
STUDY_SCHEMA = (
    "protocolSection struct<"
    "identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,"
    f"statusModule:struct<overallStatus:string,startDateStruct:{_DATE},completionDateStruct:{_DATE},lastUpdatePostDateStruct:{_DATE}>,"
    "descriptionModule:struct<briefSummary:string,detailedDescription:string>,"
    "conditionsModule:struct<conditions:array<string>>,"
    "designModule:struct<phases:array<string>,studyType:string>,"
    "eligibilityModule:struct<eligibilityCriteria:string,sex:string,minimumAge:string,maximumAge:string>,"
    f"armsInterventionsModule:struct<interventions:{_NAMED}>,"
    "contactsLocationsModule:struct<locations:array<struct<facility:string,city:string,state:string,country:string,status:string>>>,"
    "referencesModule:struct<references:array<struct<pmid:string,citation:string,type:string>>>>"
)


def pages(fetch: Callable[[dict], tuple[int, dict]], query: str, statuses: list[str] | None = None, page_size: int = 100, limit: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Studies page by page. ``fetch(params)`` gives a status code and a decoded body; retried with jitter, throttled."""
    params = {"query.term": query, "pageSize": max(1, min(MAX_PAGE, page_size))}
    if statuses:
        params["filter.overallStatus"] = "|".join(statuses)
    sent = 0
    while True:
        for attempt in range(RETRIES + 1):
            code, body = fetch(dict(params))
            if code == 200:
                break
            if code not in RETRY_CODES or attempt == RETRIES:
                raise OSError(f"registry answered {code}")
            sleep(2**attempt + random.random())
        for study in body.get("studies", []):
            if limit is not None and sent >= limit:
                return
            sent += 1
            yield study
        if not body.get("nextPageToken"):
            return
        params["pageToken"] = body["nextPageToken"]
        sleep(1 / PER_SECOND)


def land(studies: Iterator[dict], path: str) -> int:
    """Writes studies as JSON lines for Spark to read; the number of them."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for n, study in enumerate(studies, 1):  # noqa: B007
            f.write(json.dumps(study, ensure_ascii=False) + "\n")
    return n


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STUDY_SCHEMA).json(path)


def read_trial_json(spark: SparkSession, folder: str, schema: str | None = None, ids: list | None = None) -> DataFrame:
    """Trial documents, one JSON file each, optionally of some ids only."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json")
    df = (reader.schema(schema) if schema else reader).json(folder)
    return df.filter(F.col("nct_id").isin(ids)) if ids else df


def read_criteria_json(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Criteria in ``<trial>/<criterion>.json``."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    return (reader.schema(schema) if schema else reader).json(folder)


def updated_since(df: DataFrame, since: str, *dates: str) -> DataFrame:
    """Rows whose first known date isn't before ``since``; rows without a date pass."""
    date = F.coalesce(*[parse_date(d) for d in dates])
    return df.filter(date.isNull() | (date >= F.to_date(F.lit(since))))


def _text(path: str) -> Column:
    return F.nullif(collapse(F.col(f"protocolSection.{path}")), F.lit(""))


def normalize_studies(studies: DataFrame) -> DataFrame:
    """One row per study with an id; empty values are null."""
    lines = F.transform(F.split(F.coalesce("protocolSection.eligibilityModule.eligibilityCriteria", F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    kept = lambda path: F.filter(F.transform(F.col(f"protocolSection.{path}"), lambda x: collapse(x)), lambda x: x != "")
    rows = studies.select(
        _text("identificationModule.nctId").alias("nct_id"),
        F.lit("clinicaltrials.gov").alias("source"),
        _text("identificationModule.briefTitle").alias("brief_title"),
        _text("identificationModule.officialTitle").alias("official_title"),
        _text("descriptionModule.briefSummary").alias("brief_summary"),
        _text("descriptionModule.detailedDescription").alias("detailed_description"),
        kept("conditionsModule.conditions").alias("condition"),
        F.nullif(F.trim(F.array_join(lines, "\n")), F.lit("")).alias("eligibility_criteria"),
        _text("statusModule.overallStatus").alias("overall_status"),
        F.nullif(F.array_join(kept("designModule.phases"), ", "), F.lit("")).alias("phase"),
        _text("designModule.studyType").alias("study_type"),
        F.coalesce(_text("eligibilityModule.sex"), F.lit("All")).alias("gender"),
        _text("eligibilityModule.minimumAge").alias("minimum_age"),
        _text("eligibilityModule.maximumAge").alias("maximum_age"),
        _text("statusModule.startDateStruct.date").alias("start_date"),
        _text("statusModule.completionDateStruct.date").alias("completion_date"),
        _text("statusModule.lastUpdatePostDateStruct.date").alias("last_update_posted"),
        F.col("protocolSection.armsInterventionsModule.interventions").alias("intervention"),
        F.col("protocolSection.contactsLocationsModule.locations").alias("location"),
        F.col("protocolSection.referencesModule.references").alias("reference"),
    )
    rows = rows.filter("nct_id is not null").withColumn("source_url", F.concat(F.lit("https://clinicaltrials.gov/study/"), "nct_id"))
    content = [c for c in rows.columns if c != "source_hash"]
    return rows.withColumn("source_hash", F.sha2(F.to_json(F.struct(*sorted(content))).cast("binary"), 256))


def _filled(names: list[str]) -> Callable:
    return lambda x: F.struct(*[F.coalesce(x[n], F.lit("")).alias(n) for n in names])


def prepare_trials(trials: DataFrame) -> DataFrame:
    """Typed trial rows: ages in years (0 and 999 where unknown), ISO dates, texts without null, lists with at least one element."""
    texts = [c for c in ("brief_title", "official_title", "brief_summary", "detailed_description", "eligibility_criteria", "overall_status", "phase", "study_type", "gender", "source", "source_url", "last_update_posted") if c in trials.columns]
    out = trials.withColumns({c: F.coalesce(collapse(c), F.lit("")) for c in texts if c != "eligibility_criteria"})
    out = out.withColumns({"start_date": F.coalesce(to_iso_date("start_date"), F.lit("")), "completion_date": F.coalesce(to_iso_date("completion_date"), F.lit(""))})
    out = out.withColumns({"minimum_age": F.coalesce(age_to_years("minimum_age"), F.lit(0.0)), "maximum_age": F.coalesce(age_to_years("maximum_age"), F.lit(999.0))})
    for c in ("intervention", "location", "reference"):
        names = [f.name for f in trials.schema[c].dataType.elementType.fields]
        blank = F.array(F.struct(*[F.lit("").alias(n) for n in names]))
        filled = F.transform(c, _filled(names))
        out = out.withColumn(c, F.when(F.coalesce(F.size(c), F.lit(0)) > 0, filled).otherwise(blank))
    return out


def prepare_criteria(trials: DataFrame) -> DataFrame:
    return chunk_criteria(trials.filter("eligibility_criteria is not null"))
