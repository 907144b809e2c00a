"""Patients from OMOP, FHIR, phenopackets and notes, to one long table of facts.

Every importer gives ``patients`` (patient_id, age, sex, country) and ``facts`` (patient_id, bucket, kind, label,
value, unit, negated, temporality, evidence_text, codes, fact_id).
"""

from __future__ import annotations

import json
import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_age_years, parse_date
from ..functions.text import collapse, normalize_gender, safe_patient_id, sha_id

#: Buckets of facts and the constraint kind of each; family history is no fact about the patient.
BUCKETS = {"conditions": "condition", "phenotypes": "condition", "observations": "lab", "medications": "medication", "procedures": "procedure", "diagnostic_reports": "lab", "genomic_findings": "biomarker", "cancer_profile": "condition", "family_history": None}
_DROP, _INACTIVE = ("entered-in-error", "cancelled", "not-done", "nullified", "declined"), ("resolved", "inactive", "remission")
#: Which bucket a resource type feeds.
RESOURCES = {"Condition": "conditions", "Observation": "observations", "Procedure": "procedures", "MedicationStatement": "medications", "MedicationRequest": "medications", "MedicationAdministration": "medications", "DiagnosticReport": "diagnostic_reports", "AllergyIntolerance": "observations", "FamilyMemberHistory": "family_history"}
_FACT = ("patient_id", "bucket", "kind", "label", "value", "unit", "negated", "temporality", "evidence_text", "codes")


class Patients(NamedTuple):
    patients: DataFrame
    facts: DataFrame


def facts_frame(df: DataFrame) -> DataFrame:
    """Adds what a fact lacks, its kind and its id; blank labels go."""
    types = {"value": "double", "negated": "boolean", "codes": "array<string>"}
    for c in _FACT:
        if c not in df.columns and c != "kind":
            df = df.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    kinds = F.create_map(*[F.lit(x) for k, v in BUCKETS.items() if v for x in (k, v)])
    df = df.withColumn("negated", F.coalesce("negated", F.lit(False))).withColumn("label", collapse("label")).filter("label <> ''")
    df = df.withColumn("kind", kinds[F.col("bucket")])
    return df.select(*_FACT).withColumn("fact_id", sha_id("patient_id", "bucket", "label", F.col("value").cast("string"), "temporality", length=16))


def patient_context(facts: DataFrame) -> DataFrame:
    """Facts that constraints may look at, performance status included."""
    from ..operators.constraints import performance_facts

    known = facts.filter("kind is not null")
    return known.unionByName(performance_facts(facts).select(known.columns))


# OMOP -------------------------------------------------------------------------------------------------------


def canonical_id(value) -> Column:
    """One text for 1, 1.0 and "1"."""
    v = F.trim(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))
    return F.nullif(F.regexp_replace(v, r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def read_omop(spark: SparkSession, folder: str, strict: bool = False) -> dict[str, DataFrame]:
    """Tables by lower-case file name, columns lower-case; an unreadable one is left out unless strict."""
    tables = {}
    for name in sorted(os.listdir(folder)):
        stem, ext = os.path.splitext(name)
        if ext.lower() not in (".csv", ".parquet"):
            continue
        try:
            path = f"{folder}/{name}"
            df = spark.read.parquet(path) if ext.lower() == ".parquet" else spark.read.option("header", True).csv(path)
            tables[stem.lower()] = df.toDF(*[c.lstrip("﻿").lower() for c in df.columns])
        except Exception:
            if strict:
                raise
    return tables


#: OMOP event tables: bucket, concept column, date column.
_EVENTS = {"condition_occurrence": ("conditions", "condition_concept_id", "condition_start_date"), "drug_exposure": ("medications", "drug_concept_id", "drug_exposure_start_date"), "procedure_occurrence": ("procedures", "procedure_concept_id", "procedure_date"), "measurement": ("observations", "measurement_concept_id", "measurement_date"), "observation": ("observations", "observation_concept_id", "observation_date")}


def with_concept(events: DataFrame, concepts: DataFrame | None, column: str) -> DataFrame:
    """Left lookup of a concept's label and code; 0 is none, an unknown id stays as an unmapped code."""
    keyed = events.withColumn("_c", F.nullif(canonical_id(column), F.lit("0")))
    if concepts is None:
        return keyed.withColumns({"label": F.col("_c"), "codes": F.array(F.concat(F.lit("OMOP:"), "_c"))}).drop("_c")
    c = concepts.select(canonical_id("concept_id").alias("_c"), F.col("concept_name").alias("_name"), F.concat("vocabulary_id", F.lit(":"), "concept_code").alias("_code")).dropDuplicates(["_c"])
    out = keyed.join(c, "_c", "left")
    code = F.coalesce("_code", F.concat(F.lit("OMOP:"), "_c"))
    return out.withColumns({"label": F.coalesce("_name", "_c"), "codes": F.when(code.isNotNull(), F.array(code))}).drop("_c", "_name", "_code")


def import_omop(tables: dict[str, DataFrame], today: str) -> Patients:
    """All children meet PERSON by canonical id in one join per table; nothing is looked up per person."""
    concepts = tables.get("concept")
    person = tables["person"].withColumn("patient_id", canonical_id("person_id"))
    cols = set(person.columns)
    get = lambda c, t="string": F.col(c).cast(t) if c in cols else F.lit(None).cast(t)
    age = F.year(F.lit(today).cast("date")) - get("year_of_birth", "int")
    people = person.select("patient_id", F.when(age.between(0, 150), age).alias("age"), normalize_gender(get("gender_source_value")).alias("sex"), canonical_id(get("location_id")).alias("location_id"))
    if "location" in tables:
        place = tables["location"].select(canonical_id("location_id").alias("location_id"), F.col("country_source_value").alias("country")).groupBy("location_id").agg(F.min("country").alias("country"))
        people = people.join(place, "location_id", "left")
    else:
        people = people.withColumn("country", F.lit(None).cast("string"))
    parts = []
    for name, (bucket, concept, date) in _EVENTS.items():
        if name not in tables:
            continue
        t = with_concept(tables[name], concepts, concept)
        has = set(t.columns)
        value = F.col("value_as_number").cast("double") if "value_as_number" in has else F.lit(None).cast("double")
        unit = F.col("unit_source_value") if "unit_source_value" in has else F.lit(None).cast("string")
        parts.append(facts_frame(t.select(canonical_id("person_id").alias("patient_id"), F.lit(bucket).alias("bucket"), "label", value.alias("value"), unit.alias("unit"), (F.col(date).cast("string") if date in has else F.lit(None).cast("string")).alias("temporality"), "codes")))
    if "note_nlp" in tables:
        parts.append(_note_nlp(tables, concepts))
    facts = parts[0] if parts else None
    for p in parts[1:]:
        facts = facts.unionByName(p)
    facts = facts.join(people.select("patient_id"), "patient_id", "left_semi")
    return Patients(people.drop("location_id").withColumn("export_id", safe_patient_id("patient_id")), facts)


def _note_nlp(tables: dict, concepts: DataFrame | None) -> DataFrame:
    """NLP findings reach their person over the first row of their note, else by their own person_id."""
    nlp = with_concept(tables["note_nlp"], concepts, "note_nlp_concept_id")
    has = set(nlp.columns)
    own = canonical_id("person_id") if "person_id" in has else F.lit(None).cast("string")
    if "note" in tables and "note_id" in has:
        note = tables["note"].select(canonical_id("note_id").alias("_n"), canonical_id("person_id").alias("_p"), F.monotonically_increasing_id().alias("_at"))
        note = note.groupBy("_n").agg(F.min_by("_p", "_at").alias("_p"))
        nlp = nlp.withColumn("_n", canonical_id("note_id")).join(note, "_n", "left")
        own = F.coalesce("_p", own)
    negated = F.upper(F.coalesce(F.col("term_exists"), F.lit("Y"))) == "N" if "term_exists" in has else F.lit(False)
    return facts_frame(nlp.select(own.alias("patient_id"), F.lit("observations").alias("bucket"), "label", negated.alias("negated"), (F.col("snippet") if "snippet" in has else F.lit(None).cast("string")).alias("evidence_text"), "codes").filter("patient_id is not null"))


# FHIR -------------------------------------------------------------------------------------------------------

_CONCEPT = "struct<coding:array<struct<system:string,code:string,display:string>>,text:string>"
_REF = "struct<reference:string>"
RESOURCE_SCHEMA = (
    f"resourceType string, id string, status string, gender string, birthDate string, subject {_REF}, patient {_REF}, code {_CONCEPT}, "
    f"medicationCodeableConcept {_CONCEPT}, verificationStatus {_CONCEPT}, clinicalStatus {_CONCEPT}, valueString string, valueQuantity struct<value:double,unit:string>, "
    f"valueCodeableConcept {_CONCEPT}, valueRange struct<low:struct<value:double,unit:string>,high:struct<value:double,unit:string>>, onsetDateTime string, effectiveDateTime string, "
    f"medicationReference {_REF}, contained array<struct<id:string,code:{_CONCEPT}>>, fullUrl string"
)


def _as_struct(ddl: str) -> str:
    """A struct type from a list of top-level fields."""
    depth, out, token = 0, [], ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = token.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            token = ""
        else:
            token += c
    return f"struct<{','.join(out)}>"


def read_fhir(spark: SparkSession, path: str, ndjson: bool = False, strict: bool = False) -> DataFrame:
    """Resources of bundles, lists and single files, or of NDJSON lines; bad lines are skipped unless strict."""
    kind = _as_struct(RESOURCE_SCHEMA)
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    if ndjson:
        return spark.read.schema(RESOURCE_SCHEMA).option("mode", mode).json(path)
    text = spark.read.option("wholetext", True).text(path)
    bundle = F.from_json("value", f"struct<resourceType:string,entry:array<struct<fullUrl:string,resource:{kind}>>>")
    listed = F.from_json("value", f"array<{kind}>")
    single = F.from_json("value", kind)
    entries = F.transform(bundle["entry"], lambda e: e["resource"].withField("fullUrl", e["fullUrl"]))
    resources = F.when(bundle["resourceType"] == "Bundle", entries).when(F.ltrim("value").startswith("["), listed).otherwise(F.array(single))
    return text.select(F.explode(resources).alias("r")).select("r.*").filter("resourceType is not null")


def _label(c: Column) -> Column:
    return F.coalesce(F.nullif(collapse(c["text"]), F.lit("")), F.get(c["coding"], F.lit(0))["display"], F.get(c["coding"], F.lit(0))["code"])


def _code(c: Column) -> Column:
    return F.lower(F.coalesce(F.get(c["coding"], F.lit(0))["code"], c["text"], F.lit("")))


def value_text(r: DataFrame) -> Column:
    """A value[x] as text: quantity, concept, range or string."""
    q, low, high = F.col("valueQuantity"), F.col("valueRange.low"), F.col("valueRange.high")
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    span = F.when(low["value"].isNotNull() | high["value"].isNotNull(), F.concat(F.coalesce(number(low["value"]), F.lit("")), F.lit("-"), F.coalesce(number(high["value"]), F.lit(""))))
    return F.coalesce(F.when(q["value"].isNotNull(), F.concat_ws(" ", number(q["value"]), q["unit"])), _label(F.col("valueCodeableConcept")), span, F.col("valueString"))


def import_fhir(resources: DataFrame, today: str) -> Patients:
    """References are resolved by one join: each patient offers its keys, each fact asks with one."""
    people = resources.filter("resourceType = 'Patient'").withColumn("patient_id", safe_patient_id(F.coalesce("id", "fullUrl")))
    born = parse_date("birthDate")
    patients = people.select("patient_id", F.floor(F.months_between(F.lit(today).cast("date"), born) / 12).cast("int").alias("age"), normalize_gender("gender").alias("sex"), F.lit(None).cast("string").alias("country"))
    keys = F.filter(F.array(F.col("id"), F.concat(F.lit("Patient/"), "id"), F.col("fullUrl"), F.regexp_extract("fullUrl", r"([0-9a-fA-F-]{36})$", 1)), lambda k: k.isNotNull() & (k != ""))
    offers = people.select("patient_id", F.posexplode(keys).alias("at", "ref")).groupBy("ref").agg(F.min_by("patient_id", "at").alias("patient_id"))
    types = F.create_map(*[F.lit(x) for kv in RESOURCES.items() for x in kv])
    rows = resources.withColumn("bucket", types[F.col("resourceType")]).filter("bucket is not null")
    status, verified, clinical = F.lower(F.coalesce("status", F.lit(""))), _code(F.col("verificationStatus")), _code(F.col("clinicalStatus"))
    rows = rows.filter(~status.isin(*_DROP) & (F.coalesce(verified, F.lit("")) != "entered-in-error"))
    inactive = F.col("resourceType").isin("Condition", "AllergyIntolerance") & F.coalesce(clinical, F.lit("")).isin(*_INACTIVE)
    inside = F.filter(F.coalesce("contained", F.array().cast(resources.schema["contained"].dataType)), lambda c: F.concat(F.lit("#"), c["id"]) == F.col("medicationReference.reference"))
    label = F.coalesce(_label(F.col("code")), _label(F.col("medicationCodeableConcept")), _label(F.get(inside, F.lit(0))["code"]))
    code = F.transform(F.col("code.coding"), lambda c: F.concat(F.coalesce(c["system"], F.lit("local")), F.lit(":"), c["code"]))
    ref = F.coalesce("subject.reference", "patient.reference")
    tail = F.regexp_extract(ref, r"([^/:]+)$", 1)
    asked = rows.select("bucket", label.alias("label"), F.col("valueQuantity.value").alias("value"), F.col("valueQuantity.unit").alias("unit"), (inactive | (F.coalesce(verified, F.lit("")) == "refuted")).alias("negated"), F.coalesce("onsetDateTime", "effectiveDateTime").alias("temporality"), value_text(rows).alias("evidence_text"), code.alias("codes"), ref.alias("ref"), tail.alias("tail"))
    first = asked.join(offers, "ref", "left")
    second = offers.select(F.col("ref").alias("tail"), F.col("patient_id").alias("by_tail"))
    only = patients.agg(F.when(F.count("*") == 1, F.min("patient_id")).alias("only"))
    found = first.join(second, "tail", "left").crossJoin(F.broadcast(only)).withColumn("patient_id", F.coalesce("patient_id", "by_tail", "only"))  # one row
    return Patients(patients, facts_frame(found.filter("patient_id is not null").drop("ref", "tail", "by_tail", "only")))


# phenopackets and notes -------------------------------------------------------------------------------------

_TERM = "struct<id:string,label:string>"
PHENOPACKET = f"id string, subject struct<id:string,sex:string,timeAtLastEncounter:struct<age:struct<iso8601duration:string>>>, phenotypicFeatures array<struct<type:{_TERM},excluded:boolean>>, diseases array<struct<term:{_TERM},excluded:boolean>>, measurements array<struct<assay:{_TERM},value:struct<quantity:struct<unit:{_TERM},value:double>>>>, medicalActions array<struct<treatment:struct<agent:{_TERM}>,procedure:struct<code:{_TERM}>>>"


def import_phenopacket(spark: SparkSession, path: str) -> Patients:
    rows = spark.read.schema(PHENOPACKET).option("multiLine", True).json(path).withColumn("patient_id", safe_patient_id(F.coalesce("subject.id", "id")))
    patients = rows.select("patient_id", iso_age_years("subject.timeAtLastEncounter.age.iso8601duration").alias("age"), normalize_gender("subject.sex").alias("sex"), F.lit(None).cast("string").alias("country"))

    def part(column: str, bucket: str, term: str, extra: dict | None = None) -> DataFrame:
        x = rows.select("patient_id", F.explode(column).alias("x"))
        get = {k: F.col(f"x.{v}").alias(k) for k, v in (extra or {}).items()}
        return facts_frame(x.select("patient_id", F.lit(bucket).alias("bucket"), F.col(f"x.{term}.label").alias("label"), F.array(F.col(f"x.{term}.id")).alias("codes"), *get.values()))

    facts = part("phenotypicFeatures", "phenotypes", "type", {"negated": "excluded"})
    for p in (part("diseases", "conditions", "term", {"negated": "excluded"}), part("measurements", "observations", "assay", {"value": "value.quantity.value", "unit": "value.quantity.unit.label"}), part("medicalActions", "medications", "treatment.agent"), part("medicalActions", "procedures", "procedure.code")):
        facts = facts.unionByName(p)
    return Patients(patients, facts)


def import_notes(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, text) of .txt and .md notes, a file each."""
    notes = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:txt|md)$", 1).alias("patient_id"), F.trim("value").alias("text"))
    return notes.filter("patient_id <> '' and text <> ''").withColumn("patient_id", safe_patient_id("patient_id"))


def detect_format(path: str) -> str:
    """omop, fhir, fhir-ndjson, phenopacket or text, from the folder's files or the file's suffix and JSON shape."""
    if os.path.isdir(path):
        names = [n.lower() for n in os.listdir(path)]
        if any(n.startswith("person.") for n in names):
            return "omop"
        for ext, kind in ((".ndjson", "fhir-ndjson"), (".json", "fhir"), (".txt", "text"), (".md", "text")):
            if any(n.endswith(ext) for n in names):
                return kind
        raise ValueError(f"no patient files in {path}")
    ext = os.path.splitext(path)[1].lower()
    if ext in (".txt", ".md"):
        return "text"
    if ext == ".ndjson":
        return "fhir-ndjson"
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if isinstance(data, dict) and ("phenotypicFeatures" in data or "subject" in data and "metaData" in data):
        return "phenopacket"
    if isinstance(data, list) or isinstance(data, dict) and "resourceType" in data:
        return "fhir"
    raise ValueError(f"unknown patient format: {path}")


def import_patients(spark: SparkSession, path: str, today: str, fmt: str | None = None):
    kind = fmt or detect_format(path)
    if kind == "omop":
        return import_omop(read_omop(spark, path), today)
    if kind in ("fhir", "fhir-ndjson"):
        return import_fhir(read_fhir(spark, path, kind == "fhir-ndjson"), today)
    if kind == "phenopacket":
        return import_phenopacket(spark, path)
    if kind == "text":
        return import_notes(spark, path)
    raise ValueError(f"unknown patient format: {kind}")
