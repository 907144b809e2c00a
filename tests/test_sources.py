import json

import pytest

from trialweave.plans import config, planner, stages
from trialweave.sources import evaluation, patients, registry, sinks, vocabularies

STUDY = {"protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": " A  trial "}, "statusModule": {"overallStatus": "RECRUITING", "startDateStruct": {"date": "2021-03"}}, "conditionsModule": {"conditions": ["Asthma", " "]}, "eligibilityModule": {"eligibilityCriteria": "Inclusion Criteria:\n- Adults\n- Asthma for a year\nExclusion Criteria:\n- Smoking", "minimumAge": "18 Years"}, "designModule": {"phases": ["PHASE1", "PHASE2"]}}}


def test_registry(spark, tmp_path):
    calls = []

    def fetch(params):
        calls.append(params)
        if len(calls) == 1:
            return 503, {}
        return 200, {"studies": [STUDY], "nextPageToken": None if "pageToken" in params else "t"}

    path = str(tmp_path / "s.jsonl")
    assert registry.land(registry.pages(fetch, "asthma", ["RECRUITING"], 5000, sleep=lambda s: None), path) == 2
    assert calls[0]["pageSize"] == 1000 and len(calls) == 3
    trials = registry.prepare_trials(registry.normalize_studies(registry.read_studies(spark, path)))
    r = trials.first()
    assert (r.nct_id, r.brief_title, r.phase, r.minimum_age, r.maximum_age, r.start_date, r.gender) == ("NCT1", "A trial", "PHASE1, PHASE2", 18.0, 999.0, "2021-03-01", "All")
    assert r.condition == ["Asthma"] and len(r.location) == 1 and registry.prepare_criteria(trials.limit(1)).count() == 3
    with pytest.raises(OSError):
        list(registry.pages(lambda p: (404, {}), "x", sleep=lambda s: None))


def test_vocabularies(spark, tmp_path):
    (tmp_path / "C.csv").write_text("concept_id\tconcept_name\tdomain_id\tvocabulary_id\tconcept_class_id\tstandard_concept\tconcept_code\tinvalid_reason\n1\tCancer\tCondition\tSNOMED\tx\tS\t36\t\n2\tOld\tCondition\tSNOMED\tx\t\t37\tD\n3\tOther\tDrug\tRxNorm\tx\tS\t9\t\n")
    (tmp_path / "S.csv").write_text("concept_id\tconcept_synonym_name\n1\tTumor\n1\ttumor\n1\tCancer\n")
    rows = vocabularies.omop_concepts(spark, str(tmp_path / "C.csv"), str(tmp_path / "S.csv"), ["snomed"]).collect()
    assert [(r.concept_name, r.synonyms) for r in rows] == [("Cancer", ["Tumor"])]
    (tmp_path / "d.txt").write_text("EntrezGene:1956,7||EGFR|ERBB1|egfr\nbad line\n")
    rows = vocabularies.dictionary_concepts(spark, str(tmp_path / "d.txt"), "EntrezGene").orderBy("concept_id").collect()
    assert [(r.concept_id, r.concept_name, r.synonyms) for r in rows] == [("EntrezGene:1956", "EGFR", ["ERBB1"]), ("EntrezGene:7", "EGFR", ["ERBB1"])]
    (tmp_path / "o.obo").write_text('format-version: 1.2\n\n[Term]\nid: DOID:1\nname: flu\nsynonym: "influenza" EXACT []\n\n[Term]\nid: DOID:2\nname: gone\nis_obsolete: true\n\n[Typedef]\nid: x\nname: y\n\n[Term]\nid: DOID:3\nname: last\n')
    got = sorted((r.id, r.names) for r in vocabularies.obo_terms(spark, str(tmp_path / "o.obo"), "DOID").collect())
    assert got == [("DOID:1", ["flu", "influenza"]), ("DOID:3", ["last"])]
    (tmp_path / "g.tsv").write_text("#head\n9606\t1956\tEGFR\t-\tERBB|HER1\t-\t-\t-\tdesc\tt\tEGFR\tepidermal\tO\tpfam|-\n")
    assert vocabularies.gene_terms(spark, str(tmp_path / "g.tsv")).first().names == ["EGFR", "epidermal", "ERBB", "HER1", "pfam"]


def test_evaluation_sources(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1 0 N1 2\n1 0 N1 1\nshort line\n1 0 N2 x\n2 0 N3 0\n")
    got = sorted((r.query_id, r.nct_id, r.grade) for r in evaluation.read_qrels(spark, str(tmp_path / "q.txt"), "t-").collect())
    assert got == [("t-1", "N1", 1), ("t-2", "N3", 0)]
    (tmp_path / "e.txt").write_text("x\n")
    with pytest.raises(ValueError):
        evaluation.read_qrels(spark, str(tmp_path / "e.txt"))
    (tmp_path / "t.xml").write_text('<topics><topic number="1">A 45 year old man</topic><topic number="2"><summary>S</summary><description>D</description></topic></topics>')
    got = {r.query_id: r.raw_description for r in evaluation.read_topics(spark, str(tmp_path / "t.xml")).collect()}
    assert got == {"1": "A 45 year old man", "2": "S"}
    rows = spark.createDataFrame([("q", "t", 1)], "query string, text string, label int")
    assert evaluation.reranker_rows(rows).first().messages[1].content == "Yes"


def test_omop(spark, tmp_path):
    (tmp_path / "PERSON.csv").write_text("person_id,gender_source_value,year_of_birth,location_id\n1,F,1980,7\npat 01,M,1950,\n")
    (tmp_path / "CONDITION_OCCURRENCE.csv").write_text("person_id,condition_concept_id,condition_start_date\n1.0,10,2020-01-01\npat 01,99,2020-01-01\n5,10,2020-01-01\n1,0,2020-01-01\n")
    (tmp_path / "CONCEPT.csv").write_text("concept_id,vocabulary_id,concept_code,concept_name,domain_id\n10,SNOMED,36,Asthma,Condition\n")
    (tmp_path / "NOTE.csv").write_text("note_id,person_id\n3,1\n")
    (tmp_path / "NOTE_NLP.csv").write_text("note_id,note_nlp_concept_id,term_exists,snippet\n3,10,N,no asthma\n")
    (tmp_path / "LOCATION.csv").write_text("location_id,country_source_value\n7,France\n")
    (tmp_path / "DRUG_EXPOSURE.parquet").write_text("broken")
    assert patients.detect_format(str(tmp_path)) == "omop"
    p = patients.import_patients(spark, str(tmp_path), "2024-01-01")
    assert sorted((r.patient_id, r.age, r.sex, r.country, r.export_id) for r in p.patients.collect()) == [("1", 44, "Female", "France", "1"), ("pat 01", 74, "Male", None, "pat-01")]
    assert sorted((r.patient_id, r.label, r.negated, r.codes[0]) for r in p.facts.collect()) == [("1", "Asthma", False, "SNOMED:36"), ("1", "Asthma", True, "SNOMED:36"), ("pat 01", "99", False, "OMOP:99")]


BUNDLE = {"resourceType": "Bundle", "entry": [{"fullUrl": "urn:uuid:11111111-1111-1111-1111-111111111111", "resource": {"resourceType": "Patient", "id": "p1", "gender": "female", "birthDate": "1980-02-03"}}, {"resource": {"resourceType": "Patient", "id": "p2"}}, {"resource": {"resourceType": "Condition", "id": "c1", "subject": {"reference": "Patient/p2"}, "code": {"text": "Asthma"}, "clinicalStatus": {"coding": [{"code": "resolved"}]}}}, {"resource": {"resourceType": "Observation", "id": "o1", "subject": {"reference": "urn:uuid:11111111-1111-1111-1111-111111111111"}, "code": {"text": "Hemoglobin"}, "valueQuantity": {"value": 12.5, "unit": "g/dL"}}}, {"resource": {"resourceType": "Condition", "id": "c2", "status": "entered-in-error", "subject": {"reference": "Patient/p2"}, "code": {"text": "Gone"}}}]}


def test_fhir(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(BUNDLE))
    p = patients.import_patients(spark, str(tmp_path / "b.json"), "2024-01-01")
    assert sorted((r.patient_id, r.age, r.sex) for r in p.patients.collect()) == [("p1", 43, "Female"), ("p2", None, None)]
    assert sorted((r.patient_id, r.label, r.negated, r.evidence_text) for r in p.facts.collect()) == [("p1", "Hemoglobin", False, "12.5 g/dL"), ("p2", "Asthma", True, None)]
    (tmp_path / "r.ndjson").write_text("\n".join(json.dumps(e["resource"]) for e in BUNDLE["entry"]) + "\nnot json\n")
    assert patients.import_patients(spark, str(tmp_path / "r.ndjson"), "2024-01-01").patients.count() == 2
    exported = json.loads(sinks.export_fhir(p.patients, p.facts).filter("patient_id = 'p1'").first().bundle)
    assert len(exported["entry"]) == 2
    assert json.loads(sinks.export_phenopacket(p.patients, p.facts).filter("patient_id = 'p2'").first().packet)["diseases"][0]["excluded"] is True


def test_phenopacket_and_notes(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"id": "x", "subject": {"id": "s", "sex": "FEMALE", "timeAtLastEncounter": {"age": {"iso8601duration": "P42Y"}}}, "phenotypicFeatures": [{"type": {"id": "HP:1", "label": "Fever"}, "excluded": True}], "diseases": [{"term": {"id": "D:1", "label": "Flu"}}]}))
    p = patients.import_patients(spark, str(tmp_path / "p.json"), "2024-01-01")
    assert (p.patients.first().age, p.patients.first().sex) == (42.0, "Female")
    assert sorted((r.label, r.negated, r.kind) for r in p.facts.collect()) == [("Fever", True, "condition"), ("Flu", False, "condition")]
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a b.txt").write_text("Patient has metastatic melanoma.")
    assert [r.text for r in patients.import_patients(spark, str(tmp_path / "n"), "2024-01-01").collect()] == ["Patient has metastatic melanoma."]


def test_planner(spark):
    p = spark.createDataFrame([("p", 60, "Female"), ("q", None, None)], "patient_id string, age int, sex string")
    rows = [("p", "conditions", 0, "Lung cancer", None, False, None, ["SNOMED:1"]), ("p", "conditions", 1, "Fever", None, True, None, []), ("p", "medications", 2, "osimertinib", "prior", False, None, []), ("p", "cancer_profile", 3, "EGFR positive", None, False, None, [])]
    facts = spark.createDataFrame(rows, "patient_id string, bucket string, ordinal int, label string, temporality string, negated boolean, evidence_text string, codes array<string>")
    s = planner.summaries(p, facts)
    r = {x.patient_id: x for x in s.collect()}
    assert r["p"].main_conditions == ["Lung cancer", "EGFR positive"] and r["p"].other_conditions == ["osimertinib"] and r["q"].patient_narrative == ["No structured patient facts were available."]
    synonyms = spark.createDataFrame([("lung cancer", ["lung carcinoma"])], "term string, synonyms array<string>")
    c = {x.kind: x for x in planner.channels(s, facts, synonyms).filter("patient_id = 'p'").collect()}
    assert c["concept_synonym"].terms == ["lung carcinoma"] and c["biomarker"].terms == ["EGFR"] and c["therapy"].terms == ["osimertinib", "prior osimertinib"] and c["primary_condition"].channel_idx == 0 and "llm_expansion" not in c
    raw = spark.createDataFrame([("p", '{"primary_queries":["a","A"],"disease_aliases":["b"]}'), ("q", "nonsense")], "patient_id string, answer string")
    assert {x.patient_id: x.terms for x in planner.expansion_terms(raw).collect()} == {"p": ["a", "b"], "q": []}
    assert planner.second_level_queries(s).filter("patient_id = 'p'").count() >= 3


def test_stages_and_config(tmp_path):
    assert stages.select(first="link", last="ingest") == ["link", "index", "ingest"] and stages.select(only=["match", "prepare"]) == ["prepare", "match"]
    assert "eval" not in stages.select(skip=("eval",))
    for bad in ({"only": ["nope"]}, {"first": "eval", "last": "prepare"}):
        with pytest.raises(ValueError):
            stages.select(**bad)
    ran, path = [], str(tmp_path / "j.json")
    steps = {"prepare": lambda: ran.append(1)}
    for _ in range(2):
        stages.run(steps, ["prepare"], stages.Journal(path), {"prepare": "f"})
    assert ran == [1] and stages.run(steps, ["prepare"], stages.Journal(path), {"prepare": "g"}) == ["prepare"]
    assert config.load(environ={"TRIALWEAVE_SEARCH__RRF_K": "10", "TRIALWEAVE_RAG__ENABLED": "no"})["search"]["rrf_k"] == 10
    (tmp_path / "c.json").write_text('{"linker": {"accept": 0.4}}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"), {})
    stages.register("embedder", "x")(lambda: 1)
    assert stages.resolve("embedder", "x")() == 1
    with pytest.raises(KeyError):
        stages.resolve("embedder", "y")


def test_sinks(spark, tmp_path):
    import zipfile

    html = sinks.render_html([{"a": "</script>&"}], "T<1>")
    assert "</script>&" not in html and "T&lt;1&gt;" in html
    sinks.atomic_write(str(tmp_path / "x" / "y.json"), "{}")
    assert sinks.valid_json(str(tmp_path / "x" / "y.json")) and not sinks.valid_json(str(tmp_path / "none"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        sinks.unpack(str(tmp_path / "a.zip"), str(tmp_path / "out"))
    t = spark.createDataFrame([("N", "c", [1.0, 3.0], [3.0])], "nct_id string, condition string, condition_vector array<double>, brief_title_vector array<double>")
    r = sinks.trial_records(t).first()
    assert r.search_text == "c" and r.search_vector == [2.0]


def test_data_source(spark, tmp_path):
    from trialweave.sources import datasource

    other = json.loads(json.dumps(STUDY).replace("NCT1", "NCT2"))
    (tmp_path / "pages.jsonl").write_text(json.dumps({"studies": [STUDY], "nextPageToken": "t"}) + "\n" + json.dumps({"studies": [other]}) + "\n")
    datasource.register(spark)
    rows = spark.read.format("registry").option("path", str(tmp_path / "pages.jsonl")).load()
    assert sorted(r.nct_id for r in rows.collect()) == ["NCT1", "NCT2"]
    assert registry.normalize_studies(datasource.parsed(rows)).count() == 2
    q = spark.readStream.format("registry").option("path", str(tmp_path / "pages.jsonl")).load().writeStream.format("memory").queryName("studies").option("checkpointLocation", str(tmp_path / "cp")).start()
    import time

    for _ in range(60):
        time.sleep(0.5)
        if spark.table("studies").count() >= 2:
            break
    q.stop()
    assert sorted(r.nct_id for r in spark.table("studies").collect()) == ["NCT1", "NCT2"]
