import pytest
from pyspark.sql import functions as F

from trialweave.operators import chunking, constraints, criteria, entities, filters, fusion, linking, metrics, ranking, retrieval, upsert


def test_hard_filters(spark):
    rows = [(1, 18.0, 65.0, "All", "Recruiting"), (2, None, None, "", None), (3, 70.0, 90.0, "Male", "Recruiting"), (4, 0.0, 99.0, "M", "Completed")]
    df = spark.createDataFrame(rows, "nct_id int, minimum_age double, maximum_age double, gender string, overall_status string")
    df = df.withColumns({"age": F.lit(50.0), "sex": F.lit("female"), "requested_status": F.lit("All")})
    ids = lambda d: sorted(r.nct_id for r in d.collect())
    assert ids(filters.hard_filter(df)) == [1, 2]
    assert ids(filters.hard_filter(df, ())) == [1, 2, 3, 4]
    assert ids(filters.ids_in(df, [])) == [1, 2, 3, 4] and ids(filters.ids_in(df, [3])) == [3]


def test_min_max_and_threshold(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 3.0), ("b", 5.0), ("b", None)], "k string, s double")
    got = sorted((r.k, r.s or -1, r.x) for r in fusion.min_max(df, "s", ["k"], "x", 1.0).collect())
    assert got == [("a", 2.0, 0.0), ("a", 3.0, 0.5), ("a", 4.0, 1.0), ("b", -1, None), ("b", 5.0, 1.0)]
    c = spark.createDataFrame([("q", 1, 1.0, 1.0, 0.4), ("q", 2, 0.5, 0.2, 0.9)], "q string, id int, bm25 double, lexical double, vector double")
    assert [r.id for r in retrieval.hybrid_hits(c, ["q"], "id", 5, threshold=0.5).collect()] == [2]
    assert [r.id for r in retrieval.hybrid_hits(c, ["q"], "id", 5, mode="bm25").orderBy("rank").collect()] == [1, 2]


def test_rrf_channels(spark):
    hits = spark.createDataFrame([("p", 0, "a", 1.0, "N1", 1, 0.9), ("p", 1, "b", 0.5, "N1", 2, 0.5), ("p", 1, "b", 0.5, "N2", 1, 0.6), ("p", 1, "b", 0.5, " ", 3, 0.1)], "patient_id string, channel_idx int, kind string, weight double, nct_id string, rank int, score double")
    out = fusion.rrf_channels(hits, ["patient_id"]).orderBy("rank").collect()
    assert [r.nct_id for r in out] == ["N1", "N2"] and abs(out[0].score - (1 / 61 + 0.5 / 62)) < 1e-12 and len(out[0].channels) == 2


def test_shortlist(spark):
    a = spark.createDataFrame([("p", "x", 1, 2.0), ("p", "y", 2, 1.0)], "p string, nct_id string, rank int, score double")
    b = spark.createDataFrame([("p", "y", 1, 0.5), ("p", "z", 2, 0.4)], "p string, nct_id string, rank int, score double")
    assert {r.nct_id for r in fusion.fuse_shortlist(a, b, ["p"]).collect()} == {"x", "y", "z"}
    assert {r.nct_id: r.fused for r in fusion.fuse_shortlist(a, b, ["p"], method="score_sum").collect()} == {"y": 1.5, "z": 0.4}


def test_search_channels(spark):
    trials = spark.createDataFrame([("N1", "EGFR lung cancer osimertinib"), ("N2", "general lung cancer"), ("N3", "solid tumor"), ("N4", None)], "nct_id string, search_text string")
    channels = spark.createDataFrame([("p", 0, "primary_condition", 1.0, ["EGFR lung cancer"]), ("p", 1, "broader_disease", 0.35, ["solid tumor"])], "patient_id string, channel_idx int, kind string, weight double, terms array<string>")
    hits = retrieval.search_channels(trials, channels, retrieval.build_bm25(trials, "nct_id", "search_text"))
    out = fusion.rrf_channels(hits, ["patient_id"]).orderBy("rank").collect()
    assert out[0].nct_id == "N1" and {r.nct_id for r in out} == {"N1", "N2", "N3"}


def test_trial_scores(spark):
    rows = [("p", "N", "c1", 0.8, None), ("p", "N", "c1", 0.9, None), ("p", "N", "c2", 0.4, 0.7), ("p", "N", "c3", 0.1, 0.2), ("p", "M", None, 0.6, None), ("p", "M", None, 0.6, None)]
    df = spark.createDataFrame(rows, "patient_id string, nct_id string, criteria_id string, score double, pre_constraint_score double")
    got = {r.nct_id: (r.n, r.trial_score) for r in criteria.trial_scores(df, ["patient_id"]).collect()}
    assert got["N"][0] == 2 and abs(got["N"][1] - (0.7 * 1.3 / 2**0.5 + 0.3 * 0.9)) < 1e-12 and got["M"][0] == 2


def test_ranking(spark):
    v = spark.createDataFrame([("p", "A", "inclusion", "Met"), ("p", "A", "inclusion", "Unclear."), ("p", "B", "inclusion", "Met"), ("p", "B", "exclusion", "**Violated**"), ("p", "C", "inclusion", "Met"), ("p", "C", "exclusion", "Not Violated"), ("p", "D", "inclusion", "Irrelevant")], "patient_id string, nct_id string, section string, classification string")
    bands = ranking.eligibility_scores(v, ["patient_id", "nct_id"])
    assert {r.nct_id: r.band for r in bands.collect()} == {"A": 0.75, "B": -1.0, "C": 1.0, "D": 0.0}
    one = spark.createDataFrame([("p", "A", 0.2, 0.0), ("p", "C", 0.1, 0.0)], "patient_id string, nct_id string, reranker double, first_level double")
    rows = ranking.with_scores(bands, one.drop("first_level"), one.drop("reranker"), ["patient_id", "nct_id"])
    out = ranking.blend_ranks(rows).orderBy("rank").collect()
    assert [r.nct_id for r in out] == ["C", "A", "D", "B"]
    assert all(b.score >= a.band for a, b in zip(out, out))


def test_ndcg_golden(spark):
    rows = spark.createDataFrame([("q", "b", 2.0, 1), ("q", "a", 1.0, 3)], "query_id string, nct_id string, score double, grade int")
    assert round(metrics.ndcg_tie_aware(rows, 2).first().ndcg, 5) == 0.79671
    tied = spark.createDataFrame([("q", c, 1.0, g) for c, g in zip("abc", (2, 1, 0))], "query_id string, nct_id string, score double, grade int")
    assert round(metrics.ndcg_tie_aware(tied, 3).first().ndcg, 4) == 0.81


def test_best_threshold(spark):
    rows = spark.createDataFrame([("c", "c", 0.9), ("CUI-less", "d", 0.2), (None, "e", 0.3)], "gold string, candidate string, quality double")
    sweep = metrics.threshold_sweep(rows, [0.1, 0.5, 0.7])
    assert metrics.best_threshold(sweep).first().threshold == 0.5


SENTENCE = "Patients aged 18 to 75 years, ANC >= 1,500 /mm3, ECOG performance status 0-1, EGFR mutation, prior therapy with osimertinib within 6 months."


def test_extract_constraints(spark):
    kinds = {(c["kind"], c["label"], c["comparator"]) for c in constraints.constraints_of(SENTENCE)}
    assert {("lab", "absolute neutrophil count", "ge"), ("performance_status", "ECOG", "between"), ("biomarker", "EGFR", "mutated"), ("temporal", "time window", "current")} <= kinds
    assert ("age", "age", "between") in kinds and any(k == "medication" for k, _, _ in kinds)
    assert [c["label"] for c in constraints.constraints_of("Adults only")] == ["adult"]
    assert constraints.constraints_of("Pregnant women") == [] and constraints.constraints_of(None) == []
    assert [c["value_str"] for c in constraints.constraints_of("Male patients")] == ["male"]


def test_evaluate_constraints(spark):
    rows = [("p", "c1", "N", "inclusion", SENTENCE), ("p", "c2", "N", "exclusion", "prior therapy with osimertinib"), ("p", "c3", "N", "inclusion", "ANC >= 1500 /mm3"), ("q", "c1", "N", "inclusion", SENTENCE)]
    crit = constraints.extract_constraints(spark.createDataFrame(rows, "patient_id string, criteria_id string, nct_id string, eligibility_type string, criterion string"))
    people = spark.createDataFrame([("p", 60, "Female"), ("q", None, None)], "patient_id string, age int, sex string")
    facts = [("p", "lab", "absolute neutrophil count", 800.0, "/mm3", False, None, []), ("p", "biomarker", "EGFR", None, None, False, "EGFR mutation", []), ("p", "medication", "osimertinib", None, None, False, None, []), ("p", "performance_status", "ECOG", 1.0, None, False, None, [])]
    f = spark.createDataFrame(facts, "patient_id string, kind string, label string, value double, unit string, negated boolean, evidence_text string, codes array<string>")
    ev = constraints.evaluate(crit, people, f)
    got = {(r.patient_id, r.criteria_id, r.kind): (r.status, r.signal) for r in ev.collect()}
    assert got["p", "c1", "age"] == ("matched", 1.0) and got["q", "c1", "age"] == ("unknown", 0.0)
    assert got["p", "c1", "lab"] == ("violated", -0.6) and got["p", "c1", "performance_status"] == ("matched", 1.0)
    assert got["p", "c1", "biomarker"][0] == "matched" and got["p", "c2", "medication"] == ("violated", -1.0) and got["p", "c1", "temporal"][0] == "unknown"
    signal = {(r.patient_id, r.criteria_id): r.signal for r in constraints.criterion_signals(ev).collect()}
    assert signal["p", "c3"] == -0.6 and signal["p", "c2"] == -1.0
    assert {r["shift"] for r in constraints.explain(ev).filter("patient_id = 'p'").collect()} <= {"boosted", "penalized", "unchanged"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Inclusion Criteria:\n- Age 18 or older\n- ECOG 0-1\n\nExclusion Criteria:\n- Pregnancy", [("inclusion", "Age 18 or older"), ("inclusion", "ECOG 0-1"), ("exclusion", "Pregnancy")]),
        ("1. First item\n2. Second item continues\nhere", [("unknown", "First item"), ("unknown", "Second item continues here")]),
        ("Inclusion: 1. Age over 18; no metastases (brain; liver)", [("inclusion", "Age over 18"), ("inclusion", "no metastases (brain; liver)")]),
        ("- Infection with E. coli. Dose 1.5 mg. Given twice.", [("unknown", "Infection with E. coli."), ("unknown", "Dose 1.5 mg. Given twice.")]),
        ("Patients with asthma", [("unknown", "Patients with asthma")]),
        ("", []),
        (None, []),
    ],
)
def test_split_criteria(text, want):
    assert chunking.split_criteria(text) == want


def test_chunk_table_function(spark):
    chunking.register(spark)
    df = spark.createDataFrame([(1, "- one thing\n- another thing"), (2, None)], "nct_id int, t string")
    df.createOrReplaceTempView("trial_texts")
    assert spark.sql("select nct_id, criterion from trial_texts, lateral chunk_criteria(t)").count() == 2
    assert chunking.chunk_criteria(df, text="t").count() == 2


def test_entities(spark):
    df = spark.createDataFrame([("EGFR V600E amplification in melanoma, aspirin",), (None,), ("weight loss",)], "text string")
    got = {r.text: [(s.entity_group, s.text) for s in r.annotations or []] for r in entities.recognize(df).collect()}
    assert ("disease", "melanoma") in got[df.first().text] and ("gene", "EGFR") in got[df.first().text] and got["weight loss"] == []
    span = "array<struct<entity_group:string,text:string,start:int,end:int,score:double,schema_id:string>>"
    o = spark.createDataFrame([([("a", "x", 0, 5, 0.9, ""), ("b", "y", 3, 8, 0.95, ""), ("c", "z", 8, 9, 0.5, "")],)], f"s {span}")
    assert [s.entity_group for s in o.select(entities.resolve_overlaps("s").alias("s")).first().s] == ["b", "c"]
    v = entities.hashing_vector("Lung cancer")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9 and entities.hashing_vector(" ") is None and entities.hashing_vector("!!!") is not None


def test_linking(spark):
    concepts = spark.createDataFrame([("S1", "malignant neoplasm", ["cancer"]), ("S2", "malignant neoplastic disease", []), ("S3", "asthma", None)], "concept_id string, concept_name string, synonyms array<string>")
    rows = spark.createDataFrame([("disease", "Cancer", "not_linked"), ("disease", "cancer", None), ("disease", "malignant neoplastic disorder", "not_linked"), ("disease", "gout", "not_linked"), ("disease", "x", "accepted")], "entity_group string, text string, linker_status string")
    got = {r.text: (r.linker_status, r.linked_id) for r in linking.link_corpus(rows, concepts).collect()}
    assert got["Cancer"] == ("accepted", "S1") == got["cancer"] and got["malignant neoplastic disorder"][0] == "ambiguous" and got["gout"] == ("rejected", None) and got["x"] == ("accepted", None)


def test_versioned_table(spark, tmp_path):
    t = upsert.VersionedTable(spark, f"file://{tmp_path}/t")
    assert t.read() is None
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "nct_id int, v string"), "nct_id")
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "nct_id int, v string"), "nct_id")
    assert sorted((r.nct_id, r.v) for r in t.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_classification(spark):
    inc = spark.createDataFrame([("a", "h1", 1), ("a", "h1", 2), ("b", "h2", 3), ("c", "h3", 4), ("d", "h4", 5)], "nct_id string, source_hash string, position int")
    man = spark.createDataFrame([("a", "h1", "indexed"), ("b", "old", "indexed"), ("d", "h4", "failed")], "nct_id string, source_hash string, processing_status string")
    got = upsert.classify(inc, man)
    assert {r.position: r.update_status for r in got.collect()} == {1: "unchanged", 2: "duplicate", 3: "changed", 4: "new", 5: "changed"}
    r = upsert.update_report(got).first()
    assert (r.fetched, r.new, r.changed, r.unchanged, r.duplicate) == (4, 1, 2, 1, 1)


def test_reasoning(spark):
    from trialweave.operators import reasoning

    answer = '<think>{</think>Sure: {"Inclusion_Criteria_Evaluation": [{"Criterion": "a {b}", "Classification": "Met", "Justification": "x"}], "Exclusion_Criteria_Evaluation": [], "Final Decision": "Eligible"} bye'
    df = spark.createDataFrame([("p", "N1", answer), ("p", "N2", "no json"), ("p", "N3", None)], "patient_id string, nct_id string, answer string")
    verdicts, status = reasoning.parse_answers(df)
    assert [(r.section, r.criterion, r.classification) for r in verdicts.collect()] == [("inclusion", "a {b}", "Met")]
    assert {r.nct_id: (r.decision, r.error is None) for r in status.collect()} == {"N1": ("Eligible", True), "N2": (None, False), "N3": (None, False)}
    bands = ranking.eligibility_scores(verdicts, ["patient_id", "nct_id"])
    assert {r.nct_id: r.band for r in reasoning.bands_with_errors(bands, status).collect()} == {"N1": 1.0, "N2": -1.0, "N3": -1.0}
    assert {r.nct_id for r in reasoning.worklist(df, status).collect()} == {"N2", "N3"}
    crit = spark.createDataFrame([("N1", 0, "inclusion", "Age 18"), ("N1", 1, "exclusion", "Smoking")], "nct_id string, ordinal int, eligibility_type string, criterion string")
    people = spark.createDataFrame([("p", ["Has asthma."])], "patient_id string, sentences array<string>")
    prompt = reasoning.prompts(df.select("patient_id", "nct_id").limit(1), crit, people).first().prompt
    assert "- Age 18" in prompt and "- Smoking" in prompt and "Has asthma." in prompt
    s = spark.createDataFrame([("p", ["a"], ["b"], ["c"])], "patient_id string, main_conditions array<string>, other_conditions array<string>, patient_narrative array<string>")
    e = spark.createDataFrame([("p", ["x"] * 20, [], None)], "patient_id string, main_conditions array<string>, other_conditions array<string>, expanded_sentences array<string>")
    r = reasoning.enrich(s, e).first()
    assert len(r.main_conditions) == 11 and r.other_conditions == ["b"] and r.patient_narrative == ["c"]


def test_matching_plan(spark):
    from trialweave.plans import matching

    trials = spark.createDataFrame([("N1", "EGFR lung cancer osimertinib", 18.0, 99.0, "All"), ("N2", "lung cancer", 70.0, 99.0, "All"), ("N3", "asthma", 0.0, 99.0, "Male")], "nct_id string, search_text string, minimum_age double, maximum_age double, gender string").withColumn("overall_status", F.lit("Recruiting"))
    crit = spark.createDataFrame([("N1", "c1", "inclusion", "EGFR lung cancer"), ("N1", "c2", "exclusion", "prior therapy with osimertinib"), ("N3", "c3", "inclusion", "asthma")], "nct_id string, criteria_id string, eligibility_type string, criterion string")
    people = spark.createDataFrame([("p", 60, "Female")], "patient_id string, age int, sex string")
    rows = [("p", "conditions", 0, "EGFR lung cancer", None, False, None, [], "condition", None, None), ("p", "medications", 1, "osimertinib", "prior", False, None, [], "medication", None, None)]
    facts = spark.createDataFrame(rows, "patient_id string, bucket string, ordinal int, label string, temporality string, negated boolean, evidence_text string, codes array<string>, kind string, value double, unit string")
    m = matching.match(people, facts, trials, crit, context=facts)
    assert [r.nct_id for r in m.first.orderBy("rank").collect()] == ["N1"]
    assert [r.nct_id for r in m.shortlist.collect()] == ["N1"]
    bands = spark.createDataFrame([("p", "N1", 1.0)], "patient_id string, nct_id string, band double")
    assert matching.final_ranking(bands, m.second, m.first).first().rank == 1


def test_command_line(spark, capsys, tmp_path):
    from trialweave.__main__ import main

    main(["stages", "--from", "match"])
    assert capsys.readouterr().out.split() == ["match", "eval"]
    (tmp_path / "q.txt").write_text("1 0 N1 2\n1 0 N2 0\n")
    spark.createDataFrame([("1", "N1", 0.9), ("1", "N2", 0.1)], "query_id string, nct_id string, score double").write.parquet(str(tmp_path / "r"))
    main(["eval", str(tmp_path / "r"), str(tmp_path / "q.txt")])
    assert '"recall_10": 1.0' in capsys.readouterr().out
