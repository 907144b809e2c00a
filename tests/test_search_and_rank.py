"""Hybrid retrieval, neighbours, demographics, units, and the way from raw answers to the final order."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import vectors
from trialweave.functions.text import demographics_from_text
from trialweave.operators import constraints, entities, retrieval
from trialweave.plans import matching


@pytest.mark.parametrize(
    ("said", "age", "gender"),
    [
        ("62 M with cough", 62, "Male"),
        ("A 70 F presents", 70, "Female"),
        ("55yr man", 55, "Male"),
        ("A 45-year-old woman, her husband a man of 50", 45, "Female"),
        ("3 y/o boy", 3, "Male"),
        ("a man with a female partner", None, "Male"),
        ("aged 900 year old tree", None, None),
        (None, None, None),
    ],
)
def test_demographics(spark, said, age, gender):
    got = spark.createDataFrame([(said,)], "t string").select(demographics_from_text("t").alias("d")).first().d
    assert (got.age, got.gender) == (age, gender)


def test_units_keep_micro_dots_and_dashes():
    found = constraints.constraints_of("Platelets >= 100 10^9/L. and ANC >= 1500/µL, creatinine <= 1.5 mg/dL")
    assert [(c["label"], c["unit"]) for c in found] == [("platelet count", "10^9/L"), ("absolute neutrophil count", "/µL"), ("creatinine", "mg/dL")]


def test_texts_are_read_in_place(spark):
    rows = spark.createDataFrame([(1, "EGFR positive, age 18-75 years"), (2, None), (3, "EGFR positive, age 18-75 years")], "id int, text string")
    for out in (constraints.extract_constraints(rows, "text"), entities.recognize(rows)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r[-1] for r in out.collect()}
        assert got[1] == got[3] and len(got[1]) >= 1 and got[2] is None


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(1)
    v[5] = v[9] = v[7]  # ties
    v[20] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(400, None)], "id long, v array<double>").repartition(7)
    got = vectors.nearest(rows, "id", "v", rows.filter("id % 20 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv")), "q", "qv", 6)
    n = np.linalg.norm(v, axis=1)
    unit = v / np.where(n > 0, n, 1)[:, None]
    want = {(q, int(i), r) for q in range(0, 300, 20) for r, i in enumerate(sorted(range(300), key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:6], 1)}
    assert {(r.q, r.id, r["rank"]) for r in got.collect()} == want


TRIALS = [("N1", "EGFR lung cancer treated with osimertinib", [1.0, 0.0]), ("N2", "general lung cancer", [0.6, 0.8]), ("N3", "solid tumor", [0.9, 0.1]), ("N4", "asthma", None)]


def test_hybrid_search_takes_what_only_the_vector_finds(spark):
    trials = spark.createDataFrame(TRIALS, "name string, search_text string, search_vector array<double>").withColumn("nct_id", F.substring("name", 2, 1).cast("long"))
    channels = spark.createDataFrame([(1, 0, "primary_condition", 1.0, ["EGFR lung cancer"], [1.0, 0.0])], "patient_id int, channel_idx int, kind string, weight double, terms array<string>, query_vector array<double>")
    index = retrieval.build_bm25(trials, "nct_id", "search_text")
    got = {r.nct_id: r for r in retrieval.hybrid_channels(trials, channels, index).collect()}
    assert got[1]["rank"] == 1 and set(got) == {1, 2, 3}  # the third shares no word
    # BM25 is scaled over the candidates, 3:2 with the lexical score, half of the score is the vector's
    assert got[1].score == pytest.approx(0.5 * (0.6 * 1 + 0.4 * 0.95) + 0.5 * 1.0)
    assert got[3].score == pytest.approx(0.5 * (0.9 / np.hypot(0.9, 0.1) + 1) / 2)
    near = retrieval.hybrid_channels(trials, channels, index, threshold=0.95).collect()
    assert {r.nct_id for r in near} == {1, 3}
    text = {r.nct_id: r.score for r in retrieval.hybrid_channels(trials, channels, index, mode="bm25").collect()}
    assert set(text) == {1, 2} and text[1] == pytest.approx(0.6 + 0.4 * 0.95)


def test_criteria_search_with_and_without_synonyms(spark):
    queries = spark.createDataFrame([(1, 0, "breast cancer", [1.0, 0.0])], "patient_id int, query_idx int, query string, query_vector array<double>")
    scope = spark.createDataFrame([(1, "A"), (1, "A")], "patient_id int, nct_id string")
    rows = spark.createDataFrame([("A", "a1", "mammary carcinoma", "carcinoma", "breast cancer", [1.0, 0.0]), ("A", "a2", "breast cancer", "", "", [0.0, 1.0]), ("B", "b1", "breast cancer", "", "", [1.0, 0.0])], "nct_id string, criteria_id string, criterion string, entity_text string, entity_synonyms_text string, criterion_vector array<double>")
    got = {r.criteria_id: r.text_score for r in retrieval.criteria_hits(queries, scope, rows).collect()}
    assert got == {"a1": pytest.approx(1.2 / 3.0), "a2": pytest.approx(1.0 / 3.0)}
    got = {r.criteria_id: r.text_score for r in retrieval.criteria_hits(queries, scope, rows, synonyms=False, threshold=0.0).collect()}
    assert got == {"a1": 0.0, "a2": 1.0}


def test_from_answers_to_the_final_order(spark):
    """Bands first, the reranker inside a band; errors last; what has a result already is not asked again."""

    def said(inclusion, exclusion=()):
        rows = lambda xs: [{"Criterion": "c", "Classification": x, "Justification": ""} for x in xs]
        return "<think>{</think>" + json.dumps({"Inclusion_Criteria_Evaluation": rows(inclusion), "Exclusion_Criteria_Evaluation": rows(exclusion)})

    answers = {"A": said(["Met", "Met"]), "B": said(["Met", "**Met**."]), "C": said(["Met", "Not Met"]), "D": said(["Met"], ["Violated."]), "E": "no JSON {"}
    keys = [(1, t) for t in "ABCDE"]
    short = spark.createDataFrame([(p, t, 0.1, i) for i, (p, t) in enumerate(keys, 1)], "patient_id int, nct_id string, fused double, rank int")
    scores = spark.createDataFrame([(1, t, s) for t, s in zip("ABCDE", (0.2, 0.9, 1.0, 1.0, 1.0), strict=True)], "patient_id int, nct_id string, score double")
    summaries = spark.createDataFrame([(1, ["has cancer"])], "patient_id int, patient_narrative array<string>")
    lines = spark.createDataFrame([("A", 0, "adult", "inclusion")], "nct_id string, ordinal int, criterion string, eligibility_type string")
    asked = []

    def reasoner(prompts):
        asked.extend(r.nct_id for r in prompts.collect())
        told = spark.createDataFrame(list(answers.items()), "nct_id string, answer string")
        return prompts.join(told, "nct_id")

    found = matching.Matches(scores, scores, short)
    got = matching.reason_and_rank(found, summaries, lines, reasoner)
    assert [r.nct_id for r in got.orderBy("rank").collect()][:3] == ["B", "A", "C"] and sorted(asked) == list("ABCDE")
    asked.clear()
    results = spark.createDataFrame([(1, "A", answers["A"], None), (1, "B", "bad", "error")], "patient_id int, nct_id string, answer string, error string")
    again = matching.reason_and_rank(found, summaries, lines, reasoner, results=results)
    assert [r.nct_id for r in again.orderBy("rank").collect()] == [r.nct_id for r in got.orderBy("rank").collect()] and sorted(asked) == list("BCDE")
