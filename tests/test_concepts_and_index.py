"""Recognition, routed linking, the concept table, the stored index, resumed runs and the summaries of constraints."""

import pytest

from trialweave.operators import entities, linking, upsert
from trialweave.plans import index
from trialweave.sources import concepts, sinks

KNOWN = [
    ("1", "SNOMED", "Condition", "100", "Melanoma", ["malignant melanoma", "Melanoma"]),
    ("2", "RxNorm", "Drug", "200", "aspirin", None),
    ("3", "RxNorm", "Drug", "300", "melanoma", None),
    ("4", "SNOMED", "Condition", "", "asthma", None),
]
SCHEMA = "concept_id string, vocabulary_id string, domain_id string, concept_code string, concept_name string, synonyms array<string>"
MENTION = "id int, entity_group string, schema_id string, text string"


def test_variants():
    groups = lambda t: {(s["text"], s["entity_group"]) for s in entities.resolved(entities.variant_spans(t))}
    assert any("V600E" in w and g == "protein mutation" for w, g in groups("BRAF V600E positive"))
    assert any("fusion" in g for _, g in groups("ALK fusion"))
    assert not groups("an increase in weight after the loss")
    assert any(g == "loss" for _, g in groups("PTEN loss"))
    assert entities.variant_spans(None) == [] == entities.variant_spans("")


def test_resolved_matches_the_column_version(spark):
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(20):
        spans = [{"entity_group": "g", "text": "t", "start": a, "end": a + n, "score": s, "schema_id": None} for a, n, s in [(rng.randrange(30), rng.randrange(1, 6), rng.choice([0.5, 0.9])) for _ in range(15)]]
        got = entities.resolved(spans)
        assert all(a["end"] <= b["start"] for a, b in itertools.pairwise(got))
        column = spark.createDataFrame([(spans,)], f"s {entities._SPAN}").select(entities.resolve_overlaps("s").alias("s")).first().s
        assert [(s["start"], s["end"], s["score"]) for s in got] == [(s.start, s.end, s.score) for s in column]


def test_an_error_stays_with_its_text(spark):
    def fails(text):
        if "bad" in text:
            raise ValueError("no such text")
        return entities.regex_spans(text)

    rows = spark.createDataFrame([(1, "cancer"), (2, "bad cancer"), (3, None), (4, "")], "id int, text string")
    got = {r.id: r for r in entities.recognize(rows, names=("own",), recognizers={"own": fails}).collect()}
    assert [a.text for a in got[1].annotations] == ["cancer"] and got[1].annotation_error is None
    assert got[2].annotations is None and got[2].annotation_error == "no such text"
    assert got[3].annotations is None and got[3].annotation_error is None and got[4].annotations == []


def test_routed_linking(spark):
    known = spark.createDataFrame(KNOWN, SCHEMA)
    rows = [(1, "DISEASE", None, "melanoma"), (2, "x", "medication", "Melanoma"), (3, "protein mutation", None, "V600E"), (4, "disease", None, "gout"), (5, "disease", None, "asthma"), (6, None, None, None), (7, "disease", None, None)]
    got = {r.id: r for r in linking.link_annotations(spark.createDataFrame(rows, MENTION), known).collect()}
    assert (got[1].linker_status, got[1].normalized_id, got[1].synonyms) == ("accepted", ["SNOMED:100"], ["Melanoma", "malignant melanoma"])
    assert (got[2].linker_status, got[2].normalized_id) == ("accepted", ["RxNorm:300"])
    assert got[3].linker_status == got[6].linker_status == "not_linkable" and got[3].linker_score is None
    assert (got[4].linker_status, got[4].linker_score, got[4].normalized_id, got[4].concept_candidates) == ("rejected", 0.0, ["CUI-less"], [])
    assert got[5].normalized_id == ["CUI-less"] and got[5].linker_status == "accepted"  # a concept without a code
    assert got[7].linker_status == "rejected" and len(got) == 7
    none = {r.id: r.linker_status for r in linking.link_annotations(spark.createDataFrame(rows, MENTION), None).collect()}
    assert none[1] == "concept_store_unavailable" and none[3] == "not_linkable"
    with pytest.raises(ValueError):
        linking.link_annotations(spark.createDataFrame(rows, MENTION), known, accept=0.1)


def test_annotate_keeps_every_text(spark):
    texts = spark.createDataFrame([(1, "Aspirin for melanoma", "kept"), (2, None, "kept"), (3, "nothing", "kept")], "id int, text string, annotator string")
    got = {r.id: r for r in linking.annotate(texts, "id", spark.createDataFrame(KNOWN, SCHEMA)).collect()}
    assert [(a.text, a.normalized_id) for a in got[1].annotations] == [("Aspirin", ["RxNorm:200"]), ("melanoma", ["SNOMED:100"])]
    assert got[2].annotations == [] == got[3].annotations and {r.annotator for r in got.values()} == {"kept"}


def test_hybrid_candidates(spark):
    known = spark.createDataFrame([("a", "melanoma", [1.0, 0.0]), ("b", "skin tumour", [0.9, 0.1]), ("c", "asthma", [0.0, 1.0])], "concept_id string, concept_name string, embedding array<double>").selectExpr("*", "cast(null as array<string>) as synonyms")
    asked = spark.createDataFrame([("m", "melanoma", [1.0, 0.0])], "key string, mention string, vector array<double>")
    got = [(r.concept_id, r.quality) for r in linking.hybrid_candidates(asked, known, ["key"], 2).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 0.0)]


def test_concept_table(spark, tmp_path):
    (tmp_path / "d.txt").write_text("D1||asthma|bronchial asthma\n")
    (tmp_path / "e.txt").write_text("E1||aspirin\n")
    path, made = f"file://{tmp_path}/concepts", []

    def embed(df):
        made.append(1)
        return entities.embed_hashing(df, "fts_text", "embedding")

    build = lambda names, **more: concepts.build_concepts(spark, path, dictionaries=[f"{n.upper()}:Disease:file://{tmp_path}/{n}.txt" for n in names], embed=embed, **more)
    assert build("d").count() == 1 and build("d").count() == 1 and len(made) == 1
    assert build("de").count() == 2 and len(made) == 2
    assert build("ed", embedder="other").count() == 2 and len(made) == 3
    build("ed", embedder="other", force=True)
    assert len(made) == 4
    assert concepts.write_concepts(spark.createDataFrame([("9", "gout")], "concept_id string, concept_name string"), path, append=True).count() == 3
    with pytest.raises(ValueError):
        concepts.build_concepts(spark, path)
    with pytest.raises(ValueError):
        concepts.dictionary_spec("a:b")


def test_index_provenance(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    trials = spark.createDataFrame([("t1", "lung cancer", [1.0]), ("t2", "asthma", [2.0])], "nct_id string, search_text string, search_vector array<double>")
    rows = spark.createDataFrame([("t1", "adults"), ("t2", "children")], "nct_id string, criterion string")
    assert index.open_index(spark, path) is None
    with pytest.raises(ValueError):
        index.build_index(trials, rows.limit(0), path, "a")
    assert index.open_index(spark, path) is None
    assert index.build_index(trials, rows, path, "a").built and not index.build_index(trials, rows, path, "a").built
    with pytest.raises(ValueError):
        index.build_index(trials, rows, path, "b")
    swapped = index.build_index(trials, rows, path, "b", embed=lambda t, c: (t.selectExpr("nct_id", "search_text", "array(9.0D) as search_vector"), c))
    assert swapped.built and swapped.provenance == "b" and {tuple(r.search_vector) for r in swapped.trials.collect()} == {(9.0,)}
    few = index.build_index(trials, rows, path, "b", only=trials.filter("nct_id = 't1'"), force=True)
    assert few.trials.count() == few.criteria.count() == 1 and {r.term for r in few.bm25.terms.collect()} == {"lung", "cancer"}


def test_matching_resumes_until_the_index_changes(spark, tmp_path):
    path, out, asked = f"file://{tmp_path}/index", f"file://{tmp_path}/out", []
    trials = spark.createDataFrame([("t1", "x")], "nct_id string, search_text string")
    rows = spark.createDataFrame([("t1", "y")], "nct_id string, criterion string")
    index.build_index(trials, rows, path)

    def match(who):
        asked.append(sorted(r.patient_id for r in who.collect()))
        return who.selectExpr("patient_id", "'t1' as nct_id")

    people = lambda *p: spark.createDataFrame([(x,) for x in p], "patient_id string")
    run = lambda who, settings: index.run_matching(who, path, out, settings, match).count()
    assert run(people("a"), {}) == 1 and run(people("a", "b"), {}) == 2 and run(people("a", "b"), {}) == 2
    assert run(people("a", "b"), {"mode": "bm25"}) == 2
    index.build_index(trials, rows, path, force=True)
    assert run(people("a"), {"mode": "bm25"}) == 1
    assert asked == [["a"], ["b"], ["a", "b"], ["a"]]


def test_linking_resumes(spark, tmp_path):
    known = spark.createDataFrame(KNOWN, SCHEMA)
    rows = spark.createDataFrame([(1, "disease", None, "melanoma"), (2, "disease", None, "gout"), (None, "disease", None, "asthma")], MENTION)
    link = lambda df, mark, force=False: linking.link_resumed(df, known, "id", f"file://{tmp_path}/linked", mark, force).count()
    assert link(rows.filter("id = 1"), "v1") == 1 and link(rows, "v1") == 3 and link(rows, "v1") == 3
    assert link(rows, "v2") == 3 and link(rows.filter("id = 1"), "v1", True) == 1


def test_prepared_trials_replace_old_criteria(spark, tmp_path):
    path = f"file://{tmp_path}/prepared"
    frame = lambda rows: spark.createDataFrame(rows, "nct_id string, v string")
    sinks.write_prepared(frame([("t1", "a"), ("t2", "a")]), frame([("t1", "c1"), ("t1", "c2"), ("t2", "c3")]), path)
    sinks.write_prepared(frame([("t1", "b")]), frame([("t1", "c4")]), path)
    read = lambda n: sorted(tuple(r) for r in upsert.VersionedTable(spark, f"{path}/{n}").read().collect())
    assert read("trials") == [("t1", "b"), ("t2", "a")] and read("criteria") == [("t1", "c4"), ("t2", "c3")]


def test_constraint_summaries(spark):
    rows = [("p", "t1", "c", i, f"label {i}", "lab", "matched", 1.0, "trial text", ("lab of p", None)) for i in range(10)] + [("p", "t0", "c", 0, None, "age", "violated", -0.6, None, None)]
    ev = spark.createDataFrame(rows, "patient_id string, nct_id string, criteria_id string, at int, label string, kind string, status string, signal double, evidence_text string, fact struct<label:string,evidence_text:string>")
    top = spark.createDataFrame([("p", "t2", 1, 0.5), ("p", "t1", 2, 0.25)], "patient_id string, nct_id string, rank int, score double")
    text = sinks.constraint_summaries(ev, top).first().markdown
    assert text.index("## t2") < text.index("## t1") < text.index("## t0")
    assert "- Retrieval score: 0.2500" in text and text.count("  - label") == 8 and "boosted" in text and "penalized" in text
    assert "  - label 0. Patient: lab of p. Trial: trial text." in text and "  - age. Patient: no patient evidence. Trial: ." in text
    plain = sinks.report_rows(top.drop("rank"), ev.select("patient_id", "nct_id", "status").limit(0), spark.createDataFrame([("t1", "one")], "nct_id string, name string"))
    assert {(r.nct_id, r["rank"]) for r in plain.collect()} == {("t2", 1), ("t1", 2)}
