"""What the findings of round 2 asked for, on small inputs."""

import random
import time
from collections import Counter

import pyarrow as pa

from pyspark.sql import functions as F

from trialweave.functions.text import lex_constraint, norm_constraint
from trialweave.llm import html
from trialweave.llm.common import Scratch
from trialweave.llm.jaccard import _asked, _open_to_each_other, _sets, _verify, document_sets
from trialweave.operators import constraints, criteria, fusion, retrieval
from trialweave.plans import matching


def test_topk_ranks_by_the_unrounded_score(spark):
    rows = spark.createDataFrame([(1, 10, 0.5, 0.5), (1, 20, 0.5 + 1e-12, 0.5)], "c long, nct_id long, lexical double, vector double").withColumn("bm25", F.lit(None).cast("double"))
    order = lambda **o: [r.nct_id for r in fusion.ranked(retrieval.hybrid_hits(rows, ["c"], "nct_id", 2, **o), ["c"], ["rank"]).orderBy("rank").collect()]
    assert order(digits=None) == [20, 10]
    assert order() == [10, 20]


def test_fused_channels_rank_by_the_unrounded_score(spark):
    # 1/(60+10) * 1/3 against two shares that add up to a little more
    hits = [(1, "b", 0, 1.0 / 3, 10, 1.0), (1, "a", 1, 1.0 / 6, 10, 1.0), (1, "a", 2, 1.0 / 6 + 1e-13, 10, 1.0)]
    rows = spark.createDataFrame(hits, "p long, nct_id string, channel_idx int, weight double, rank int, score double").withColumn("kind", F.lit("x"))
    order = lambda **o: [r.nct_id for r in fusion.rrf_channels(rows, ["p"], **o).orderBy("rank").collect()]
    assert order(digits=None) == ["a", "b"]
    assert order() == ["b", "a"]


def _evaluate(spark, labels, facts):
    """Signals of conditions, one constraint a label, of patients with these facts (patient_id, label, code)."""
    c = F.struct(F.lit("condition").alias("kind"), "label", F.lit("present").alias("comparator"), *[F.lit(None).cast(t).alias(k) for k, t in {"value_num": "double", "value_str": "string", "min_value": "double", "max_value": "double", "unit": "string", "evidence_text": "string"}.items()], F.array("code").alias("codes"))
    rules = labels.crossJoin(facts.select("patient_id").distinct()).select("patient_id", "criteria_id", F.lit(1).alias("nct_id"), F.lit("inclusion").alias("eligibility_type"), F.array(c).alias("constraints"))
    known = facts.select("patient_id", F.lit("condition").alias("kind"), F.col("said").alias("label"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(False).alias("negated"), F.lit(None).cast("string").alias("evidence_text"), F.array("its").alias("codes"))
    people = facts.select("patient_id", F.lit(50.0).alias("age"), F.lit("female").alias("sex")).distinct()
    return constraints.evaluate(rules, people, known)


def test_constraints_meet_every_fact_that_they_match(spark):
    texts = ["egfr", "EGFR-mutated lung cancer", "lung", "pd", "pd-l1 positive", "---", "a---b", "--- -- x", "--- -- y", "-", "non small cell", "", "small cell", "cell-free dna", "dna"]
    labels = spark.createDataFrame([(i, t, f"A:{i}") for i, t in enumerate(texts)], "criteria_id int, label string, code string")
    facts = spark.createDataFrame([(k, t, "a:3") for k, t in enumerate(texts)], "patient_id int, said string, its string")
    score = lex_constraint(norm_constraint("label"), norm_constraint("said"))
    want = labels.crossJoin(facts).filter((score > 0) | (F.lower("code") == F.lower("its"))).select("patient_id", "criteria_id")
    got = _evaluate(spark, labels, facts).filter("relation = 'satisfied'").select("patient_id", "criteria_id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_constraints_do_not_meet_all_facts_of_their_kind(spark):
    labels = spark.range(6000).select(F.col("id").alias("criteria_id"), F.concat(F.lit("part "), "id").alias("label"), F.concat(F.lit("P:"), "id").alias("code"))
    facts = spark.range(6000).select(F.lit(1).alias("patient_id"), F.concat(F.lit("item x"), "id").alias("said"), F.concat(F.lit("p:"), F.col("id") * 2).alias("its"))
    began = time.time()
    assert _evaluate(spark, labels, facts).filter("relation = 'satisfied'").count() == 3000
    assert time.time() - began < 60  # 36 million pairs of texts take minutes


def test_prefix_rows_stay_only_where_a_partner_fits(spark):
    most = lambda n, at: (n - at) * 175 // 75 - n
    rows = [(1, c, c, 100, most(100, 20)) for c in range(5)]  # equal sizes, each too deep in its prefix
    rows += [(2, c, c, 100, most(100, 14)) for c in range(5)]  # just not too deep
    rows += [(3, 1, 1, 100, most(100, 0)), (3, 9, 9, 10, most(10, 0)), (4, 1, 1, 100, most(100, 20)), (4, 8, 8, 80, most(80, 0))]
    met = spark.createDataFrame(rows, "gram long, cls long, part long, n long, most long")
    kept = sorted((r.gram, r.cls) for r in _open_to_each_other(met, 75).collect())
    assert kept == [(2, c) for c in range(5)] + [(4, 1), (4, 8)]


def _searched(spark, n=3000):
    """Texts of few words, so that many tie and all share words, and queries over them."""
    word = lambda salt, m: F.concat(F.lit("w"), F.xxhash64(F.lit(salt), "id") % m)
    texts = spark.range(n).repartition(3).select(F.concat(F.lit("T"), "id").alias("nct_id"), F.when(F.col("id") % 97 != 0, F.concat_ws(" ", F.lit("The"), word(1, 9), word(2, 9), word(3, 40))).alias("search_text"))
    asked = ["the", "w3", "w3 w-2 w7", "nowhere", "", "the w5 w5 nowhere", "w1, w2"]
    rows = [("p", i, "primary_condition", 1.0, [t]) for i, t in enumerate(asked)]
    return texts, spark.createDataFrame(rows, "patient_id string, channel_idx int, kind string, weight double, terms array<string>")


def test_blocks_of_texts_give_the_hits_of_the_postings(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_BLOCK_ROWS", 256)
    monkeypatch.setattr(retrieval, "_HELD", 900)
    texts, channels = _searched(spark)
    index = retrieval.build_bm25(texts, "nct_id", "search_text")
    for k in (5, 300, 10_000):
        got, want = (retrieval.search_channels(texts, channels, i, k, k).withColumn("score", F.round("score", 9)).collect() for i in (index, index._replace(texts=None)))
        assert sorted(got) == sorted(want) and got


def test_a_block_sends_no_more_than_the_best_of_a_query(spark):
    texts, channels = _searched(spark)
    index = retrieval.build_bm25(texts.coalesce(1), "nct_id", "search_text")
    sent = retrieval.block_hits(index, channels.select(F.col("channel_idx").cast("long").alias("_q"), F.array_join("terms", " ").alias("query")), "nct_id", 10)
    few = {r["_q"]: r["n"] for r in sent.groupBy("_q").agg(F.count("*").alias("n"), F.count_distinct(F.round("bm25", 9)).alias("scores")).collect() if r["scores"] > 1}
    assert few and all(n < 500 for n in few.values())  # ten, and what ties with the tenth, of up to 3,000


def test_copies_of_a_text_are_sent_k_times_at_most(spark):
    texts = spark.range(5000).coalesce(1).select("id", F.lit("one same text").alias("text"))
    index = retrieval.build_bm25(texts, "id", "text")
    asked = spark.createDataFrame([(1, "same"), (2, "text one")], "_q long, query string")
    sent = retrieval.block_hits(index, asked, "id", 10).groupBy("_q").agg(F.count("*").alias("n"), F.max("id").alias("last")).collect()
    assert sorted(sent) == [(1, 10, 9), (2, 10, 9)]


def test_only_sets_of_a_pair_are_compared(spark):
    sets = spark.range(1000).select(F.col("id").alias("cls"), F.lit(4).cast("long").alias("n"), F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.col("id") % 2)).cast("array<array<long>>").alias("grams"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "a long, b long")
    assert sorted(r.cls for r in _asked(sets, pairs).collect()) == [1, 2, 3, 4]
    assert sorted(map(tuple, _verify(pairs, sets, 75).collect())) == [(1, 3), (2, 4)]


def _second(spark):
    word = lambda salt, m: F.concat(F.lit("w"), F.abs(F.xxhash64(F.lit(salt), "id")) % m)
    lines = spark.range(1500).repartition(3).select((F.col("id") % 60).alias("nct_id"), F.concat(F.lit("c"), "id").alias("criteria_id"), F.when(F.col("id") % 41 != 0, F.concat_ws(" ", *[word(k, 12) for k in range(5)], F.lit("É"))).alias("criterion"), F.when(F.col("id") % 3 != 0, "inclusion").otherwise("exclusion").alias("eligibility_type"))
    near = spark.range(300).select(F.concat(F.lit("p"), F.col("id") % 9).alias("patient_id"), (F.xxhash64("id") % 60).alias("nct_id")).distinct()
    asked = ["w1 w2", "W3, w3 w5 w9", "", "nowhere w1", "w7", "w1 w2 w3 w4 w5 w6 w7 w8"]
    queries = spark.createDataFrame([(f"p{p}", i, q) for p in range(11) for i, q in enumerate(asked[p % 3 :])], "patient_id string, query_idx int, query string")
    return queries, near, lines


def test_blocks_of_criteria_give_the_hits_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(criteria, "_BLOCK_ROWS", 300)
    monkeypatch.setattr(criteria, "_BLOCK_PATIENTS", 4)
    monkeypatch.setattr(criteria, "_LOOKUPS", 50)
    queries, near, lines = _second(spark)
    want = matching.criterion_hits(queries, near, lines)
    got = criteria.block_hits(queries, near, lines).select(want.columns)
    order = lambda rows: sorted((r.patient_id, r.query_idx, r.nct_id, r.criteria_id, round(r.score, 9), r.eligibility_type) for r in rows.collect())
    assert order(got) == order(want) and order(got)
    assert criteria.block_hits(queries, near, lines, 0.5).count() < got.count()


def test_second_level_is_that_of_all_hits(spark):
    queries, near, lines = _second(spark)
    signals = near.join(lines, "nct_id").select("patient_id", "criteria_id", (F.xxhash64("criteria_id") % 5 / 4).alias("signal"))
    for size in (3, 250):
        for s in (None, signals):
            top = fusion.ranked(matching.criterion_hits(queries, near, lines), ["patient_id", "query_idx"], [F.round("score", 9).desc(), "criteria_id"], size)
            hits = criteria.normalise(top).drop("score").withColumnRenamed("norm_score", "score")
            hits = hits.withColumn("pre_constraint_score", F.col("score")) if s is None else criteria.adjust(hits, s)
            want = criteria.trial_scores(hits, ["patient_id"], "weighted", 0.5)
            got = matching.second_level(queries, near, lines, size, signals=s)
            rows = lambda d, c: sorted((r.patient_id, r.nct_id, r.n, round(r[c], 9)) for r in d.collect())
            assert rows(got, "score") == rows(want, "trial_score") and rows(got, "score")


def test_sets_of_classes_of_one_row_are_not_shuffled(spark):
    texts = [(i, f"one two three four five six {i}") for i in range(6)] + [(2, "one two three four five six 2"), (2, "another text of that number"), (None, "a b c d e f")]
    labels = document_sets(pa.array([t for _, t in texts]), 5)[2].astype("int64").tolist()
    left = spark.createDataFrame([(labels[k], texts[k][0], 2, 2 if k == 2 else 1) for k in (0, 1, 2, 3, 8)], "label long, rep long, n long, rows long")
    sets = _sets(spark.createDataFrame(texts, "doc_id long, text string"), left, 5)
    assert sorted(r.cls for r in sets.collect()) == sorted(labels[k] for k in (0, 1, 2, 3, 8))
    singles = _sets(spark.createDataFrame(texts, "doc_id long, text string"), left.filter("rows = 1"), 5).filter("n < 0")
    plan = singles._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cls") == 1  # that of repeated rows alone


def _said(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(n))


def test_the_suffix_array_decides_inside_articles(spark, monkeypatch):
    """F8: pages with declared articles; what their host repeats goes, by array and structure together."""
    notice, phrase = "sign up and get our letter every monday", "it was one of the first things that"
    title = lambda i: f"title {i} of a page that others list"
    listed = "".join(f"<li>{title(i)}</li>" for i in range(14))
    page = lambda i, *ps: f"<nav>menu of page {i} is its own</nav><article><h1>{title(i)}</h1>{''.join(f'<p>{p}</p>' for p in ps)}</article><aside><ul>{listed}</ul></aside>"
    told = {i: [f"{_said(i, 20)} {phrase} {_said(100 + i, 20)}", notice, _said(200 + i, 20), "read more"] for i in range(14)}
    rows = [(i, f"http://many.org/{i}", page(i, *ps)) for i, ps in told.items()]
    rows += [(50, "http://many.org/copy", page(3, *told[3]))]
    rows += [(100 + i, f"http://few.org/{i}", page(i, *told[i])) for i in range(9)]  # too few bodies to overrule the declaration
    near = {200 + i: [_said(300, 40), _said(301, 40), _said(400 + i, 5)] for i in range(14)}
    rows += [(i, f"http://near.org/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>") for i, ps in near.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: "\n\n".join([title(i), ps[0], ps[2], ps[3]]) for i, ps in told.items()}
    want |= {50: want[3]} | {100 + i: "\n\n".join([title(i), *told[i]]) for i in range(9)} | {i: "\n\n".join(ps) for i, ps in near.items()}
    assert {r.page_id: r.text for r in html.extract_main_text(pages).collect()} == want
    monkeypatch.setattr(html, "_PART_PAGES", 2)
    monkeypatch.setattr(html, "_PART_CHARS", 2000)
    assert {r.page_id: r.text for r in html.extract_main_text(pages).collect()} == want


def test_boilerplate_runs_against_brute_force(spark, monkeypatch):
    """F8: a host in one part and in many gives the runs that a plain count of its distinct bodies gives."""
    draw = random.Random(5)
    rows, bodies = [], {}
    for i in range(60):
        host = "ab"[i % 2]
        texts = [" ".join(draw.choices("uv", k=draw.randint(3, 9))) for _ in range(3)]
        if i % 5 == 4:
            texts = [bodies[host][-1][0], texts[1], bodies[host][-1][2]]  # the article again, with another frame
        bodies.setdefault(host, []).append(texts)
        rows.append((host, f"<article><p>{texts[0]}</p></article><div>{texts[1]}</div><article><p>{texts[2]}</p></article>"))
    want = set()
    for host, pages in bodies.items():
        grams = lambda t: {tuple(t[i : i + 4]) for i in range(len(t) - 3)}
        have, inside = {}, {}
        for a, b, c in pages:
            have.setdefault(f"{a} {c}", set()).update(grams(f"{a} {b} {c}".split()))
            inside.setdefault(f"{a} {c}", set()).update(grams(a.split()) | grams(c.split()))
        n, k = Counter(g for x in have.values() for g in x), Counter(g for x in inside.values() for g in x)
        want |= {(host, html.suffixes([[(html.OPEN, " ".join(g))]], 4)[2].item(), bool(k[g] >= 4 and k[g] >= 0.35 * len(have))) for g in n if n[g] >= 3 and n[g] >= 0.6 * len(have)}
    pages = spark.createDataFrame(rows, "host string, html string").repartition(4)
    found = lambda: {(r.host, r.run, r.settled) for r in html.boilerplate_runs(pages, 4, 0.6, 3, 0.35, 4, True, Scratch(spark, "test")).collect()}
    assert found() == want and len({s for _, _, s in want}) == 2
    monkeypatch.setattr(html, "_PART_PAGES", 5)
    monkeypatch.setattr(html, "_PART_CHARS", 100)
    assert found() == want
