"""The corpus pipeline on planted cases: every stage against what was planted."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_operators import prose

#: Columns with the names that stages use inside.
CLASH = ["score", "predicted", "_id", "label", "part", "n_words", "n_removed", "leaks"]
BAD = ["idiot", "moron", "scum", "loser"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    item = prose(77, 30)
    passage = prose(78, 70)
    rows, labels, clean = [], [], set()

    def add(i, text, source="s1"):
        rows.append((i, text, "en", source, len(text) if text is not None else None))

    for i in range(400):  # labelled, clean and toxic
        w = prose(i, 60, 500).split()
        toxic = int(i % 4 == 0)
        for k in rng.sample(range(60), 4 * toxic):
            w[k] = rng.choice(BAD)
        add(i, " ".join(w), f"s{i % 5}")
        labels.append((i, 1, toxic))
        clean |= set() if toxic else {i}
    near = prose(500, 150).split()
    for k in range(20):
        w = list(near)
        w[k * 7] = "edit"
        add(1000 + k, " ".join(w))
    add(1100, "repeated row " + prose(501, 30))
    add(1100, "repeated row " + prose(501, 30))
    add(1200, prose(502, 80) + " " + passage)
    add(1201, prose(503, 80) + "\n" + passage + "\n" + prose(504, 80))
    add(1300, prose(505, 40) + " " + item.upper() + " " + prose(506, 40))
    add(1500, "unlike " + prose(507, 40))  # one id, two texts: a copy of another document and a text of its own
    add(1500, prose(502, 80) + " " + passage)
    add(None, prose(508, 40))
    add(None, prose(508, 40))
    add(None, " ".join(near))
    add(1400, None, None)
    add(1401, "")
    clean |= {1000, 1100, 1200, 1201, 1400, 1401}
    d = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in CLASH}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept, columns = spark.read.parquet(f"{d}/documents.parquet"), {}, None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{d}/out-{name}")
        docs = spark.read.parquet(f"{d}/out-{name}")
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "mixing"
        assert all(r[c] == f"own {c}" for r in kept[name] for c in CLASH)
    ids = {n: [r.doc_id for r in rs] for n, rs in kept.items()}
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(ids["toxicity"])) <= 2 and len(clean - set(ids["toxicity"])) <= 2
    lost = clean - set(ids["toxicity"])
    assert {i for i in ids["near_duplicates"] if i is not None and 1000 <= i < 1100} == {1000} and ids["near_duplicates"].count(1100) == 1
    assert [r.text[:6] for r in kept["near_duplicates"] if r.doc_id == 1500] == ["unlike"] and [r.text for r in kept["near_duplicates"] if r.doc_id is None] == [prose(508, 40)]
    cut = {r.doc_id: r for r in kept["repeated_passages"]}
    assert cut[1201].text == prose(503, 80) + " " + prose(504, 80) and cut[1201].n_chars == len(cut[1201].text)
    before = {r.doc_id: r.text for r in kept["near_duplicates"]}
    assert all(cut[i].text == before[i] for i in cut if i != 1201) and set(cut) == set(before)
    assert set(ids["decontamination"]) == set(ids["repeated_passages"]) - {1300}
    assert clean - lost <= set(ids["decontamination"])
    mixed = kept["mixing"]
    assert all(r.copies in (1, 2) and r.taken == r.copies * r.size == r.copies * len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed)
    assert {r.doc_id for r in mixed} <= set(ids["decontamination"])
    for source in {r.source for r in mixed}:
        mine = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
    run = corpus_pipeline.run(spark, d).collect()
    assert sorted((str(r.doc_id), r.copies) for r in run) == sorted((str(r.doc_id), r.copies) for r in mixed)
    empty = spark.createDataFrame([], docs.schema).select(columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
