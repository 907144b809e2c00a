"""Cases found by review: ties, nulls, short items, masks, and plain versions of scorers and searches."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import prose

from trialweave.llm import chat, common, html, leaks, mixing, queries, toxicity, warc


def test_a_source_of_copies_without_ids_comes_near_its_target(spark):
    rows = [(None, "one two three four five six seven eight nine ten", "a")] * 400 + [(i, "x " * (1 + i % 7), "b") for i in range(200)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken <= 2 * r.size for r in mine)


def test_short_items_are_found_exactly(spark):
    docs = [(1, "The capital, of FRANCE is"), (2, "the capital of the france"), (3, "Yes!"), (4, None), (5, "yesterday")]
    items = [(10, "Capital of France"), (11, "yes"), (12, ""), (13, None)]
    got = leaks.mark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: [x.item_id for x in r.leaks] for r in got.collect()} == {1: [10], 2: [], 3: [11], 4: [], 5: []}


def fits(item, words, k):
    """Whether some run of the words is within k edits of the item, by the whole table."""
    before = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        now = [i]
        for j, v in enumerate(words, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (v != w)))
        before = now
    return min(before) <= k


@pytest.mark.parametrize("seed", range(2))
def test_leaks_against_every_edit_distance(seed):
    """All documents against all items; items of many sizes, edits up to and beyond the limit."""
    rng = random.Random(seed)
    items = [[f"w{rng.randrange(200)}" for _ in range(rng.choice((3, 6, 8, 14, 20, 27, 40, 90)))] for _ in range(30)]
    texts = []
    for _ in range(120):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(5, 60))]
        item = list(rng.choice(items))
        for _ in range(rng.randrange(int(0.2 * len(item)) + 1)):
            at = rng.randrange(len(item))
            kind = rng.randrange(3)
            if kind == 0:
                item[at] = "new"
            elif kind == 1:
                item.insert(at, "more")
            elif len(item) > 1:
                del item[at]
        at = rng.randrange(len(words))
        texts.append(words[:at] + item + words[at:])
    built = leaks.build_items(list(range(len(items))), [" ".join(i) for i in items], 0.15, 0.995, 1)
    found = leaks.find_in(pa.array([" ".join(t) for t in texts]), built)
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if fits(item, t, int(0.15 * len(item)))}
    got = {(d, i) for d, f in enumerate(found) for i in f}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_an_item_that_many_share_is_laid_out_in_pieces():
    total = np.cumsum([5, 0, 7, 3_000_000, 1, 2])
    assert list(leaks._pieces(total, 1 << 20)) == [(0, 3), (3, 4), (4, 6)]


def test_digest_of_the_loss_follows_the_mask(spark):
    rows = [(1, 0, "user", "hi <|im_end|> <\\|"), (1, 1, "assistant", "a <|im_start|> b"), (1, 2, "assistant", None), (2, 0, "assistant", "é\nplain"), (3, 0, "user", "none")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: r for r in chats.withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert {k: r.loss for k, r in got.items()} == {1: "a <|im_start|> b", 2: "é\nplain", 3: ""}
    for r in got.values():
        assert sum(x.chars for x in r.loss_mask) == len(r.formatted)
    other = chats.withColumn("loss_mask", F.transform("loss_mask", lambda x: F.struct(x["chars"].alias("chars"), (~x["loss"]).alias("loss"))))
    changed = {r.conv_id: r.loss_sha256 for r in chat.chat_digest(other).collect()}
    assert all(changed[r.conv_id] != r.loss_sha256 for r in chat.chat_digest(chats).collect())


def plain_grams(text, orders):
    line = " " + re.sub(r"[\x09-\x0d ]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).strip(" ") + " "
    line = line if line.strip(" ") else " "
    return {line[k : k + n] for n in orders for k in range(len(line) - n + 1)}


def test_toxicity_features_and_scores_against_a_plain_version():
    texts = ["Ab  c\néÉ abc", "", None, "x", "漢字 and \U0001f600!", "aaaa aaaa " * 50]
    orders = (3, 4, 5)
    doc, feature = toxicity.text_features(pa.array(texts, pa.string()), 40, orders)
    for d, t in enumerate(texts):
        assert (doc == d).sum() == len(plain_grams(t, orders)), t
    weight = np.zeros(1 << 12, np.float32)
    weight[::3] = np.random.default_rng(1).normal(size=len(weight[::3]))
    model = toxicity.Model(12, orders, -0.5, weight)
    for d, p in enumerate(toxicity.score_texts(pa.array(texts, pa.string()), model)):
        doc, feature = toxicity.text_features(pa.array([texts[d]], pa.string()), 12, orders)
        assert p == pytest.approx(1 / (1 + math.exp(0.5 - float(weight[sorted(set(feature.tolist()))].astype(float).sum()))))


def test_toxicity_learns_and_stands_repeated_ids(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = prose(i, 30, 300).split()
        if i % 5 == 0:
            words[rng.randrange(30)] = words[rng.randrange(30)] = "vile scum"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(7, rows[7][1])] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, max_labels=150)).collect()}
    assert sum(got[i].predicted == int(i % 5 == 0) for i in range(200, 300)) >= 97


def test_null_text_in_the_queries(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = [(1, prose(1, 60), "en", "s", 3), (2, None, None, None, None), (3, "", "en", "s", 0), (4, prose(1, 60), "en", "s", 3), (5, "word " * 60_000, "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    got = {r.doc_id: r for r in queries.op10_substring_dedup(spark, d).collect()}
    assert got[2].kept_sha256 == got[3].kept_sha256 == got[4].kept_sha256 == empty and (got[4].n_removed, got[5].n_removed) == (60, 0)
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, d).collect()}
    assert got[2].base_failed and not got[2].kept and got[5].n_repeat_words == 60_000
    got = {r.doc_id: r for r in queries.op5_license_scan(spark, d).collect()}
    assert (got[2].n_words, got[2].labels, got[5].n_words) == (0, "", 60_000)
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, d).collect()}
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got.values())


def test_merge_in_many_ranges_keeps_the_order(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i % 11}", f"<p>{i}</p>") for i in range(300)], "page_id long, url string, html string")
    scratch = common.Scratch(spark, "ranges")
    archives = scratch.keep(warc.write_archives(pages.repartition(5), f"{scratch.path}/warc"), "archives")
    runs = scratch.keep(warc.capture_runs(archives), "runs")
    rows = warc.merged_captures(runs, range_rows=20).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    order = [(r.url_key, r.timestamp, r.page_id) for r in rows]
    assert order == sorted(order) and len(order) == 300


def test_the_suffix_array_alone(spark):
    """Without declared structure, what a third of a host's pages repeat goes, inside article or not."""
    menu, legal = "home news sport weather travel contact us", "all rights reserved by the publisher of this site"
    rows = [(i, "http://a.org/x", f"<div>{menu}</div><article><p>{prose(i, 30)}</p><p>{legal}</p></article>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {r.page_id: r.text for r in html.extract_main_text(pages, structure=False).collect()}
    assert alone == {i: prose(i, 30) for i in range(6)}
    both = {r.page_id: r.text for r in html.extract_main_text(pages).collect()}
    assert both == {i: prose(i, 30) + "\n\n" + legal for i in range(6)}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_root(Session())
