"""Cases of the review of round 1 that the given tables don't hold."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from test_llm_operators import PAGES, edited, prose
from trialweave.llm import html, leaks, licenses
from trialweave.llm.queries import op10_substring_dedup


@pytest.mark.parametrize("size", [30, 250, 500, 1000])
def test_long_items_leak(size):
    rng = random.Random(size)
    items = [prose(100 * size + i, size).split() for i in range(3)]
    short = [prose(9000 + i, 20) for i in range(200)]  # most items are short ones
    built = leaks.build_items(list(range(3 + len(short))), [" ".join(w) for w in items] + short, 0.15, 0.995, 5)
    texts = []
    for d in range(60):
        body = prose(70_000 + d, 60)
        texts.append(body + " " + " ".join(edited(items[d % 3], int(0.15 * size), rng)) + (" " + body if d % 2 else ""))
    got = leaks.find_in(pa.array([*texts, prose(5, 3 * size), None, " ".join(items[0][: size // 2])]), built)
    assert sum(d % 3 in got[d] for d in range(60)) >= (60 if size > 64 else 58)
    assert all(set(g) <= {d % 3} for d, g in enumerate(got[:60])) and not any(got[60:])
    assert all(dist <= 0.15 * size and abs(at - 60) <= 0.3 * size for g in got[:60] for dist, at in g.values())


def test_every_licence_verbatim_with_all_words_indexed():
    rng = np.random.default_rng(1)
    vocab = licenses.vocabulary().tolist()
    for weights in ({h: 1.0 for h in vocab}, {h: float(rng.uniform(0.1, 6)) for h in vocab}):
        index = licenses.Index(weights, 1.0, 400)
        texts = [f"{prose(3 * k, 40)} {t[1]} {prose(3 * k + 1, 40)}" for k, t in enumerate(licenses.TEMPLATES)]
        texts += [f"{t[1]} {prose(900 + k, 9)} {t[1]}" for k, t in enumerate(licenses.TEMPLATES)]
        texts += [f"the program of the year {prose(950 + k, 3)} the end of the line {t[1]}" for k, t in enumerate(licenses.TEMPLATES)]
        part = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        got = licenses._scan(part, index, [], 0.6, 4).to_pylist()
        n = len(licenses.TEMPLATES)
        for i, r in enumerate(got):
            label, notice, _ = licenses.TEMPLATES[i % n]
            at = [m["word"] for m in r["matches"] if m["label"] == label and m["share"] == 1.0]
            size = len(notice.split())
            assert set([[40], [0, size + 9], [13]][i // n]) <= set(at), (i, label, at)


def test_digest_of_a_null_text(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a  b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.kept_sha256) for r in op10_substring_dedup(spark, f"file://{tmp_path}").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (0, sha("")), 2: (0, sha("")), 3: (0, sha("")), 4: (2, sha("a b"))}


def test_html_keeps_bodies_that_are_copies(spark):
    body, phrase, foot = prose(1, 40), "it was one of the first things", "all rights of this fine site reserved forever"
    page = lambda text: f"<body><div>{text}</div><div>{foot}</div></body>"
    rows = [(i, f"http://copy.com/{i}", f"<div>{body}</div>") for i in range(4)]  # re-crawls of one page
    told = {10 + i: f"{prose(20 + i, 20)} {phrase} {prose(50 + i, 20)}" if i < 3 else prose(20 + i, 40) for i in range(12)}
    rows += [(i, f"http://site.com/{i}", page(t)) for i, t in told.items()]
    rows += [(30 + i, url, page(prose(90, 30) + f" {i}")) for i, url in enumerate([None, "", "/x", "mailto:a", None])]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], PAGES).repartition(3)
    got = {r.page_id: r.text for r in html.extract_main_text(df).collect()}
    assert all(got[i] == body for i in range(4))
    assert {i: got[i] for i in told} == told  # a phrase of a quarter of the bodies stays, the footer of all goes
    assert all(got[30 + i] == f"{prose(90, 30)} {i}\n\n{foot}" for i in range(5))
