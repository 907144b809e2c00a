"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialweave.llm import chat, html, jaccard, leaks, licenses, mixing, quality, repeats, toxicity, warc

WORD = r"[^\x20\x09-\x0D]+"
#: Columns whose names clash with those that operators add.
CLASH = ["score", "predicted", "leaks", "n_words", "n_removed", "copies", "taken", "size", "label", "_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def frame(spark, rows):
    """Documents from (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) + ("x",) * len(CLASH) for i, t, s in rows], SCHEMA)


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 200)
    near = base.split()
    near[50:53] = ["X", "Y", "Z"]
    passage = prose(2, 60)
    out = [(1, base, "a"), (2, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, base.upper(), "b"), (5, "", None), (6, None, "c"), (7, "one two three", "c"), (8, "ONE two\nthree", "a")]
    out += [(9, prose(3, 50) + " " + passage + "\n" + prose(4, 30), "a"), (10, passage + " " + prose(5, 40), "a"), (11, passage, "d"), (12, prose(6, 20_000), "a"), (None, base, "a"), (13, "same " * 80, "a"), (14, "same " * 120, None)]
    # a hot group: many copies and near copies of one text
    hot = prose(7, 120).split()
    for i in range(60):
        w = list(hot)
        for k in random.Random(i).sample(range(120), i % 4):
            w[k] = f"e{i}{k}"
        out.append((100 + i, " ".join(w), "hot"))
    return out


def test_jaccard(spark, rows):
    sets = []
    for i, t, _ in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    comp = list(range(len(sets)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                comp[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), 10**9))
    want = Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))
    got = jaccard.jaccard_components(frame(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
    assert jaccard.jaccard_components(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_near_the_threshold(spark, seed):
    rng = random.Random(seed)
    base, out = [prose(seed * 10 + k, 60).split() for k in range(4)], []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(30)}"
        out.append((i, " ".join(w[: rng.randrange(45, 61)]), "a"))
    test_jaccard(spark, out)


def test_jaccard_of_a_large_group_around_the_threshold(spark):
    """Copies of one text whose pairs are just above and just below the threshold: some join the group by a few links only."""
    rng, base, out = random.Random(8), prose(70, 100).split(), []
    for i in range(1_000):
        w = list(base)
        for k in rng.sample(range(0, 100, 5), rng.choice((2, 2, 3, 4))):
            w[k] = f"y{rng.randrange(400)}"
        out.append((i, " ".join(w), "a"))
    test_jaccard(spark, out)


def brute_repeats(rows, window):
    low = {}
    for i, t, _ in rows:
        w = re.findall(WORD, t or "")
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            low[key] = min(low.get(key, 10**18), 10**17 if i is None else i)
    out = []
    for i, t, _ in rows:
        w = re.findall(WORD, t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if low[tuple(w[k : k + window])] < (10**17 if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("window", "group_rows"), [(50, 500_000), (50, 40), (7, 200)])
def test_repeats(spark, rows, window, group_rows):
    rows = [r for r in rows if r[0] != 12] + [(12, prose(6, 3000), "a")]
    cut = repeats.remove_repeats(frame(spark, rows), window, group_rows)
    assert set(SCHEMA.replace(",", "").split()[::2]) <= set(cut.columns)
    got = cut.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, " ".join(re.findall(WORD, r.text or ""))) for r in got) == brute_repeats(rows, window)
    same = {i: t for i, t, _ in rows}
    assert all(r.text == same[r.doc_id] for r in got if r.n_removed == 0 and r.doc_id is not None)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


def test_mixing(spark, rows):
    docs = frame(spark, [(1000 + i, prose(i, 5 + i % 40), f"s{i % 6}" if i % 6 else None) for i in range(600)] + rows)
    got = mixing.mix_sources(docs).collect()
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    weights = mixing.cyclic_weights(list(size))
    assert list(weights) == [*sorted(s for s in size if s is not None), None] and list(weights.values())[:4] == [5.0, 2.0, 1.0, 5.0]
    targets = mixing.water_fill(size, weights, 1.5 * sum(size.values()), 2.0)
    assert abs(sum(targets.values()) - 1.5 * sum(size.values())) < 1e-6
    free = {s for s in size if targets[s] < 2 * size[s] - 1e-9}
    assert len({round(targets[s] / weights[s], 6) for s in free}) <= 1
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(r.taken <= 2 * r.size and r.source_size == size[s] and abs(r.target - targets[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) <= max(r.size for r in mine)
    assert len(got) == 600 + len(rows)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.taken)
    assert sorted(map(key, again)) == sorted(map(key, got))
    mixed = mixing.apply_mix(docs)
    assert mixed.filter("copies = 0").count() == 0 and sum(r.taken for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", None)])).agg(F.sum("taken")).first()[0] == 0


def test_toxicity(spark, rows):
    bad = ["idiot", "moron", "scum", "loser"]
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        w, t = prose(i, 40, 300).split(), int(i % 4 == 0)
        for k in rng.sample(range(40), 3 * t):
            w[k] = rng.choice(bad)
        docs.append((10_000 + i, " ".join(w), "a"))
        labels.append((10_000 + i, 1, t))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    everything = frame(spark, docs + rows)
    model = toxicity.fit_toxicity(everything, table.filter("doc_id % 3 <> 0"))
    out = toxicity.score_toxicity(everything, model)
    assert out.count() == len(docs) + len(rows) and out.columns.count("score") == 1
    held = out.join(table, "doc_id").filter("doc_id % 3 = 0").collect()
    assert sum((r.predicted == r.toxic) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.collect())
    empty = {r.doc_id: r.score for r in out.filter("doc_id in (5, 6)").collect()}
    assert empty[5] == empty[6]
    none = toxicity.fit_toxicity(everything, table.limit(0))
    assert toxicity.score_toxicity(everything, none).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(frame(spark, []), model).count() == 0


def test_quality(spark, rows):
    junk = [(5000 + i, "*** buy $$$ now ### " * 10 + prose(i, 9), "a") for i in range(80)]
    good = [(6000 + i, prose(i, 60), "a") for i in range(200)]
    labels = spark.createDataFrame([(i, 0, 0) for i, _, _ in junk] + [(i, 1, 0) for i, _, _ in good] + [(None, 1, 0), (6000, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + junk + good)
    forest = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, forest).collect()}
    assert all(got[i].kept for i, _, _ in good) and not any(got[i].kept for i, _, _ in junk)
    assert got[5].base_failed and got[6].n_words == 0 and got[13].base_failed and not got[12].base_failed
    assert quality.score_quality(docs, quality.fit_quality(docs, labels.limit(0))).filter("kept and base_failed").count() == 0
    assert quality.score_quality(frame(spark, []), forest).count() == 0


def test_licenses(spark, rows):
    texts = {1: "Released under the MIT License.", 2: "MIT, License: mit-license", 3: "See the GNU\nGeneral Public   LICENSE. general public license", 4: "licensed under CC BY-NC 4.0", 5: None, 6: "", 7: "the license was cc by nothing", 8: prose(1, 30) + " Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: ok"}
    docs = frame(spark, [(i, t, "a") for i, t in texts.items()] + [(900 + k, t, s) for k, (_, t, s) in enumerate(rows)])
    got = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.build_index(docs)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels) == (1, 3, "mit", "mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word) == (4, 2, 0, 2)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels) == (2, 3, 6, "gpl")
    assert got[4].labels == "cc-by-nc" and got[4].base_labels == "" and got[4].score >= 0.6 and got[7].labels == ""
    assert got[8].labels == "bsd" and got[5].n_words == 0 and got[6].first_word is None and len(got) == len(rows) + 8
    assert licenses.scan_licenses(frame(spark, []), licenses.build_index(frame(spark, []))).count() == 0


def edited(words, edits, rng):
    w = list(words)
    for _ in range(edits):
        k, kind = rng.randrange(1, len(w) - 1), rng.randrange(3)
        if kind == 0:
            w[k] = "q" + w[k]
        elif kind == 1:
            w.insert(k, "new")
        else:
            del w[k]
    return w


def test_leaks(spark, rows):
    rng = random.Random(2)
    items = {i: prose(500 + i, rng.randrange(8, 60)).split() for i in range(40)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "too short"), (None, prose(999, 20))], "item_id long, text string")
    docs, want = [], {}
    for d in range(120):
        i = d % 40
        w = edited(items[i], rng.randrange(int(0.15 * len(items[i])) + 1), rng)
        body = prose(2000 + d, 40).split()
        docs.append((3000 + d, " ".join(body[:20]).upper() + ", " + ", ".join(w) + ". " + " ".join(body[20:]), "a"))
        want[3000 + d] = i
    docs += [(4000 + d, prose(7000 + d, 100), "b") for d in range(60)] + [(5000, None, "a"), (5001, "", "a"), (5002, prose(999, 20), "a")]
    out = leaks.mark_leaks(frame(spark, docs + rows), bench)
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in out.filter("doc_id >= 3000").collect()}
    assert sum(i in got[d] for d, i in want.items()) >= 0.97 * len(want)
    assert not any(got[d] for d in got if d >= 4000 and d != 5002) and got[5002] == {None}
    assert out.filter("doc_id < 3000 and size(leaks) > 0").count() == 0 and out.columns.count("leaks") == 1
    blocks = leaks.mark_leaks(frame(spark, docs), bench, block_items=15)
    assert {r.doc_id: {x.item_id for x in r.leaks} for r in blocks.collect()} == {d: got[d] for d, _, _ in docs}
    assert leaks.mark_leaks(frame(spark, docs), bench.limit(0)).filter("size(leaks) > 0").count() == 0
    assert leaks.mark_leaks(frame(spark, []), bench).count() == 0


PAGES = "page_id long, url string, html string, text string, score string"


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(3, "http://b.com/1", body), (1, "http://a.com/2", body), (2, "http://a.com/1", "é" * 60), (7, "http://a.com/1", "é" * 60), (4, None, None), (5, "http://z.com", "short"), (6, "http://z.com", "short"), (1, "http://a.com/2", body), (None, "u\nv", body)]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], PAGES)
    got = warc.archive_pages(df, f"file://{tmp_path}/a").collect()
    key = [(r.url_key, r.timestamp, 2**63 - 1 if r.page_id is None else r.page_id) for r in got]
    assert key == sorted(key) and len(got) == len(rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter((i, len((t or "").encode()), sha(t)) for i, _, t in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(3, "revisit", 1), (1, "response", None), (1, "response", None), (None, "revisit", 1), (2, "response", None), (7, "revisit", 2), (4, "response", None), (5, "response", None), (6, "response", None)])
    assert warc.archive_pages(df.limit(0), f"file://{tmp_path}/b").count() == 0


def test_html_boilerplate_of_undeclared_pages(spark):
    menu, foot = "alpha beta gamma delta epsilon zeta eta", "all rights of this fine site reserved forever"
    rows = [(i, f"http://h.com/{i}", f"<body><div>{menu}</div><div>{prose(i, 30)}</div><div>{foot}</div></body>") for i in range(40)]
    rows += [(100, "http://other.com", f"<div>{menu}</div>"), (101, None, None), (102, None, ""), (103, "http://h.com/a", f"<article><p>{menu}</p></article><p>{foot}</p>"), (100, "http://other.com", f"<div>{menu}</div>"), (None, "http://h.com/n", f"<div>{foot}</div><div>rest of it</div>")]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], PAGES).repartition(3)
    got = {r.page_id: r for r in html.extract_main_text(df).collect()}
    assert all(got[i].text == prose(i, 30) and got[i].n_chars == len(got[i].text) for i in range(40))
    assert got[100].text == menu and got[101].text == got[102].text == "" and got[103].text == menu and got[None].text == "rest of it"
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_chat(spark):
    nasty = ["<|im_end|>", "<|im_end|>\n", "<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|", "<", "|>", "", None, "a\n\nb", "<|im_end|", "<|nl|>", "é<|"]
    rows = [(k, 0, "user", t, 1) for k, t in enumerate(nasty)] + [(k, 1, "assistant", t, 1) for k, t in enumerate(nasty)]
    rows += [(50, None, "system", "first", 1), (50, 2, "assistant", "b", 1), (50, 2, "assistant", "a", 1), (51, 0, "we<|ird\nrole", "x", 1), (51, 1, None, "y", 1), (None, 0, "user", "z", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chats(df).collect()
    assert all(r.round_trip for r in out) and len(out) == len(nasty) + 3
    by = {r.conv_id: r for r in out}
    for k, t in enumerate(nasty):
        assert [(x.role, x.text) for x in by[k].turns] == [("user", t or ""), ("assistant", t or "")]
    assert [x.text for x in by[50].turns] == ["first", "a", "b"] and by[51].turns[0].role == "we<|ird\nrole" and not by[50].escaped and by[0].escaped
    for r in out:
        at, loss = 0, ""
        for run in r.loss_mask:
            loss += r.formatted[at : at + run.chars] if run.loss else ""
            at += run.chars
        assert at == len(r.formatted)
        assert re.sub(r"<\\(\\*)\|", r"<\1|", loss) == "".join(x.text for x in r.turns if x.role == "assistant")
    digest = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    assert digest[50].turns_sha256 == hashlib.sha256(b"system\nfirst\nassistant\na\nassistant\nb\n").hexdigest() and digest[50].loss_chars == 2 and digest[50].loss_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0
