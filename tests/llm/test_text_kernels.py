"""Tokens, features and the per-text kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trialweave.llm import boosting, quality, tokens
from trialweave.llm.html import main_text, parse_page
from trialweave.llm.warc import LoserTree, url_key

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="abAé \n\t\x0b0*ß", max_size=40)), max_size=8)
SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(deadline=None, max_examples=60)
@given(TEXT)
def test_tokens(texts):
    for kind, pattern in (("space", SPACE), ("alnum", ALNUM)):
        t = tokens.tokenize(pa.array(texts, pa.string()), kind, lower=True)
        words = [t.buf[a:b].tobytes().decode() for a, b in zip(t.start, t.end, strict=True)]
        assert [words[a:b] for a, b in zip(t.doc[:-1], t.doc[1:], strict=True)] == [re.findall(pattern, lower(x or "")) for x in texts]
        by = {}
        for w, h in zip(words, t.hash.tolist(), strict=True):
            assert by.setdefault(w, h) == h
        assert len(set(by.values())) == len(by)


def test_hash_of_a_word_does_not_depend_on_its_place():
    long = "x" * (3 << 20)
    t = tokens.tokenize(pa.array([f"ab {long} ab", "ab"]))
    assert t.hash[0] == t.hash[2] == t.hash[3] != t.hash[1]
    g = tokens.grams(np.concatenate([t.hash[:1]] * 200), 50)
    assert len(set(g.tolist())) == 1 and len(g) == 151 and len(tokens.grams(g[:3], 50)) == 0


def stats(text):
    w = re.findall(SPACE, text or "")
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {j for i, g in enumerate(five) if five.count(g) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)]


@settings(deadline=None, max_examples=60)
@given(TEXT)
def test_counts(texts):
    counts, features = quality.text_stats(pa.array(texts, pa.string()))
    assert counts.tolist() == [stats(t) for t in texts] and np.isfinite(features).all()


def test_boosting_is_monotone_and_learns():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.standard_normal(3000) < 0.5) & (x[:, 1] > 0.2)).astype(float)
    f = boosting.fit(x[:2000], y[:2000], {0: -1})
    p = boosting.score(f, x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.8
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.7), np.full(200, 0.3)], 1)
    assert (np.diff(boosting.score(f, grid)) <= 1e-12).all()
    assert len(boosting.score(boosting.fit(x[:0], y[:0]), x[:5])) == 5 and len(set(boosting.score(boosting.fit(x[:9], np.ones(9)), x[:5]))) == 1


@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=7))
def test_loser_tree(runs):
    merged = list(LoserTree([iter(sorted(r)) for r in runs], lambda x: x))
    assert merged == sorted(x for r in runs for x in r)


def test_url_key():
    assert url_key("http://WWW.a.Example.com:80/X/?b=2&a=1#f") == "com,example,a)/x?a=1&b=2" and url_key(None) == "" and url_key("https://h:81/") == "h:81)/"


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><article>no</article>";</script></head>
<body><header>Site</header><nav><a href="/">Home</a></nav><div class="ad">buy</div><article><header><h1>Title</h1></header>
<p>One &lt;b&gt; two<br>three <b>bold</b> &nbsp; end<p>Second<!-- hidden > --> part<ul><li>item one<li>item two</ul>
<aside>side</aside><div class="share-buttons">share</div><div id="comments"><p>nice</p></div><footer>by</footer></article>
<footer>&copy; me</footer></body></html>"""


def test_parse_page():
    assert main_text(parse_page(PAGE), None, 6) == "Title\n\nOne <b> two three bold end\n\nSecond part\n\nitem one\n\nitem two"
    assert main_text(parse_page("<div>plain</div> tail <foo"), None, 6) == "plain\n\ntail"
    assert main_text(parse_page("<body><main><p>m</p></main><p>o</p></body>"), None, 6) == "m"
    assert main_text(parse_page("<article><p>cut &am"), None, 6) == "cut &am"
    assert parse_page("") == [] and main_text([], None, 6) == ""
    assert main_text(parse_page('<div><a href="x>y">k</a> 1 < 2 & 3</div>'), None, 6) == "k 1 < 2 & 3"
    assert main_text(parse_page("<p>a" * 3 + "<" * 5), None, 6)
    many = "<div>" * 3000 + "deep" + "<p " * 3000
    assert "deep" in main_text(parse_page(many), None, 6)
