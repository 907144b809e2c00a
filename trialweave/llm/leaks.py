"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

An item leaks into a document if some run of the document's words is within ``max_share`` of the item's
words of it by edit distance (insert, delete, replace a word). Words are runs of ASCII letters
(lower-cased), digits and characters beyond ASCII, so case and punctuation don't hide a leak.

1. *Windows.* k edits leave one of any k + 1 pieces of an item whole, so a leak holds an n-gram of the item of
   floor(words / (k + 1)) words (``_GRAM`` at most). Where a document has one, all windows of the item's
   size whose start is within k words of the aligned place are looked at; elsewhere no leak can be.
2. *Embedding.* Each window is read by a random walk (Chakraborty, Goldenberg, Koucky): at step j the
   current word is written out, and the walk moves on if a random function of j and the word says so.
   Strings few edits apart come out a small Hamming distance apart. Items go the same walks.
3. *LSH.* Each table hashes a few sampled places of the walk; windows and items of one size that agree in any
   table are candidates. Walks are repeated with new randomness until items that carry the largest allowed
   number of random edits are found with at least the target recall, which is measured for each item size when the index is built.
4. *Verification.* Exact edit distance of the item to the best-fitting run around each candidate window.

Where ``_MOST_WALKS`` walks don't reach the target, and for items of more than ``_LSH_WORDS`` words, steps 2 and 3 are left
out and verification follows step 1, which is complete: k edits spoil at most k * q of an item's q-grams, and
those that stay have aligned places within k words of each other, so only places with that many are verified.

Items of fewer than 7 words allow no edits at the default share, so these are found as exact runs of words.
Items without a word, or with fewer than ``min_words``, are left out. Items are read in
blocks of ``block_items``, a pass over the documents each, so what is broadcast is bounded at any size of the benchmark.
Null and empty texts have no leaks; repeated items are all reported; extra columns pass through; an empty
table of documents gives no rows and an empty benchmark no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .tokens import U, chunks, gram_docs, grams, mix, tokenize

_GRAM, _SAMPLED, _TABLES, _MOST_WALKS, _LSH_WORDS = 5, 3, 8, 16, 64
#: Cells of a row of edit distances that are worked on at once.
_CELLS = 1 << 20
_LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("item_words", T.LongType())]))


class Items(NamedTuple):
    """Words of a block of benchmark items, and their LSH tables by size."""

    ids: list
    words: list[np.ndarray]
    edits: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: sorted hashes, item, offset
    seen: dict[int, np.ndarray]  # length: a bitmap of the hashes' leading bits
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # size: sorted keys, item
    walks: dict[int, int]  # by size; 0 where windows go to verification without LSH


def walk(windows: np.ndarray, seed: int) -> np.ndarray:
    """The random walk over each row of word hashes: 3 words out for each in, zeros once a row is used up."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), U)], 1)
    at, out, row = np.zeros(rows, np.int64), np.empty((rows, 3 * n), U), np.arange(rows)
    steps = mix(np.arange(3 * n).astype(U) + U(seed) * U(1_000_003))
    for j in range(3 * n):
        now = padded[row, at]
        out[:, j] = now
        at = np.minimum(at + (mix(now ^ steps[j]) & U(1)).astype(np.int64), n)
    return out


def table_keys(windows: np.ndarray, walks: range) -> np.ndarray:
    """Keys of each row in each table (rows x tables)."""
    n, keys = windows.shape[1], []
    for w in walks:
        out = walk(windows, w + 1)
        rng = np.random.default_rng(1000 * w + n)
        for t in range(_TABLES):
            key = np.full(len(windows), w * _TABLES + t, U)
            for place in rng.choice(2 * n, min(_SAMPLED, 2 * n), replace=False):
                key = mix(key ^ out[:, place]) * U(0x9E3779B97F4A7C15)
            keys.append(mix(key))
    return np.stack(keys, 1) if keys else np.zeros((len(windows), 0), U)


def _perturb(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """An item-sized window with so many random edits."""
    out = [int(x) for x in words]
    for _ in range(edits):
        kind, at, new = rng.integers(3), int(rng.integers(len(out))), int(rng.integers(2**63))
        if kind == 0:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    out += [int(rng.integers(2**63)) for _ in range(len(words) - len(out))]
    return np.array(out[: len(words)], U)


def walks_for(words: list[np.ndarray], edits: int, recall: float, samples: int = 300) -> int:
    """Walks after which windows with so many edits of items of one size are found with the target recall; 0 if none are enough."""
    if len(words[0]) > _LSH_WORDS:
        return 0
    rng = np.random.default_rng(5)
    pick = rng.integers(len(words), size=samples)
    a = np.stack([words[i] for i in pick])
    b = np.stack([_perturb(words[i], edits, rng) for i in pick])
    found = np.zeros(samples, bool)
    for w in range(_MOST_WALKS):
        found |= (table_keys(a, range(w, w + 1)) == table_keys(b, range(w, w + 1))).any(1)
        if found.mean() >= recall:
            return w + 1
    return 0


def build_items(ids: list, texts: list, max_share: float, recall: float, min_words: int) -> Items:
    t = tokenize(pa.array(texts, pa.string()), "alnum", lower=True)
    words = [t.hash[a:b] for a, b in zip(t.doc[:-1], t.doc[1:], strict=True)]
    good = [i for i, w in enumerate(words) if len(w) >= max(1, min_words)]
    ids, words = [ids[i] for i in good], [words[i] for i in good]
    edits = np.array([int(max_share * len(w)) for w in words], np.int64)
    pieces: dict[int, list] = {}
    for i, w in enumerate(words):
        q = min(_GRAM, len(w) // (int(edits[i]) + 1))
        pieces.setdefault(q, []).append((grams(w, q), np.full(len(w) - q + 1, i), np.arange(len(w) - q + 1)))
    index, seen = {}, {}
    for q, rows in pieces.items():
        h, item, at = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(h, kind="stable")
        index[q] = (h[order], item[order], at[order])
        bits = max(10, int(np.ceil(np.log2(16 * len(h)))))
        seen[q] = np.zeros(1 << bits, bool)
        seen[q][(h >> U(64 - bits)).astype(np.int64)] = True
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    walks: dict[int, int] = {}
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size, these in by_size.items():
        mine = np.array(these)
        walks[size] = walks_for([words[i] for i in these], int(edits[these[0]]), recall)
        if not walks[size]:
            continue
        keys = table_keys(np.stack([words[i] for i in mine]), range(walks[size]))
        item = np.repeat(mine, keys.shape[1])
        order = np.argsort(keys.ravel(), kind="stable")
        tables[size] = (keys.ravel()[order], item[order])
    return Items(ids, words, edits, index, seen, tables, walks)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each member of the ranges is from, and the members."""
    many = hi - lo
    of = np.repeat(np.arange(len(lo)), many)
    return of, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[of]


def _pieces(total: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts rows with running totals of hits into pieces of about ``most`` hits, so that n-grams of many items need little memory at a time."""
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _dense(t, doc: np.ndarray, who: np.ndarray, start: np.ndarray, times: np.ndarray, q: int, items: Items) -> np.ndarray:
    """Texts, items and stretches of k + 1 places that may hold a leak, as rows, from the places that shared q-grams align to, and how many do."""
    order = np.lexsort((start, who, doc))
    doc, who, start, times = doc[order], who[order], start[order], times[order]
    k = items.edits[who]
    size = np.array([len(w) for w in items.words], np.int64)[who]
    pair = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (who[1:] != who[:-1])])
    line = pair * int(start.max() - start.min() + k.max() + 1) + start - start.min()
    total = np.append(0, np.cumsum(times))
    enough = total[np.searchsorted(line, line + k, "right")] - total[:-1] >= size - q + 1 - k * q
    return np.unique(np.stack([doc, who, (start - t.doc[doc]) // (k + 1)])[:, enough], axis=1)


def _windows(t, items: Items) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By item size: texts and first words of the windows that may hold a leak; and what goes to verification without LSH."""
    found: dict[int, list] = {}
    sure = [np.zeros((3, 0), np.int64)]
    exact = np.array([not items.walks[len(w)] for w in items.words], bool)
    size_of = np.array([len(w) for w in items.words], np.int64)
    for q, (h, item, offset) in items.grams.items():
        at, owner, g = gram_docs(t, q)
        seen = items.seen[q]
        bits = len(seen).bit_length() - 1
        near = np.flatnonzero(seen[(g >> U(64 - bits)).astype(np.int64)])
        at, owner, g = at[near], owner[near], g[near]
        lo, hi = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
        total = np.cumsum(hi - lo)
        far: list[np.ndarray] = []
        for a, b in _pieces(total):
            of, entry = _expand(lo[a:b], hi[a:b])
            who, start = item[entry], at[a:b][of] - offset[entry]
            doc = owner[a:b][of]
            mine = exact[who]
            if mine.any():
                places, times = np.unique(np.stack([doc[mine], who[mine], start[mine]]), axis=1, return_counts=True)
                far.append(np.vstack([places, times]))
            doc, who, start = doc[~mine], who[~mine], start[~mine]
            # one row for each text, size, place and reach before the starts around it are laid out
            keys = np.unique(np.stack([doc, size_of[who], start, items.edits[who]]), axis=1) if len(doc) else np.zeros((4, 0), np.int64)
            of, place = _expand(keys[2] - keys[3], keys[2] + keys[3] + 1)
            doc, size = keys[0][of], keys[1][of]
            # a window begins inside the text; a leak that lost words may end with the text before the window does
            place = np.clip(place, t.doc[doc], t.doc[doc + 1] - 1)
            for n in np.unique(size):
                mine = size == n
                found.setdefault(int(n), []).append(np.unique(np.stack([doc[mine], place[mine]]), axis=1))
        if far:
            sure.append(_dense(t, *np.concatenate(far, 1), q, items))
    out = {}
    for n, parts in found.items():
        pair = np.unique(np.concatenate(parts, 1), axis=1)
        out[n] = (pair[0], pair[1])
    return out, np.concatenate(sure, 1)


def _distances(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of an item to the best run of each region, and the word after that run."""
    rows, m = regions.shape
    before = np.zeros((rows, m + 1), np.int64)
    step = np.arange(m + 1)
    for i, w in enumerate(item, 1):
        best = np.empty((rows, m + 1), np.int64)
        best[:, 0] = i
        best[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + (regions != w))
        before = np.minimum.accumulate(best - step, 1) + step
    end = before.argmin(1)
    return before[np.arange(rows), end], end


def find_in(texts: pa.Array, items: Items, block: int = 20_000) -> list[dict[int, tuple[int, int]]]:
    """For each text, by item: the least distance and the first word of the window that led to it."""
    t = tokenize(texts, "alnum", lower=True)
    leaks: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(texts))]
    windows, sure = _windows(t, items)
    for n, (docs, places) in windows.items():
        keys, owners = items.tables[n]
        padded = np.concatenate([t.hash, np.zeros(n, U)])
        for lo in range(0, len(docs), block):
            doc, place = docs[lo : lo + block], places[lo : lo + block]
            window = padded[place[:, None] + np.arange(n)]
            window[place[:, None] + np.arange(n) >= t.doc[doc + 1][:, None]] = 0  # beyond the text
            mine = table_keys(window, range(items.walks[n])).ravel()
            row, entry = _expand(np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right"))
            pair = np.unique(np.stack([row // (items.walks[n] * _TABLES), owners[entry]]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            for i in np.unique(pair[1]):
                rows = pair[0][pair[1] == i]
                k = int(items.edits[i])
                first = np.maximum(t.doc[doc[rows]], place[rows] - k)
                span = first[:, None] + np.arange(n + 2 * k)
                region = np.where(span < t.doc[doc[rows] + 1][:, None], np.concatenate([t.hash, np.zeros(1, U)])[np.minimum(span, len(t.hash))], U(0))
                distance, _ = _distances(items.words[i], region)
                for r, d in zip(rows[distance <= k], distance[distance <= k], strict=True):
                    new = (int(d), int(place[r] - t.doc[doc[r]]))
                    old = leaks[doc[r]].get(int(i))
                    leaks[doc[r]][int(i)] = min(old, new) if old else new
    padded = np.append(t.hash, U(0))
    for i in np.unique(sure[1]):
        item, k = items.words[i], int(items.edits[i])
        doc, _, stretch = sure[:, sure[1] == i]
        n, many = len(item), max(1, _CELLS // (len(item) + 3 * k))
        for lo in range(0, len(doc), many):
            d = doc[lo : lo + many]
            first = t.doc[d] + stretch[lo : lo + many] * (k + 1) - k
            span = first[:, None] + np.arange(n + 3 * k)
            inside = (span >= t.doc[d][:, None]) & (span < t.doc[d + 1][:, None])
            distance, end = _distances(item, np.where(inside, padded[np.clip(span, 0, len(t.hash))], U(0)))
            begin = np.clip(first + end - n, t.doc[d], np.maximum(t.doc[d], t.doc[d + 1] - n)) - t.doc[d]
            for r in np.flatnonzero(distance <= k):
                new = (int(distance[r]), int(begin[r]))
                old = leaks[d[r]].get(int(i))
                leaks[d[r]][int(i)] = min(old, new) if old else new
    return leaks


def mark_leaks(documents: DataFrame, benchmark: DataFrame, max_share: float = 0.15, recall: float = 0.995, min_words: int = 1, block_items: int = 20_000) -> DataFrame:
    """``documents`` with ``leaks`` added: an array of (item_id, distance, start_word, item_words), by item_id."""
    spark = documents.sparkSession
    ship(spark)
    rest = [f for f in documents.schema.fields if f.name != "leaks"]
    out = documents.select(*[f"`{f.name}`" for f in rest]).withColumn("leaks", F.array().cast(_LEAKS))
    schema = out.schema
    items_of = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null")
    blocks = -(-items_of.count() // block_items)
    for b in range(blocks):
        part = items_of.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect() if blocks > 1 else items_of.orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(build_items([r[0] for r in part], [r[1] for r in part], max_share, recall, min_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for piece in chunks(batch, "text"):
                    old = piece["leaks"].to_pylist()
                    new = [was + [{"item_id": items.ids[i], "distance": d, "start_word": s, "item_words": len(items.words[i])} for i, (d, s) in got.items()] for was, got in zip(old, find_in(piece["text"], items), strict=True)]
                    new = [sorted(x, key=lambda r: (r["item_id"] is None, r["item_id"], r["distance"], r["start_word"])) for x in new]
                    yield pa.RecordBatch.from_arrays([*(piece[f.name] for f in rest), pa.array(new, pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "start_word", "item_words")])))], schema.names)

        out = out.mapInArrow(run, schema)
    return out
