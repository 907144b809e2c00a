"""Quality rules: base counts of a text, and a boosted-tree verdict over document statistics.

``document_stats`` counts over whole texts, vectorised; ``fit_quality`` trains on a bounded sample of
labelled rows (``max_labels``, those whose doc_id hashes lowest); ``score_quality`` adds the score of
the flattened trees. The forest may only fall with the shares of symbols, of repeated lines and of
repeated words. Without labels of both kinds it is a constant and the base rules alone decide.

Nulls and empty texts have no words, so the base rule (fewer than ``MIN_WORDS``) rejects them. Rows
with the same doc_id are scored each on its own. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import boosting
from .tokens import CLASSES, U, chunks, gram_docs, hash_spans, mix, tokenize

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punctuation_share", "distinct_share", "long_word_share", "words_a_line", "beyond_ascii_share", "top_word_share")
MONOTONE = {2: -1, 3: -1, 4: -1}


def _lookup(chars: str | bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return table


_SYMBOL = _lookup(SYMBOLS)
_UPPER, _DIGIT, _POINT = _lookup(bytes(range(65, 91))), _lookup(b"0123456789"), _lookup(b".,;:!?\"'()[]{}-/\\@^_~`+=")
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _seen_before(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands earlier in the array."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether an equal key stands anywhere else in the array."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def text_stats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (long) and FEATURES (double) of each text."""
    t = tokenize(texts)
    docs, buf, offsets = len(t.offsets) - 1, t.buf, t.offsets
    salt = mix(np.arange(docs).astype(U) + U(1))
    n_words = np.diff(t.doc)
    lead = _LEAD[buf]
    inside = CLASSES["space"][buf]
    word_chars = _per_text(lead & inside, offsets)
    n_symbols = _per_text(_SYMBOL[buf], offsets)
    # lines: spans between line breaks and the edges of texts
    breaks = np.flatnonzero(buf == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(buf)]
    of = np.searchsorted(offsets, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(buf)), offsets[of + 1])
    stop = stop - (buf[stop - 1] == 10) if len(stop) else stop
    has = np.searchsorted(t.start, stop) > np.searchsorted(t.start, begin)
    begin, stop, of = begin[has], stop[has], of[has]
    n_lines = np.bincount(of, minlength=docs)
    n_dup_lines = np.bincount(of[_seen_before(hash_spans(buf, begin, stop) ^ salt[of])], minlength=docs)
    # words inside a window that occurs again
    at, owner, h = gram_docs(t, REPEAT_WINDOW)
    hit = at[_repeated(h ^ salt[owner])]
    edge = np.zeros(len(t.start) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + REPEAT_WINDOW, -1)
    n_repeat = _per_text(np.cumsum(edge[:-1]) > 0, t.doc)
    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], 1).astype(np.int64)
    # more statistics for the trees
    who = t.owner()
    key = np.sort(t.hash ^ salt[who])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    wo = t.hash ^ salt[who]
    again = _seen_before(wo)
    distinct = np.bincount(who[~again], minlength=docs)
    size = np.diff(np.append(first, len(key)))
    most = np.zeros(docs)
    if len(wo):
        rank = np.searchsorted(key[first], wo)
        np.maximum.at(most, who, size[rank])
    length = t.end - t.start
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    long_words = np.bincount(who[length > 14], minlength=docs)
    features = np.stack([
        np.log1p(n_words), word_chars / words, n_symbols / chars, n_dup_lines / np.maximum(n_lines, 1), n_repeat / words,
        _per_text(_UPPER[buf], offsets) / chars, _per_text(_DIGIT[buf], offsets) / chars, _per_text(_POINT[buf], offsets) / chars,
        distinct / words, long_words / words, n_words / np.maximum(n_lines, 1), _per_text(lead & (buf > 127), offsets) / chars, most / words,
    ], 1).astype(float)
    return counts, features


def fit_quality(documents: DataFrame, labels: DataFrame, max_labels: int = 20_000, **options) -> boosting.Forest:
    """Fits the trees to ``labels.quality`` of at most ``max_labels`` rows, which is also the bound of what is broadcast and collected."""
    ship(documents.sparkSession)
    sample = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, x = text_stats(part["text"])
                yield pa.RecordBatch.from_arrays([part["quality"].cast(pa.int64()), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["quality", *FEATURES])

    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "quality")
    # an id may repeat: the bound holds for rows too, and the fit must not depend on the order in which tasks end
    got = rows.mapInArrow(stats, "quality long, " + ", ".join(f"{f} double" for f in FEATURES))
    got = got.orderBy(F.xxhash64("quality", *FEATURES), "quality", *FEATURES).limit(max_labels).toPandas()
    return boosting.fit(got[list(FEATURES)].to_numpy(), (got["quality"].to_numpy() > 0).astype(float), MONOTONE, **options)


def score_quality(documents: DataFrame, forest: boosting.Forest, keep_at: float = 0.5) -> DataFrame:
    """Each row's doc_id, COUNTS, base_failed, score (of quality 1) and kept."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, x = text_stats(part["text"])
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                p = boosting.score(forest, x)
                columns = [part["doc_id"].cast(pa.int64()), *(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return documents.select("doc_id", "text").mapInArrow(run, schema)
