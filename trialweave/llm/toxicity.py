"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z), runs of white space become one blank, and a blank is put at either end. The
features of a text are its distinct n-grams of code points, hashed. Two distributed passes over a bounded
sample of labelled rows give the model:

1. texts of either label that contain a feature, per feature; the log of the smoothed ratio of its
   shares in the two classes is the naive Bayes ratio, and features rank by how significantly their
   counts differ;
2. the first features of each sampled text, to which the driver fits a logistic regression whose
   inputs are the ratios themselves. How many features stay and the penalty are those of ``grid`` with the least
   log loss in cross-validation among the sampled rows: nothing is chosen on rows that the caller held out.

``max_labels`` bounds the sample (rows whose doc_id hashes lowest; as many texts, should ids repeat), ``2 ** bits``
the features; both together bound what is broadcast and collected. Scoring reads every whole text once.

Null and empty texts have no features and get the score of the intercept. Rows with the same doc_id
are scored each on its own. Without labels of both kinds every score is the (smoothed) share of label 1.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch
from .tokens import U, chunks, text_bytes

#: Text bytes worked on at a time: each has a feature an order, of 8 bytes, in several arrays.
_BLOCK = 1 << 18
#: A-Z to lower case, and every white space to a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


class Model(NamedTuple):
    """``weight`` (float32, 2**bits) already holds coefficient times ratio."""

    bits: int
    orders: tuple[int, ...]
    intercept: float
    weight: np.ndarray


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each with a blank at either end and single blanks inside, and the text of each."""
    buf, offsets = text_bytes(texts)
    buf = _FOLD[np.insert(buf, np.concatenate([offsets[:-1], offsets[1:]]), 32)]
    lead = (buf & 0xC0) != 0x80
    point = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    bounds = offsets + 2 * np.arange(len(offsets))
    size = np.diff(np.append(0, np.cumsum(lead))[bounds])
    owner = np.repeat(np.arange(len(size)), size)
    stay = np.ones(len(point), bool)
    stay[1:] = (point[1:] != 32) | (point[:-1] != 32) | (owner[1:] != owner[:-1])
    return point[stay].astype(U), owner[stay]


#: Numbers of features and penalties to choose from.
GRID = tuple((keep, l2) for keep in (256, 1024, 4096) for l2 in (1.0, 5.0, 25.0))


def text_features(texts: pa.Array, bits: int, orders: tuple[int, ...], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, by text; ``only``: a flag for each feature that is wanted."""
    point, owner = _code_points(texts)
    h, pairs = point, []
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1] * U(0x100000001B3) + point[n - 1 :]
        if n not in orders or not len(h):
            continue
        feature = ((h + U(n)) * U(0x9E3779B97F4A7C15) >> U(64 - bits)).astype(np.int64)
        good = owner[: len(h)] == owner[n - 1 :]
        if only is not None:
            good &= only[feature]
        pairs.append(owner[: len(h)][good] << bits | feature[good])
    pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return pair >> bits, pair & ((1 << bits) - 1)


def _logistic(rows: np.ndarray, cols: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on an L2-penalised logistic loss of a sparse matrix; deterministic."""
    w, b = np.zeros(width), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols] * value, len(y)) + b, -30, 30)))
        d = (p - y) / len(y)
        g, gb = np.bincount(cols, d[rows] * value, width) + l2 * w / len(y), d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * (1 - i / (steps + 1))
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
        b -= rate * (mb / (1 - 0.9**i)) / (np.sqrt(vb / (1 - 0.999**i)) + 1e-9)
    return w, float(b)


def _ranked(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each feature, and its place by how significantly its counts differ."""
    ratio = np.log((toxic + alpha) / (n_toxic + 2 * alpha)) - np.log((clean + alpha) / (n_clean + 2 * alpha))
    share = (clean + toxic) / (n_clean + n_toxic)
    z = (toxic - n_toxic * share) / np.sqrt(np.maximum(n_toxic * share * (1 - share) * n_clean / (n_clean + n_toxic), 1e-9))
    place = np.empty(len(z), np.int64)
    place[np.lexsort((np.arange(len(z)), -np.abs(z)))] = np.arange(len(z))
    return ratio, place


def _choose(cols: np.ndarray, n: np.ndarray, width: int, y: np.ndarray, grid: tuple, alpha: float, steps: int, folds: int = 4) -> tuple[int, float]:
    """The (features, penalty) of ``grid`` with the least log loss over the folds, each with ratios and ranks of its own."""
    row, fold, losses = np.repeat(np.arange(len(y)), n), np.arange(len(y)) % folds, np.zeros(len(grid))
    for k in range(folds):
        out = fold == k
        toxic, clean = int(y[~out].sum()), int((~out).sum() - y[~out].sum())
        if not toxic or not clean:
            continue
        learn, test = ~out[row], out[row]
        counts = [np.bincount(cols[learn & (y[row] == v)], minlength=width) for v in (0, 1)]
        ratio, rank = _ranked(*counts, clean, toxic, alpha)
        place = np.cumsum(~out) - 1
        for g, (keep, l2) in enumerate(grid):
            mine, theirs = learn & (rank[cols] < keep), test & (rank[cols] < keep)
            w, b = _logistic(place[row[mine]], cols[mine], ratio[cols[mine]], y[~out], width, l2, steps)
            z = np.bincount(row[theirs], w[cols[theirs]] * ratio[cols[theirs]], len(y))[out] + b
            losses[g] += np.logaddexp(0, np.where(y[out] > 0, -z, z)).sum()
    return grid[int(np.argmin(losses.round(6)))]


def fit_toxicity(documents: DataFrame, labels: DataFrame, max_labels: int = 20_000, bits: int = 20, orders: tuple[int, ...] = (3, 4, 5, 6), grid: tuple = GRID, alpha: float = 1.0, steps: int = 300, choose_rows: int = 2_000) -> Model:
    """Learns label ``toxic`` of at most ``max_labels`` rows of ``labels``; cross-validates on ``choose_rows`` of them."""
    ship(documents.sparkSession)
    sample = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labels)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, (1 << bits) + 1), np.int64)  # the last column counts texts
        for batch in batches:
            for part in chunks(batch, "text", _BLOCK):
                doc, feature = text_features(part["text"], bits, orders)
                y = (part["toxic"].to_numpy(zero_copy_only=False) > 0).astype(np.int64)
                for k in (0, 1):
                    np.add.at(seen[k], feature[y[doc] == k], 1)
                    seen[k, -1] += (y == k).sum()
        some = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["feature", "clean", "toxic"])

    counts = rows.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = Scratch(documents.sparkSession, "toxicity").keep(counts, "counts")
    texts = counts.filter(F.col("feature") == 1 << bits).first()
    clean, toxic = (texts["clean"], texts["toxic"]) if texts else (0, 0)
    weight = np.zeros(1 << bits, np.float32)
    if not clean or not toxic:
        return Model(bits, orders, float(np.log((toxic + 1) / (clean + 1))), weight)
    share = (F.col("clean") + F.col("toxic")) / (clean + toxic)
    z = (F.col("toxic") - toxic * share) / F.sqrt(F.greatest(toxic * share * (1 - share) * clean / (clean + toxic), F.lit(1e-9)))
    best = counts.filter((F.col("feature") < 1 << bits) & (F.col("clean") + F.col("toxic") >= 3)).orderBy(F.round(F.abs(z), 9).desc(), "feature")
    best = best.limit(max(keep for keep, _ in grid)).toPandas().sort_values("feature")
    kept = best["feature"].to_numpy()
    ratio, rank = _ranked(best["clean"].to_numpy(), best["toxic"].to_numpy(), clean, toxic, alpha)
    wanted = np.zeros(1 << bits, bool)
    wanted[kept] = True

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _BLOCK):
                doc, f = text_features(part["text"], bits, orders, wanted)
                n = np.bincount(doc, minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(np.searchsorted(kept, f).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), part["toxic"].cast(pa.int32()), lists], ["doc_id", "toxic", "features"])

    texts = rows.mapInArrow(select, "doc_id long, toxic int, features array<short>").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", F.xxhash64("features")).limit(max_labels)
    texts = texts.toArrow().combine_chunks()
    lists = texts["features"].combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    cols = lists.flatten().to_numpy().astype(np.int64)
    y = (texts["toxic"].to_numpy() > 0).astype(float)
    few = min(choose_rows, len(y))  # in the order of a hash
    keep, l2 = _choose(cols[: n[:few].sum()], n[:few], len(kept), y[:few], grid, alpha, steps // 4)
    row, mine = np.repeat(np.arange(len(y)), n), rank[cols] < keep
    w, intercept = _logistic(row[mine], cols[mine], ratio[cols[mine]], y, len(kept), l2, steps)
    weight[kept] = w * ratio
    return Model(bits, orders, intercept, weight)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    doc, feature = text_features(texts, model.bits, model.orders, model.weight != 0)
    total = np.bincount(doc, model.weight[feature], len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score_toxicity(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``documents`` with score and predicted added; columns of these names are replaced."""
    ship(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 4 * 2**bits bytes
    rest = [f for f in documents.schema.fields if f.name not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _BLOCK):
                p = score_texts(part["text"], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    base = documents.select(*[f"`{f.name}`" for f in rest])
    schema = base.limit(0).schema.add("score", "double").add("predicted", "integer")
    return base.mapInArrow(run, schema)
