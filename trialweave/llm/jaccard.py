"""N-gram Jaccard join by vertical partitioning, to classes and components.

Documents with equal n-gram sets form a class; the join runs between classes. The global order of
n-grams is that of their hashes, cut into fragments of equal width, so each fragment holds an even
share of all n-grams and no pass over the corpus is needed to find the cuts.

1. *Filter.* Sets with Jaccard t or more that are cut to their first n - ceil(t n) + k n-grams in the
   global order share k of them. Every class sends such a prefix (k = ``extra`` of its size) to the
   fragments; each fragment counts, per class, the n-grams that another class has too; the partial
   counts are summed, and classes that fall short of k cannot have a partner. An n-gram that a task
   sees in two classes is settled there, so that a frequent one is sent once a task and no fragment
   gathers its whole posting list.
2. *Folding.* What is left are the documents with much of their text elsewhere. Classes with an equal
   min-hash are compared with one centre each; the verified links fold groups of near copies into
   parts, so a group of g costs g comparisons, not g squared.
3. *Completion.* Links inside a part change nothing. Among n-grams that several parts have, each class
   takes its prefix with rare ones first (document frequency over what is left). Rows stay where size and place in
   the prefix allow a row of another part to be the first common n-gram of a link. In two rounds the members
   of each prefix n-gram are compared with two of them drawn at random, which merges nearly all parts that
   link. Then all pairs of classes of different parts that meet in a prefix n-gram are compared: an
   n-gram's largest part only with its strangers, and a pair at the first n-gram that it shares.

A pair is compared in two steps: a bound from 1,024-bit parity sketches (the Hamming distance of two
sketches never exceeds the size of the symmetric difference), evaluated inside the join, so pairs that
fail are never rows; then exact overlaps, counted per fragment and summed per pair. No link between
classes of different parts is missed, nothing is capped, and components are exact up to 64-bit hash
collisions. An n-gram of m classes, s of them strangers to its largest part, costs up to m * s bounds
(nanoseconds each); rows are made only of those that pass, which is a thin shell around the threshold.

Empty and null texts have no n-grams and are linked with nothing; a text with fewer words than n is one
n-gram. Documents with a null doc_id take part, but never name a component unless they are alone in it
(then it is null). Repeated rows are in one class. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_small
from .graph import components
from .tokens import U, chunks, distinct_pairs, gram_docs, grams, mix, release, runs_of, tokenize

#: Words of the parity sketch, min-hashes, and fragments in which overlaps of pairs are counted.
_SKETCH, _MINHASHES, _PARTS = 16, 3, 4
#: Rounds of comparisons with drawn centres at most, and earlier n-grams that a row carries; both only save work.
_ROUNDS, _EARLIER = 2, 6
#: N-grams that one fragment of the filter should hold, which bounds its task's memory.
_FRAGMENT = 500_000
#: N-grams of a task that are settled together before they are sent, which bounds its memory too.
_BLOCK = 300_000
#: Ratio of one step of sizes to the next, in summaries of an n-gram's members.
_STEP = 1.1
_NULL_ID = -(2**63)


def document_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes in global order, text by text: the hashes, the size of each set, and its class (0 if empty)."""
    t = tokenize(texts, lower=True)
    docs = len(t.doc) - 1
    _, owner, h = gram_docs(t, n)
    words = np.diff(t.doc)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        whole = [grams(t.hash[t.doc[d] : t.doc[d + 1]], int(words[d]))[0] for d in short]
        h, owner = np.concatenate([h, mix(np.array(whole, U) + words[short].astype(U))]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    size = np.bincount(owner, minlength=docs)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), out=total[1:])
    at = np.append(0, np.cumsum(size))
    label = mix(total[at[1:]] - total[at[:-1]] + size.astype(U))
    label[size == 0] = 0
    return h, size, label


def _need(n, percent: int):
    """Least overlap with any partner: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _extra(n, percent: int):
    """k of the prefix; it never falls as n grows, so a partner's k is at least that of the smallest partner size."""
    return np.maximum(1, n * percent // 100)


def _spread(h: np.ndarray, row: np.ndarray, label: np.ndarray, part: np.ndarray, fragments: int) -> pa.RecordBatch:
    """Rows for the fragments. N-grams of one part go with their label; of those that several parts of this
    task have, one witness goes, and their labels' counts are settled.
    """
    order = np.lexsort((row, h))
    hs, rows = h[order], row[order]
    ps, ls = part[rows], label[rows]
    first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(hs)))
    many = np.minimum.reduceat(ps, first) != np.maximum.reduceat(ps, first) if len(first) else np.zeros(0, bool)
    settled = np.repeat(many, size)
    key, count = np.unique(distinct_pairs(ls[settled], hs[settled])[0], return_counts=True)
    # equal classes of this task send an n-gram once
    lone = np.flatnonzero(~settled)
    lone = lone[distinct_pairs(hs[lone], ls[lone])[2]]
    none = np.zeros(many.sum(), U)
    sh, sl, sp = np.concatenate([hs[lone], hs[first[many]]]), np.concatenate([ls[lone], none]), np.concatenate([ps[lone], none])
    frag = ((sh >> U(40)) * U(fragments) >> U(24)).astype(np.int64)
    order = np.lexsort((sl, frag))
    sh, sl, sp, frag = sh[order], sl[order], sp[order], frag[order]
    out: dict[str, list] = {c: [] for c in ("frag", "grams", "labels", "parts", "runs", "settled", "counts")}
    for i, (f, a, b) in enumerate(runs_of(frag)):
        mine = i == 0  # the settled counts travel with any one fragment; there is a witness for each
        start = np.flatnonzero(np.r_[True, sl[a + 1 : b] != sl[a : b - 1]])
        values = (f, sh[a:b].tobytes(), sl[a:b][start].tobytes(), sp[a:b][start].tobytes(), np.diff(np.append(start, b - a)).astype(np.uint32).tobytes(), key.tobytes() if mine else b"", count.astype(np.uint32).tobytes() if mine else b"")
        for c, v in zip(out, values, strict=True):
            out[c].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out["frag"], pa.int32()), *(pa.array(out[c], pa.binary()) for c in list(out)[1:])], list(out))


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, percent: int, extra: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """First n-grams of the sets in the global order, the rows they are of, and the rows' labels."""
    for batch in batches:
        for part in chunks(batch, "text"):
            h, size, label = document_sets(part["text"], n)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            keep = place < (size - _need(size, percent) + _extra(size, extra))[row]
            yield h[keep], row[keep], label


def _blocks(pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Joins pieces to blocks of about ``_BLOCK`` n-grams, each of which sends one witness of a frequent n-gram."""
    held: list[tuple] = []
    grams_, rows = 0, 0
    for h, row, label in pieces:
        held.append((h, row + rows, label))
        grams_, rows = grams_ + len(h), rows + len(label)
        if grams_ >= _BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, grams_, rows = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


_SPREAD_SCHEMA = "frag int, grams binary, labels binary, parts binary, runs binary, settled binary, counts binary"


def _count_shared(table: pa.Table, buckets: int) -> pa.Table:
    """Per label, the n-grams of this fragment that another part has too."""
    read = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
    h, runs = read("grams", U), read("runs", np.uint32)
    label, part = np.repeat(read("labels", U), runs), np.repeat(read("parts", U), runs)
    order = np.argsort(h, kind="stable")
    h, label, part = h[order], label[order], part[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    low, high = (np.minimum.reduceat(part, first), np.maximum.reduceat(part, first)) if len(first) else (part, part)
    shared = np.repeat(low != high, size) & (label != 0)
    # a class may come from several tasks
    once = distinct_pairs(label[shared], h[shared])[0]
    labels, counts = np.concatenate([once, read("settled", U)]), np.concatenate([np.ones(len(once)), read("counts", np.uint32)])
    return _packed(*_summed(labels, counts), buckets)


def _summed(labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(labels, return_inverse=True)
    return key, np.bincount(inverse, counts, len(key)).astype(np.uint32)


def _packed(labels: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Labels and counts of each bucket of labels, in a row a bucket."""
    bucket = (labels % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows = [(k, labels[order[a:b]].tobytes(), counts[order[a:b]].tobytes()) for k, a, b in runs_of(bucket[order])]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "labels": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})


def _shared_counts(spread: DataFrame, fragments: int) -> DataFrame:
    """(label, shared): the sums of the fragments' partial counts, packed by bucket of labels on the way.

    A class that several tasks settle is counted once a task, which can only keep it.
    """

    def count(table: pa.Table) -> pa.Table:
        release()
        return _count_shared(table, fragments)

    def total(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        labels, counts = _summed(read("labels", U), read("counts", np.uint32))
        return pa.table({"label": labels.astype(np.int64), "shared": counts.astype(np.int64)})

    partial = spread.groupBy("frag").applyInArrow(count, "bucket int, labels binary, counts binary")
    return partial.groupBy("bucket").applyInArrow(total, "label long, shared long")


def jaccard_components(documents: DataFrame, **options) -> DataFrame:
    """Each row's doc_id, n_shingles and component_id, linking sets with 100 * intersection >= ``percent`` * union."""
    return jaccard_rows(documents, **options).select("doc_id", "n_shingles", "component_id")


def with_label(documents: DataFrame, name: str, n: int = 5) -> DataFrame:
    """Adds each row's class, 0 for none, which tells rows of one doc_id apart."""
    schema = documents.limit(0).schema.add(name, "long")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(document_sets(part["text"], n)[2].astype(np.int64))], schema.names)

    return documents.mapInArrow(label, schema)


def jaccard_rows(documents: DataFrame, n: int = 5, percent: int = 75, extra: int = 9) -> DataFrame:
    """Each row's doc_id, n_shingles, component_id, class (``label``, 0 if it has no words) and group of linked classes (``part``, null if it has none)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    documents = documents.select("doc_id", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, size, label = document_sets(part["text"], n)
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(label.astype(np.int64))], ["doc_id", "n", "label"])

    info = scratch.keep(documents.mapInArrow(describe, "doc_id long, n long, label long"), "info")
    classes = scratch.keep(info.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("rows")), "classes")
    total = info.agg(F.sum("n")).first()[0] or 0
    fragments = max(1, -(-total * (100 - percent + extra) // 100 // _FRAGMENT))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, row, label in _blocks(_prefixes(batches, n, percent, extra)):
            yield _spread(h, row, label, label, fragments)

    counts = _shared_counts(documents.mapInArrow(prefixes, _SPREAD_SCHEMA), fragments)
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * extra / 100))
    left = scratch.keep(classes.join(counts, "label").filter(F.col("shared") >= least).select("label", "rep", "n", "rows"), "left")
    scratch.settle()
    sets = scratch.keep(_sets(documents, left, n), "sets")
    scratch.settle()
    parts = _fold(sets, percent, scratch)
    parts = _complete(sets, parts, percent, scratch)
    named = classes.join(parts, classes.label == parts.cls, "left").select("label", "rep", F.coalesce("part", "label").alias("part"))
    named = scratch.keep(named, "named")
    scratch.drop("classes", "left", "sets", "chosen", "open", *(f"{a}-{b}" for a in ("pairs", "links", "parts", "prefixes") for b in ("fold", *range(_ROUNDS + 1))))
    ids = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = named.join(ids, "part").select("label", "part", "component_id")
    return info.join(named, "label", "left").select("doc_id", "label", "part", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets(documents: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """One row per remaining class: cls, n, sketch, minhash, and its n-grams in the global order by fragment.

    A class of one row is sent nowhere; only of others can its first doc_id be repeated.
    """
    left = left.withColumn("_id", F.coalesce("rep", F.lit(_NULL_ID)))
    small = is_small(left, 200_000)  # 16 bytes a row

    def texts(some: DataFrame) -> DataFrame:
        return documents.join(F.broadcast(some) if small else some, F.coalesce("doc_id", F.lit(_NULL_ID)) == F.col("_id")).select("text", "label")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, size, label = document_sets(part["text"], n)
                good = label.astype(np.int64) == part["label"].to_numpy()
                at = np.append(0, np.cumsum(size))
                sketches, mins, cuts = [], [], []
                for d in np.flatnonzero(good):
                    x = h[at[d] : at[d + 1]]
                    bits = np.bincount((mix(x ^ U(11)) >> U(54)).astype(np.int64), minlength=64 * _SKETCH) & 1
                    sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
                    mins.append([int(mix(x ^ U(7919 * (k + 1))).min().astype(np.int64)) for k in range(_MINHASHES)])
                    edge = np.searchsorted(x, np.array([(k << 64) // _PARTS for k in range(1, _PARTS)], U))
                    cuts.append([p.astype(np.int64) for p in np.split(x, edge)])
                sketch = pa.array([list(s) for s in sketches], pa.list_(pa.int64()))
                grams_ = pa.array(cuts, pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array(label[good].astype(np.int64)), pa.array(size[good].astype(np.int64)), sketch, pa.array(mins, pa.list_(pa.int64())), grams_], ["cls", "n", "sketch", "minhash", "grams"])

    schema = "cls long, n long, sketch array<long>, minhash array<long>, grams array<array<long>>"
    single, several = (texts(left.filter(f).select("_id", "label")).mapInArrow(build, schema) for f in ("rows = 1", "rows > 1"))
    return single.unionByName(several.dropDuplicates(["cls"]))


def _may_link(percent: int) -> Column:
    """Whether the sizes and sketches of a and b allow a link: |symmetric difference| <= (100 - p) / (100 + p) * (|a| + |b|)."""
    apart = F.expr(" + ".join(f"bit_count(a.sketch[{i}] ^ b.sketch[{i}])" for i in range(_SKETCH)))
    na, nb = F.col("a.n"), F.col("b.n")
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def _asked(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets that pairs name, filtered before any shuffle as long as their ids (16 bytes a row) are few enough to broadcast."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    return sets.join(F.broadcast(ids), "cls", "left_semi") if is_small(ids, 200_000) else sets


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted per fragment and summed per pair. Only sets that are in a pair are sent."""
    parts = _asked(sets, pairs).select("cls", "n", F.posexplode("grams").alias("fragment", "grams"))
    a = parts.select(F.col("cls").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    b = parts.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    named = pairs.select("a", "b")
    both = a.join(F.broadcast(named) if is_small(named, 200_000) else named, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("same"))
    sums = both.groupBy("a", "b").agg(F.sum("same").alias("same"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return sums.filter(F.col("same") * 100 >= (F.col("na") + F.col("nb") - F.col("same")) * percent).select("a", "b")


def _fold(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(cls, part) after the links between each class and the centres of its min-hashes."""
    keyed = sets.select("cls", "n", "sketch", F.posexplode("minhash").alias("k", "value"))
    centre = keyed.groupBy("k", "value").agg(F.min_by(F.struct("cls", "n", "sketch"), "cls").alias("c"), F.count("*").alias("m")).filter("m > 1").select("k", "value", "c.*")
    pairs = keyed.alias("b").join(centre.alias("a"), (F.col("a.k") == F.col("b.k")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.cls") != F.col("b.cls")) & _may_link(percent))
    pairs = scratch.keep(pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct(), "pairs-fold")
    links = scratch.keep(_verify(pairs, sets, percent), "links-fold")
    scratch.settle()
    found = components(links, scratch, "fold").select(F.col("node").alias("cls"), F.col("component").alias("part"))
    return scratch.keep(sets.select("cls").join(found, "cls", "left").select("cls", F.coalesce("part", "cls").alias("part")), "parts-fold")


def _complete(sets: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Adds every link between different parts, and with it the components."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    fragments = max(1, -(-total // _FRAGMENT))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part["grams"].flatten()
                h = lists.flatten().to_numpy().astype(np.int64).view(U)
                size = part["n"].to_numpy()
                yield _spread(h, np.repeat(np.arange(len(size)), size), part["cls"].to_numpy().view(U), part["part"].to_numpy().view(U), fragments)

    labelled = sets.join(F.broadcast(parts) if is_small(parts, 200_000) else parts, "cls")
    counts = _shared_counts(labelled.select("cls", "part", "n", "grams").mapInArrow(spread, _SPREAD_SCHEMA), fragments)
    # which classes stay is settled without their n-grams, so that only those are sent, if any
    chosen = labelled.select("cls", "part", "n").join(counts, F.col("cls") == F.col("label")).filter(F.col("shared") * 100 >= F.col("n") * percent)
    chosen = scratch.keep(chosen.select("cls", "part"), "chosen")
    scratch.settle()
    open_ = sets.join(F.broadcast(chosen) if is_small(chosen, 200_000) else chosen, "cls")
    open_ = scratch.keep(open_.select("cls", "part", "n", "sketch", F.flatten("grams").alias("grams")), "open")
    scratch.settle()
    each = open_.select("cls", "part", "n", F.explode("grams").alias("gram"))
    frequency = each.groupBy("gram").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("gram", "df")
    rare = each.join(frequency, "gram").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("order"), F.max("n").alias("n"))
    # of the n-grams of one part only, which come first in the order, there are n - size(order)
    length = F.size("order") - F.ceil(F.col("n") * percent / 100) + 1
    rare = rare.select("cls", "n", length.cast("int").alias("length"), F.transform("order", lambda o: o["gram"]).alias("order")).filter("length > 0")
    rare = rare.select("cls", "n", (F.col("n") - F.size("order")).alias("before"), F.posexplode(F.slice("order", F.lit(1), F.col("length"))).alias("at", "gram"), "order")
    rest = F.col("n") - F.col("before") - F.col("at")  # n-grams from this one on
    most = F.floor(rest * (100 + percent) / percent) - F.col("n")
    earlier = F.slice("order", F.greatest(F.col("at") - _EARLIER + 1, F.lit(1)), F.least("at", F.lit(_EARLIER)))
    rare = rare.select("cls", "gram", most.cast("long").alias("most"), earlier.alias("earlier"))
    met = scratch.keep(_open_to_each_other(rare.join(open_.select("cls", "part", "n", "sketch"), "cls"), percent), "prefixes-0")
    scratch.settle()
    for k in range(_ROUNDS):
        links, parts, met = _round(_centre_pairs(met, percent, k), sets, parts, met, percent, scratch, k)
        if links.isEmpty():
            break
    _, parts, _ = _round(_all_pairs(met, percent), sets, parts, met, percent, scratch, _ROUNDS)
    return parts


def _size_step(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(_STEP))).cast("int")


def _open_to_each_other(met: DataFrame, percent: int) -> DataFrame:
    """The rows whose n-gram has a row of another part that size and place allow to be the first common one of a link.

    From its first common n-gram on, a partner's whole overlap must fit in, which is at least p / (100 + p) of both
    sizes, so a row admits partners of percent of its own size up to ``most``. Both rows of a link's first common n-gram
    stay. Each n-gram keeps one summary per step of sizes, a bounded list.
    """
    steps = met.groupBy("gram", _size_step(F.col("n")).alias("step")).agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("most").alias("reach"))
    steps = steps.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("step", "low", "high", "reach")).alias("steps")).filter("low <> high")
    least, most = _size_step(F.ceil(F.col("n") * percent / 100)), _size_step(F.greatest(F.col("most"), F.lit(1)))
    fits = F.exists("steps", lambda s: (s["step"] >= least) & (s["step"] <= most) & (s["reach"] >= F.col("n")) & ((s["low"] != F.col("part")) | (s["high"] != F.col("part"))))
    return met.join(steps.select(F.col("gram").alias("_gram"), "steps"), (F.col("gram") == F.col("_gram")) & fits, "left_semi")


def _centre_pairs(met: DataFrame, percent: int, k: int) -> DataFrame:
    """Each n-gram's members against two of them, drawn anew for each n-gram and round, where these are of another part."""
    row, draw = F.struct("cls", "part", "n", "sketch"), F.xxhash64(F.lit(k), "gram", "cls")
    centres = met.groupBy("gram").agg(F.min_by(row, draw).alias("x"), F.max_by(row, draw).alias("y")).select("gram", F.explode(F.array("x", "y")).alias("c")).select("gram", "c.*")
    return centres.alias("a").join(met.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.part") != F.col("b.part")) & _may_link(percent))


def _all_pairs(met: DataFrame, percent: int) -> DataFrame:
    """All pairs of different parts that share a prefix n-gram, at the first of these as far as the ``earlier`` ones tell.

    Members of an n-gram's largest part meet those of its other parts only, so a large group that has become
    one part costs as many comparisons as there are strangers, not as many as it has pairs.
    """
    sizes = met.groupBy("gram", "part").count().groupBy("gram").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    b = met.join(sizes, "gram").withColumn("main", F.col("part") == F.col("main"))
    a = b.filter(~F.col("main"))
    once = F.col("b.main") | (F.col("a.cls") < F.col("b.cls"))
    first = ~F.arrays_overlap("a.earlier", "b.earlier")
    return a.alias("a").join(b.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.part") != F.col("b.part")) & once & _may_link(percent) & first)


def _round(pairs: DataFrame, sets: DataFrame, parts: DataFrame, met: DataFrame, percent: int, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links among some pairs, the parts that they join, and the members of n-grams that are still of several parts."""
    pairs = scratch.keep(pairs.select(F.least("a.cls", "b.cls").alias("a"), F.greatest("a.cls", "b.cls").alias("b")).distinct(), f"pairs-{k}")
    links = scratch.keep(_verify(pairs, sets, percent), f"links-{k}")
    scratch.settle()
    if links.isEmpty():
        return links, parts, met
    grown = links.join(parts.select(F.col("cls").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("cls").alias("b"), F.col("part").alias("pb")), "b")
    merged = components(grown.select(F.col("pa").alias("a"), F.col("pb").alias("b")), scratch, f"round-{k}").select(F.col("node").alias("part"), "component")
    parts = scratch.keep(parts.join(merged, "part", "left").select("cls", F.coalesce("component", "part").alias("part")), f"parts-{k}")
    met = met.join(merged, "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")
    return links, parts, scratch.keep(_open_to_each_other(met, percent), f"prefixes-{k + 1}")
