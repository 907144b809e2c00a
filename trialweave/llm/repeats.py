"""Substring dedup with prefix-partitioned suffix trees.

A window is ``window`` consecutive words of one document. Words covered by a window that also starts in
a document with a smaller doc_id are removed; windows are judged on the input.

1. *Candidates.* Only suffixes that some other document may share go into trees. The anchor of a window
   is the least hash of its n-grams of half the window's length, so equal windows have equal anchors, and
   anchors are few (about 7 in 100 words for 50-word windows). Anchors that two documents have, counted
   over all documents, mark the candidate suffixes; no repeat is lost.
2. *Partitioning.* Candidate suffixes are counted by their first word, in hashed slots. Neighbouring slots
   are joined into groups of up to ``group_rows`` suffixes; a slot above that is split by the first 2
   words, then 4, 8 and so on, up to the window.
3. *Subtrees.* One task builds the subtree of a group: its suffixes in order, the node of each at the depth
   of the window, and the smallest document below the node. Leaves of other documents are repeats; a run
   of such leaves along a document is a maximal repeat. Below that depth a tree need not branch.

Suffixes whose node has a smaller document in the same block of a map task (2 MB of text) are settled there: a
block sends at most one document's leaves for a node, so a passage that a third of all documents share makes a small group.

Null and empty texts have no words and lose none. A null doc_id is larger than any other, and not smaller
than another null. Rows with one doc_id never remove from each other. Extra columns pass through the pipeline's
stage but are ignored here; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, is_small
from .tokens import U, Tokens, chunks, distinct_pairs, grams, mix, release, runs_of, tokenize

_NULL = 2**63 - 1
_SLOT_BITS = 12
#: Anchors that one fragment of the candidate search should hold, which bounds its task's memory.
_FRAGMENT = 500_000
#: Documents up to which the ids of candidates are broadcast (8 bytes each).
_IDS = 400_000
#: Text bytes of a block in which suffixes are settled.
_BLOCK = 2 << 20


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part["doc_id"].cast(pa.int64()).fill_null(_NULL).to_numpy()


def _window_anchors(t: Tokens, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, texts and anchors."""
    n = window - window // 2
    h = grams(t.hash, n)
    span = window - n + 1  # n-grams in a window
    m, width = h, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:]) if len(m) > width else m[:0]
        width *= 2
    if width < span and len(m) > span - width:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    elif width < span:
        m = m[:0]
    owner = t.owner()
    at = np.flatnonzero(owner[: len(m)] == owner[window - 1 : window - 1 + len(m)]) if len(m) else np.zeros(0, np.int64)
    return at, owner[at], m[at]


def shared_anchors(documents: DataFrame, window: int, scratch: Scratch, fragments: int) -> DataFrame:
    """(doc_id, anchor) of the anchors that two documents have; nulls as the largest long."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", _BLOCK):
                t = tokenize(part["text"])
                _, owner, anchor = _window_anchors(t, window)
                change = np.ones(len(anchor), bool)
                change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                a, d = distinct_pairs(anchor[change], _ids(part)[owner[change]])[:2]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
                size = np.diff(np.append(first, len(a)))
                settled = np.repeat(size > 1, size)
                sent = np.ones(len(a), bool)
                sent[settled] = False
                sent[first] = True  # of settled anchors one witness
                columns: list[list] = [[], [], [], [], [], []]
                sa, sd, sw = a[sent], d[sent], settled[sent]
                none = a[:0].tobytes()
                for f, i, j in runs_of(((sa >> U(40)) * U(fragments) >> U(24)).astype(np.int64)):  # sorted by anchor
                    for c, v in zip(columns, (f, sa[i:j].tobytes(), sd[i:j].tobytes(), sw[i:j].tobytes(), none, none), strict=True):
                        c.append(v)
                pa_, pd = a[settled], d[settled]
                other = (mix(pd.astype(U)) % U(fragments)).astype(np.int64)  # settled pairs go by document
                order = np.argsort(other, kind="stable")
                for f, i, j in runs_of(other[order]):
                    for c, v in zip(columns, (f, none, none, none, pa_[order[i:j]].tobytes(), pd[order[i:j]].tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["frag", "anchor", "doc", "witness", "done", "done_doc"])

    def settle(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        a, d, w = read("anchor", U), read("doc", np.int64), read("witness", bool)
        order = np.argsort(a, kind="stable")
        a, d, w = a[order], d[order], w[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        many = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) | np.logical_or.reduceat(w, first) if len(first) else np.zeros(0, bool)
        good = np.repeat(many, np.diff(np.append(first, len(a)))) & ~w
        return pa.table({"doc_id": np.concatenate([d[good], read("done_doc", np.int64)]), "anchor": np.concatenate([a[good], read("done", U)]).astype(np.int64)})

    rows = documents.mapInArrow(spread, "frag int, anchor binary, doc binary, witness binary, done binary, done_doc binary")
    return rows.groupBy("frag").applyInArrow(settle, "doc_id long, anchor long")


class _Groups:
    """The partition of suffixes: slots of the first word joined into groups, and slots split by longer prefixes.

    A slot that is split opens about as many new ones as it holds groups, so there are a few slots for each group,
    that is, for each task of the subtrees.
    """

    def __init__(self, window: int):
        self.lengths = [n for n in (1, 2, 4, 8, 16, 32) if n < window] + [window]
        self.split: list[tuple[np.ndarray, np.ndarray]] = []  # nodes of each length that go on to the next, and bits of their new slots
        self.nodes, self.group = np.zeros(0, U), np.zeros(0, np.int64)

    def node(self, words: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The node of each suffix, of the shortest prefix that isn't split, and which suffixes reach ``depth``."""
        hashed = lambda n: mix(grams(words, n)[at]) if len(at) else np.zeros(0, U)
        node, alive = hashed(1) >> U(64 - _SLOT_BITS), np.ones(len(at), bool)
        for heavy, bits in self.split[:depth]:
            place = np.minimum(np.searchsorted(heavy, node), len(heavy) - 1)
            alive &= heavy[place] == node
            if alive.any():
                k = self.lengths[self._level(heavy) + 1]
                node = np.where(alive, mix(node + U(1)) ^ (hashed(k) >> (U(64) - bits[place])), node)
        return node, alive

    def _level(self, heavy: np.ndarray) -> int:
        return next(i for i, (h, _) in enumerate(self.split) if h is heavy)

    def of(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        node, _ = self.node(words, at, len(self.split))
        return self.group[np.searchsorted(self.nodes, node)]


def _partition(candidates: DataFrame, window: int, group_rows: int) -> _Groups:
    context = candidates.sparkSession.sparkContext
    groups, done, level = _Groups(window), {}, 0
    while True:
        shared = context.broadcast(groups)

        def count(batches: Iterator[pa.RecordBatch], level: int = level, shared=shared) -> Iterator[pa.RecordBatch]:
            for part, t, at in _suffixes(batches, window):
                node, alive = shared.value.node(t.hash, at, level)
                key, n = np.unique(node[alive], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["node", "n"])

        rows = candidates.mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toArrow()  # a row per slot, not per suffix
        found = dict(zip(rows["node"].to_numpy().astype(np.int64).view(U).tolist(), rows["n"].to_pylist(), strict=True))
        heavy = {k: n for k, n in found.items() if n > group_rows} if level + 1 < len(groups.lengths) else {}
        done |= {k: n for k, n in found.items() if k not in heavy}
        if not heavy:
            break
        bits = [min(_SLOT_BITS, (4 * heavy[k] // group_rows).bit_length() + 2) for k in sorted(heavy)]
        groups.split.append((np.array(sorted(heavy), U), np.array(bits, U)))
        level += 1
    nodes, group, filled = sorted(done), [], 0
    for k in nodes:
        if not group or filled + done[k] > group_rows:
            group.append(group[-1] + 1 if group else 0)
            filled = done[k]
        else:
            group.append(group[-1])
            filled += done[k]
    groups.nodes, groups.group = np.array(nodes, U), np.array(group, np.int64)
    return groups


def _suffixes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.RecordBatch, Tokens, np.ndarray]]:
    """Blocks of candidate documents, their words, and the first words of candidate windows."""
    for batch in batches:
        for part in chunks(batch, "text", _BLOCK):
            t = tokenize(part["text"])
            at, owner, anchor = _window_anchors(t, window)
            lists = part["anchors"]
            flat = lists.flatten().to_numpy().astype(np.int64).view(U)
            of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            salt = lambda d: mix(d.astype(U) + U(1))
            good = np.isin(anchor ^ salt(owner), flat ^ salt(of))
            yield part, t, at[good]


def _sequence(t: Tokens) -> np.ndarray:
    """A hash of the whole word sequence of each text, which tells rows of one doc_id apart."""
    total = np.zeros(len(t.hash) + 1, U)
    place = np.arange(len(t.hash)) - np.repeat(t.doc[:-1], np.diff(t.doc))
    np.cumsum(mix(t.hash ^ mix(place.astype(U))), out=total[1:])
    return mix(total[t.doc[1:]] - total[t.doc[:-1]])


def _repeat_rows(candidates: DataFrame, groups: _Groups, window: int) -> DataFrame:
    """(doc_id, sequence, starts): windows that a smaller document has; subtrees send them packed by bucket of documents."""
    buckets = int(groups.group[-1]) + 1 if len(groups.group) else 1
    shared = candidates.sparkSession.sparkContext.broadcast(groups)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t, at in _suffixes(batches, window):
            ids, seq, owner = _ids(part), _sequence(t), t.owner()
            leaf = grams(t.hash, window)[at] if len(at) else np.zeros(0, U)
            doc, place = owner[at], at - t.doc[owner[at]]
            order = np.lexsort((ids[doc], leaf))
            key, d = leaf[order], ids[doc][order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            least = np.repeat(d[first], np.diff(np.append(first, len(key))))
            known = order[d > least]  # a smaller document of this block has the window
            rest = order[d == least]
            group = shared.value.of(t.hash, at[rest])
            order = np.lexsort((place[rest], doc[rest], group))
            rest, group = rest[order], group[order]
            for g, a, b in runs_of(group):
                s = rest[a:b]
                yield _blob(g, leaf[s], ids[doc[s]], seq[doc[s]], place[s], False)
            if len(known):
                known = known[np.lexsort((place[known], doc[known]))]
                g = int(mix(seq[doc[known[:1]]])[0] % U(buckets))
                yield _blob(g, leaf[known], ids[doc[known]], seq[doc[known]], place[known], True)

    def subtree(table: pa.Table) -> pa.Table:
        release()
        done = np.array(table["done"].to_pylist(), bool)
        size = np.array([len(x) // 8 for x in table["leaf"].to_pylist()], np.int64)
        done = np.repeat(done, size)
        read = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        leaf, doc, seq, place = read("leaf", U), read("doc", np.int64), read("seq", U), read("place", np.uint32)
        live = np.flatnonzero(~done)
        order = live[np.lexsort((doc[live], leaf[live]))]
        node = leaf[order]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        least = np.repeat(doc[order][first], np.diff(np.append(first, len(node))))
        hit = np.concatenate([order[doc[order] > least], np.flatnonzero(done)])
        bucket = (mix(doc[hit].astype(U)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        hit = hit[order]
        rows = [(k, *(x[hit[a:b]].tobytes() for x in (doc, seq, place))) for k, a, b in runs_of(bucket[order])]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("doc", "seq", "place"), 1)}})

    def merge(table: pa.Table) -> pa.Table:
        release()
        read = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        d, s, place = read("doc", np.int64), read("seq", U), read("place", np.uint32)
        order = np.lexsort((place, s, d))
        d, s, place = d[order], s[order], place[order]
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])]) if len(d) else np.zeros(0, np.int64)
        starts = pa.ListArray.from_arrays(np.append(new, len(d)).astype(np.int32), pa.array(place.astype(np.int32)))
        return pa.table({"doc_id": d[new], "sequence": s[new].astype(np.int64), "starts": starts})

    rows = candidates.mapInArrow(spread, "grp int, leaf binary, doc binary, seq binary, place binary, done boolean")
    leaves = rows.groupBy("grp").applyInArrow(subtree, "bucket int, doc binary, seq binary, place binary")
    return leaves.groupBy("bucket").applyInArrow(merge, "doc_id long, sequence long, starts array<int>")


def _blob(group: int, leaf: np.ndarray, doc: np.ndarray, seq: np.ndarray, place: np.ndarray, done: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (leaf, doc, seq, place.astype(np.uint32))), pa.array([done])], ["grp", "leaf", "doc", "seq", "place", "done"])


def _cut(t: Tokens, d: int, starts: np.ndarray, window: int) -> tuple[int, str]:
    """Words removed from text d, and what stays: its runs of kept words, as they stand, joined by a blank."""
    a, b = int(t.doc[d]), int(t.doc[d + 1])
    edge = np.zeros(b - a + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    keep = np.cumsum(edge[:-1]) == 0
    change = np.flatnonzero(np.diff(np.r_[0, keep.astype(np.int8), 0]))
    runs = [t.buf[t.start[a + i] : t.end[a + j - 1]].tobytes() for i, j in zip(change[::2], change[1::2], strict=True)]
    return int((~keep).sum()), b" ".join(runs).decode("utf-8", "replace")


def remove_repeats(documents: DataFrame, window: int = 50, group_rows: int = 500_000) -> DataFrame:
    """``documents`` (doc_id, text and any more columns) with its text cut, and n_words and n_removed (long) added.

    A text that loses nothing comes back as it is, null included.
    """
    scratch = Scratch(documents.sparkSession, "repeats")
    base = documents.select("doc_id", "text")
    n_bytes = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(1, -(-n_bytes // 80 // _FRAGMENT))  # an anchor in 80 bytes or fewer
    anchors = shared_anchors(base, window, scratch, fragments).groupBy(F.col("doc_id").alias("__tw_id")).agg(F.collect_list("anchor").alias("anchors"))
    anchors = scratch.keep(anchors, "anchors")
    small = is_small(anchors, _IDS)
    bounded = lambda df: F.broadcast(df) if small else df
    rest = [c for c in documents.columns if c not in ("n_words", "n_removed")]
    keyed = documents.select(*[f"`{c}`" for c in rest], F.coalesce("doc_id", F.lit(_NULL)).alias("__tw_id"))
    some = keyed.select("__tw_id", "doc_id", "text").join(bounded(anchors.select("__tw_id")), "__tw_id", "left_semi")
    candidates = scratch.keep(some.join(anchors, "__tw_id").select("doc_id", "text", "anchors"), "candidates")
    groups = _partition(candidates, window, group_rows)
    found = _repeat_rows(candidates, groups, window).groupBy(F.col("doc_id").alias("__tw_id")).agg(F.collect_list(F.struct("sequence", "starts")).alias("__tw_repeats"))
    found = scratch.keep(found, "repeats")
    scratch.drop("candidates", "anchors")
    small = is_small(found, _IDS)
    plain = keyed.join(bounded(found.select("__tw_id")), "__tw_id", "left_anti").withColumn("__tw_repeats", F.lit(None).cast(found.schema["__tw_repeats"].dataType))
    hit = keyed.join(bounded(found.select("__tw_id")), "__tw_id", "left_semi").join(found, "__tw_id")
    schema = documents.select(*[f"`{c}`" for c in rest]).schema.add("n_words", "long").add("n_removed", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                repeats = part["__tw_repeats"]
                texts = part["text"]
                removed = np.zeros(part.num_rows, np.int64)
                if repeats.null_count < part.num_rows:
                    t = tokenize(part["text"])
                    seq, n_words = _sequence(t), np.diff(t.doc)
                    texts = texts.to_pylist()
                    for d, r in enumerate(repeats.to_pylist()):
                        for x in r or ():
                            if x["sequence"] == int(seq[d].astype(np.int64)):
                                removed[d], texts[d] = _cut(t, d, np.array(x["starts"], np.int64), window)
                    texts = pa.array(texts, pa.string())
                else:
                    n_words = np.diff(tokenize(part["text"], hashes=False).doc)
                columns = [texts if c == "text" else part[c] for c in rest]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words.astype(np.int64)), pa.array(removed)], [f.name for f in schema])

    columns = [*rest, "__tw_repeats"]
    return plain.select(*[f"`{c}`" for c in columns]).unionByName(hit.select(*[f"`{c}`" for c in columns])).mapInArrow(cut, schema)
