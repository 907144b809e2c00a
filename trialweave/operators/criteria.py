"""Second level: criterion scores to trial scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import apply_constraint
from ..functions.text import norm_search, search_tokens

#: Weight of a criterion by polarity.
POLARITY_WEIGHT = {"inclusion": 1.0, "exclusion": 0.25}
#: Criteria and their bytes, and patients, that are scored together; terms that are looked up at once; rows up to which a side is broadcast.
_BLOCK_ROWS, _BLOCK_BYTES, _BLOCK_PATIENTS, _LOOKUPS, _FEW_PATIENTS, _FEW_TRIALS = 8192, 6_000_000, 256, 2_000_000, 20_000, 200_000


def scope(criteria: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Criteria of shortlisted trials, for every patient: (patient_id, nct_id) semi-joins before any scoring."""
    return criteria.join(shortlist.select("patient_id", "nct_id").distinct(), "nct_id")


def normalise(hits: DataFrame, score: str = "score", polarity: str = "eligibility_type") -> DataFrame:
    """Scores over the patient's best of all queries (0 counts as 1), times the polarity's weight."""
    best = F.max(score).over(Window.partitionBy("patient_id"))
    weight = F.when(F.col(polarity) == "inclusion", POLARITY_WEIGHT["inclusion"]).when(F.col(polarity) == "exclusion", POLARITY_WEIGHT["exclusion"]).otherwise(1.0)
    return hits.withColumn("norm_score", F.col(score) / F.when(best == 0, 1.0).otherwise(best) * weight)


def adjust(hits: DataFrame, signals: DataFrame, weight: float = 0.25) -> DataFrame:
    """Applies one constraint signal per (patient_id, criteria_id) to its hits; without one, nothing changes."""
    once = signals.dropDuplicates(["patient_id", "criteria_id"]).select("patient_id", "criteria_id", "signal")
    out = hits.join(once, ["patient_id", "criteria_id"], "left").withColumn("pre_constraint_score", F.col("score"))
    return out.withColumn("score", apply_constraint("score", "signal", weight))


def trial_scores(hits: DataFrame, keys: list, method: str = "weighted", threshold: float = 0.5) -> DataFrame:
    """Trial scores from criterion hits (keys, nct_id, criteria_id, score, pre_constraint_score).

    A hit counts if either score reaches the threshold; a criterion counts once with its best score, and
    hits without a criteria_id each on their own. Two partial aggregations, no list is collected.
    """
    kept = hits.filter((F.col("score") >= threshold) | (F.coalesce("pre_constraint_score", "score") >= threshold))
    named = kept.filter("criteria_id is not null").groupBy(*keys, "nct_id", "criteria_id").agg(F.max("score").alias("score")).select(*keys, "nct_id", "score")
    each = named.unionByName(kept.filter("criteria_id is null").select(*keys, "nct_id", "score"))
    sums = each.groupBy(*keys, "nct_id").agg(F.sum("score").alias("total"), F.count("*").alias("n"), F.max("score").alias("best"))
    n = F.col("n").cast("double")
    formula = {
        "avg": F.col("total") / n,
        "sqrt": F.col("total") / F.sqrt(n),
        "log": F.col("total") / F.log(n + 1),
        "weighted": 0.7 * F.col("total") / F.sqrt(n) + 0.3 * F.col("best"),
    }[method]
    return sums.select(*keys, "nct_id", "n", formula.alias("trial_score"))


def _line_blocks(criteria_rows: DataFrame, near: DataFrame) -> DataFrame:
    """A row per block of criteria of the trials in ``near``: their ids and token strings, trials, and distinct terms as binary."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def block(held: list) -> pa.RecordBatch:
            ids, norms, hashes, trial = (pa.concat_arrays([b[c] for b in held]) for c in ("ids", "norm", "hashes", "trial"))
            nd = pc.list_value_length(hashes).to_numpy().astype(np.int64)
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            parts = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (trial.to_numpy(), nd, hashes.flatten().to_numpy())]
            return pa.RecordBatch.from_arrays([whole(ids), whole(norms), *parts], ["ids", "norms", "trial", "nd", "term"])

        held, rows, size = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                rows, size = rows + part.num_rows, size + part.nbytes
                if rows >= _BLOCK_ROWS or size >= _BLOCK_BYTES:
                    yield block(held)
                    held, rows, size = [], 0, 0
        if held:
            yield block(held)

    asked = near.select("nct_id").distinct()
    few = asked.limit(_FEW_TRIALS + 1).count() <= _FEW_TRIALS
    lines = criteria_rows.join(F.broadcast(asked) if few else asked, "nct_id", "left_semi")
    terms = F.transform(F.array_distinct(search_tokens("criterion")), lambda t: F.xxhash64(t))
    rows = lines.select(F.struct("nct_id", "criteria_id", "eligibility_type").alias("ids"), norm_search("criterion").alias("norm"), terms.alias("hashes"), F.xxhash64("nct_id").alias("trial"))
    kind = rows.schema["ids"].dataType.simpleString()
    return rows.mapInArrow(pack, f"ids array<{kind}>, norms array<string>, trial binary, nd binary, term binary").withColumn("block", F.monotonically_increasing_id())


def _patient_blocks(queries: DataFrame, near: DataFrame) -> DataFrame:
    """A row per block of patients: their ids, trials, and queries with token strings and distinct terms."""

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_PATIENTS):
                part = batch.slice(at, _BLOCK_PATIENTS)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part[c]])) for c in ("patient_id", "trials", "asked")], ["patients", "trials", "asked"])

    terms = F.transform(F.array_distinct(search_tokens("query")), lambda t: F.xxhash64(t))
    asked = queries.select("patient_id", F.struct(F.col("query_idx").cast("long").alias("idx"), norm_search("query").alias("norm"), terms.alias("terms")).alias("q"))
    asked = asked.filter(F.size("q.terms") > 0).groupBy("patient_id").agg(F.collect_list("q").alias("asked"))
    trials = near.select("patient_id", F.xxhash64("nct_id").alias("t"), "nct_id").filter("nct_id is not null").groupBy("patient_id").agg(F.collect_set("t").alias("trials"))
    rows = trials.join(asked, "patient_id").select("patient_id", "trials", "asked")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(pack, f"patients array<{kinds['patient_id']}>, trials array<{kinds['trials']}>, asked array<{kinds['asked']}>")


def block_hits(queries: DataFrame, near: DataFrame, criteria_rows: DataFrame, least: float = 0.0) -> DataFrame:
    """Lexical scores of patients' queries on criteria of their trials (patient_id, query_idx, nct_id, criteria_id, eligibility_type, score).

    A block of criteria and one of patients are scored together, so that shared words are never rows. Hits below ``least`` of the
    best that their task has seen of the patient are left out, and so are never those of at least that share of the patient's best.
    """

    def score(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        best: dict = {}
        block = None
        mix = lambda trial, term: (trial * np.int64(-7046029254386353131)) ^ term

        def spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The places of ranges, and which range each is of."""
            of = np.repeat(np.arange(len(size)), size)
            return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of], of

        for batch in batches:
            for at in range(batch.num_rows):
                if batch["block"][at].as_py() != block:
                    block = batch["block"][at].as_py()
                    ids, norms = batch["ids"][at].values, batch["norms"][at].values
                    trial, nd, term = (np.frombuffer(batch[c][at].as_buffer(), np.int64) for c in ("trial", "nd", "term"))
                    line = np.repeat(np.arange(len(nd)), nd)
                    key = mix(trial[line], term)
                    order = np.argsort(key, kind="stable")
                    key, line = key[order], line[order]
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                    keys, held = key[first], np.diff(np.append(first, len(key)))
                    known = np.unique(trial)
                if not len(keys):
                    continue
                patients, lists, asked = (batch[c][at].values for c in ("patients", "trials", "asked"))
                near_, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(patients)), pc.list_value_length(lists).to_numpy())
                mine = known[np.minimum(np.searchsorted(known, near_), len(known) - 1)] == near_
                near_, who = near_[mine], who[mine]
                if not len(near_):
                    continue
                every = asked.flatten()
                texts, index, terms = every.field("norm"), every.field("idx").to_numpy(), every.field("terms")
                nq = pc.list_value_length(terms).to_numpy().astype(np.int64)
                words, of = terms.flatten().to_numpy(), np.repeat(np.arange(len(nq)), nq)
                per = np.append(0, np.cumsum(pc.list_value_length(asked).to_numpy()))  # the queries of a patient
                word_at = np.append(0, np.cumsum(nq))[per]  # their terms
                owner = np.repeat(np.arange(len(patients)), np.diff(per))
                size = (word_at[1:] - word_at[:-1])[who]
                names = patients.to_pylist()
                cut = np.searchsorted(np.cumsum(size), np.arange(_LOOKUPS, size.sum() + _LOOKUPS, _LOOKUPS), side="right")
                for a, b in zip(np.append(0, cut[:-1]), np.append(cut[:-1], len(size)), strict=True):
                    place, pair = spread(word_at[who[a:b]], size[a:b])
                    wanted = mix(near_[a:b][pair], words[place])
                    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    hit = np.flatnonzero(keys[found] == wanted)
                    found, query = found[hit], of[place[hit]]
                    lines, back = spread(first[found], held[found])
                    both, same = np.unique(query[back] * len(nd) + line[lines], return_counts=True)
                    q, d = both // len(nd), both % len(nd)
                    value = np.minimum(1.0, 0.75 * same / nq[q] + 0.25 * same / (nq[q] + nd[d] - same))
                    for j in np.flatnonzero(same == nq[q]):
                        want, text = texts[q[j]].as_py(), norms[d[j]].as_py()
                        if want == text or f" {want} " in f" {text} ":
                            value[j] = 1.0 if want == text else 0.95
                    if least > 0 and len(q):
                        top = np.zeros(len(names))
                        np.maximum.at(top, owner[q], value)
                        for i in np.flatnonzero(top):
                            top[i] = best[names[i]] = max(top[i], best.get(names[i], 0.0))
                        kept = value >= least * top[owner[q]] - 1e-8  # scores are compared to 9 digits
                        q, d, value = q[kept], d[kept], value[kept]
                    for k in range(0, len(q), 50_000):
                        i, j = q[k : k + 50_000], pa.array(d[k : k + 50_000])
                        which = ids.take(j)
                        columns = [patients.take(pa.array(owner[i])), pa.array(index[i]), *(pc.struct_field(which, c) for c in ("nct_id", "criteria_id", "eligibility_type")), pa.array(value[k : k + 50_000])]
                        yield pa.RecordBatch.from_arrays(columns, ["patient_id", "query_idx", "nct_id", "criteria_id", "eligibility_type", "score"])

    asked = _patient_blocks(queries, near)
    few = near.select("patient_id").distinct().limit(_FEW_PATIENTS + 1).count() <= _FEW_PATIENTS
    both = _line_blocks(criteria_rows, near).crossJoin(F.broadcast(asked) if few else asked)
    kind = {c: d.schema[c].dataType.simpleString() for d, c in ((near, "patient_id"), (criteria_rows, "nct_id"), (criteria_rows, "criteria_id"), (criteria_rows, "eligibility_type"))}
    return both.mapInArrow(score, f"patient_id {kind['patient_id']}, query_idx long, nct_id {kind['nct_id']}, criteria_id {kind['criteria_id']}, eligibility_type {kind['eligibility_type']}, score double")
