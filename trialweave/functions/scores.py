"""Score arithmetic of retrieval, constraints and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, doubled

#: The share of BM25 in a text score, of secondary terms, and of secondary query vectors.
BM25_SHARE, OTHER_TERMS, SECONDARY_SHARE = 0.6, 0.75, 0.2
#: Weights of trial text fields, trial vector fields and criterion text fields.
TRIAL_TEXT_WEIGHTS = {"condition": 6.0, "eligibility_criteria": 4.0, "brief_title": 3.0, "brief_summary": 2.0, "detailed_description": 1.5, "official_title": 1.0}
TRIAL_VECTOR_WEIGHTS = {"condition_vector": 0.3, "brief_title_vector": 0.1, "brief_summary_vector": 0.1, "eligibility_criteria_vector": 0.3}
CRITERIA_TEXT_WEIGHTS = {"criterion": 1.0, "entity_synonyms_text": 1.2, "entity_text": 0.8}


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), doubled(x)))


def fuse_text(bm25, heuristic) -> Column:
    """BM25 (already scaled to [0, 1]) and the heuristic score 3:2; the heuristic alone where BM25 is missing."""
    return F.when(col(bm25).isNull(), doubled(heuristic)).otherwise(clamp(BM25_SHARE * col(bm25) + (1 - BM25_SHARE) * col(heuristic)))


def combine_scores(text, vector, mode: str = "hybrid", weight: float = 0.5) -> Column:
    if mode == "bm25":
        return doubled(text)
    return doubled(vector) if mode == "vector" else (1 - weight) * col(text) + weight * col(vector)


def damp_other(primary, other) -> Column:
    return F.greatest(doubled(primary), OTHER_TERMS * col(other))


def field_weighted(scores: dict, weights: dict) -> Column:
    """Weighted mean of field scores, over the sum of all weights, at most 1."""
    total = sum(weights.values())
    num = sum((weights[k] * col(v) for k, v in scores.items()), F.lit(0.0))
    return F.least(F.lit(1.0), num / F.lit(float(total)))


def vector_fields(scores: dict, present: dict, weights: dict, secondary: dict | None = None, cap: bool = True) -> Column:
    """Weighted mean over the fields that are present; secondary scores add a fifth of their weight on top; 0 without fields."""
    num = sum((F.when(col(present[k]), weights[k] * col(v)).otherwise(0.0) for k, v in scores.items()), F.lit(0.0))
    den = sum((F.when(col(present[k]), weights[k]).otherwise(0.0) for k in scores), F.lit(0.0))
    for k, v in (secondary or {}).items():
        num = num + F.when(col(present[k]), SECONDARY_SHARE * weights[k] * col(v)).otherwise(0.0)
    out = F.when(den > 0, num / den).otherwise(0.0)
    return F.least(F.lit(1.0), out) if cap else out


def apply_constraint(base, signal, weight: float | None = 0.25) -> Column:
    """A score moved by a constraint signal, within [0, 1]; a weight that isn't a number counts as 0.25."""
    w = min(1.0, max(0.0, weight)) if isinstance(weight, (int, float)) and weight == weight else 0.25
    return clamp(doubled(base) + w * F.coalesce(doubled(signal), F.lit(0.0)))


def compare_numeric(value, comparator, target, low=None, high=None) -> Column:
    """Whether a value satisfies a comparator; between ignores a missing bound, others are false without a target."""
    v, c, t = doubled(value), col(comparator), doubled(target)
    lo, hi = (doubled(x) if x is not None else F.lit(None).cast("double") for x in (low, high))
    within = (lo.isNull() | (v >= lo)) & (hi.isNull() | (v <= hi))
    out = F.when(c == "between", within)
    for name, test in (("gt", v > t), ("ge", v >= t), ("lt", v < t), ("le", v <= t), ("eq", v == t), ("ne", v != t)):
        out = out.when(c == name, test)
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def units_incompatible(a, b) -> Column:
    """True only where both units are given and differ beyond blanks, dots and case."""
    norm = lambda u: F.lower(F.regexp_replace(F.coalesce(col(u), F.lit("")), r"[\s.]+", ""))
    given = (F.coalesce(col(a), F.lit("")) != "") & (F.coalesce(col(b), F.lit("")) != "")
    return given & (norm(a) != norm(b))


def discount(rank) -> Column:
    return 1.0 / F.log2(doubled(rank) + 1)


def yes_probability(yes, no) -> Column:
    """Softmax of two log-probabilities; a missing one counts as impossible, both missing as 0."""
    y, n = doubled(yes), doubled(no)
    top = F.greatest(y, n)
    e = lambda x: F.coalesce(F.exp(x - top), F.lit(0.0))
    return F.when(y.isNull() & n.isNull(), 0.0).otherwise(e(y) / (e(y) + e(n)))
