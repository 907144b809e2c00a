"""Text normalisation and lexical scores, as column expressions.

Four normalisers exist because four parts of the matching pipeline compare text by different rules;
they are not interchangeable. All of them fold case with :func:`casefold`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col, doubled

#: Markers of a disease term and the broader terms that each adds.
_SOLID = ("cancer", "carcinoma", "melanoma", "sarcoma", "tumor", "tumour", "neoplasm")
_BLOOD = ("leukemia", "lymphoma", "myeloma")
_LUNG = ("cancer", "carcinoma", "nsclc")
#: Gene symbols that count as biomarkers.
GENES = ("ALK", "BRAF", "BRCA1", "BRCA2", "EGFR", "ERBB2", "HER2", "KRAS", "NTRK", "PD-L1", "PIK3CA", "ROS1", "TP53")


def casefold(text) -> Column:
    """Lower case, with the one folding of Latin text that lower() lacks."""
    return F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))


def collapse(text) -> Column:
    """White space runs to one blank, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))


def flatten_text(*parts) -> Column:
    """Nested values joined by single blanks: strings as they are, arrays of strings element by element."""
    return collapse(F.concat_ws(" ", *[col(p) for p in parts]))


def search_tokens(text) -> Column:
    return F.regexp_extract_all(casefold(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def norm_search(text) -> Column:
    return F.array_join(search_tokens(text), " ")


def norm_constraint(text) -> Column:
    folded = F.replace(casefold(F.coalesce(col(text), F.lit(""))), F.lit("non small"), F.lit("non-small"))
    return F.array_join(F.regexp_extract_all(folded, F.lit("[a-z0-9-]+"), F.lit(0)), " ")


def norm_linker(text) -> Column:
    return collapse(F.replace(casefold(F.coalesce(col(text), F.lit(""))), F.lit("-"), F.lit(" ")))


def _sets(left: Column, right: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Distinct tokens of two normalised texts, and the sizes of their overlap and union."""
    a = F.array_distinct(F.filter(F.split(left, " "), lambda t: t != ""))
    b = F.array_distinct(F.filter(F.split(right, " "), lambda t: t != ""))
    same = F.size(F.array_intersect(a, b))
    return a, b, same, F.size(a) + F.size(b) - same, F.size(a)


def lex_search(query, text) -> Column:
    """Score of two texts in norm_search form: equal 1, contained phrase 0.95, else coverage and Jaccard 3:1, capped."""
    q, t = col(query), col(text)
    _, _, same, union, size = _sets(q, t)
    blend = F.least(F.lit(1.0), 0.75 * same / F.greatest(size, F.lit(1)) + 0.25 * same / F.greatest(union, F.lit(1)))
    padded = F.concat(F.lit(" "), t, F.lit(" ")).contains(F.concat(F.lit(" "), q, F.lit(" ")))
    return F.when((q == "") | (t == ""), 0.0).when(q == t, 1.0).when(padded, 0.95).when(same > 0, blend).otherwise(0.0)


def _whole_word(needle: Column, text: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"\b\Q"), needle, F.lit(r"\E\b")))


def lex_constraint(left, right) -> Column:
    """Score of two texts in norm_constraint form; not symmetric, as coverage counts the left one's tokens."""
    a, b = col(left), col(right)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    _, _, same, union, size = _sets(a, b)
    blend = 0.75 * same / F.greatest(size, F.lit(1)) + 0.25 * same / F.greatest(union, F.lit(1))
    inside = (F.length(short) >= 3) & _whole_word(short, long)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, 0.95).when(blend >= 0.5, blend).otherwise(0.0)


def lex_linker(mention, name) -> Column:
    """Score of two texts in norm_linker form: Jaccard on a 0.2 floor, raised to the length ratio for token subsets."""
    m, n = col(mention), col(name)
    a, b, same, union, _ = _sets(m, n)
    base = F.when(same > 0, 0.2 + 0.6 * same / F.greatest(union, F.lit(1))).otherwise(0.0)
    subset = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    ratio = doubled(F.least(F.length(m), F.length(n))) / F.greatest(F.length(m), F.length(n), F.lit(1))
    raised = F.when(subset & (F.length(m) >= 3), F.greatest(base, ratio)).otherwise(base)
    return F.when((m == "") | (n == ""), 0.0).when(m == n, 1.0).otherwise(raised)


def lex_linker_names(mention, names) -> Column:
    """The best score over an array of names."""
    return F.coalesce(F.array_max(F.transform(col(names), lambda n: lex_linker(col(mention), n))), F.lit(0.0))


def distinct_terms(terms) -> Column:
    """An array without blanks and case-insensitive repeats, in order of first occurrence, white space collapsed."""
    clean = F.filter(F.transform(F.coalesce(col(terms), F.array().cast("array<string>")), lambda t: collapse(t)), lambda t: t != "")
    folded = F.transform(clean, lambda t: casefold(t))
    return F.filter(clean, lambda t, i: F.array_position(folded, casefold(t)) == i + 1)


def terms_except(terms, other) -> Column:
    """Terms that no term of the other array equals but for case."""
    seen = F.transform(col(other), lambda t: casefold(t))
    return F.filter(col(terms), lambda t: ~F.array_contains(seen, casefold(t)))


def safe_patient_id(value) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(value), F.lit("")), r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", "")


def normalize_gender(value) -> Column:
    v = F.lower(F.trim(col(value)))
    return F.when(v.isin("f", "female", "woman"), "Female").when(v.isin("m", "male", "man"), "Male").when(v != "", F.initcap(v))


def normalize_polarity(value) -> Column:
    v = casefold(F.coalesce(col(value), F.lit("")))
    return F.when(v.contains("excl"), "exclusion").when(v.contains("incl"), "inclusion").otherwise("unknown")


def norm_classification(value) -> Column:
    """Verdict text without markup and punctuation around it, folded."""
    edge = F.lit(" \t\r\n*_`.,;:!\"'")
    return casefold(F.btrim(F.coalesce(col(value), F.lit("")), edge))


def normalize_concept_id(vocabulary, code) -> Column:
    """vocabulary:code; a code with a colon stands for itself, a blank one for no concept."""
    c = F.trim(F.coalesce(col(code), F.lit("")))
    return F.when(c == "", "CUI-less").when(c.contains(":"), c).otherwise(F.concat(F.coalesce(col(vocabulary), F.lit("local")), F.lit(":"), c))


def broader_terms(terms) -> Column:
    """Broader disease terms of an array of terms, distinct in order."""

    def has(t: Column, words: tuple) -> Column:
        return F.rlike(casefold(t), F.lit("|".join(words)))

    def of(t: Column) -> Column:
        some = lambda cond, *x: F.when(cond, F.array(*[F.lit(v) for v in x])).otherwise(F.array().cast("array<string>"))
        solid = some(has(t, _SOLID), "cancer", "malignant neoplasm", "solid tumor")
        blood = some(has(t, _BLOOD), "hematologic malignancy", "blood cancer")
        lung = some(has(t, ("lung",)) & has(t, _LUNG), "thoracic cancer", "solid tumor")
        return F.concat(solid, blood, lung)

    return distinct_terms(F.flatten(F.transform(col(terms), of)))


def biomarker_terms(text) -> Column:
    """Gene symbols in a text, upper case, distinct in order."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(rf"(?i)\b({'|'.join(GENES)})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda g: F.upper(g)))


def therapy_terms(label, temporality) -> Column:
    """A therapy's label, and "prior" before it if it lies in the past."""
    both = F.array(col(label), F.concat(F.lit("prior "), col(label)))
    return F.when(casefold(F.coalesce(col(temporality), F.lit(""))).contains("prior"), both).otherwise(F.array(col(label)))


def narrative_term(sentences, limit: int = 1500) -> Column:
    """Sentences without absent findings as one text, cut at the last blank within ``limit`` characters."""
    kept = F.filter(col(sentences), lambda s: ~casefold(s).contains(" absent"))
    text = collapse(F.array_join(kept, " "))
    head = F.substring(text, 1, limit)
    cut = F.trim(F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1))
    return F.when(cut != "", cut).otherwise(head)


def strip_thinking(text) -> Column:
    """A model's answer without its reasoning block, closed by either tag, or cut where an open one begins."""
    closed = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?s)<think>.*?(</think>|<think>)", "")
    return F.trim(F.substring_index(closed, "<think>", 1))


# How a text says an age, and a sex.
AGE_PATTERNS = (
    r"(?i)(\d{1,3})\s*[- ]?\s*year[\s-]*old",
    r"(?i)(\d{1,3})\s*[- ]?\s*(?:yo|y/o|yr)\b",
    r"\b(\d{1,3})\s*[- ]?\s*(?:M|F|male|female|man|woman)\b",
)
FEMALE_PATTERN = r"(?i)\b(?:female|woman|girl|lady|\d{1,3}\s*F)\b"
MALE_PATTERN = r"(?i)\b(?:male|man|boy|gentleman|\d{1,3}\s*M)\b"


def demographics_from_text(text) -> Column:
    """struct(age, gender): the age by the first pattern that gives one of 1 to 120 years, and the sex that is mentioned first."""
    t = F.coalesce(col(text), F.lit(""))
    ages = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int") for p in AGE_PATTERNS]
    age = F.coalesce(*[F.when(a.between(1, 120), a) for a in ages])
    female, male = F.regexp_instr(t, F.lit(FEMALE_PATTERN)), F.regexp_instr(t, F.lit(MALE_PATTERN))
    gender = F.when((female > 0) & ((male == 0) | (female < male)), "Female").when(male > 0, "Male")
    return F.struct(age.alias("age"), gender.alias("gender"))


def sha_id(*parts, length: int = 64) -> Column:
    """Leading hex digits of the SHA-256 of the non-empty parts joined by a bar."""
    kept = F.filter(F.array(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), lambda p: p != "")
    return F.substring(F.sha2(F.array_join(kept, "|").cast("binary"), 256), 1, length)


def criteria_id(trial, criterion) -> Column:
    return F.sha2(F.concat(col(trial).cast("string"), F.lit(":"), col(criterion)).cast("binary"), 256)
