from pyspark.sql import Row
from pyspark.sql import functions as F

from trialweave.functions import dates, scores, text, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_normalisers_differ(spark):
    t = F.lit("Non Small-Cell  Straße, 3.5")
    r = one(spark, search=text.norm_search(t), constraint=text.norm_constraint(t), linker=text.norm_linker(t), flat=text.flatten_text(t, F.lit(None).cast("string")))
    assert r == Row(search="non small cell strasse 3 5", constraint="non-small-cell strasse 3 5", linker="non small cell strasse, 3.5", flat="Non Small-Cell Straße, 3.5")
    assert one(spark, a=text.norm_search(F.lit(None).cast("string"))).a == ""


def test_lexical_scores(spark):
    s = lambda a, b: one(spark, x=text.lex_search(F.lit(a), F.lit(b))).x
    assert (s("lung cancer", "lung cancer"), s("lung cancer", "egfr lung cancer"), s("", "x"), s("a", "b")) == (1.0, 0.95, 0.0, 0.0)
    assert round(s("lung cancer", "lung tumor"), 6) == round(0.75 / 2 + 0.25 / 3, 6)
    c = lambda a, b: one(spark, x=text.lex_constraint(F.lit(a), F.lit(b))).x
    assert c("egfr", "egfr-positive nsclc") == 0.95 and c("ab", "ab cd") != 0.95 and c("prior aspirin use", "aspirin") == 0.95
    k = lambda a, b: one(spark, x=text.lex_linker(F.lit(a), F.lit(b))).x
    assert k("cancer", "lung cancer") == 6 / 11 and k("x", "x") == 1.0 and k("q", "z") == 0.0


def test_terms(spark):
    r = one(
        spark,
        d=text.distinct_terms(lit("A  b", "a B", " ", "c")), e=text.terms_except(lit("X", "y"), lit("x")), b=text.broader_terms(lit("Lung cancer", "Lymphoma")),
        g=text.biomarker_terms(F.lit("egfr and PD-L1, EGFR")), t=text.therapy_terms(F.lit("aspirin"), F.lit("Prior use")), n=text.narrative_term(lit("Has x.", "Fever absent.")),
        s=text.strip_thinking(F.lit("<think>a</think>yes <think>open")), p=text.safe_patient_id(F.lit("pat 01!")), v=text.norm_classification(F.lit(" **Violated**. ")),
    )
    assert r.d == ["A b", "c"] and r.e == ["y"] and r.g == ["EGFR", "PD-L1"] and r.t == ["aspirin", "prior aspirin"]
    assert r.b == ["cancer", "malignant neoplasm", "solid tumor", "thoracic cancer", "hematologic malignancy", "blood cancer"]
    assert r.n == "Has" and r.s == "yes" and r.p == "pat-01" and r.v == "violated"


def test_demographics(spark):
    r = one(spark, a=text.demographics_from_text(F.lit("A 45-year-old woman whose father, a man of 80")), b=text.demographics_from_text(F.lit("no data")))
    assert (r.a.age, r.a.gender, r.b.age, r.b.gender) == (45, "Female", None, None)


def test_concept_ids(spark):
    r = one(spark, a=text.normalize_concept_id(F.lit("SNOMED"), F.lit("1")), b=text.normalize_concept_id(F.lit("SNOMED"), F.lit("DOID:2")), c=text.normalize_concept_id(F.lit("SNOMED"), F.lit(" ")))
    assert r == Row(a="SNOMED:1", b="DOID:2", c="CUI-less")


def test_dates(spark):
    d = lambda s: one(spark, x=dates.parse_date(F.lit(s))).x
    assert [str(d(s)) for s in ("2020-03-04T01:02:03Z", "2020-03", "2020", "soon")] == ["2020-03-04", "2020-03-01", "2020-01-01", "None"]
    iso = lambda s: one(spark, x=dates.to_iso_date(F.lit(s))).x
    assert [iso(s) for s in ("March 4, 2021", "March 2021", "2021", "?")] == ["2021-03-04", "2021-03-01", "2021-01-01", None]
    age = lambda s: one(spark, x=dates.age_to_years(F.lit(s))).x
    assert [age(s) for s in ("18 Months", "65 Years", "N/A", "9 moons")] == [1.5, 65.0, None, None]
    a = lambda s: one(spark, x=dates.iso_age_years(F.lit(s))).x
    assert [a(s) for s in ("P42Y", "P1Y6M", "P", "42")] == [42.0, 1.5, None, None]
    p = lambda s: one(spark, x=dates.parse_age_input(F.lit(s), F.lit("2024-06-01").cast("date"))).x
    assert [p(s) for s in ("45", "45 yrs", "151", "1980-07-01")] == [45, 45, None, 43]
    n = lambda s: one(spark, x=dates.parse_numeric(F.lit(s))).x
    assert tuple(n("ANC -1,500.5 /mm3")) == (-1500.5, "/mm3") and n("none").value is None


def test_scores(spark):
    r = one(
        spark, a=scores.fuse_text(F.lit(None).cast("double"), F.lit(0.42)), b=scores.fuse_text(F.lit(1.0), F.lit(0.0)), c=scores.apply_constraint(F.lit(0.9), F.lit(1.0)),
        d=scores.apply_constraint(F.lit(0.1), F.lit(-1.0), 9), e=scores.yes_probability(F.lit(None).cast("double"), F.lit(None).cast("double")), f=scores.yes_probability(F.lit(0.0), F.lit(0.0)),
        g=scores.compare_numeric(F.lit(5.0), F.lit("between"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(6.0)), h=scores.compare_numeric(F.lit(5.0), F.lit("ge"), F.lit(None).cast("double")),
        i=scores.units_incompatible(F.lit("g / dL"), F.lit("G/dl")), j=scores.units_incompatible(F.lit(None).cast("string"), F.lit("g")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (0.42, 0.6, 1.0, 0.0, 0.0, 0.5, True, False, False, False)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, []), (4, None), (5, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {r.id: (r.coerced, r.v) for r in vectors.coerce_vectors(df, "v").collect()}
    assert got[3] == (True, [0.0] * 3) and got[4] == (True, [0.0] * 3) and got[5] == (True, [1.0] * 3) and got[1][0] is False
    q = F.array(F.lit(1.0), F.lit(0.0))
    s = {r.id: r.s for r in df.select("id", vectors.vector_score("v", q).alias("s")).collect()}
    assert s[1] == 1.0 and s[2] == 0.5 and s[3] == 0.0 and s[4] == 0.0
    m = one(spark, m=vectors.mean_vector(lit(1.0, 3.0), lit(3.0, 5.0, 9.0), F.array().cast("array<double>")), z=vectors.mean_vector(F.array().cast("array<double>")))
    assert m.m == [2.0, 4.0] and m.z is None
