"""Concept linking: candidates by shared tokens, fusion, lexical gate.

A mention is linked once however often it occurs: distinct (group, folded text) pairs are linked and the
result is joined back, which is what a cache does in a loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, distinct_terms, lex_linker_names, norm_linker, normalize_concept_id, search_tokens
from ..functions.vectors import nearest
from .entities import SCHEMAS, recognize
from .filters import vocabulary_domain
from .fusion import ranked, rrf_concepts

#: Acceptance, rejection, margin over the runner-up, candidates.
ACCEPT, REJECT, MARGIN, LIMIT = 0.7, 0.5, 0.05, 10
#: Statuses that a later run links again.
RELINK = ("not_linked", "concept_store_unavailable")
#: The id of what is no concept.
NO_CONCEPT = "CUI-less"


def candidates(mentions: DataFrame, concepts: DataFrame, key: list, limit: int = LIMIT, by: tuple = ()) -> DataFrame:
    """Best concepts per mention (key, mention) by lexical score over name and synonyms, among those that share a token.

    ``concepts``: concept_id, concept_name, synonyms. Tokens meet in an equi-join of postings. ``by`` names columns of both
    sides (and of ``key``) that must agree too, such as the schema that admits a concept.
    """
    names = F.concat(F.array("concept_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    posts = concepts.select(*by, "concept_id", F.explode(F.array_distinct(F.flatten(F.transform(names, lambda n: search_tokens(n))))).alias("token"))
    asked = mentions.select(*key, "mention", F.explode(F.array_distinct(search_tokens("mention"))).alias("token"))
    pairs = asked.join(posts, [*by, "token"]).select(*key, "mention", "concept_id").distinct().join(concepts.select(*by, "concept_id", "concept_name", names.alias("names")), [*by, "concept_id"])
    scored = pairs.withColumn("quality", lex_linker_names(norm_linker("mention"), F.transform("names", lambda n: norm_linker(n))))
    return ranked(scored.filter("quality > 0").drop("names"), key, [F.col("quality").desc(), "concept_name", "concept_id"], limit)


def hybrid_candidates(mentions: DataFrame, concepts: DataFrame, key: list, limit: int = LIMIT) -> DataFrame:
    """Candidates by text and by vector (``mentions.vector``, ``concepts.embedding``), fused by reciprocal rank.

    ``quality`` is the lexical score of the pair, which the gate needs whichever list found it. Ids are compared by 64-bit hash.
    """
    asked = mentions.withColumn("_m", F.xxhash64(*key))
    known = concepts.withColumn("_c", F.xxhash64("concept_id"))
    text = candidates(asked, concepts, ["_m"], limit).select("_m", "concept_id", "concept_name", "rank")
    near = nearest(known, "_c", "embedding", asked, "_m", "vector", limit).join(known.select("_c", "concept_id", "concept_name"), "_c")
    fused = rrf_concepts(text.unionByName(near.select("_m", "concept_id", "concept_name", "rank")), "_m").filter(F.col("rank") <= limit)
    names = F.concat(F.array("concept_name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    rows = fused.join(asked.select(*key, "mention", "_m"), "_m").join(concepts.select("concept_id", names.alias("names")), "concept_id")
    quality = lex_linker_names(norm_linker("mention"), F.transform("names", lambda n: norm_linker(n)))
    return rows.withColumn("quality", quality).select(*key, "mention", "concept_id", "concept_name", "quality", "rank", "score")


def gate(found: DataFrame, key: list, accept: float = ACCEPT, reject: float = REJECT, margin: float = MARGIN) -> DataFrame:
    """Status per mention from its best candidate and the runner-up."""
    w = Window.partitionBy(*key).orderBy("rank")
    best = found.withColumn("runner_up", F.lead("quality").over(w)).filter("rank = 1")
    near = F.col("quality") - F.coalesce("runner_up", F.lit(0.0)) < margin
    status = F.when(F.col("quality") < reject, "rejected").when((F.col("quality") < accept) | (F.col("runner_up").isNotNull() & near & (F.col("quality") < 1.0)), "ambiguous").otherwise("accepted")
    return best.withColumn("status", status).withColumn("linked_id", F.when(F.col("status") == "accepted", F.col("concept_id"))).drop("rank")


def _route(schemas: dict) -> Column:
    """The schema of an annotation: by its schema_id if that is known, else by its group, case aside; null if neither is."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    groups = {**{k.casefold(): k for k in schemas}, **{s[0].casefold(): k for k, s in schemas.items()}}
    return F.coalesce(pairs({k: k for k in schemas})[F.col("schema_id")], pairs(groups)[casefold(F.col("entity_group"))])


def link_annotations(annotations: DataFrame, concepts: DataFrame | None, schemas: dict = SCHEMAS, accept: float = ACCEPT, reject: float = REJECT, margin: float = MARGIN, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds normalized_id, synonyms, concept_candidates, linker_score and linker_status to annotations.

    ``annotations``: entity_group, text, schema_id and any others. ``concepts``: concept_id, vocabulary_id, domain_id, concept_code,
    concept_name, synonyms, or None without a store. A schema admits the concepts of its vocabularies and domains. Statuses:
    not_linkable (no schema, or one without vocabularies), concept_store_unavailable, rejected (also without any candidate, with
    score 0), ambiguous, accepted. Only accepted ones have an id and synonyms. ``reranker`` gets ranked candidates and returns them
    with another rank. Each (schema, folded text) is linked once.
    """
    if reject > accept:
        raise ValueError("reject is above accept")
    none = F.array(F.lit(NO_CONCEPT))
    found_type = "array<struct<rank:int,concept_id:string,vocabulary_id:string,concept_code:string,concept_name:string,score:double>>"
    rows = annotations.drop("normalized_id", "synonyms", "concept_candidates", "linker_score", "linker_status")
    rows = rows.withColumn("_route", _route(schemas)).withColumn("_key", casefold(F.col("text")))
    linkable = F.coalesce(F.col("_route").isin([k for k, s in schemas.items() if s[1]]), F.lit(False))
    strings = F.array().cast("array<string>")
    if concepts is None:
        status = F.when(linkable, "concept_store_unavailable").otherwise("not_linkable")
        return rows.withColumns({"normalized_id": none, "synonyms": strings, "concept_candidates": F.array().cast(found_type), "linker_score": F.lit(None).cast("double"), "linker_status": status}).drop("_route", "_key")
    key = ["_route", "_key"]
    routes = concepts.sparkSession.createDataFrame([(k, s[1], s[2]) for k, s in schemas.items()], "schema_id string, vocabularies array<string>, domains array<string>")
    admitted = vocabulary_domain(concepts, F.broadcast(routes)).withColumnRenamed("schema_id", "_route")  # one row a schema
    once = rows.filter(linkable).select(*key).distinct().withColumn("mention", F.col("_key"))
    found = candidates(once, admitted, key, by=("_route",))
    found = reranker(found) if reranker else found
    about = admitted.select("_route", "concept_id", "vocabulary_id", "concept_code", distinct_terms(F.concat(F.array("concept_name"), F.coalesce("synonyms", strings))).alias("_names"))
    full = found.join(about, ["_route", "concept_id"])
    listed = F.struct(F.col("rank").cast("int").alias("rank"), F.col("concept_id").cast("string").alias("concept_id"), "vocabulary_id", "concept_code", "concept_name", F.col("quality").alias("score"))
    lists = full.groupBy(*key).agg(F.sort_array(F.collect_list(listed)).alias("concept_candidates"))  # at most LIMIT a mention
    best = gate(full, key, accept, reject, margin).join(lists, key)
    taken = F.col("status") == "accepted"
    linked = best.select(*key, F.when(taken, F.array(normalize_concept_id("vocabulary_id", "concept_code"))).otherwise(none).alias("normalized_id"), F.when(taken, F.col("_names")).otherwise(strings).alias("synonyms"), F.col("concept_candidates").cast(found_type).alias("concept_candidates"), F.col("quality").alias("linker_score"), F.col("status").alias("linker_status"))
    out = rows.join(linked, key, "left")
    empty = {"normalized_id": none, "synonyms": strings, "concept_candidates": F.array().cast(found_type)}
    out = out.withColumns({c: F.coalesce(c, v) for c, v in empty.items()} | {"linker_score": F.coalesce("linker_score", F.when(linkable, 0.0)), "linker_status": F.when(linkable, F.coalesce("linker_status", F.lit("rejected"))).otherwise("not_linkable")})
    return out.drop(*key)


def annotate(texts: DataFrame, key: str, concepts: DataFrame | None, text: str = "text", names: tuple = ("regex", "variants"), schemas: dict = SCHEMAS) -> DataFrame:
    """Adds ``annotations`` (recognised and linked, in order of place) and ``annotation_error`` to texts with a unique key.

    Texts are read in place; only their spans are shuffled.
    """
    spans = recognize(texts.select(key, text), text, names).select(key, "annotation_error", F.posexplode_outer("annotations").alias("_at", "_a"))
    linked = link_annotations(spans.select(key, "annotation_error", "_at", "_a.*"), concepts, schemas)
    fields = ["entity_group", "text", "start", "end", "score", "schema_id", "normalized_id", "synonyms", "concept_candidates", "linker_score", "linker_status"]
    span = F.when(F.col("_at").isNotNull(), F.struct("_at", *fields))
    lists = linked.groupBy(key).agg(F.max("annotation_error").alias("annotation_error"), F.sort_array(F.collect_list(span)).alias("_l"))
    lists = lists.withColumn("annotations", F.transform("_l", lambda s: F.struct(*[s[f].alias(f) for f in fields]))).drop("_l")
    return texts.join(lists, key, "left")


def link_resumed(annotations: DataFrame, concepts: DataFrame | None, key: str, path: str, fingerprint: str, force: bool = False) -> DataFrame:
    """Links what an earlier run with the same fingerprint of the concepts hasn't; the linked rows of all runs.

    The output is the journal: each run appends one partition whose rows Spark commits together, so a key is either
    linked whole or pending. ``force`` starts again. Keys may be null.
    """
    spark = annotations.sparkSession
    folder = f"{path.rstrip('/')}/{fingerprint}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    done = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place) and not force
    if done:
        keys = spark.read.parquet(folder).select(F.col(key).alias("_done")).distinct()
        annotations = annotations.join(keys, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    link_annotations(annotations, concepts).write.mode("append" if done else "overwrite").parquet(folder)
    return spark.read.parquet(folder)


def link_corpus(annotations: DataFrame, concepts: DataFrame, force: bool = False) -> DataFrame:
    """Links annotations (any columns, entity_group, text, linker_status); settled ones keep their status unless forced."""
    open_ = F.lit(True) if force else F.coalesce("linker_status", F.lit("not_linked")).isin(*RELINK)
    rows = annotations.withColumn("_key", casefold(F.col("text"))).withColumn("_open", open_)
    once = rows.filter("_open").select("entity_group", "_key").distinct().withColumn("mention", F.col("_key"))
    linked = gate(candidates(once, concepts, ["entity_group", "_key"]), ["entity_group", "_key"]).select("entity_group", "_key", "linked_id", F.col("status").alias("_status"), F.col("quality").alias("linker_score"))
    out = rows.join(linked, ["entity_group", "_key"], "left")
    return out.withColumn("linker_status", F.when(F.col("_open"), F.coalesce("_status", F.lit("rejected"))).otherwise(F.col("linker_status"))).drop("_key", "_open", "_status")


def tally(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("linker_status").count()
