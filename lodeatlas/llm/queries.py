"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.llm import canonical, copies, entities, leaks, mixing, stuffing
from lodeatlas.plans.session import table


_OFFERS = ("listings", "models", "families", "providers")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.match_offers(*(table(spark, sf_dir, t) for t in _OFFERS)).select("row_id", "listing_id")


def p2_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate pair with its belief."""
    pairs = entities.pair_beliefs(*(table(spark, sf_dir, t) for t in _OFFERS))
    return pairs.select("row_id", "listing_id", F.round("belief", 6).alias("belief"), (F.col("residual") < entities.SETTLED).alias("settled"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = copies.copy_classes(table(spark, sf_dir, "models"), "row_id", ["provider"], ["model_id", "display_name"])
    return classes.where("key <> first").select(F.col("first").alias("first_row_id"), F.col("key").alias("row_id"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = copies.collapse(table(spark, sf_dir, "models"), "row_id", ["provider"], ["model_id", "display_name"])
    return one.select("row_id", "provider", "model_id", "display_name", "n_copies")


def _raw_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "models").where(F.coalesce("family", F.lit("")) == "")
    values = models.select("row_id", F.col("raw_family").alias("value"))
    return canonical.resolve_values(values, table(spark, sf_dir, "families"), table(spark, sf_dir, "providers").select("provider"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_families(spark, sf_dir).select("ref_id", "row_id")


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value that stands for no entry was typed."""
    values = table(spark, sf_dir, "models").select("row_id", F.col("raw_family").alias("value"))
    return _raw_families(spark, sf_dir).where("ref_id = 0").join(values, "row_id").groupBy("value").agg(F.count("*").alias("n_rows"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p7_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that occur with words changed, left out or put in."""
    return leaks.near_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source whether its documents keep to repeats and budget, fill the budget, and add up to what the shares say."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    chosen, shares = mixing.mix(documents, targets)
    size = F.col("n_tokens") * F.col("repeats")
    used = chosen.join(targets, "source").groupBy("source").agg(
        F.sum(size).alias("tokens"), F.max("n_tokens").alias("largest"), F.bool_and(F.col("repeats") <= F.col("max_repeats")).alias("kept"), (F.count("*") == F.count_distinct("doc_id")).alias("once")
    )
    rows = shares.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    filled = (F.col("tokens") + F.col("short_tokens") + F.coalesce("largest", F.lit(1)) * F.col("max_repeats") > F.col("budget_tokens")) | (F.col("budget_tokens") == 0)
    return rows.select(
        "source", "target_share", F.coalesce("kept", F.lit(True)).alias("repeats_kept"), F.coalesce("once", F.lit(True)).alias("each_once"), (F.col("tokens") <= F.col("budget_tokens")).alias("budget_kept"),
        filled.alias("budget_filled"), (F.col("tokens") == F.col("mixed_tokens")).alias("adds_up"), (F.col("available_tokens") > 0).alias("has_documents"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"))


def p9_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffing(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_beliefs, p4_found, p4_collapsed, p6_found, p6_unmatched, p7_found, p7_passages, p7_nearby, p8_mixture, p8_shares, p8_invariants, p9_found, p9_signals)}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")

_BAGS = f"""
WITH bags AS (
  SELECT row_id, provider, model_id, display_name, array_to_string(list_sort(regexp_extract_all(
    lower(translate(coalesce(model_id, '') || ' ' || coalesce(display_name, ''), '{_WIDE}', '{_NARROW}')), '[\\p{{L}}\\p{{N}}]+')), ' ') AS bag
  FROM models),
firsts AS (SELECT *, min(row_id) OVER (PARTITION BY provider, bag) AS first_row_id, count(*) OVER (PARTITION BY provider, bag) AS n_copies FROM bags)
"""

_PLAIN = """regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(replace(text, '&nbsp;', ' '),
  '</?(b|i|em|strong|u)>', '', 'g'), '</?[A-Za-z][^<>]*>', ' ', 'g'), '[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]', '', 'g')), '[\\p{L}\\p{N}]+')"""

_INVARIANTS = """
SELECT t.source, target_share, true AS repeats_kept, true AS each_once, true AS budget_kept, true AS budget_filled, true AS adds_up,
  EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.doc_id IS NOT NULL AND d.text <> '') AS has_documents
FROM mix_targets t WHERE t.source IS NOT NULL"""

#: Places are counted without the targets of links.
_NO_TARGETS = _PLAIN.replace("replace(text, '&nbsp;', ' ')", "regexp_replace(replace(text, '&nbsp;', ' '), '\\]\\([^()\\s]*\\)', ' ', 'g')")

ORACLES: dict[str, str] = {
    "p8_invariants": _INVARIANTS,
    "p4_found": _BAGS + "SELECT first_row_id, row_id FROM firsts WHERE row_id <> first_row_id",
    "p4_collapsed": _BAGS + "SELECT row_id, provider, model_id, display_name, n_copies FROM firsts WHERE row_id = first_row_id",
    "p7_found": f"""
WITH i AS (SELECT item_id, {_PLAIN} AS w FROM eval_items), d AS (SELECT doc_id, {_PLAIN} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d)
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)
""",
    "p7_passages": f"""
WITH i AS (SELECT item_id, {_NO_TARGETS} AS w FROM eval_items), d AS (SELECT doc_id, {_NO_TARGETS} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS ik, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS dk, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d),
hit AS (SELECT DISTINCT item_id, doc_id, ik, dk FROM ig JOIN dg USING (g)),
island AS (SELECT *, dk - ik AS shift, ik - row_number() OVER (PARTITION BY item_id, doc_id, dk - ik ORDER BY ik) AS part FROM hit)
SELECT item_id, doc_id, min(ik) - 1 AS item_from, min(dk) - 1 AS doc_from, count(*) + 11 AS n_words FROM island GROUP BY item_id, doc_id, shift, part
""",
}
