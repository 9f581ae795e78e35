"""Queries of the catalog's own operators over the stored tables, with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.functions import vocabulary as V
from lodeatlas.operators import analysis, entities, lineage, lookup, merge, normalize, resolve
from lodeatlas.plans.registry import query
from lodeatlas.plans.registry import sql_list as _sql_list
from lodeatlas.plans.session import cut, table

_MODS = _sql_list(V.MODIFIERS)
_ORDER = _sql_list(V.MODIFIER_ORDER)
_GLOBAL_ATTRIBUTES = _sql_list(m for m, c in V.MODIFIER_CLASS.items() if c == "attribute")
_FAMILY_ATTRIBUTES = _sql_list(f"{f}|{m}" for (f, m), c in V.FAMILY_MODIFIER_CLASS.items() if c == "attribute")

#: The models with the modifiers that their identifiers spell out, in canonical order, and split by class.
_M = f"""
WITH spelled AS (
  SELECT *, list_transform(list_sort(list_transform(list_distinct(list_filter(
           string_split_regex(lower(model_id), '[^a-z0-9]+'), lambda x: list_contains({_MODS}, x))),
           lambda x: {{'r': list_position({_ORDER}, x), 'x': x}})), lambda s: s.x) AS mods
  FROM models),
m AS (
  SELECT *, list_filter(mods, lambda x: list_contains({_GLOBAL_ATTRIBUTES}, x) OR list_contains({_FAMILY_ATTRIBUTES}, lower(family) || '|' || x)) AS attribute_mods,
         list_filter(mods, lambda x: NOT (list_contains({_GLOBAL_ATTRIBUTES}, x) OR list_contains({_FAMILY_ATTRIBUTES}, lower(family) || '|' || x))) AS identity_mods
  FROM spelled),
keyed AS (
  SELECT *, family || CASE WHEN variant <> '' THEN '/' || variant ELSE '' END || CASE WHEN version <> '' THEN '@' || version ELSE '' END
         || CASE WHEN len(identity_mods) > 0 THEN '{{' || array_to_string(identity_mods, ',') || '}}' ELSE '' END AS entity_key
  FROM m)
"""

_CANONICAL = """provider || '/' || CASE WHEN family = '' THEN model_id ELSE family || CASE WHEN variant <> '' THEN '/' || variant ELSE '' END
 || CASE WHEN version <> '' THEN '/' || version ELSE '' END || CASE WHEN date <> '' THEN '@' || date ELSE '' END
 || CASE WHEN len(identity_mods) > 0 THEN '{' || array_to_string(identity_mods, ',') || '}' ELSE '' END
 || CASE WHEN len(attribute_mods) > 0 THEN '[' || array_to_string(attribute_mods, ',') || ']' ELSE '' END END"""


def models_with_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows, which keep no modifiers, with those that their identifiers spell out."""
    spelled = F.filter(F.split(F.lower("model_id"), "[^a-z0-9]+"), lambda x: x.isin(V.MODIFIERS))
    return table(spark, sf_dir, "models").withColumn("modifier", C.order_modifiers(spelled))


# --- projections, filters, lookups -----------------------------------------------------------------


@query("SELECT row_id, model_id, provider FROM models WHERE provider = 'sofeiv-ai'")
def models_by_provider(spark, d):
    return lookup.by_provider(table(spark, d, "models"), "sofeiv-ai").select("row_id", "model_id", "provider")


@query("SELECT row_id, model_id, raw_family FROM models WHERE raw_family = 'quouhoum'")
def models_by_raw_family(spark, d):
    return lookup.by_raw_family(table(spark, d, "models"), "quouhoum").select("row_id", "model_id", "raw_family")


@query("SELECT row_id, family, variant, version FROM models WHERE variant = 'pro' AND version = '8.8'")
def query_by_canonical(spark, d):
    return lookup.by_canonical(table(spark, d, "models"), variant="pro", version="8.8").select("row_id", "family", "variant", "version")


@query("SELECT row_id, provider FROM models WHERE provider NOT IN ('sofeiv-ai', 'tropliax')")
def scan_without_providers(spark, d):
    return lookup.scan(table(spark, d, "models"), without=["sofeiv-ai", "tropliax"]).select("row_id", "provider")


@query(_M + f"SELECT row_id, {_CANONICAL} AS canonical, array_to_string(mods, ',') AS modifiers FROM keyed")
def canonical_format(spark, d):
    named = lookup.with_names(models_with_modifiers(spark, d))
    return named.select("row_id", "canonical", C.modifier_key(F.col("modifier")).alias("modifiers"))


@query(
    _M
    + f""", d AS (SELECT row_id, provider, model_id, {_CANONICAL} AS canonical FROM keyed)
SELECT row_id, provider, 'admitted' AS rating, s.scheme AS scheme, CASE s.scheme WHEN 'raw' THEN model_id WHEN 'canonical' THEN canonical
  WHEN 'huggingface' THEN provider || '/' || model_id ELSE 'pkg:huggingface/' || provider || '/' || model_id END AS value
FROM d CROSS JOIN (VALUES ('raw'), ('canonical'), ('huggingface'), ('purl')) s(scheme)"""
)
def designations(spark, d):
    named = lookup.with_names(models_with_modifiers(spark, d))
    return named.select("row_id", F.inline(C.designations(F.col("provider"), F.col("model_id"), F.col("canonical")))).select("row_id", "provider", "rating", "scheme", "value")


# --- scalar functions --------------------------------------------------------------------------------


@query(
    """
WITH t AS (SELECT row_id, model_id, release_date,
  regexp_extract(model_id, '(\\d{4}-\\d{2}-\\d{2})', 1) AS a, regexp_extract(model_id, '(?:^|[^0-9])(\\d{8})(?:$|[^0-9])', 1) AS b,
  regexp_extract(release_date, '(\\d{4}-\\d{2}-\\d{2})', 1) AS c FROM models)
SELECT row_id, coalesce(
  strftime(TRY_CAST(nullif(a, '') AS DATE), '%Y-%m-%d'),
  strftime(TRY_CAST(CASE WHEN b <> '' THEN substr(b, 1, 4) || '-' || substr(b, 5, 2) || '-' || substr(b, 7, 2) END AS DATE), '%Y-%m-%d'),
  strftime(TRY_CAST(nullif(c, '') AS DATE), '%Y-%m-%d'), '') AS found_date,
  CASE WHEN regexp_matches(model_id, '\\d{4}-\\d{2}-\\d{2}$') THEN rtrim(regexp_replace(model_id, '-?\\d{4}-\\d{2}-\\d{2}$', ''), '-')
       WHEN regexp_matches(model_id, '\\d{8}$') THEN rtrim(regexp_replace(model_id, '-?\\d{8}$', ''), '-') ELSE model_id END AS undated
FROM t"""
)
def extract_date(spark, d):
    ident = F.col("model_id")
    return table(spark, d, "models").select("row_id", C.extract_date(ident, F.coalesce("release_date", F.lit(""))).alias("found_date"), C.strip_trailing_date(ident).alias("undated"))


@query(
    """
SELECT row_id, regexp_extract(model_id, ':([0-9]+)$', 1) AS context_n, array_slice(string_split(model_id, '/'), -1, -1)[1] AS last_segment,
  CASE WHEN NOT contains(model_id, '/') AND starts_with(lower(model_id), 'azure-') AND length(model_id) > 6 THEN 'azure' ELSE '' END AS host,
  CASE WHEN NOT contains(model_id, '/') AND starts_with(lower(model_id), 'azure-') AND length(model_id) > 6 THEN substr(model_id, 7) ELSE model_id END AS without_host,
  regexp_extract(model_id, '^.+-(\\d+\\.\\d+)$', 1) AS dot_version
FROM models"""
)
def identifier_parts(spark, d):
    i = F.col("model_id")
    return table(spark, d, "models").select(
        "row_id", C.context_n(i).alias("context_n"), C.last_segment(i).alias("last_segment"), C.host(i).alias("host"), C.without_host(i).alias("without_host"), C.dot_version(i).alias("dot_version")
    )


@query(
    """
WITH t AS (SELECT row_id, unnest(string_split(lower(model_id), '-')) AS tok FROM models)
SELECT row_id, CAST(count(*) FILTER (regexp_full_match(tok, '\\d{4}|\\d{6}')) AS BIGINT) AS n_dates,
  CAST(count(*) FILTER (regexp_full_match(tok, '\\d+(\\.\\d+)?[bm]|\\d+x\\d+b|\\d+b-a\\d+b')) AS BIGINT) AS n_sizes,
  CAST(count(*) FILTER (regexp_full_match(tok, '\\d+') AND length(tok) <> 4) AS BIGINT) AS n_versions,
  CAST(count(*) FILTER (regexp_full_match(tok, '[a-z0-9.-]+') AND regexp_matches(tok, '[0-9]')) AS BIGINT) AS n_version_shaped
FROM t GROUP BY row_id"""
)
def token_kinds(spark, d):
    toks = F.split(F.lower("model_id"), "-")
    n = lambda test: F.size(F.filter(toks, test)).cast("bigint")
    return table(spark, d, "models").where("model_id is not null").select(
        "row_id", n(C.is_date_token).alias("n_dates"), n(C.is_size_token).alias("n_sizes"), n(C.is_version_token).alias("n_versions"), n(C.is_version_shaped).alias("n_version_shaped")
    )


@query(
    f"""
SELECT row_id, array_to_string(list_filter(string_split(coalesce(modalities_input, ''), ','), lambda x: list_contains({_sql_list(V.MODALITIES)}, x)), ',') AS inputs,
  array_to_string(list_filter(string_split(coalesce(modalities_output, ''), ','), lambda x: list_contains({_sql_list(V.MODALITIES)}, x)), ',') AS outputs
FROM models"""
)
def known_modalities(spark, d):
    m = lambda c: C.modalities_text(C.modalities(F.col(c)))
    return table(spark, d, "models").select("row_id", m("modalities_input").alias("inputs"), m("modalities_output").alias("outputs"))


@query()
def decompose_models(spark, d):
    """Family, variant, version, modifiers, date and host of every stored row."""
    n = normalize.normalize(table(spark, d, "models"))
    return n.select("row_id", "family", "variant", "version", C.modifier_key(F.col("modifier")).alias("modifiers"), "date", "host", "reason")


@query(
    f"""
SELECT ref_id, family, CASE WHEN list_contains({_sql_list(V.VARIANT_SUFFIXES)}, variant) THEN variant ELSE '' END AS variant, '' AS version FROM families"""
)
def decompose_inverse(spark, d):
    """Identifiers put together from the canonical list, taken apart again."""
    rows = table(spark, d, "families").select("ref_id", F.when(F.col("variant") != "", F.concat_ws("-", "family", "variant")).otherwise(F.col("family")).alias("model_id"), F.lit("").alias("raw_family"))
    return normalize.normalize(rows).select("ref_id", "family", "variant", "version")


@query(
    """
SELECT o_orderkey, 'claude' AS family, 'opus' AS variant, (1 + o_orderkey % 9) || '.' || (o_custkey % 10) AS version, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderstatus = 'F' THEN 'thinking' ELSE '' END AS modifiers
FROM orders"""
)
def decompose_dated(spark, d):
    """Identifiers with a version, a date and sometimes a modifier, put together from orders and taken apart again."""
    version = F.concat_ws("-", 1 + F.col("o_orderkey") % 9, F.col("o_custkey") % 10)
    mark = F.when(F.col("o_orderstatus") == "F", "-thinking").otherwise("")
    ident = F.concat(F.lit("claude-opus-"), version, F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"), mark)
    rows = table(spark, d, "orders").select("o_orderkey", ident.alias("model_id"), F.lit("claude-opus").alias("raw_family"))
    n = normalize.normalize(rows)
    return n.select("o_orderkey", "family", "variant", "version", "date", C.modifier_key(F.col("modifier")).alias("modifiers"))


@query(
    """
SELECT p_partkey, unnest(['qwen', 'kimi', 'minimax', 'gpt', 'glm']) AS family, unnest(['max', 'k', 'm', 'o', 'v']) AS variant,
  CAST(p_size AS VARCHAR) AS version, unnest(['instruct', 'thinking,turbo', 'highspeed', 'pro', 'turbo']) AS modifiers
FROM part"""
)
def decompose_series(spark, d):
    """Generations, series and product lines by the size of parts, without a label."""
    n = F.col("p_size").cast("string")
    idents = F.array(
        F.concat(F.lit("qwen"), n, F.lit("-max-instruct")), F.concat(F.lit("moonshotai/kimi-k"), n, F.lit("-thinking-turbo")), F.concat(F.lit("MiniMaxAI/MiniMax-M"), n, F.lit("-highspeed")),
        F.concat(F.lit("openai/o"), n, F.lit("-pro")), F.concat(F.lit("glm-"), n, F.lit("v-turbo")),
    )
    rows = table(spark, d, "part").select("p_partkey", F.explode(idents).alias("model_id")).withColumn("raw_family", F.lit(""))
    return normalize.normalize(rows).select("p_partkey", "family", "variant", "version", C.modifier_key(F.col("modifier")).alias("modifiers"))


# --- entities -----------------------------------------------------------------------------------------


@query(_M + "SELECT row_id, entity_key FROM keyed")
def entity_key(spark, d):
    return entities.with_entity(models_with_modifiers(spark, d)).select("row_id", "entity_key")


_RANGES = ", ".join(f"{n}({c}) AS {n}_{c}" for c in ("cost_input", "cost_output", "context_window", "max_output") for n in ("min", "max"))
_FLAGS = ", ".join(f"bool_or({c}) AS {c}" for c in entities.CAPABILITIES)


@query(_M + f"SELECT entity_key, count(*) AS n_instances, {_RANGES}, {_FLAGS} FROM keyed GROUP BY entity_key, family, variant, version")
def entity_rollup(spark, d):
    e = entities.roll_up(models_with_modifiers(spark, d))
    return e.drop("family", "variant", "version", "first", "identity_modifiers")


@query(_M + "SELECT entity_key, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, count(*) AS n_instances FROM keyed GROUP BY entity_key")
def entity_providers(spark, d):
    e = entities.entities(models_with_modifiers(spark, d))
    return e.select("entity_key", F.array_join("providers", ",").alias("providers"), "n_instances")


@query(
    """
WITH c AS (SELECT family, min(canonical_provider) AS publisher FROM families GROUP BY family),
r AS (SELECT m.family, m.variant, m.version, m.provider, m.model_id, row_number() OVER (PARTITION BY m.family, m.variant, m.version
      ORDER BY CASE WHEN m.provider <> coalesce(c.publisher, '') THEN 1 ELSE 0 END, m.provider, m.model_id) AS rn FROM models m LEFT JOIN c USING (family))
SELECT family, variant, version, provider, model_id FROM r WHERE rn = 1"""
)
def latest_representative(spark, d):
    publishers = table(spark, d, "families").groupBy("family").agg(F.min("canonical_provider").alias("publisher"))
    rows = table(spark, d, "models").select("family", "variant", "version", "provider", "model_id").join(publishers, "family", "left")
    return entities.one_per_group(rows, ["family", "variant", "version"], F.coalesce("publisher", F.lit(""))).drop("publisher")


@query("SELECT DISTINCT provider FROM models WHERE raw_family = 'quouhoum'")
def providers_for_family(spark, d):
    return entities.providers_for_family(table(spark, d, "models"), "quouhoum")


# --- merge ----------------------------------------------------------------------------------------------

_STORED = ["model_id", "provider", "display_name", "context_window", "last_synced"]


@query(
    """
WITH b AS (SELECT model_id, provider, display_name, context_window, last_synced, 1 AS s FROM models
           UNION ALL SELECT model_id, provider, display_name, context_window, last_synced, 0 FROM model_snapshots),
r AS (SELECT *, row_number() OVER (PARTITION BY model_id, provider ORDER BY coalesce(last_synced, '') DESC, s DESC,
      display_name DESC NULLS LAST, CAST(context_window AS VARCHAR) DESC NULLS LAST) AS rn FROM b)
SELECT model_id, provider, display_name, context_window, last_synced FROM r WHERE rn = 1"""
)
def merge_latest(spark, d):
    return merge.merge_models(table(spark, d, "models").select(*_STORED), table(spark, d, "model_snapshots").select(*_STORED))


@query(
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_type, ts, event_id FROM r WHERE rn = 1"""
)
def latest_event(spark, d):
    return merge.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


# --- lineage ----------------------------------------------------------------------------------------------


@query(
    """
WITH l AS (SELECT lower(child_id) AS k, min(child_ref.family) AS child_family FROM lineage GROUP BY 1)
SELECT m.row_id, m.model_id, coalesce(a.child_family, b.child_family) AS child_family FROM models m
LEFT JOIN l a ON lower(m.model_id) = a.k
LEFT JOIN l b ON a.k IS NULL AND contains(m.model_id, '/') AND array_slice(string_split(lower(m.model_id), '/'), -1, -1)[1] = b.k"""
)
def lineage_attach(spark, d):
    records = table(spark, d, "lineage").select("child_id", F.col("child_ref.family").alias("child_family"))
    return lineage.attach(table(spark, d, "models").select("row_id", "model_id"), records, "child_family")


_EDGES = """
WITH RECURSIVE rows_ AS (SELECT child_ref AS c, unnest(parents) AS p FROM lineage),
e AS (SELECT DISTINCT c.family || CASE WHEN coalesce(c.variant, '') <> '' THEN '/' || c.variant ELSE '' END || CASE WHEN coalesce(c.version, '') <> '' THEN '@' || c.version ELSE '' END AS src,
             p.family || CASE WHEN coalesce(p.variant, '') <> '' THEN '/' || p.variant ELSE '' END || CASE WHEN coalesce(p.version, '') <> '' THEN '@' || p.version ELSE '' END AS dst
      FROM rows_),
"""


def _plain_edges(spark, d):
    rows = table(spark, d, "lineage").withColumn("child_ref", F.struct("child_ref.family", "child_ref.variant", "child_ref.version", F.lit(None).cast("array<string>").alias("modifier")))
    return lineage.edges(rows)


@query(_EDGES + "w AS (SELECT src AS start, dst AS node FROM e UNION SELECT w.start, e.dst FROM w JOIN e ON w.node = e.src) SELECT start, node FROM w WHERE start <> node")
def lineage_ancestors(spark, d):
    e = _plain_edges(spark, d)
    return lineage.ancestors(e.select(F.col("child_key").alias("start")), e).select("start", "node")


@query(_EDGES + "w AS (SELECT dst AS start, src AS node FROM e UNION SELECT w.start, e.src FROM w JOIN e ON w.node = e.dst) SELECT start, node FROM w WHERE start <> node")
def lineage_descendants(spark, d):
    e = _plain_edges(spark, d)
    return lineage.descendants(e.select(F.col("parent_key").alias("start")), e).select("start", "node")


# --- resolver -----------------------------------------------------------------------------------------------


def _inputs(spark, d):
    entries, models = table(spark, d, "families"), table(spark, d, "models")
    names = entries.select(F.col("family").alias("input")).union(entries.where("variant <> ''").select(F.concat_ws("-", "family", "variant")))
    purl = lambda owner: models.where("row_id % 7 = 0").select(F.concat(F.lit("pkg:huggingface/"), owner, F.lit("/"), "model_id"))
    paths = models.where("family <> ''").select(F.explode(F.array(F.concat_ws("/", "family", "variant", "version"), F.concat_ws("/", "provider", "family", "variant", "version"), F.concat("family", F.lit("@"), "date"))))
    fixed = spark.createDataFrame([("claude-opus",), ("pkg:huggingface/nothing",), ("a/b/c",), ("/x@1",)], "input string")
    every = [models.select("model_id"), table(spark, d, "providers").select("provider"), purl(F.col("provider")), purl(F.lit("nobody")), models.select(F.concat_ws("/", "provider", "model_id")), paths, fixed]
    for more in every:
        names = names.union(more)
    return names


_OPEN_FAMILIES = _sql_list(sorted({f.lower() for f in V.FAMILIES}))


@query(
    _M
    + f""", i0 AS (SELECT family AS input FROM families UNION ALL SELECT family || '-' || variant FROM families WHERE variant <> '' UNION ALL SELECT model_id FROM models UNION ALL SELECT provider FROM providers
   UNION ALL SELECT 'pkg:huggingface/' || provider || '/' || model_id FROM models WHERE row_id % 7 = 0 UNION ALL SELECT 'pkg:huggingface/nobody/' || model_id FROM models WHERE row_id % 7 = 0
   UNION ALL SELECT concat_ws('/', provider, model_id) FROM models UNION ALL SELECT concat_ws('/', family, variant, version) FROM models WHERE family <> ''
   UNION ALL SELECT concat_ws('/', provider, family, variant, version) FROM models WHERE family <> '' UNION ALL SELECT family || '@' || date FROM models WHERE family <> ''
   UNION ALL SELECT unnest(['claude-opus', 'pkg:huggingface/nothing', 'a/b/c', '/x@1'])),
i1 AS (SELECT DISTINCT input, len(input) - len(replace(input, '/', '')) AS slashes, starts_with(input, 'pkg:huggingface/') AS purl, substr(input, 17) AS rest,
   contains(input, '@') OR len(list_filter(string_split(input, '/'), lambda s: regexp_full_match(s, '\\d+\\.\\d+'))) > 0 AS versioned FROM i0 WHERE input IS NOT NULL),
i2 AS (SELECT *, CASE WHEN purl THEN 'purl' WHEN (slashes BETWEEN 1 AND 3 AND versioned) OR (slashes = 0 AND contains(input, '@')) THEN 'canonical' WHEN slashes = 1 AND NOT starts_with(input, 'pkg:') THEN 'huggingface' ELSE 'raw' END AS scheme FROM i1),
i3 AS (SELECT *, CASE WHEN scheme = 'purl' THEN CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/') + 1) ELSE rest END WHEN scheme = 'huggingface' THEN substr(input, strpos(input, '/') + 1) ELSE input END AS text,
   CASE WHEN scheme = 'purl' AND contains(rest, '/') THEN string_split(rest, '/')[1] END AS hint,
   CASE WHEN contains(input, '@') THEN array_slice(string_split(input, '@'), -1, -1)[1] ELSE '' END AS on_date,
   string_split(CASE WHEN contains(input, '@') THEN regexp_extract(input, '^(.*)@[^@]*$', 1) ELSE input END, '/') AS path FROM i2),
t AS (SELECT *, concat_ws('|', 'f', family, variant, version, array_to_string(mods, ','), date, regexp_extract(model_id, ':([0-9]+)$', 1)) AS tuple FROM keyed),
shifted AS (SELECT *, CASE WHEN len(path) = 4 OR (len(path) = 3 AND shift = 1) THEN path[2:] ELSE path END AS p FROM i3 CROSS JOIN (VALUES (0), (1)) s(shift) WHERE scheme = 'canonical' AND path[1] <> '' AND (shift = 0 OR (len(path) = 3 AND path[1] <> path[2]))),
pick AS (
  SELECT DISTINCT input, 1 AS stage, false AS missed, row_id FROM i3 JOIN t ON i3.text = t.model_id WHERE scheme IN ('raw', 'huggingface', 'canonical') OR (scheme = 'purl' AND (hint IS NULL OR hint = '' OR hint = provider))
  UNION SELECT input, 2, true, row_id FROM i3 JOIN t ON i3.text = t.model_id WHERE scheme = 'purl' AND hint <> ''
  UNION SELECT input, 1, false, row_id FROM i3 JOIN t ON i3.text = t.family WHERE scheme = 'canonical' AND text <> ''
  UNION SELECT input, 1, false, row_id FROM shifted s JOIN t ON s.p[1] = t.family WHERE coalesce(s.p[2], '') IN ('', t.variant) AND coalesce(s.p[3], '') IN ('', t.version) AND on_date IN ('', t.date)
  UNION SELECT input, 2, false, row_id FROM i3 JOIN t ON i3.text = t.family WHERE scheme = 'raw' AND NOT regexp_matches(text, '[/@:]') AND text <> ''
  UNION SELECT input, 2 + len(t.family) + 1, false, row_id FROM i3 JOIN t ON i3.text = t.family || '-' || t.variant WHERE scheme = 'raw' AND NOT regexp_matches(text, '[/@:]') AND t.variant <> '' AND list_contains({_OPEN_FAMILIES}, lower(t.family))),
best AS (SELECT * FROM pick QUALIFY stage = min(stage) OVER (PARTITION BY input)),
g AS (SELECT b.input, count(*) AS n_rows, count(DISTINCT t.model_id) AS n_ids, count(DISTINCT tuple) AS n_tuples, bool_and(t.model_id = i3.text) AS same_id, bool_or(missed) AS missed,
      bool_or(scheme = 'canonical' OR (stage > 1 AND NOT missed)) AS canonical, min({{'provider': provider, 'model_id': t.model_id}}) AS best FROM best b JOIN t USING (row_id) JOIN i3 ON i3.input = b.input GROUP BY 1),
r AS (SELECT *, CASE WHEN canonical AND NOT same_id THEN n_tuples ELSE n_ids END AS n_models FROM g)
SELECT i3.input, CASE WHEN r.input IS NULL THEN 'not_found' WHEN n_models = 1 AND NOT missed THEN 'ok' ELSE 'ambiguous' END AS status, coalesce(n_rows, 0) AS n_rows, coalesce(n_models, 0) AS n_models,
  CASE WHEN n_models = 1 AND NOT missed THEN best.provider END AS provider, CASE WHEN n_models = 1 AND NOT missed THEN best.model_id END AS model_id
FROM i3 LEFT JOIN r ON i3.input = r.input"""
)
def resolve_batch(spark, d):
    return resolve.resolve_batch(models_with_modifiers(spark, d), _inputs(spark, d))


# --- analysis ---------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT raw_family FROM models WHERE raw_family <> ''")
def raw_families(spark, d):
    return analysis.raw_families(table(spark, d, "models"))


@query("SELECT count(DISTINCT provider) AS n_providers FROM models")
def count_providers(spark, d):
    return analysis.count_providers(table(spark, d, "models"))


@query(
    """
WITH c AS (SELECT provider, family, variant, version, model_id, count(*) OVER (PARTITION BY provider, family, variant, version) AS n_ids FROM models WHERE version <> '')
SELECT * FROM c WHERE n_ids > 1"""
)
def version_duplicates(spark, d):
    return analysis.version_duplicates(table(spark, d, "models"))


@query("SELECT provider, model_id, version FROM models WHERE contains(version, '.')")
def dotted_versions(spark, d):
    return analysis.dotted_versions(table(spark, d, "models"))


_DIVERGENT = """
WITH t AS (SELECT model_id, count(*) AS n_rows, count(DISTINCT (family, variant, version)) AS n_tuples, list_sort(list(DISTINCT family) FILTER (family <> '')) AS families FROM models GROUP BY model_id),
v AS (SELECT model_id, n_rows, n_tuples, coalesce(families, []) AS families FROM t WHERE n_rows > 1 AND n_tuples > 1)
"""


@query(_DIVERGENT + "SELECT model_id, n_rows, n_tuples, array_to_string(families, ',') AS families FROM v")
def divergence(spark, d):
    return analysis.divergence(table(spark, d, "models")).withColumn("families", F.array_join("families", ","))


@query(
    _DIVERGENT
    + """, s AS (SELECT model_id, families, list_transform(families, lambda f: lower(f)) AS low, list_transform(families, lambda f: rtrim(lower(f), '0123456789.-')) AS cut FROM v)
SELECT model_id, CASE WHEN len(families) <= 1 THEN 'C' WHEN len(list_distinct(low)) <= 1 THEN 'A' WHEN len(list_distinct(cut)) <= 1 AND cut[1] <> '' THEN 'B'
  WHEN len(list_filter(low, lambda a: len(list_filter(low, lambda b: starts_with(a, b || '-'))) > 0)) > 0 THEN 'C' ELSE 'D' END AS category FROM s"""
)
def divergence_category(spark, d):
    v = analysis.divergence(table(spark, d, "models"))
    return v.select("model_id", analysis.divergence_category(F.col("families")).alias("category"))


@query(
    """
WITH o AS (SELECT provider, model_id, max(context_window) AS c FROM models GROUP BY 1, 2), n AS (SELECT provider, model_id, max(context_window) AS c FROM model_snapshots GROUP BY 1, 2)
SELECT coalesce(o.provider, n.provider) AS provider, coalesce(o.model_id, n.model_id) AS model_id, CASE WHEN o.model_id IS NULL THEN 'added' WHEN n.model_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.provider = n.provider AND o.model_id = n.model_id WHERE o.model_id IS NULL OR n.model_id IS NULL OR o.c IS DISTINCT FROM n.c"""
)
def drift(spark, d):
    largest = lambda t: table(spark, d, t).groupBy("provider", "model_id").agg(F.max("context_window").alias("context_window"))
    return analysis.drift(largest("models"), largest("model_snapshots"), ["provider", "model_id"], ["context_window"])


@query(
    """
SELECT provider, 'left' AS side FROM (SELECT DISTINCT provider FROM models WHERE provider NOT IN (SELECT provider FROM documents WHERE provider IS NOT NULL))
UNION ALL SELECT provider, 'right' FROM (SELECT DISTINCT provider FROM documents WHERE provider IS NOT NULL AND provider NOT IN (SELECT provider FROM models))"""
)
def set_difference(spark, d):
    return analysis.set_difference(table(spark, d, "models"), table(spark, d, "documents").where("provider is not null"), ["provider"])


@query("SELECT family, variant FROM families f WHERE NOT EXISTS (SELECT 1 FROM models m WHERE m.family = f.family AND m.variant = f.variant)")
def unreached_entries(spark, d):
    return analysis.unreached(table(spark, d, "families").select("family", "variant"), table(spark, d, "models"))


@query()
def normalized_quality_counters(spark, d):
    """The counters over newly decomposed rows, with the residual failures."""
    return analysis.quality_counters(normalize.normalize(table(spark, d, "models")), V.RESIDUAL)


@query()
def diff_decompositions(spark, d):
    """What a new decomposition changes against the stored parts of the normalised rows."""
    stored = table(spark, d, "models").where("family <> ''")
    key = ["provider", "model_id", "raw_family", "family", "variant", "version", "release_date"]
    before = cut(merge.latest(stored.select(*key), ["provider", "model_id"], ["raw_family"]))
    after = normalize.normalize(before)
    return analysis.diff_decompositions(before.withColumn("modifier", F.lit(None).cast("array<string>")), after)
