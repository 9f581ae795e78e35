"""Queries that run single operators over whole tables, with the SQL that must agree with them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.functions import decompose as D
from lodeatlas.functions import enums
from lodeatlas.functions import vocabulary as V
from lodeatlas.operators import analysis, entities, lineage, lookup, merge, migrate, naming, resolve
from lodeatlas.plans.catalog_queries import _DIVERGENT, _M, models_with_modifiers
from lodeatlas.plans.registry import query, sql_list, sql_map
from lodeatlas.plans.session import ensure_checkpoint_dir, ship_package, table
from lodeatlas.sources.catalog_json import flatten

_FIRST_ID = "(SELECT min(model_id) FROM models)"


def _first_id(models: DataFrame) -> str:
    return models.agg(F.min("model_id")).first()[0]


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _python(rows: DataFrame, f: Callable[..., object], out: str = "result") -> DataFrame:
    """``rows`` with the text that a function of the library gives for the columns; errors as "error"."""
    ship_package(rows.sparkSession)

    def run(batches):
        for pdf in batches:
            results = []
            for args in pdf.itertuples(index=False):
                try:
                    got = f(*args)
                except (ValueError, KeyError):
                    got = "error"
                results.append(str(got.value if hasattr(got, "value") else got))
            yield pdf.assign(**{out: results})

    return rows.mapInPandas(run, ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in rows.schema) + f", {out} string")


# --- lookups ------------------------------------------------------------------------------------------


@query(f"SELECT model_id, provider FROM models WHERE model_id = {_FIRST_ID} ORDER BY provider LIMIT 1")
def first_offer(spark, d):
    m = table(spark, d, "models")
    return lookup.one_by_id(m, _first_id(m)).select("model_id", "provider")


@query(f"SELECT row_id, model_id, provider FROM models WHERE model_id = {_FIRST_ID}")
def offers_by_id(spark, d):
    m = table(spark, d, "models")
    return lookup.by_id(m, _first_id(m)).select("row_id", "model_id", "provider")


@query(f"WITH k AS (SELECT provider, model_id FROM models WHERE model_id = {_FIRST_ID} ORDER BY provider LIMIT 1) SELECT row_id, provider, model_id FROM models SEMI JOIN k USING (provider, model_id)")
def offer_by_key(spark, d):
    m = table(spark, d, "models")
    got = lookup.get(m, _first_id(m))
    return lookup.by_provider_and_id(m, got["provider"], got["model_id"]).select("row_id", "provider", "model_id")


@query("SELECT model_id, provider, raw_family, family, variant, version, date FROM models")
def model_references(spark, d):
    return lookup.reference(table(spark, d, "models"))


_NAMES = [*V.PROVIDERS[:30], *V.FAMILIES[:30], *V.CURATED_FAMILIES, *V.HOSTS, *V.HARNESSES, "Claude", "GPT", "nobody", "mixtral", "Mixtral"]


@query(
    f"""
WITH n AS (SELECT provider AS name FROM providers UNION SELECT family FROM families UNION SELECT unnest({sql_list(_NAMES)}))
SELECT name, list_contains({sql_list(V.PROVIDERS)}, name) AS provider, list_contains({sql_list(V.HOSTS)}, name) AS host, list_contains({sql_list(V.HARNESSES)}, name) AS harness,
  list_contains({sql_list([*V.FAMILIES, *V.CURATED_FAMILIES])}, name) AS family, list_contains({sql_list([f.lower() for f in V.FAMILIES])}, lower(name)) AS family_any_case,
  list_contains({sql_list(V.ENFORCED_FAMILIES)}, lower(name)) AS enforced FROM n"""
)
def known_names(spark, d):
    fixed = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    n = table(spark, d, "providers").select(F.col("provider").alias("name")).union(table(spark, d, "families").select("family")).union(fixed).distinct()
    x = F.col("name")
    flags = {"provider": C.is_known_provider(x), "host": C.is_known_host(x), "harness": C.is_known_harness(x), "family": C.is_known_family(x), "family_any_case": C.is_known_family(x, False), "enforced": C.is_enforced_family(x)}
    return n.select("name", *[f.alias(k) for k, f in flags.items()])


@query(f"WITH f AS (SELECT family FROM families UNION SELECT unnest({sql_list(V.CANONICAL_PROVIDERS)})) SELECT family, coalesce({sql_map(V.CANONICAL_PROVIDERS.items()).format(x='family')}, '') AS publisher FROM f")
def publishers(spark, d):
    f = table(spark, d, "families").select("family").union(spark.createDataFrame([(x,) for x in V.CANONICAL_PROVIDERS], "family string")).distinct()
    return f.select("family", C.canonical_provider(F.col("family")).alias("publisher"))


#: Models whose families have publishers: the stored rows under the names of a few known families.
_PUBLISHED = "SELECT row_id, model_id, CASE row_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'gpt' ELSE 'unlisted' END AS family, CASE WHEN row_id % 5 = 0 THEN CASE row_id % 3 WHEN 0 THEN 'anthropic' ELSE 'openai' END ELSE provider END AS provider FROM models WHERE provider IS NOT NULL"
_CLAUDE, _GPT = (V.CANONICAL_PROVIDERS.get(f, "") for f in ("claude", "gpt"))


def _published(spark, d):
    k = F.col("row_id") % 3
    own = F.when(F.col("row_id") % 5 == 0, F.when(k == 0, "anthropic").otherwise("openai")).otherwise(F.col("provider"))
    return table(spark, d, "models").where("provider is not null").select("row_id", "model_id", F.when(k == 0, "claude").when(k == 1, "gpt").otherwise("unlisted").alias("family"), own.alias("provider"))


@query(
    f"""
WITH m AS ({_PUBLISHED}), r AS (SELECT *, row_number() OVER (PARTITION BY family, model_id ORDER BY CASE WHEN provider = CASE family WHEN 'claude' THEN '{_CLAUDE}' WHEN 'gpt' THEN '{_GPT}' ELSE '' END THEN 0 ELSE 1 END, provider) AS rn FROM m)
SELECT family, model_id, provider FROM r WHERE rn = 1"""
)
def published_representative(spark, d):
    return entities.one_per_group(_published(spark, d).select("family", "model_id", "provider"), ["family", "model_id"])


@query(f"WITH m AS ({_PUBLISHED}) SELECT DISTINCT family, provider FROM m WHERE provider <> CASE family WHEN 'claude' THEN '{_CLAUDE}' WHEN 'gpt' THEN '{_GPT}' ELSE '' END")
def rehosting_providers(spark, d):
    return resolve.rehosts(_published(spark, d), ["family"])


# --- entities -----------------------------------------------------------------------------------------


@query(_M + "SELECT entity_key, min({'p': provider, 'm': model_id}).p AS provider, min({'p': provider, 'm': model_id}).m AS model_id FROM keyed WHERE provider IS NOT NULL AND model_id IS NOT NULL GROUP BY entity_key")
def entity_first(spark, d):
    e = entities.roll_up(models_with_modifiers(spark, d).where("provider is not null and model_id is not null"))
    return e.select("entity_key", "first.provider", "first.model_id")


@query(_M + "SELECT entity_key, provider, model_id, CASE WHEN starts_with(lower(model_id), 'azure-') AND length(model_id) > 6 AND NOT contains(model_id, '/') THEN 'azure' ELSE '' END AS host, cost_input, cost_output, context_window, max_output FROM keyed")
def entity_instances(spark, d):
    return entities.instances(models_with_modifiers(spark, d))


@query(
    _M
    + """, h AS (SELECT entity_key, CASE WHEN row_id % 3 = 0 AND NOT contains(model_id, '/') THEN 'azure' ELSE '' END AS host FROM keyed WHERE NOT starts_with(lower(model_id), 'azure-'))
SELECT entity_key, array_to_string(list_sort(list(DISTINCT host)), ',') AS hosts FROM h GROUP BY entity_key"""
)
def entity_hosts(spark, d):
    m = models_with_modifiers(spark, d).where("not startswith(lower(model_id), 'azure-')")
    moved = m.withColumn("model_id", F.when((F.col("row_id") % 3 == 0) & ~F.contains("model_id", F.lit("/")), F.concat(F.lit("azure-"), "model_id")).otherwise(F.col("model_id")))
    return entities.entities(moved).select("entity_key", F.array_join(F.array_sort("hosts"), ",").alias("hosts"))


@query(
    _M
    + """, l AS (SELECT lower(child_id) AS k, min(list_transform(parents, lambda p: {'family': coalesce(p.family, ''), 'variant': coalesce(p.variant, ''), 'version': coalesce(p.version, ''), 'kind': coalesce(p.kind, '')})) AS ps FROM lineage GROUP BY 1),
a AS (SELECT k.entity_key, k.provider, k.model_id, unnest(CASE WHEN x.k IS NOT NULL THEN x.ps ELSE y.ps END) AS p FROM keyed k LEFT JOIN l x ON lower(k.model_id) = x.k
      LEFT JOIN l y ON x.k IS NULL AND contains(k.model_id, '/') AND array_slice(string_split(lower(k.model_id), '/'), -1, -1)[1] = y.k)
SELECT entity_key, p.family || CASE WHEN p.variant <> '' THEN '/' || p.variant ELSE '' END || CASE WHEN p.version <> '' THEN '@' || p.version ELSE '' END AS parent_key, p.kind AS kind,
  min(provider) AS first_provider FROM a GROUP BY ALL"""
)
def entity_lineage(spark, d):
    filled = F.transform("parents", lambda p: F.struct(*[F.coalesce(p[c], F.lit("")).alias(c) for c in ("family", "variant", "version", "kind")]))
    records = table(spark, d, "lineage").select("child_id", filled.alias("parents"))
    got = entities.parents(lineage.attach(models_with_modifiers(spark, d), records))
    return got.select("entity_key", "parent_key", "kind", F.col("first.provider").alias("first_provider"))


@query(_M + "SELECT DISTINCT entity_key, family || '|' || variant || '|' || version || '|' || array_to_string(identity_mods, ',') AS result FROM keyed WHERE family <> ''")
def entity_tuples(spark, d):
    keys = entities.with_entity(models_with_modifiers(spark, d)).where("family <> ''").select("entity_key").distinct()
    joined = lambda k: "|".join([*(t := entities.parse_entity_tuple(k))[:3], ",".join(t[3])])
    return _python(keys, joined)


_LAST_KEY = "(SELECT max(entity_key) FROM keyed WHERE len(identity_mods) > 0 AND family <> '')"


@query(_M + f"SELECT entity_key, count(*) AS n_instances FROM keyed WHERE entity_key = {_LAST_KEY} GROUP BY 1")
def entity_of_tuple(spark, d):
    m = models_with_modifiers(spark, d)
    key = entities.with_entity(m).where("family <> '' and identity_modifiers is not null").agg(F.max("entity_key")).first()[0]
    return entities.entity_by_tuple(m, *entities.parse_entity_tuple(key)).select("entity_key", "n_instances")


@query(_M + ", one AS (SELECT model_id FROM models GROUP BY 1 HAVING count(*) = 1 ORDER BY 1 LIMIT 1) SELECT entity_key, count(*) AS n_instances FROM keyed WHERE entity_key = (SELECT entity_key FROM keyed SEMI JOIN one USING (model_id)) GROUP BY 1")
def entity_of_offer(spark, d):
    m = models_with_modifiers(spark, d)
    ident = m.groupBy("model_id").count().where("count = 1").agg(F.min("model_id")).first()[0]
    return entities.lookup_entity(m, ident).select("entity_key", "n_instances")


# --- analysis -----------------------------------------------------------------------------------------


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY 1")
def reason_counts(spark, d):
    return analysis.reason_counts(table(spark, d, "events").select(F.col("event_type").alias("reason")))


@query("SELECT count(*) AS n_rows, count(*) FILTER (version <> '') AS n_versioned, count(*) FILTER (version = '' AND raw_family <> '') AS n_reported FROM models")
def quality_counters(spark, d):
    """Rows without a version but with a raw family count as reported."""
    reason = F.when((F.col("version") == "") & (F.col("raw_family") != ""), V.RESIDUAL).when(F.col("version") == "", V.UNKNOWN_OVERFLOW)
    return analysis.quality_counters(table(spark, d, "models").withColumn("reason", reason), V.RESIDUAL)


#: The stored rows under a wrong family: the first word of who offers them.
_WRONG = _DIVERGENT.replace("FROM models", "FROM (SELECT model_id, string_split(provider, '-')[1] AS family, variant, version FROM models WHERE provider IS NOT NULL)")


@query(
    _WRONG
    + """, s AS (SELECT model_id, families, list_transform(families, lambda f: lower(f)) AS low, list_transform(families, lambda f: rtrim(lower(f), '0123456789.-')) AS cut FROM v),
d AS (SELECT model_id, families FROM s WHERE len(families) > 1 AND len(list_distinct(low)) > 1 AND NOT (len(list_distinct(cut)) = 1 AND cut[1] <> '')
      AND len(list_filter(low, lambda a: len(list_filter(low, lambda b: starts_with(a, b || '-'))) > 0)) = 0),
e AS (SELECT model_id, unnest(families) AS f FROM d)
SELECT a.f AS family_a, b.f AS family_b, count(*) AS n_ids FROM e a JOIN e b ON a.model_id = b.model_id AND a.f < b.f GROUP BY ALL"""
)
def mislabel_pairs(spark, d):
    m = table(spark, d, "models").where("provider is not null").withColumn("family", F.split("provider", "-")[0])
    return analysis.mislabel_pairs(analysis.divergence(m))


@query(_M + ", t AS (SELECT model_id, count(*) AS n_rows, count(DISTINCT (family, variant, version, array_to_string(mods, ','))) AS n_tuples FROM keyed GROUP BY 1) SELECT * FROM t WHERE n_rows > 1 AND n_tuples > 1")
def modifier_divergence(spark, d):
    m = models_with_modifiers(spark, d).withColumn("mods", C.modifier_key(F.col("modifier")))
    return analysis.divergence(m, ("family", "variant", "version", "mods")).drop("families")


@query("SELECT model_id, provider, family, variant, version FROM models WHERE row_id % 2 = 0 AND row_id % 3 = 0 AND model_id IS NOT NULL")
def gated_changes(spark, d):
    """Changed rows of even number, of which those whose number is divisible by three differ from the one allowed result."""
    m = table(spark, d, "models").where("model_id is not null").withColumn("model_id", F.concat("model_id", F.lit("#"), "row_id"))
    changed = m.where("row_id % 2 = 0").select("row_id", "model_id", "provider", "family", "variant", "version")
    allowed = m.select("model_id", F.when(F.col("row_id") % 3 == 0, F.concat("family", F.lit("?"))).otherwise(F.col("family")).alias("family"), "variant", "version")
    return analysis.gate(changed, allowed).select(F.split("model_id", "#")[0].alias("model_id"), "provider", "family", "variant", "version")


@query(
    """
SELECT CAST(p_partkey AS VARCHAR) AS provider, 'claude-opus-' || p_size || '-' || p_partkey AS model_id,
  CASE WHEN p_partkey % 8 = 0 THEN 'fix' WHEN p_partkey % 8 = 4 THEN 'regression' WHEN p_partkey % 4 = 1 THEN 'regression' ELSE 'improvement' END AS change
FROM part WHERE p_partkey % 4 <> 3 AND NOT (p_partkey % 8 = 5)
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'claude-opus-' || p_size || '-' || p_partkey, 'improvement' FROM part WHERE p_partkey % 8 = 5"""
)
def classified_changes(spark, d):
    """Decompositions of composed identifiers, changed in ways whose class is known: filled, lost, extended or moved parts."""
    p, n = table(spark, d, "part"), F.col("p_partkey")
    none = F.array().cast("array<string>")
    rows = p.select(n.alias("n"), n.cast("string").alias("provider"), F.concat(F.lit("claude-opus-"), F.col("p_size").cast("string"), F.lit("-"), n.cast("string")).alias("model_id"), F.col("p_size").cast("string").alias("size"))
    before = rows.select("provider", "model_id", F.lit("claude").alias("family"), F.lit("opus").alias("variant"), F.lit("").alias("version"), none.alias("modifier"))
    k, k8 = F.col("n") % 4, F.col("n") % 8
    variant = F.when(k8 == 1, "").when(k8 == 5, "").when(k == 2, "opus-max").otherwise("opus")
    # Of the rows that lose the variant, some keep it among the modifiers.
    after = rows.select("provider", "model_id", F.lit("claude").alias("family"), variant.alias("variant"), F.when(k == 0, F.col("size")).otherwise("").alias("version"), F.when(k8 == 5, F.array(F.lit("opus"))).otherwise(none).alias("modifier"))
    allowed = rows.where("n % 4 = 0").select("model_id", F.lit("claude").alias("family"), F.lit("opus").alias("variant"), F.when(F.col("n") % 8 == 0, F.col("size")).otherwise("0.0").alias("version"), none.alias("modifier"))
    return analysis.diff_decompositions(before, after, allowed)


@query(_M + "SELECT provider, model_id, raw_family, family, variant, version, array_to_string(mods, ',') AS modifiers FROM keyed WHERE provider IS NOT NULL AND model_id IS NOT NULL AND raw_family IS NOT NULL")
def dumped_decompositions(spark, d):
    """Written as tab-separated text and read back."""
    m = models_with_modifiers(spark, d).where("provider is not null and model_id is not null and raw_family is not null")
    path = _folder(spark, "dump")
    analysis.dump_decompositions(m, path)
    return analysis.load_decompositions(spark, path).withColumn("modifiers", F.coalesce(F.array_join("modifier", ","), F.lit(""))).drop("modifier")


# --- wire, store, migration -----------------------------------------------------------------------------

_NUM = "CASE WHEN json_type(payload, '{p}') IN ({k}) THEN CAST(json_extract(payload, '{p}') AS {t}) END"
_CONTEXT = _NUM.format(p="$.limit.context", k="'UBIGINT', 'BIGINT'", t="BIGINT")
_INPUT = _NUM.format(p="$.cost.input", k="'UBIGINT', 'BIGINT', 'DOUBLE'", t="DOUBLE")
_TRUE = "coalesce(json_type(payload, '$.{x}') = 'BOOLEAN' AND CAST(json_extract(payload, '$.{x}') AS VARCHAR) = 'true', false)"
_OBJECT = "json_type(payload, '$.interleaved') = 'OBJECT' AND len(list_filter(json_keys(payload, '$.interleaved'), lambda k: json_type(payload, '$.interleaved.' || k) <> 'VARCHAR')) = 0"


@query(
    f"""
SELECT coalesce(payload->>'$.id', '') AS model_id, coalesce(provider, '') AS provider, coalesce(payload->>'$.family', '') AS raw_family, coalesce({_CONTEXT}, 0) AS context_window,
  {_TRUE.format(x='reasoning')} AS reasoning, {_TRUE.format(x='tool_call')} AS tool_call, {_TRUE.format(x='interleaved')} OR coalesce({_OBJECT}, false) AS interleaved,
  CASE WHEN {_OBJECT} THEN CAST(json_extract(payload, '$.interleaved') AS VARCHAR) ELSE '' END AS interleaved_config, {_INPUT} AS cost_input
FROM wire_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'"""
)
def wire_models(spark, d):
    """The wire records as one-model documents, flattened to catalog rows."""
    rows = table(spark, d, "wire_records").where(F.try_parse_json("payload").isNotNull() & (F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")))
    name = F.to_json(F.array(F.coalesce("provider", F.lit(""))))
    doc = F.concat(F.lit("{"), name.substr(F.lit(2), F.length(name) - 2), F.lit(':{"name":"","models":{"m":'), F.col("payload"), F.lit("}}}"))
    return flatten(rows.select(doc.alias("value"))).select("model_id", "provider", "raw_family", "context_window", "reasoning", "tool_call", "interleaved", "interleaved_config", "cost_input")


@query(
    """
WITH s AS (SELECT model_id, provider, max({'d': display_name, 't': CAST(context_window AS VARCHAR), 'c': context_window}) AS b FROM model_snapshots WHERE display_name IS NOT NULL AND context_window IS NOT NULL GROUP BY 1, 2),
m AS (SELECT model_id, provider, max({'d': display_name, 't': CAST(context_window AS VARCHAR), 'c': context_window}) AS b FROM models WHERE display_name IS NOT NULL AND context_window IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(s.model_id, m.model_id) AS model_id, coalesce(s.provider, m.provider) AS provider, coalesce(s.b, m.b).d AS display_name, coalesce(s.b, m.b).c AS context_window,
  CASE WHEN s.b IS NOT NULL THEN '2026-02-01T00:00:00Z' ELSE '2026-01-01T00:00:00Z' END AS last_synced
FROM m FULL JOIN s ON m.model_id = s.model_id AND m.provider = s.provider"""
)
def stored_catalog(spark, d):
    """Two batches put into a stored catalog, which is then read."""
    store = merge.CatalogStore(spark, _folder(spark, "store"))
    for name, now in (("models", "2026-01-01T00:00:00Z"), ("model_snapshots", "2026-02-01T00:00:00Z")):
        store.upsert(table(spark, d, name).where("display_name is not null and context_window is not null").select("model_id", "provider", "display_name", "context_window"), now)
    return store.read().select("model_id", "provider", "display_name", "context_window", "last_synced")


_PATTERNS = [r"(.+)-(v\d+\.\d+(?:-.+)?)", r"(.+)-(k\d+\.\d+)", r"(.+)-(m\d+\.\d+)", r"([a-zA-Z][a-zA-Z0-9]*)(\d+\.\d+)", r"([a-zA-Z][a-zA-Z0-9]*(?:-[a-zA-Z][a-zA-Z0-9]*)*)-(\d+(?:-\d+)*)"]
_SUFFIX = f"(.*?)-({'|'.join(sorted(V.VARIANT_SUFFIXES, key=lambda s: (-len(s), s)))})"


def _split_sql(raw: str, i: int) -> str:
    """Family (1) or variant (2) of a raw family, by the curated list, the patterns and the suffixes in turn."""
    curated = sql_map((k, v[i - 1]) for k, v in V.OVERRIDES.items()).format(x=raw)
    cases = " ".join(f"WHEN regexp_full_match({raw}, '{p}') THEN regexp_extract({raw}, '^{p}$', {i})" for p in [*_PATTERNS, _SUFFIX])
    return f"coalesce({curated}, CASE {cases} ELSE {raw if i == 1 else chr(39) * 2} END)"


@query(
    f"""
WITH one AS (SELECT model_id, provider, display_name, raw_family, release_date, context_window, row_number() OVER (PARTITION BY model_id, provider
    ORDER BY display_name NULLS FIRST, raw_family NULLS FIRST, release_date NULLS FIRST, context_window NULLS FIRST) AS rn FROM models WHERE raw_family IS NOT NULL),
t AS (SELECT *, regexp_extract(model_id, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS a, regexp_extract(model_id, '(?:^|[^0-9])(\\d{{8}})(?:$|[^0-9])', 1) AS b, regexp_extract(release_date, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS c FROM one WHERE rn = 1)
SELECT model_id, provider, display_name, raw_family, release_date, context_window, '' AS interleaved_config, {_split_sql('raw_family', 1)} AS family, {_split_sql('raw_family', 2)} AS variant, coalesce(
  strftime(TRY_CAST(nullif(a, '') AS DATE), '%Y-%m-%d'), strftime(TRY_CAST(CASE WHEN b <> '' THEN substr(b, 1, 4) || '-' || substr(b, 5, 2) || '-' || substr(b, 7, 2) END AS DATE), '%Y-%m-%d'),
  strftime(TRY_CAST(nullif(c, '') AS DATE), '%Y-%m-%d'), '') AS date, '' AS version FROM t"""
)
def migrate_stored(spark, d):
    """The rows as a version 1 table had them, brought to the current version."""
    old = table(spark, d, "models").where("raw_family is not null").select("model_id", "provider", "display_name", F.col("raw_family").alias("family"), "release_date", "context_window")
    return migrate.migrate(old, 1)


@query("SELECT model_id, provider, min(context_window) AS context_window, '' AS interleaved_config FROM models WHERE context_window IS NOT NULL GROUP BY 1, 2")
def migrated_keys(spark, d):
    return migrate.to_v2(table(spark, d, "models").where("context_window is not null").select("model_id", "provider", "context_window"))


@query("SELECT model_id, '' AS version FROM models")
def migrated_version(spark, d):
    return migrate.to_v4(table(spark, d, "models").select("model_id"))


# --- names ----------------------------------------------------------------------------------------------

_STYLE = "coalesce(" + sql_map(naming.BRANDS.items()).format(x="lower(t)") + ", upper(substr(t, 1, 1)) || lower(substr(t, 2)))"


@query(f"SELECT provider, 'Provider' || array_to_string(list_transform(string_split_regex(provider, '[-.]'), lambda t: {_STYLE}), '') AS result FROM providers")
def provider_names(spark, d):
    return _python(table(spark, d, "providers").select("provider"), naming.provider_name)


@query(f"SELECT DISTINCT family, 'Family' || {_STYLE.replace('(t', '(family').replace('lower(t)', 'lower(family)')} AS result FROM families")
def family_names(spark, d):
    return _python(table(spark, d, "families").select("family").distinct(), naming.family_name)


@query(
    f"""
WITH t AS (SELECT ref_id, family || '_' || variant || '+' || ref_id || 'b' AS token, [family, variant, ref_id || 'b'] AS parts FROM families WHERE variant <> '')
SELECT token, array_to_string(list_transform(parts, lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN t ELSE {_STYLE} END), '_') AS result FROM t"""
)
def compound_parts(spark, d):
    f = table(spark, d, "families").where("variant <> ''")
    return _python(f.select(F.concat("family", F.lit("_"), "variant", F.lit("+"), F.col("ref_id").cast("string"), F.lit("b")).alias("token")), naming.part)


@query(
    """
WITH o AS (SELECT o_orderkey AS n, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders),
f AS (SELECT n, date, CASE n % 5 WHEN 0 THEN replace(date, '-', '') WHEN 1 THEN date WHEN 2 THEN substr(date, 6, 2) || '-' || substr(date, 1, 4) WHEN 3 THEN substr(date, 6) ELSE 'x' || n END AS tail FROM o)
SELECT 'model-' || n || 'x-' || tail AS name, date, CASE WHEN n % 5 = 4 THEN 'model-' || n || 'x-' || tail || '|False' ELSE 'model-' || n || 'x|True' END AS result FROM f"""
)
def undated_names(spark, d):
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    k = n % 5
    tail = F.when(k == 0, F.replace(day, F.lit("-"), F.lit(""))).when(k == 1, day).when(k == 2, F.concat(day.substr(6, 2), F.lit("-"), day.substr(1, 4))).when(k == 3, day.substr(6, 5)).otherwise(F.concat(F.lit("x"), n.cast("string")))
    rows = table(spark, d, "orders").select(F.concat(F.lit("model-"), n.cast("string"), F.lit("x-"), tail).alias("name"), day.alias("date"))
    return _python(rows, lambda name, date: "|".join(map(str, naming.strip_date(name, date))))


def _named_rows(spark, d):
    """Identifiers put together from the canonical list; every third entry in two spellings whose names collide."""
    f = table(spark, d, "families").where("variant <> ''")
    version = F.concat((F.col("ref_id") % 9 + 1).cast("string"), F.lit("."), (F.col("ref_id") % 7).cast("string"))
    spelled = F.when(F.col("ref_id") % 3 == 0, F.array(version, F.replace(version, F.lit("."), F.lit("-")))).otherwise(F.array(version))
    rows = f.select("ref_id", "family", "variant", version.alias("version"), F.explode(spelled).alias("said"))
    return rows.select("ref_id", F.lit("zikria").alias("provider"), F.concat_ws("-", "family", "variant", "said").alias("model_id"), "family", "variant", "version", F.lit("").alias("date"), F.lit(None).cast("array<string>").alias("modifier"))


_NAMED = f"""
WITH f AS (SELECT *, (1 + ref_id % 9) || '.' || (ref_id % 7) AS version FROM families WHERE variant <> ''),
s AS (SELECT *, unnest(CASE WHEN ref_id % 3 = 0 THEN [version, replace(version, '.', '-')] ELSE [version] END) AS said FROM f),
n AS (SELECT family || '-' || variant || '-' || said AS model_id, family, variant, version,
  'Model__Zikria__' || array_to_string(list_transform([family, variant], lambda t: {_STYLE}), '__') || '__' || replace(version, '.', '_') AS name FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY name) AS k, row_number() OVER (PARTITION BY name ORDER BY model_id) AS rn FROM n)
"""


@query(_NAMED + "SELECT 'zikria' AS provider, model_id, CASE WHEN k = 1 THEN name ELSE name || '_' || rn END AS name FROM c")
def constant_names(spark, d):
    return naming.constants(_named_rows(spark, d))


@query(_NAMED + "SELECT model_id, version, name AS result FROM c")
def constant_name_parts(spark, d):
    rows = _named_rows(spark, d).select("model_id", "version")
    return _python(rows, lambda i, v: naming.constant_name(i, "zikria", "f", v, "", []))


@query(_NAMED + "SELECT model_id, family, variant, replace(version, '.', '_') AS result FROM c")
def version_segments(spark, d):
    return _python(_named_rows(spark, d).select("model_id", "family", "variant"), lambda i, f, v: naming.version_segment(i, f, v, ""))


# --- scalar functions --------------------------------------------------------------------------------------

_TEXTS = ["identity", " Attribute ", "IDENTITY", "other", "canonical", "Canonical", "hf", "HuggingFace", "purl", "PURL", "raw", "peasant", "json", "YAML", "yaml", "table", "text", "video", "Video", "smell", "merge", "none", "adapter", ""]


def _fixed(spark):
    return spark.createDataFrame([(t,) for t in _TEXTS], "input string")


_INPUTS = f"WITH t AS (SELECT unnest({sql_list(_TEXTS)}) AS input) "


@query(_INPUTS + "SELECT input, CASE WHEN lower(trim(input)) IN ('identity', 'attribute') THEN lower(trim(input)) ELSE 'error' END AS result FROM t")
def parsed_modifier_classes(spark, d):
    return _python(_fixed(spark), enums.parse_modifier_class)


@query(
    _INPUTS
    + f"""SELECT input, CASE WHEN input IN ('canonical', 'huggingface', 'purl', 'raw') THEN input ELSE 'error' END AS scheme,
  CASE lower(input) WHEN 'canonical' THEN 'peasant' WHEN 'peasant' THEN 'peasant' WHEN 'hf' THEN 'huggingface' WHEN 'huggingface' THEN 'huggingface' WHEN 'purl' THEN 'purl' WHEN 'raw' THEN 'raw' ELSE 'error' END AS input_format,
  CASE WHEN list_contains({sql_list(V.MODALITIES)}, input) THEN input ELSE 'error' END AS modality, CASE WHEN list_contains({sql_list(V.DERIVATION_KINDS)}, input) THEN input ELSE 'error' END AS kind,
  CASE WHEN input IN ('json', 'yaml', 'table') THEN input ELSE 'error' END AS output_format FROM t"""
)
def parsed_names(spark, d):
    got = _fixed(spark)
    for column, f in (("scheme", enums.Scheme.parse), ("input_format", enums.InputFormat.parse), ("modality", enums.parse_modality), ("kind", enums.parse_derivation), ("output_format", enums.parse_output_format)):
        got = _python(got, lambda x, *_, f=f: f(x), column)
    return got


@query("SELECT row_id, CASE WHEN trim(interleaved_config) <> '' AND json_valid(interleaved_config) THEN replace(CAST(CAST(interleaved_config AS JSON) AS VARCHAR), '\": \"', '\":\"') ELSE '' END AS config FROM models")
def capability_configs(spark, d):
    return table(spark, d, "models").select("row_id", C.capability_config_text(C.capability_config(F.col("interleaved_config"))).alias("config"))


@query(
    f"""
WITH t AS (SELECT DISTINCT unnest(string_split(lower(model_id), '-')) AS tok FROM models)
SELECT tok, tok = '' OR regexp_full_match(tok, '\\d{{4}}|\\d{{6}}|\\d+(\\.\\d+)?[bm]|\\d+x\\d+b|\\d+b-a\\d+b|\\d+k|v\\d+(\\.\\d+)?|\\d{{4,}}') OR list_contains({sql_list(V.SERVING_WORDS)}, tok) AS transparent FROM t"""
)
def transparent_tokens(spark, d):
    toks = table(spark, d, "models").where("model_id is not null").select(F.explode(F.split(F.lower("model_id"), "-")).alias("tok")).distinct()
    return toks.select("tok", C.is_transparent_token(F.col("tok")).alias("transparent"))


@query(
    """
WITH o AS (SELECT o_orderkey AS n, (o_orderkey % 9) || '-' || (o_custkey % 10) AS v FROM orders)
SELECT n AS o_orderkey, CASE n % 4 WHEN 0 THEN replace(v, '-', '.') WHEN 1 THEN replace(v, '-', '.') WHEN 2 THEN '' ELSE CAST(n % 9 AS VARCHAR) END AS version FROM o"""
)
def dotted_numbers(spark, d):
    """Numbers with a date behind, between them or with a month and year instead."""
    n = F.col("o_orderkey")
    a, b = (n % 9).cast("string"), (F.col("o_custkey") % 10).cast("string")
    text = F.when(n % 4 == 0, F.concat_ws("-", a, b)).when(n % 4 == 1, F.concat_ws("-", a, b, F.lit("2024"), F.lit("7"))).when(n % 4 == 2, F.lit("07-2024")).otherwise(F.concat_ws("-", a, F.lit("202405"), b))
    return table(spark, d, "orders").select("o_orderkey", C.dotted(text).alias("version"))


#: Steps of the decomposition: name, call, and for a number n the input and the result.
_STEPS = [
    ("leading_family", D.leading_family, "'claude-' || n", "'claude'"),
    ("leading_family", D.leading_family, "n || '-x'", "''"),
    ("peel_modifier", D.peel_modifier, "'claude-opus' || n || '-thinking'", "'claude-opus' || n"),
    ("trailing_modifier", lambda x: D.trailing_modifier(x, "claude", "")[0], "'org/claude-' || n || '-thinking'", "'thinking'"),
    ("tail_modifiers", lambda x: ",".join(D.tail_modifiers(x, "claude", "")[0]), "'claude-' || n || '-turbo-70b-thinking-fp8'", "'thinking,turbo'"),
    ("demote_variant", lambda x: D.demote_variant(D.Reading("claude", x)).variant, "'v' || n", "'v' || n"),
    ("demote_variant", lambda x: ",".join(D.demote_variant(D.Reading("claude", x[:8])).modifiers), "'thinking' || n", "'thinking'"),
    ("family_alias", lambda x: D.read_plain(x).family, "'l3-' || n || 'b'", "'llama'"),
    ("glued_generation", lambda x: "/".join(D.glued_generation(x)), "'qwen' || n || '.5'", "'qwen/' || n || '.5'"),
    ("series", lambda x: "/".join(D.series("kimi", x)), "'kimi-k' || n || '-turbo'", "'k/' || n || '/'"),
    ("series_family", D.series_family, "'kimi-k' || n", "'kimi'"),
    ("reduced", lambda x: "/".join(D.reduced(x)), "'claude-opus-' || n || '.5'", "'claude/opus'"),
    ("reduced", lambda x: str(D.reduced(x)), "'claude-unheard-' || n", "'None'"),
    ("version_after", lambda x: D.version_after(x, "claude-opus"), "'claude-opus-' || n || '-5-20240501'", "n || '.5'"),
    ("version_between", lambda x: D.version_between(x, "claude", "opus")[0], "'claude-' || n || '-5-opus-20240501'", "n || '.5'"),
    ("plain_version", lambda x: "/".join(D.plain_version(x, "glm", "")), "'glm-' || n || '.5v'", "n || '.5/vision'"),
    ("exact", lambda x: "/".join((r := D.decompose("", x[: x.index("#")])).family + "|" + r.version for _ in (1,)), "'gryphe/mythomax-l2-13b#' || n", "'mythomax|'"),
    ("residual", lambda x: str(D.decompose("claude", x).failure), "'claude-' || n || '-odd-opus'", f"'{V.RESIDUAL}'"),
    ("date_as_version", lambda x: str(D.decompose(x, x).failure), "'claude-opus-1' || (100 + n)", f"'{V.DATE_AS_VERSION}'"),
    ("bare_name", D.bare_name, "'a/b/minimaxai-m' || n", "'m' || n"),
    ("host", lambda x: "/".join(D.host_of(x)), "'azure-gpt-' || n", "'azure/gpt-' || n"),
    ("split_raw", lambda x: "/".join(D.split_raw(x)), "'claude-' || n || '-5'", "'claude/' || n || '-5'"),
    ("split_raw_version", lambda x: "/".join(D.split_raw_version(x)), "'foo-' || n || '.5-mini'", "'foo/mini/' || n || '.5'"),
    ("order_modifiers", lambda x: ",".join(D.order_modifiers(x.split("|")[:3])), "'turbo|THINKING|thinking|' || n", "'THINKING,turbo'"),
]
_STEP_SQL = " UNION ALL ".join(f"SELECT {i} AS step_no, '{name}' AS step, {given} AS input, {result} AS result FROM n" for i, (name, _, given, result) in enumerate(_STEPS))


@query(f"WITH n AS (SELECT DISTINCT p_size AS n FROM part WHERE p_size < 60) {_STEP_SQL}")
def decomposition_steps(spark, d):
    """Single steps of the decomposition over composed texts whose result follows from their rules."""
    n = table(spark, d, "part").where("p_size < 60").select(F.col("p_size").alias("n")).distinct()
    rows = None
    for i, (name, _, given, _) in enumerate(_STEPS):
        got = n.select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.expr(given).alias("input"))
        rows = got if rows is None else rows.union(got)
    calls = [f for _, f, _, _ in _STEPS]
    return _python(rows, lambda i, _, text: calls[i](text))


_LINES = [(c, r[0], "+".join(p[0] + "/" + p[3] for p in parents)) for c, r, _, parents in V.LINEAGE]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _LINES) + ") t(child_id, family, parents)")
def curated_lineage(spark, d):
    rows = lineage.curated(spark)
    return rows.select("child_id", F.col("child_ref.family").alias("family"), F.array_join(F.transform("parents", lambda p: F.concat(p["family"], F.lit("/"), p["kind"])), "+").alias("parents"))
