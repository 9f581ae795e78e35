"""Queries of the general data problems: schema drift, hierarchies, snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeatlas.operators import hierarchy, schema_drift, snapshot_diff
from lodeatlas.plans.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, sf_dir, "wire_records"))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a typed column for each common field, and with all fields as JSON text."""
    one, _ = schema_drift.typed(schema_drift.unify(table(spark, sf_dir, "wire_records")))
    return one


#: Common fields whose values are not themselves split into members.
_FLAT = ("attachment", "open_weights", "reasoning", "tool_call", "name", "release_date")
_PRICES = ("audio", "cache_read", "cache_write", "input", "output", "reasoning")


def p1_unified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed columns of flags, names and prices of every record."""
    one = p1_unified(spark, sf_dir)
    typed = [c for c in (*_FLAT, *(f"cost_{p}" for p in _PRICES))]
    # Half flag, half text: which it mostly is depends on the feeds.
    mixed = schema_drift.plain_text(F.element_at("fields", "interleaved")).alias("interleaved")
    return one.select("feed", "file_no", "line_no", "provider", F.col("id").alias("model_id"), mixed, *[F.col(c) if c in one.columns else F.lit(None).cast("string").alias(c) for c in typed])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.node_roots(*hierarchy.lineage_edges(table(spark, sf_dir, "lineage")))


def p3_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its roots, the depths and shortest paths from them, and the number of its descendants."""
    at = hierarchy.node_positions(*hierarchy.lineage_edges(table(spark, sf_dir, "lineage")))
    # The place inside its tree depends on how nodes are numbered.
    return at.select("node_key", "root_key", "depth", "path", "n_below")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every node."""
    return hierarchy.all_descendants(*hierarchy.lineage_edges(table(spark, sf_dir, "lineage")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.diff_snapshots(table(spark, sf_dir, "model_snapshots"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p1_unified_values, p3_found, p3_positions, p3_descendants, p5_found)}

_KEY = """trim({r}.family) || CASE WHEN coalesce(trim({r}.variant), '') <> '' THEN '/' || trim({r}.variant) ELSE '' END
 || CASE WHEN coalesce(trim({r}.version), '') <> '' THEN '@' || trim({r}.version) ELSE '' END"""

#: A member of a JSON object by its key, and the text in which equal values are written equally.
_AT = """json_extract({o}, '$."' || {k} || '"')"""
_TEXT = "CASE WHEN json_type({v}) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST({v} AS DOUBLE) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"

# The names under which the feeds deliver one field.
_SAID = {
    "attachment": ["attachment", "attachments"], "open_weights": ["open_weights", "weights_open"], "tool_call": ["tool_call", "function_calling"],
    "reasoning": ["reasoning", "is_reasoning", "reasoning_mode", "supports_reasoning"], "interleaved": ["interleaved", "interleave", "interleaved_thinking"], "name": ["name"], "release_date": ["release_date"],
}
_COSTS = ["cost", "price", "pricing"]
_MEMBERS = {
    "audio": ["audio", "audio_input"], "cache_read": ["cache_read", "cached_input", "cacheRead"], "cache_write": ["cache_write", "cacheWrite"], "input": ["input", "prompt", "input_price"],
    "output": ["output", "completion", "output_price"], "reasoning": ["reasoning", "thinking_tokens"],
}


def _json_text(paths: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(CAST(json_extract(p, '{x}') AS VARCHAR), 'null')" for x in paths) + ")"


_YES, _NO = """('true', '"true"', '"yes"', '"on"', '1')""", """('false', '"false"', '"no"', '"off"', '0')"""
_BOOL = "CASE WHEN lower({t}) IN " + _YES + " THEN true WHEN lower({t}) IN " + _NO + " THEN false END"
_NUMBER = r"""TRY_CAST(regexp_replace({t}, '^"\s*[$€£]?\s*([-+0-9.eE]+)\s*"$', '\1') AS DOUBLE)"""
_STRING = """CASE WHEN starts_with({t}, '"') THEN CAST({t} AS JSON)->>'$' ELSE replace({t}, '":"', '": "') END"""
_READ_AS = {k: _STRING if k in ("interleaved", "name", "release_date") else _BOOL for k in _SAID}
_VALUES = ", ".join(
    [f"{_READ_AS[k].format(t=_json_text(['$.' + x for x in names]))} AS {k}" for k, names in _SAID.items()]
    + [f"{_NUMBER.format(t=_json_text([f'$.{c}.{m}' for c in _COSTS for m in names]))} AS cost_{k}" for k, names in _MEMBERS.items()]
)

#: Nodes, edges and every pair (x, a) with the numbers n of steps in which a lies above x.
_WALK = f"""
WITH RECURSIVE rows_ AS (
  SELECT lower(coalesce({_KEY.format(r="child_ref")}, '')
           || CASE WHEN len(child_ref.modifier) > 0 THEN '{{' || array_to_string(list_transform(child_ref.modifier, lambda m: trim(m)), ',') || '}}' ELSE '' END) AS c, parents FROM lineage),
opened AS (SELECT c, unnest(parents) AS p FROM rows_),
e AS (SELECT DISTINCT c, lower({_KEY.format(r="p")}) AS p FROM opened WHERE lower(trim(coalesce(p.kind, ''))) <> 'none'),
nodes AS (SELECT c AS x FROM rows_ UNION SELECT p FROM e),
roots AS (SELECT x FROM nodes WHERE x NOT IN (SELECT c FROM e)),
w AS (SELECT x, x AS a, 0 AS n FROM nodes UNION SELECT w.x, e.p, n + 1 FROM w JOIN e ON w.a = e.c WHERE n < 150),
rooted AS (SELECT x, a, min(n) AS n FROM w WHERE a IN (SELECT x FROM roots) GROUP BY x, a),
circle AS (SELECT DISTINCT x FROM w WHERE x = a AND n > 0)"""

ORACLES = {
    "p1_found": f"""
WITH ok AS (SELECT feed, file_no, provider, CAST(payload AS JSON) AS p FROM wire_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
keys AS (SELECT feed, file_no, provider, p->>'$.id' AS id, unnest(json_keys(p)) AS k, p FROM ok),
top AS (SELECT feed, file_no, provider, id, '' AS parent, k AS path, {_AT.format(o="p", k="k")} AS v FROM keys),
inner_keys AS (SELECT feed, file_no, provider, id, path AS parent, unnest(json_keys(v)) AS k, v FROM top WHERE json_type(v) = 'OBJECT'),
members AS (SELECT feed, file_no, provider, id, parent, parent || '.' || k AS path, {_AT.format(o="v", k="k")} AS v FROM inner_keys),
fields AS (
  SELECT feed, file_no, provider, id, parent, path,
    CASE json_type(v) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
    CASE WHEN json_type(v) = 'OBJECT' THEN array_to_string(list_sort(list_transform(json_keys(v), lambda k: k || '=' || {_TEXT.format(v=_AT.format(o="v", k="k"))})), ',')
         ELSE {_TEXT.format(v="v")} END AS value
  FROM (SELECT * FROM top UNION ALL SELECT * FROM members) WHERE json_type(v) <> 'NULL'),
prof AS (SELECT feed, file_no, parent, path, list_sort(list(DISTINCT kind)) AS kinds FROM fields GROUP BY ALL),
steps AS (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS older FROM (SELECT DISTINCT feed, file_no FROM wire_records)),
n AS (SELECT p.* FROM prof p JOIN steps s USING (feed, file_no) WHERE s.older IS NOT NULL),
o AS (SELECT p.feed, s.file_no, p.parent, p.path, p.kinds FROM prof p JOIN steps s ON p.feed = s.feed AND p.file_no = s.older),
both_ AS (SELECT coalesce(o.feed, n.feed) AS feed, coalesce(o.file_no, n.file_no) AS file_no, coalesce(o.parent, n.parent) AS parent, coalesce(o.path, n.path) AS path, o.kinds AS ok, n.kinds AS nk
          FROM o FULL JOIN n ON o.feed = n.feed AND o.file_no = n.file_no AND o.parent = n.parent AND o.path = n.path),
objects AS (SELECT feed, file_no, path FROM both_ WHERE parent = '' AND list_contains(ok, 'object') AND list_contains(nk, 'object')),
c AS (SELECT * FROM both_ b WHERE parent = '' OR EXISTS (SELECT 1 FROM objects x WHERE x.feed = b.feed AND x.file_no = b.file_no AND x.path = b.parent)),
ov AS (SELECT DISTINCT f.feed, s.file_no, f.provider, f.id, f.parent, f.path, f.value FROM fields f JOIN steps s ON f.feed = s.feed AND f.file_no = s.older
       JOIN c ON c.feed = f.feed AND c.file_no = s.file_no AND c.path = f.path AND c.nk IS NULL),
nv AS (SELECT DISTINCT f.feed, f.file_no, f.provider, f.id, f.parent, f.path, f.value FROM fields f JOIN c ON c.feed = f.feed AND c.file_no = f.file_no AND c.path = f.path AND c.ok IS NULL),
renamed AS (SELECT ov.feed, ov.file_no, ov.path AS old_field, nv.path AS new_field FROM ov JOIN nv USING (feed, file_no, provider, id, parent)
            GROUP BY ALL HAVING avg(CASE WHEN ov.value = nv.value THEN 1.0 ELSE 0.0 END) >= 0.9)
SELECT feed, file_no, 'retyped' AS change_kind, path AS old_field, path AS new_field FROM c WHERE ok <> nk
UNION ALL SELECT feed, file_no, 'renamed', old_field, new_field FROM renamed
UNION ALL SELECT feed, file_no, 'removed', path, '' FROM c WHERE nk IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = c.feed AND r.file_no = c.file_no AND r.old_field = c.path)
UNION ALL SELECT feed, file_no, 'added', '', path FROM c WHERE ok IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = c.feed AND r.file_no = c.file_no AND r.new_field = c.path)
""",
    "p1_unified_values": f"""
WITH ok AS (SELECT feed, file_no, line_no, provider, CAST(payload AS JSON) AS p FROM wire_records WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')
SELECT DISTINCT feed, file_no, line_no, provider, p->>'$.id' AS model_id, {_VALUES} FROM ok""",
    "p3_found": f"""{_WALK}
SELECT x AS node_key, a AS root_key, CAST(n AS BIGINT) AS depth FROM rooted
UNION ALL SELECT x, '', -1 FROM circle
UNION ALL SELECT x, '', -2 FROM nodes WHERE x NOT IN (SELECT x FROM rooted) AND x NOT IN (SELECT x FROM circle)
""",
    "p3_positions": f"""{_WALK},
steps AS (SELECT r.x, r.a, r.n, min(e.p) AS above FROM rooted r JOIN e ON e.c = r.x JOIN rooted q ON q.x = e.p AND q.a = r.a AND q.n = r.n - 1 GROUP BY ALL),
paths AS (SELECT x, a, n, x AS path FROM rooted WHERE n = 0
          UNION ALL SELECT s.x, s.a, s.n, p.path || ' > ' || s.x FROM paths p JOIN steps s ON s.above = p.x AND s.a = p.a),
below AS (SELECT a AS x, count(DISTINCT x) AS n FROM w WHERE n > 0 GROUP BY a),
found AS (SELECT x, a, CAST(n AS BIGINT) AS depth, path FROM paths UNION ALL SELECT x, '', -1, '' FROM circle
          UNION ALL SELECT x, '', -2, '' FROM nodes WHERE x NOT IN (SELECT x FROM rooted) AND x NOT IN (SELECT x FROM circle))
SELECT f.x AS node_key, a AS root_key, depth, path, coalesce(n, 0) AS n_below FROM found f LEFT JOIN below USING (x)
""",
    "p3_descendants": f"""{_WALK}
SELECT DISTINCT a AS node_key, x AS descendant_key FROM w WHERE n > 0
""",
    "p5_found": """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_no, provider, model_id
                               ORDER BY CAST(last_synced AS TIMESTAMPTZ) DESC) AS rn
  FROM model_snapshots),
latest AS (SELECT * FROM ranked WHERE rn = 1),
steps AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS older
          FROM (SELECT DISTINCT snapshot_no FROM model_snapshots)),
newer AS (SELECT l.*, s.older FROM latest l JOIN steps s USING (snapshot_no) WHERE s.older IS NOT NULL),
older AS (SELECT l.*, s.snapshot_no AS following FROM latest l JOIN steps s ON s.older = l.snapshot_no)
SELECT coalesce(n.snapshot_no, o.following) AS snapshot_no,
       coalesce(n.provider, o.provider) AS provider,
       coalesce(n.model_id, o.model_id) AS model_id,
       CASE WHEN o.model_id IS NULL THEN 'added' WHEN n.model_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM newer n FULL JOIN older o
  ON n.snapshot_no = o.following AND n.provider = o.provider AND n.model_id = o.model_id
WHERE o.model_id IS NULL OR n.model_id IS NULL
   OR n.cost_input IS DISTINCT FROM o.cost_input OR n.cost_output IS DISTINCT FROM o.cost_output
   OR n.context_window IS DISTINCT FROM o.context_window OR n.display_name IS DISTINCT FROM o.display_name
""",
}
