"""The catalog's own operators on small tables."""

from __future__ import annotations

import io
import json
import threading
from datetime import datetime, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodeatlas.__main__ import main
from lodeatlas.functions import columns as C
from lodeatlas.functions import vocabulary as V
from lodeatlas.functions.decompose import decompose, host_of, last_segment, modifier_class, order_modifiers, without_date
from lodeatlas.functions.enums import InputFormat, Scheme, is_known_family, parse_modality, parse_modifier_class, validate_vocabulary
from lodeatlas.operators import analysis, entities, lineage, lookup, merge, migrate, naming, normalize
from lodeatlas.operators.errors import Ambiguous, CacheMiss, CatalogError, NotFound, Unavailable
from lodeatlas.operators.resolve import Asked, asked, detect, resolve, resolve_batch, show
from lodeatlas.plans import render
from lodeatlas.sources.catalog_json import flatten, keep_response, read_cached, read_catalog
from lodeatlas.sources.http_catalog import CatalogSource, fetch, fetch_models
from lodeatlas.streaming.ingest import ingest

DOCUMENT = {
    "anthropic": {"name": "Anthropic", "models": {
        "a": {"id": "claude-opus-4-5-20251101", "name": "Claude <Opus>", "family": "claude-opus", "reasoning": True, "interleaved": {"field": "reasoning_details"},
              "cost": {"input": 5, "output": 25, "reasoning": 0.0}, "limit": {"context": 200000, "output": 64000}, "modalities": {"input": ["text", "hologram", "pdf"], "output": ["text"]}},
        "b": {"id": "claude-3-5-haiku", "name": "Haiku", "family": "claude-haiku", "interleaved": {"field": {"x": 1}}, "reasoning": "yes"}}},
    "rehost": {"name": "Rehost", "models": {
        "a": {"id": "claude-opus-4-5-20251101", "family": "claude-opus", "tool_call": True, "cost": {"input": 6.5}, "limit": {"context": 0}, "interleaved": False},
        "c": {"id": "qwen3-max", "family": ""}, "d": {"id": "azure/glm-5-turbo", "family": "glm", "interleaved": True}}},
    "zhost": {"name": "Zhost", "models": {"e": {"id": "azure-gpt-4o-mini", "family": "gpt-mini", "release_date": "2024-07-18"}, "f": {"id": "claude-sonnet-4-5", "family": "claude-sonnet"}}},
}


@pytest.fixture(scope="module")
def wire(spark):
    return flatten(spark.createDataFrame([(json.dumps(DOCUMENT),), ("broken",), (None,)], "value string")).cache()


@pytest.fixture(scope="module")
def models(wire):
    rows = normalize.normalize(wire)
    return rows.withColumns({"last_synced": F.lit("2026-01-01T00:00:00Z")}).cache()


# --- sources -----------------------------------------------------------------------------------------


def test_flatten(wire):
    by = {(r.provider, r.model_id): r for r in wire.collect()}
    assert len(by) == 7
    a = by[("anthropic", "claude-opus-4-5-20251101")]
    assert (a.context_window, a.cost_input, a.cost_reasoning, a.cost_cache_read) == (200000, 5.0, 0.0, None)
    assert a.interleaved and json.loads(a.interleaved_config) == {"field": "reasoning_details"} and list(a.modalities_input) == ["text", "pdf"]
    b = by[("anthropic", "claude-3-5-haiku")]
    assert (b.context_window, b.cost_input, b.reasoning, b.interleaved, b.interleaved_config) == (0, None, False, False, "")
    assert by[("rehost", "azure/glm-5-turbo")].interleaved and not by[("rehost", "claude-opus-4-5-20251101")].interleaved


def test_cached_response(spark, tmp_path):
    with pytest.raises(CacheMiss):
        read_cached(spark, str(tmp_path))
    path = keep_response(str(tmp_path), json.dumps(DOCUMENT).encode())
    assert read_cached(spark, str(tmp_path)).count() == 7 == read_catalog(spark, path).count()
    keep_response(str(tmp_path), b"")
    with pytest.raises(CacheMiss):
        read_cached(spark, str(tmp_path))


@pytest.fixture()
def server():
    answers: list[tuple[int, bytes]] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = answers.pop(0) if len(answers) > 1 else answers[0]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield answers, f"http://127.0.0.1:{http.server_port}/"
    http.shutdown()


def test_http(spark, server):
    answers, url = server
    waits: list[float] = []
    body = json.dumps(DOCUMENT).encode()
    answers[:] = [(500, b""), (200, b"not json"), (200, body)]
    assert fetch(url, wait=waits.append) == body and waits == [1.0, 2.0]
    answers[:] = [(200, body)]
    assert fetch_models(spark, url, "zhost").count() == 2
    spark.dataSource.register(CatalogSource)
    assert flatten(spark.read.format("catalog_http").option("url", url).load()).count() == 7
    answers[:] = [(404, b"")]
    with pytest.raises(Unavailable):
        fetch(url, retries=1, wait=waits.append)


# --- functions ------------------------------------------------------------------------------------------


def test_columns_agree_with_python(spark):
    idents = [
        "azure-gpt-4o", "Azure-X", "azure-", "azure/gpt", "a/b-2024-05-13", "m-20250514", "m-20251399", "x:128000", "x:1:k", "", "meta/l-3.1", "deep-4.5", "2024-02-30-20240101",
        "a-20240229-2023-02-29",
    ]
    i = F.col("i")
    df = spark.createDataFrame([(x,) for x in idents], "i string").select("i", C.host(i), C.without_host(i), C.strip_trailing_date(i), C.last_segment(i), C.context_n(i), C.extract_date(i, F.lit("")))
    for ident, host, rest, undated, last, n, date in (tuple(r) for r in df.collect()):
        assert (host, rest) == host_of(ident) and undated == without_date(ident) and last == last_segment(ident)
        assert n == ("128000" if ident == "x:128000" else "")
        assert date == {"a/b-2024-05-13": "2024-05-13", "m-20250514": "2025-05-14", "2024-02-30-20240101": "2024-01-01", "a-20240229-2023-02-29": "2024-02-29"}.get(ident, "")


def test_modifiers(spark):
    cases = [["Vision", "thinking", "vision", ""], ["zeta", "alpha", "turbo"], [], None, ["instruct", "fast", "think"]]
    m = F.col("m")
    df = spark.createDataFrame([(c,) for c in cases], "m array<string>")
    for mods, ordered, key in df.select("m", C.order_modifiers(m), C.modifier_key(m)).collect():
        assert tuple(ordered or ()) == order_modifiers(mods or []) and key == ",".join(order_modifiers(mods or [])) and ordered != []
    for family in ("glm", "GLM", "gpt"):
        for mod in ("turbo", "Thinking", "unheard"):
            assert df.select(C.modifier_class(F.lit(mod), F.lit(family))).first()[0] == modifier_class(mod, family)
    assert modifier_class("turbo", "glm") == "attribute" and modifier_class("turbo", "gpt") == "identity"


def test_references(spark):
    row = spark.range(1).select(
        C.entity_key(F.lit("llama"), F.lit("scout"), F.lit("4"), F.array(F.lit("vision"), F.lit("instruct"))),
        C.canonical_form(F.lit("p"), F.lit("i"), F.lit("glm"), F.lit(""), F.lit("5"), F.lit("2026-01-01"), F.array(F.lit("turbo"), F.lit("vision"))),
        C.canonical_form(F.lit("p"), F.lit("i"), F.lit(""), F.lit(""), F.lit("5"), F.lit(""), F.array(F.lit("x"))),
        C.dotted(F.lit("4-5")), C.dotted(F.lit("4-0314")), C.dotted(F.lit("08-2024")), C.dotted(F.lit("1-6-250615")), C.dotted(F.lit("2603")),
    ).first()
    assert tuple(row) == ("llama/scout@4{vision,instruct}", "p/glm/5@2026-01-01{vision}[turbo]", "p/i", "4.5", "4", "", "1.6", "")


def test_enums():
    assert InputFormat.parse("HF") is InputFormat.HUGGINGFACE and InputFormat.parse("canonical").scheme is Scheme.CANONICAL
    with pytest.raises(ValueError):
        Scheme.parse("PURL")
    with pytest.raises(ValueError):
        parse_modality("hologram")
    assert parse_modifier_class(" Identity ") == "identity"
    assert is_known_family("solar") and not is_known_family("solar", curated=False) and is_known_family("HY", curated=False) and not is_known_family("hy")


# --- normalisation and entities ----------------------------------------------------------------------------


def test_normalize(models):
    by = {(r.provider, r.model_id): r for r in models.collect()}
    r = by[("anthropic", "claude-opus-4-5-20251101")]
    assert (r.family, r.variant, r.version, r.modifier, r.date, r.host) == ("claude", "opus", "4.5", None, "2025-11-01", "")
    r = by[("zhost", "azure-gpt-4o-mini")]
    assert (r.family, r.variant, r.version, r.modifier, r.date, r.host) == ("gpt", "4o", "", ["mini"], "2024-07-18", "azure")
    r = by[("rehost", "qwen3-max")]
    assert (r.family, r.variant, r.version) == ("qwen", "max", "3")


def test_normalize_edges(spark):
    data = [(None, None), ("", ""), (None, "x" * 100_000), ("glm", None), ("qwen", "qwen3"), ("qwen", "qwen3")]
    df = spark.createDataFrame(data, "raw_family string, model_id string").withColumns({"reason": F.lit("old"), "clean_id": F.lit(1)})
    got = normalize.normalize(df).collect()
    assert len(got) == 6 and all(r.clean_id == 1 and r.reason != "old" for r in got)
    assert normalize.normalize(df.limit(0)).count() == 0


def test_entities(models):
    by = {r.entity_key: r for r in entities.entities(models).collect()}
    e = by["claude/opus@4.5"]
    assert (e.min_cost_input, e.max_cost_input, e.min_cost_output, e.min_context_window, e.max_context_window, e.n_instances) == (5.0, 6.5, 25.0, 0, 200000, 2)
    assert e.reasoning and e.tool_call and not e.attachment and list(e.providers) == ["anthropic", "rehost"]
    assert by["gpt/4o{mini}"].min_cost_input is None and list(by["gpt/4o{mini}"].hosts) == ["azure"]
    assert entities.parse_entity_tuple("llama/scout@4{vision, instruct}[x]") == ("llama", "scout", "4", ["vision", "instruct"])
    assert entities.parse_entity_tuple("claude/opus/4.5") == ("claude", "opus", "4.5", [])
    with pytest.raises(NotFound):
        entities.parse_entity_tuple("/x")
    assert entities.lookup_entity(models, "qwen3-max").first().entity_key == "qwen/max@3"
    assert entities.entity_by_tuple(models, "glm", "", "5", ["turbo"]).count() == 1
    assert entities.entities(models.limit(0)).count() == 0 and entities.instances(models).count() == 7
    with pytest.raises(NotFound):
        entities.view(models, "nothing")
    assert [r[0] for r in entities.providers_for_family(models, "claude-opus").collect()] == ["anthropic", "rehost"]


def test_lookup(models):
    assert lookup.get(models, "claude-opus-4-5-20251101")["provider"] == "anthropic"
    with pytest.raises(NotFound):
        lookup.get(models, "nothing")
    assert lookup.by_canonical(models, family="claude", version="4.5").count() == 3
    assert lookup.scan(models, only=["zhost"]).count() == 2 and lookup.scan(models, without=["zhost"]).count() == 5
    with pytest.raises(CatalogError):
        lookup.scan(models, only=["a"], without=["b"])
    with pytest.raises(CatalogError):
        lookup.scan(models, only=["nobody"], required=True)
    assert lookup.by_provider_and_id(models, "rehost", "qwen3-max").count() == 1 and lookup.reference(models).columns[-1] == "host"


# --- merge and store -----------------------------------------------------------------------------------------


def test_merge(spark, rows):
    schema = "model_id string, provider string, v string, last_synced string"
    static = spark.createDataFrame([("a", "p", "s", "2"), ("b", "p", "s", "2"), ("c", "p", "s", "2"), ("d", "p", "s", None), ("a", "q", "s", "9")], schema)
    cached = spark.createDataFrame([("a", "p", "c", "3"), ("b", "p", "c", "2"), ("c", "p", "c", "1"), ("e", "p", "c", ""), ("d", "p", "c", None)], schema)
    got = {(r.model_id, r.provider): r.v for r in merge.merge_models(static, cached).collect()}
    assert got == {("a", "p"): "c", ("b", "p"): "s", ("c", "p"): "s", ("d", "p"): "s", ("e", "p"): "c", ("a", "q"): "s"}
    assert rows(merge.merge_models(static.limit(0), cached.limit(0))) == [] and merge.merge_models(static, cached.limit(0)).count() == 5


def test_store(spark, tmp_path):
    store = merge.CatalogStore(spark, str(tmp_path / "store"))
    assert store.read() is None and merge.default_store_path(spark).endswith("lodeatlas/models")
    schema = "model_id string, provider string, v string"
    store.upsert(spark.createDataFrame([("a", "p", "1"), ("b", "p", "1")], schema), "t1")
    store.upsert(spark.createDataFrame([("a", "p", "0"), ("c", "p", "2")], schema), "t0")
    assert {(r.model_id, r.v, r.last_synced) for r in store.read().collect()} == {("a", "0", "t0"), ("b", "1", "t1"), ("c", "2", "t0")}
    assert len(store.versions()) == 2


def test_streaming(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = merge.CatalogStore(spark, str(tmp_path / "store"))
    run = lambda at: ingest(spark, str(folder), store, str(tmp_path / "checkpoint"), lambda: at, once=True).awaitTermination(120)
    (folder / "1.json").write_text(json.dumps(DOCUMENT))
    run("t1")
    (folder / "2.json").write_text(json.dumps({"zhost": {"models": {"e": {"id": "azure-gpt-4o-mini", "family": "gpt-mini"}}}}))
    run("t2")
    by = {(r.provider, r.model_id): r for r in store.read().collect()}
    assert len(by) == 7 and by[("zhost", "azure-gpt-4o-mini")].last_synced == "t2" and by[("rehost", "qwen3-max")].last_synced == "t1"


def test_store_rewrites_only_what_a_batch_touches(spark, rows, tmp_path):
    store = merge.CatalogStore(spark, str(tmp_path / "s"), buckets=8)
    batch = lambda ids, name: spark.createDataFrame([(f"m{i}", "p", name) for i in ids], "model_id string, provider string, display_name string")
    store.upsert(batch(range(40), "old"), "t1")
    before = store.newest()
    store.upsert(batch([3, 3, 50], "new"), "t2")
    after = store.newest()
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(before) == 8 and 1 <= len(changed) <= 2
    want = sorted((f"m{i}", "new" if i == 3 else "old", "t2" if i == 3 else "t1") for i in range(40)) + [("m50", "new", "t2")]
    assert rows(store.read().select("model_id", "display_name", "last_synced")) == sorted(want)
    store.upsert(batch([], "none"), "t3")
    store.vacuum()
    assert store.newest() == after and store.read().count() == 41 and len(list((tmp_path / "s").glob("*/bucket=*"))) == 8
    more = batch([4], "x").withColumn("extra", F.lit(1))
    store.upsert(more, "t4")
    assert {r.extra for r in store.read().collect()} == {None, 1}


def test_migrate(spark):
    old = spark.createDataFrame([("claude-opus-4-20250514", "anthropic", "claude-opus", ""), ("gemini-pro", "google", "gemini-pro", "2024-06-01"), ("gemini-pro", "google", "gemini-pro", "2024-06-01")], "model_id string, provider string, family string, release_date string")
    by = {r.model_id: r for r in migrate.migrate(old, 0).collect()}
    r = by["claude-opus-4-20250514"]
    assert (r.raw_family, r.family, r.variant, r.date, r.version, r.interleaved_config) == ("claude-opus", "claude", "opus", "2025-05-14", "", "")
    assert by["gemini-pro"].date == "2024-06-01" and len(by) == 2
    with pytest.raises(CatalogError):
        migrate.migrate(old, 5)


# --- lineage ----------------------------------------------------------------------------------------------------


def test_lineage(spark, rows):
    table = lineage.curated(spark)
    ids = spark.createDataFrame([("Gryphe/MythoMax-L2-13B",), ("mythomax-l2-13b",), ("other/x",), (None,)], "model_id string")
    assert {r.model_id: r.parents is not None for r in lineage.attach(ids, table).collect()} == {"Gryphe/MythoMax-L2-13B": True, "mythomax-l2-13b": True, "other/x": False, None: False}
    edges = lineage.edges(table)
    up = lineage.ancestors(spark.createDataFrame([("mythomax",)], "start string"), edges)
    assert rows(up) == [("mythomax", "huginn@2", 1), ("mythomax", "mythologic@2", 1)]
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child_key string, parent_key string")
    assert rows(lineage.ancestors(spark.createDataFrame([("d",)], "start string"), loop)) == [("d", "a", 1), ("d", "b", 2), ("d", "c", 3)]
    assert rows(lineage.descendants(spark.createDataFrame([("a",)], "start string"), loop)) == [("a", "b", 2), ("a", "c", 1), ("a", "d", 1)]
    for bad in [[("", (), True, [("llama", "", "", "merge")])], [("x", (), True, [])], [("x", (), True, [("nobody", "", "", "merge")])], [("x", (), True, [("llama", "", "", "sort of")])]]:
        with pytest.raises(CatalogError):
            lineage.validate(bad)


# --- resolver ------------------------------------------------------------------------------------------------------


def test_detect():
    assert detect("pkg:huggingface/p/x/y") == Asked(Scheme.PURL, "x/y", "p")
    assert detect("openai/gpt/4.6") == Asked(Scheme.CANONICAL, "openai/gpt/4.6") and detect("claude@2025-01-01").scheme is Scheme.CANONICAL
    assert detect("a/b") == Asked(Scheme.HUGGINGFACE, "b") and detect("a/b/c") == Asked(Scheme.RAW, "a/b/c") and detect("gpt-4o").scheme is Scheme.RAW
    assert asked("p/x", InputFormat.HUGGINGFACE, Scheme.RAW) == Asked(Scheme.HUGGINGFACE, "x") and asked("p/x", scheme=Scheme.RAW).text == "p/x"


def test_resolve(models):
    names = lambda *a, **k: [(r.provider, r.model_id) for r in resolve(models, *a, **k).collect()]
    both = [("anthropic", "claude-opus-4-5-20251101"), ("rehost", "claude-opus-4-5-20251101")]
    assert names("claude-opus-4-5-20251101") == both
    assert names("anthropic/claude/opus/4.5") == both[:1] and names("claude-opus") == both[:1] and names("claude/opus@2025-11-01") == both[:1]
    assert names("pkg:huggingface/rehost/claude-opus-4-5-20251101") == both[1:]
    assert names("gpt{mini}", scheme=Scheme.CANONICAL) == [("zhost", "azure-gpt-4o-mini")] and names("glm[turbo]", InputFormat.PEASANT) == [("rehost", "azure/glm-5-turbo")]
    with pytest.raises(NotFound):
        names("nothing-like-it")
    with pytest.raises(NotFound):
        names("gpt{vision}", scheme=Scheme.CANONICAL)
    with pytest.raises(Ambiguous) as e:
        names("claude")
    assert {c["model_id"] for c in e.value.candidates} == {"claude-opus-4-5-20251101", "claude-3-5-haiku", "claude-sonnet-4-5"} and e.value.rehosts == ["rehost", "zhost"]
    text = render.render_ambiguous(e.value)
    assert "* anthropic/claude/opus/4.5@2025-11-01" in text and "Also rehosted by:\n  rehost\n  zhost" in text
    with pytest.raises(Ambiguous) as e:
        names("pkg:huggingface/nobody/claude-opus-4-5-20251101")
    assert e.value.missed_namespace == "nobody" and [c["provider"] for c in e.value.candidates] == ["anthropic"]


def test_resolve_batch(spark, models):
    asked_ = spark.createDataFrame([("qwen3-max",), ("claude",), ("claude-opus",), ("nope",), (None,), ("nope",), ("",)], "input string")
    got = {r.input: (r.status, r.n_rows, r.n_models, r.provider) for r in resolve_batch(models, asked_).collect()}
    assert got == {
        "qwen3-max": ("ok", 1, 1, "rehost"), "claude": ("ambiguous", 4, 3, None), "claude-opus": ("ok", 2, 1, "anthropic"), "nope": ("not_found", 0, 0, None), "": ("not_found", 0, 0, None),
    }


def test_resolve_batch_as_resolve(spark, models):
    inputs = [
        "claude-opus-4-5-20251101", "claude", "claude-opus", "anthropic/claude/opus/4.5", "claude/opus@2025-11-01", "claude/opus/4.5", "pkg:huggingface/rehost/claude-opus-4-5-20251101",
        "pkg:huggingface/nobody/claude-opus-4-5-20251101", "pkg:huggingface/claude-3-5-haiku", "gpt@{mini}", "gpt/4.0@{mini}", "glm@[turbo]", "gpt@{vision}", "rehost/qwen3-max", "a/b/c@", "@", "//@", "azure-gpt-4o-mini", "x@2025-11-01", "gpt-", "-gpt", "claude//4.5",
    ]
    got = {r.input: r for r in resolve_batch(models, spark.createDataFrame([(i,) for i in inputs], "input string")).collect()}
    for i in inputs:
        try:
            rows = resolve(models, i).collect()
            want = ("ok", rows[0].provider, rows[0].model_id)
        except NotFound:
            want = ("not_found", None, None)
        except Ambiguous as e:
            want = ("ambiguous", None, None)
            assert e.missed_namespace or got[i].n_models == len(e.candidates), i
        assert (got[i].status, got[i].provider, got[i].model_id) == want, i


def test_lineage_of_entities(spark, models):
    derived = [("claude-opus-4-5-20251101", [("llama", "", "3", "finetune"), ("llama", "", "3", "finetune"), ("qwen", "", "", None)]), ("qwen3-max", None)]
    records = spark.createDataFrame(derived, "child_id string, parents array<struct<family:string,variant:string,version:string,kind:string>>")
    attached = lineage.attach(models, records)
    got = {r.entity_key: [tuple(x) for x in r.lineage] for r in entities.with_lineage(entities.entities(attached), attached).collect()}
    assert got["claude/opus@4.5"] == [("llama@3", "finetune"), ("qwen", "")] and sum(map(len, got.values())) == 2


def test_show(models):
    newer = models.where("provider = 'rehost'").withColumns({"last_synced": F.lit("2027-01-01T00:00:00Z")})
    assert show(models, newer, "claude-opus-4-5-20251101").first().provider == "rehost"
    assert show(models, newer.limit(0), "claude-opus-4-5-20251101").first().provider == "anthropic"


# --- analysis and naming ----------------------------------------------------------------------------------------------


def test_divergence(spark):
    data = [("i1", "Glm", "", "", "p"), ("i1", "glm", "", "", "q"), ("i2", "qwen3", "", "", "p"), ("i2", "qwen3.5", "", "", "q"), ("i3", "gpt", "", "", "p"), ("i3", "gpt-image", "", "", "q"), ("i4", "aion", "", "", "p"), ("i4", "llama", "", "", "q"), ("i5", "", "", "1", "p"), ("i5", "x", "", "", "q"), ("i6", "x", "", "", "p"), ("i6", "x", "", "", "q")]
    df = spark.createDataFrame(data, "model_id string, family string, variant string, version string, provider string")
    v = analysis.divergence(df)
    got = {r.model_id: r.c for r in v.select("model_id", analysis.divergence_category(F.col("families")).alias("c")).collect()}
    assert got == {"i1": "A", "i2": "B", "i3": "C", "i4": "D", "i5": "C"}
    assert [tuple(r) for r in analysis.mislabel_pairs(v).collect()] == [("aion", "llama", 1)]


def test_quality_counters(spark, tmp_path):
    from lodeatlas.plans import catalog_queries  # noqa: F401
    from lodeatlas.plans.registry import QUERIES

    pairs = [("nova", "nova-2-lite-v1"), ("text-embedding", "text-embedding-3-large"), ("gpt", "gpt-4"), ("", "")]
    rows = [(raw, ident, "p", "", "") for raw, ident in pairs]
    spark.createDataFrame(rows, "raw_family string, model_id string, provider string, release_date string, version string").write.parquet(str(tmp_path / "models.parquet"))
    got = QUERIES["normalized_quality_counters"](spark, str(tmp_path)).first()
    assert (got.n_rows, got.n_reported) == (4, 2) and got.n_versioned >= 1


def test_classify_change():
    P = analysis.Parts
    change = lambda i, b, a, bs=None, as_=None, ok=None: analysis.classify_change(i, b, a, bs or [b], as_ or [a], ok)
    assert change("x-1", P("x"), P("x", version="1")) == "improvement"
    assert change("x-pro-1", P("x", "pro", "1"), P("x", "", "1")) == "regression"
    assert change("glm-4.5v", P("glmv"), P("glm", "v")) == "improvement"
    assert change("a-1", P("llama", "", "1"), P("aion", "", "1")) == "improvement"
    assert change("o1", P("o", "", "1"), P("gpt", "o", "1"), ok=P("gpt", "o", "1")) == "fix"
    assert change("o1", P("o", "", "1"), P("gpt", "", "1"), ok=P("gpt", "o", "1")) == "regression"
    assert change("q-2", P("q", "", ""), P("q", "", "2"), [P("q"), P("q", "", "2")], [P("q", "", "2")]) == "fix"
    assert change("kimi-k2", P("kimi", "2", "2"), P("kimi", "", "2")) == "improvement"
    assert analysis.value_in_id("4.5", "a/b-4-5") and not analysis.value_in_id("", "x") and analysis.value_in_id("deep-research", "x-research-y-deep")


def test_diff_and_dump(spark, models, tmp_path):
    path = str(tmp_path / "tsv")
    analysis.dump_decompositions(models, path)
    back = analysis.load_decompositions(spark, path)
    assert analysis.diff_decompositions(back, models).count() == 0
    blank = back.withColumn("version", F.lit(""))
    assert {r.change for r in analysis.diff_decompositions(blank, models).collect()} == {"improvement"}


def test_naming(spark, models):
    assert naming.constant_name("claude-opus-4-5-20251101", "anthropic", "claude", "4.5", "2025-11-01", []) == "Model__Anthropic__Claude__Opus__4_5__20251101"
    assert naming.constant_name("org/kimi-k2-thinking-turbo", "moonshotai", "kimi", "2", "", ["thinking", "turbo"]) == "Model__MoonshotAI__Kimi__K2__2__ThinkingTurbo"
    assert naming.constant_name("x", "p", "", "", "", []) == ""
    assert naming.strip_date("command-a-03-2025", "2025-03-13") == ("command-a", True) and naming.strip_date("x", "") == ("x", False)
    assert naming.identifier("novita-ai") == "NovitaAI" and naming.identifier("302ai") == "302AI" and naming.provider_name("the-grid", "The GRID") == "ProviderTheGRID"
    got = [r.name for r in naming.constants(models).collect()]
    assert len(got) == len(set(got)) == 7
    same = spark.createDataFrame([(f"m{c}1", "p", "m", "", "", "") for c in ("-", ".", "_")] * 2, "model_id string, provider string, family string, variant string, version string, date string").withColumn("modifier", F.lit(None).cast("array<string>"))
    assert sorted(r.name for r in naming.constants(same).collect()) == ["Model__P__M__1_1", "Model__P__M__1_2", "Model__P__M__1_3"]


# --- rendering -----------------------------------------------------------------------------------------------------------


def test_render(models, tmp_path):
    docs = json.loads(render.render(models, "json"))
    assert docs[1]["ID"] == "claude-opus-4-5-20251101" and docs[1]["Modifier"] is None and docs[1]["CostCacheReadPerMTok"] is None and docs[1]["Interleaved"]["Config"] == {"field": "reasoning_details"}
    assert "Claude \\u003cOpus\\u003e" in render.render(models, "json")
    yaml = render.render(models, "yaml")
    assert yaml.startswith('models:\n  - ID: "claude-3-5-haiku"\n') and "    CostInputPerMTok: 5.0\n" in yaml and "    CostCacheReadPerMTok: null\n" in yaml and "Modifier: []" in yaml
    table = render.render(models, "table").splitlines()
    assert len(table) == 9 and table[2].endswith("—") and "$5.00" in table[3] and len({len(x) for x in table}) == 1
    with pytest.raises(ValueError):
        render.render(models, "xml")
    text = render.render_entity(entities.view(models, "claude/opus@4.5"))
    assert "Price input  /MTok: [5.0000, 6.5000]" in text and "Price output /MTok: 25.0000" in text and "Context window:     [0, 200000]" in text
    failed = normalize.failures(models)
    n = render.write_failures(failed, str(tmp_path / "f.json"), datetime(2026, 1, 1, tzinfo=timezone.utc))
    assert json.loads((tmp_path / "f.json").read_text())["failure_count"] == n == failed.count()
    assert render.write_failures(failed.limit(0), str(tmp_path / "f.json")) == 0 and '"failures": []' in (tmp_path / "f.json").read_text()
    assert f"{1.005:.2f}" == render.money(1.005)[1:]


def test_vocabulary_is_sound():
    validate_vocabulary()
    assert set(V.SERIES_LETTER) <= set(V.MEMBERS)
    assert len(V.FAMILIES) == len(set(V.FAMILIES)) and len(V.PROVIDERS) == len(set(V.PROVIDERS)) and list(V.PROVIDERS) == sorted(V.PROVIDERS)
    assert all(decompose("", i).family for i in ("qwen3", "o1", "glm-5"))


# --- command line -----------------------------------------------------------------------------------------------------------


def test_command_line(spark, tmp_path, server):
    answers, url = server
    path, store = tmp_path / "catalog.json", str(tmp_path / "store")
    path.write_text(json.dumps(DOCUMENT))

    def run(*arguments):
        out, err = io.StringIO(), io.StringIO()
        code = main([*arguments, "--catalog", str(path), "--store", store], spark, out, err)
        return code, out.getvalue(), err.getvalue()

    code, text, _ = run("list", "--provider", "zhost", "--output", "table")
    assert code == 0 and len(text.splitlines()) == 4
    answers[:] = [(200, json.dumps({"zhost": {"models": {"e": {"id": "azure-gpt-4o-mini", "name": "Newer", "family": "gpt-mini"}}}}).encode())]
    assert run("sync", "--url", url)[0] == 0
    names = {d["ID"]: d["DisplayName"] for d in json.loads(run("list")[1])}
    assert len(names) == 6 and names["azure-gpt-4o-mini"] == "Newer"
    assert json.loads(run("show", "azure-gpt-4o-mini")[1])[0]["DisplayName"] == "Newer"
    assert json.loads(run("show", "qwen3-max", "--format", "raw")[1])[0]["Provider"] == "rehost"
    code, text, err = run("show", "claude")
    assert code == 1 and text == "" and "matched multiple canonicals" in err
    assert run("show", "nothing")[0] == 1 and run("show")[0] == 1 and run("list", "--output", "xml")[0] == 1
    assert "Providers (2): anthropic, rehost" in run("show", "--by-entity", "claude/opus@4.5", "--output", "table")[1]
    assert run("providers", "claude/opus/4.5", "--output", "table")[1].splitlines()[1] == "Instances (2):"
    assert len(json.loads(run("providers", "claude-opus-4-5-20251101")[1])) == 2 and run("providers", "x", "--output", "yaml")[0] == 1
