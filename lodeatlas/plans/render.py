"""Writing rows as JSON, YAML and tables. Renderers read row by row and hold one row at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.operators.errors import Ambiguous

# Names and order of a model's fields when it is written.
FIELDS = [
    ("ID", "model_id"), ("Provider", "provider"), ("DisplayName", "display_name"), ("RawFamily", "raw_family"), ("Family", "family"), ("Variant", "variant"),
    ("Version", "version"), ("Host", "host"), ("Date", "date"), ("Modifier", "modifier"), ("ContextWindow", "context_window"), ("MaxOutput", "max_output"),
    ("Reasoning", "reasoning"), ("ToolCall", "tool_call"), ("Attachment", "attachment"), ("Temperature", "temperature"),
    ("StructuredOutput", "structured_output"), ("Interleaved", "interleaved"), ("OpenWeights", "open_weights"), ("CostInputPerMTok", "cost_input"),
    ("CostOutputPerMTok", "cost_output"), ("CostReasoningPerMTok", "cost_reasoning"), ("CostCacheReadPerMTok", "cost_cache_read"),
    ("CostCacheWritePerMTok", "cost_cache_write"), ("ReleaseDate", "release_date"), ("Knowledge", "knowledge"), ("LastSynced", "last_synced"),
]
_NOT_IN_YAML = {"Version", "Host"}
MOST_SHOWN = 5


def _rows(df: DataFrame) -> Iterator[dict]:
    for r in df.orderBy("provider", "model_id").toLocalIterator():
        yield r.asDict(recursive=True)


def _names(value) -> list[str]:
    return [x for x in value.split(",") if x] if isinstance(value, str) else list(value or [])


def _capability(row: Mapping) -> dict:
    config = row.get("interleaved_config")
    config = json.loads(config) if isinstance(config, str) and config.strip() else config
    return {"Supported": bool(row.get("interleaved")), "Config": config or None}


def document(row: Mapping) -> dict:
    """A row under the names of the written form."""
    out = {}
    for name, column in FIELDS:
        value = row.get(column)
        if name == "Interleaved":
            value = _capability(row)
        elif name == "Modifier":
            value = list(value) if value else None
        elif value is None and not name.startswith("Cost"):
            value = ""
        out[name] = value
    out["Modalities"] = {"Input": _names(row.get("modalities_input")) or None, "Output": _names(row.get("modalities_output")) or None}
    return out


def _json(value) -> str:
    text = json.dumps(value, indent=2, ensure_ascii=False)
    for c, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (chr(0x2028), "\\u2028"), (chr(0x2029), "\\u2029")):
        text = text.replace(c, escaped)
    return text


def to_json(rows: Iterable[Mapping]) -> str:
    return _json([document(r) for r in rows])


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _float(value: float | None) -> str:
    if value is None:
        return "null"
    text = f"{value:g}" if float(f"{value:g}") == value else repr(value)
    return text if "." in text or "e" in text else text + ".0"


def _yaml_lines(row: Mapping) -> Iterator[str]:
    doc = document(row)
    for name, _ in FIELDS:
        value = doc[name]
        if name in _NOT_IN_YAML:
            continue
        if name == "Interleaved":
            if value["Config"] is None:
                yield f"{name}: {str(value['Supported']).lower()}"
            else:
                yield from (f"{name}:", f"  supported: {str(value['Supported']).lower()}", "  config:")
                yield from (f"    {k}: {_quoted(v)}" for k, v in sorted(value["Config"].items()))
        elif name == "Modifier":
            yield f"{name}: [{', '.join(map(_quoted, value or []))}]"
        elif name.startswith("Cost"):
            yield f"{name}: {_float(value)}"
        elif isinstance(value, bool):
            yield f"{name}: {str(value).lower()}"
        else:
            yield f"{name}: {_quoted(value) if isinstance(value, str) else value}"
    yield "Modalities:"
    for side in ("Input", "Output"):
        yield f"  {side}:"
        yield from (f"    - {m}" for m in doc["Modalities"][side] or [])


def to_yaml(rows: Iterable[Mapping]) -> str:
    out = ["models:"]
    for row in rows:
        lines = list(_yaml_lines(row))
        out += ["  - " + lines[0], *("    " + x for x in lines[1:])]
    return "\n".join(out) + "\n"


_WIDTHS = (-40, -12, -16, 9, 9, 6, 5, 12)


def _line(cells: Iterable) -> str:
    return "  ".join(f"{str(c):<{-w}}" if w < 0 else f"{str(c):>{w}}" for c, w in zip(cells, _WIDTHS))


def money(value: float | None) -> str:
    return "—" if value is None else f"${value:.2f}"


def to_table(rows: Iterable[Mapping]) -> str:
    yes = lambda b: "yes" if b else "no"
    out = [_line(("ID", "Provider", "Family", "Context", "MaxOutput", "Reason", "Tools", "CostIn/MTok")), _line("-" * abs(w) for w in _WIDTHS)]
    for r in rows:
        out.append(_line((r["model_id"], r["provider"], r.get("family") or "", r.get("context_window") or 0, r.get("max_output") or 0, yes(r.get("reasoning")), yes(r.get("tool_call")), money(r.get("cost_input")))))
    return "\n".join(out) + "\n"


def render(df: DataFrame, output: str) -> str:
    """The rows of a catalog in the order of provider and identifier, as json, yaml or table."""
    writers = {"json": to_json, "yaml": to_yaml, "table": to_table}
    if output not in writers:
        raise ValueError(f"unknown output format {output!r}; supported: json, yaml, table")
    return writers[output](_rows(df))


def _capped(lines: list[str]) -> list[str]:
    return lines[:MOST_SHOWN] + ([f"+{len(lines) - MOST_SHOWN} more"] if len(lines) > MOST_SHOWN else [])


def render_ambiguous(e: Ambiguous) -> str:
    """The candidates of publishers, one per family, variant and version, and who else offers them."""
    from lodeatlas.functions.decompose import modifier_class, order_modifiers
    from lodeatlas.functions.vocabulary import CANONICAL_PROVIDERS

    def canonical(c: Mapping) -> str:
        text = "/".join(x for x in (c["provider"], c["family"], c.get("variant"), c.get("version")) if x)
        text += f"@{c['date']}" if c.get("date") else ""
        for kind, (left, right) in (("identity", "{}"), ("attribute", "[]")):
            mods = [m for m in order_modifiers(c.get("modifier") or []) if modifier_class(m, c["family"]) == kind]
            text += f"{left}{','.join(mods)}{right}" if mods else ""
        return text

    own: dict[tuple, str] = {}
    for c in e.candidates:
        if c["provider"] and CANONICAL_PROVIDERS.get(c["family"]) == c["provider"]:
            own.setdefault((c["family"], c.get("variant"), c.get("version")), f"* {canonical(c)}")
    out = [f"input {e.input!r} matched multiple canonicals"]
    if e.missed_namespace:
        out += ["", f'no matches in namespace "{e.missed_namespace}" — performing loose match across all providers']
    if own:
        out += ["", "* = canonical provider", "", "Canonical:", *_capped(list(own.values()))]
    if e.rehosts:
        out += ["", "Also rehosted by:", *_capped([f"  {p}" for p in e.rehosts])]
    return "\n".join(out) + "\n"


def price(value: float | None) -> str:
    return "-" if value is None else f"{value:.4f}"


def _range(low, high, show=str) -> str:
    if low is None and high is None:
        return "-"
    return show(low) if low == high else f"[{show(low)}, {show(high)}]"


def render_entity(e: Mapping) -> str:
    """An entity row of ``entities`` as text."""
    dash = lambda s: s or "-"
    flags = ("reasoning", "tool_call", "attachment", "temperature", "structured_output", "interleaved", "open_weights")
    out = [
        f"Entity: {e['entity_key']}",
        f"  Family:        {e['family']}",
        f"  Variant:       {dash(e['variant'])}",
        f"  Version:       {dash(e['version'])}",
        f"  Identity-mods: {dash(','.join(e['identity_modifiers'] or []))}",
        f"Providers ({len(e['providers'])}): {dash(', '.join(e['providers']))}",
        f"Hosts ({len(e['hosts'])}): {dash(', '.join(dash(h) for h in e['hosts']))}",
        f"Price input  /MTok: {_range(e['min_cost_input'], e['max_cost_input'], price)}",
        f"Price output /MTok: {_range(e['min_cost_output'], e['max_cost_output'], price)}",
        f"Context window:     {_range(e['min_context_window'], e['max_context_window'])}",
        f"Max output:         {_range(e['min_max_output'], e['max_max_output'])}",
        f"Capabilities: {dash(', '.join(f.replace('_', '-') for f in flags if e[f]))}",
        f"Lineage ({len(e.get('lineage') or [])}):",
        *(f"  -> {x['kind']} {x['parent']}" for x in e.get("lineage") or []),
        f"Instances ({len(e['instances'])}):",
        f"  {'ID':<40} {'PROVIDER':<22} {'HOST':<12} {'IN/MTok':>12} {'OUT/MTok':>12} {'CONTEXT':>10} {'MAXOUT':>10}",
    ]
    for i in e["instances"]:
        out.append(f"  {i['model_id']:<40} {i['provider']:<22} {dash(i['host']):<12} {price(i['cost_input']):>12} {price(i['cost_output']):>12} {i['context_window']:>10} {i['max_output']:>10}")
    return "\n".join(out) + "\n"


def write_failures(failed: DataFrame, path: str, generated_at: datetime | None = None) -> int:
    """The reported decompositions as a JSON envelope, in the order of provider/id; overwrites, returns their number."""
    rows = [r.asDict() for r in failed.orderBy(F.concat_ws("/", "provider", "raw_id")).toLocalIterator()]
    listed = [
        {"raw_id": r["raw_id"], "provider": r["provider"], "raw_family": r["raw_family"], "attempted_parse": {k: r[f"attempted_{k}"] or "" for k in ("family", "variant", "version", "date")}, "reason": r["reason"]}
        for r in rows
    ]
    at = (generated_at or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    Path(path).write_text(_json({"schema_version": 1, "generated_at": at, "failure_count": len(listed), "failures": listed}))
    return len(listed)


def write_rows(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as a JSON array in the given order, such as version duplicates and dotted versions."""
    Path(path).write_text(_json([r.asDict(recursive=True) for r in df.orderBy(*order).toLocalIterator()]))


__all__ = ["render", "render_ambiguous", "render_entity", "to_json", "to_table", "to_yaml", "write_failures", "write_rows"]
