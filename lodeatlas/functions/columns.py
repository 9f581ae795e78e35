"""Native column expressions of the catalog's scalar functions; they stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeatlas.functions import vocabulary as V


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(table: Mapping[str, str], key: Column, default: str | None = None) -> Column:
    """``table[key]`` as an expression; ``default`` where there is no entry."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, key), F.lit(default))


# --- modifiers and entity keys -------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def modifier_rank(tok: Column) -> Column:
    at = F.array_position(_strings(V.MODIFIER_ORDER), F.lower(tok))
    return F.when(at > 0, at - 1).otherwise(len(V.MODIFIER_ORDER)).cast("int")


def _sorted_once(mods: Column) -> Column:
    """Distinct modifiers in canonical order; of two spellings the first stays. May be empty."""
    spelled = F.transform(mods, lambda x: F.named_struct(F.lit("low"), F.lower(x), F.lit("tok"), x))

    def distinct(xs: Column) -> Column:
        low = F.transform(xs, lambda s: s["low"])
        first = _let(low, lambda keys: F.filter(xs, lambda s, i: (s["tok"] != "") & (F.array_position(keys, s["low"]) == i + 1)))
        ranked = F.transform(first, lambda s: F.named_struct(F.lit("rank"), modifier_rank(s["low"]), F.lit("low"), s["low"], F.lit("tok"), s["tok"]))
        return F.transform(F.array_sort(ranked), lambda s: s["tok"])

    return _let(spelled, distinct)


def _filled(xs: Column) -> Column:
    return _let(xs, lambda x: F.when(F.size(x) > 0, x))


def order_modifiers(mods: Column) -> Column:
    """Blanks and repeats in another case dropped, canonical order; null when nothing is left."""
    return _filled(_sorted_once(mods))


def modifier_key(mods: Column) -> Column:
    return F.coalesce(F.array_join(_sorted_once(mods), ","), F.lit(""))


def modifier_class(tok: Column, family: Column) -> Column:
    """identity or attribute: the family's own class, else the general one, else identity."""
    own = {f"{f}|{m}": c for (f, m), c in V.FAMILY_MODIFIER_CLASS.items()}
    return F.coalesce(lookup(own, F.concat(F.lower(family), F.lit("|"), F.lower(tok))), lookup(V.MODIFIER_CLASS, F.lower(tok), "identity"))


def _of_class(mods: Column, family: Column, kind: str) -> Column:
    return F.filter(_sorted_once(mods), lambda m: modifier_class(m, family) == kind)


def modifiers_of_class(mods: Column, family: Column, kind: str) -> Column:
    return _filled(_of_class(mods, family, kind))


def entity_modifiers(mods: Column, family: Column) -> Column:
    return modifiers_of_class(mods, family, "identity")


def _part(mark: str, text: Column, end: str = "") -> Column:
    return _let(text, lambda t: F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit(mark), t, F.lit(end))).otherwise(""))


def entity_key(family: Column, variant: Column, version: Column, identity_mods: Column) -> Column:
    """family[/variant][@version][{m1,m2}]"""
    return F.concat(F.coalesce(family, F.lit("")), _part("/", variant), _part("@", version), _part("{", modifier_key(identity_mods), "}"))


# --- references ----------------------------------------------------------------------------------


def canonical_form(provider: Column, ident: Column, family: Column, variant: Column, version: Column, date: Column, mods: Column) -> Column:
    """provider/family[/variant][/version][@date][{identity}][[attribute]]; provider/id without a family."""
    identity, attribute = (F.coalesce(F.array_join(_of_class(mods, family, k), ","), F.lit("")) for k in ("identity", "attribute"))
    full = F.concat(provider, F.lit("/"), family, _part("/", variant), _part("/", version), _part("@", date), _part("{", identity, "}"), _part("[", attribute, "]"))
    return F.when(F.coalesce(family, F.lit("")) == "", F.concat(provider, F.lit("/"), ident)).otherwise(full)


def designations(provider: Column, ident: Column, canonical: Column) -> Column:
    """Array of (value, scheme, provider, rating) in the order raw, canonical, huggingface, purl."""
    forms = [("raw", ident), ("canonical", canonical), ("huggingface", F.concat(provider, F.lit("/"), ident)), ("purl", F.concat(F.lit("pkg:huggingface/"), provider, F.lit("/"), ident))]
    return F.array(*[F.struct(v.alias("value"), F.lit(s).alias("scheme"), provider.alias("provider"), F.lit("admitted").alias("rating")) for s, v in forms])


def context_n(ident: Column) -> Column:
    """The digits after the last colon, if there is nothing else after it."""
    return F.regexp_extract(ident, r":([0-9]+)$", 1)


def host(ident: Column) -> Column:
    """The host whose prefix an identifier without namespace carries, else empty."""
    out = F.lit("")
    for prefix, name in sorted(V.HOST_PREFIXES.items(), key=lambda kv: len(kv[0])):
        hit = ~ident.contains("/") & F.lower(ident).startswith(prefix + "-") & (F.length(ident) > len(prefix) + 1)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def without_host(ident: Column) -> Column:
    out = ident
    for prefix in sorted(V.HOST_PREFIXES, key=len):
        hit = ~ident.contains("/") & F.lower(ident).startswith(prefix + "-") & (F.length(ident) > len(prefix) + 1)
        out = F.when(hit, F.substr(ident, F.lit(len(prefix) + 2))).otherwise(out)
    return out


def last_segment(text: Column) -> Column:
    return F.substring_index(text, "/", -1)


def canonical_provider(family: Column) -> Column:
    return lookup(V.CANONICAL_PROVIDERS, family, "")


def is_known_provider(provider: Column) -> Column:
    return provider.isin(V.PROVIDERS)


def is_known_host(name: Column) -> Column:
    return name.isin(V.HOSTS)


def is_known_harness(name: Column) -> Column:
    return name.isin(V.HARNESSES)


def is_known_family(family: Column, curated: bool = True) -> Column:
    """With ``curated`` exact letter case counts and the curated families are known; without, neither."""
    return family.isin([*V.FAMILIES, *V.CURATED_FAMILIES]) if curated else F.lower(family).isin(sorted({f.lower() for f in V.FAMILIES}))


def is_enforced_family(family: Column) -> Column:
    return F.lower(family).isin(V.ENFORCED_FAMILIES)


# --- dates and versions ----------------------------------------------------------------------------


def _date_in(text: Column) -> Column:
    """The first date written yyyy-mm-dd, else the first written yyyymmdd; null if it is no day."""
    dashed = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    compact = F.regexp_replace(F.regexp_extract(text, r"(?:^|[^0-9])(\d{8})(?:$|[^0-9])", 1), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    day = lambda t: F.when(t != "", F.date_format(t.try_cast("date"), "yyyy-MM-dd"))
    return F.coalesce(day(dashed), day(compact))


def extract_date(ident: Column, release_date: Column) -> Column:
    """The date in an identifier, else the one in the release date, else empty."""
    return F.coalesce(_date_in(ident), _date_in(release_date), F.lit(""))


def strip_trailing_date(text: Column) -> Column:
    dashed = F.rtrim(F.regexp_replace(text, r"-?\d{4}-\d{2}-\d{2}$", ""), F.lit("-"))
    compact = F.rtrim(F.regexp_replace(text, r"-?\d{8}$", ""), F.lit("-"))
    return F.when(text.rlike(r"\d{4}-\d{2}-\d{2}$"), dashed).when(text.rlike(r"\d{8}$"), compact).otherwise(text)


def is_date_token(tok: Column) -> Column:
    return tok.rlike(r"^(\d{4}|\d{6})$")


def is_size_token(tok: Column) -> Column:
    return tok.rlike(r"(?i)^(\d+(\.\d+)?[bm]|\d+x\d+b|\d+b-a\d+b)$")


def is_version_token(tok: Column) -> Column:
    return tok.rlike(r"^\d+$") & (F.length(tok) != 4)


def is_version_shaped(tok: Column) -> Column:
    return tok.rlike(r"^[a-z0-9.-]+$") & tok.rlike(r"\d")


def is_transparent_token(tok: Column) -> Column:
    return (tok == "") | is_date_token(tok) | is_size_token(tok) | tok.rlike(r"^\d+k$|^v\d+(\.\d+)?$|^\d{4,}$") | tok.isin(V.SERVING_WORDS)


def dot_version(text: Column) -> Column:
    """The version N.M that a text ends with after a hyphen, else empty."""
    return F.regexp_extract(text, r"^.+-(\d+\.\d+)$", 1)


def dotted(numbers: Column) -> Column:
    """4-5 is 4.5; groups from the first date-like one on, and a month with a year, are no version."""
    parts = F.split(numbers, "-")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("stop"))
    step = lambda acc, p: F.struct(
        F.when(acc["stop"] | is_date_token(p), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(p))).alias("kept"), (acc["stop"] | is_date_token(p)).alias("stop")
    )
    joined = F.aggregate(parts, start, step, lambda acc: F.array_join(acc["kept"], "."))
    return F.when(numbers.rlike(r"^(0[1-9]|1[0-2])-(19|20)..$"), "").otherwise(joined)


# --- stored forms ----------------------------------------------------------------------------------


def modalities(text: Column) -> Column:
    """Known modalities of a comma-separated text, in its order; unknown names are skipped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda m: m.isin(V.MODALITIES))


def modalities_text(names: Column) -> Column:
    return F.coalesce(F.array_join(names, ","), F.lit(""))


def flexible_bool(json_text: Column) -> Column:
    """A JSON value as boolean: everything but ``true`` is false."""
    return F.coalesce(json_text == "true", F.lit(False))


def capability(json_text: Column) -> Column:
    """(supported, config) of a JSON boolean or an object of strings; anything else is unsupported."""
    text = F.trim(json_text)
    is_object = text.startswith("{") & F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
    config = F.from_json(text, "map<string,string>")
    kinds = F.map_values(F.from_json(text, "map<string,variant>"))
    all_strings = F.coalesce(F.forall(kinds, lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False))
    fits = F.coalesce(is_object & all_strings, F.lit(False))
    return F.struct(F.coalesce((text == "true") | fits, F.lit(False)).alias("supported"), F.when(fits, config).alias("config"))


def capability_config_text(config: Column) -> Column:
    return F.coalesce(F.to_json(config), F.lit(""))


def capability_config(text: Column) -> Column:
    """The map of a stored configuration; null where the text is blank or malformed."""
    return F.from_json(F.when(F.trim(text) != "", text), "map<string,string>", {"mode": "PERMISSIVE"})
