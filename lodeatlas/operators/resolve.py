"""Resolving what a user typed to rows of the catalog, for one input or for a table of them.

A batch is resolved with joins on hashed keys: every input is opened into the few keys under which a
row could match it (identifier, provider with identifier, family, parts of a canonical path, family with
variant), the catalog is opened into those of the same kinds, and the rows of the first stage that matches
are grouped into models.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeatlas.functions import columns as C
from lodeatlas.functions.decompose import family_known, order_modifiers
from lodeatlas.functions.enums import InputFormat, Scheme
from lodeatlas.operators.entities import one_per_group
from lodeatlas.operators.errors import Ambiguous, NotFound
from lodeatlas.plans.session import cut

_PURL = "pkg:huggingface/"


@dataclass(frozen=True)
class Asked:
    """What an input asks for: the scheme, the text to match and the provider it names."""

    scheme: Scheme
    text: str
    hint: str = ""


def normalize_input(text: str, scheme: Scheme) -> str:
    if scheme is Scheme.PURL:
        rest = text.removeprefix(_PURL)
        return rest.partition("/")[2] if "/" in rest else rest
    if scheme is Scheme.HUGGINGFACE:
        return text.partition("/")[2] if "/" in text else text
    return text


def detect(text: str) -> Asked:
    """The scheme of an input by its looks."""
    if text.startswith(_PURL):
        owner, slash, _ = text.removeprefix(_PURL).partition("/")
        return Asked(Scheme.PURL, normalize_input(text, Scheme.PURL), owner if slash else "")
    slashes = text.count("/")
    versioned = "@" in text or any(re.fullmatch(r"\d+\.\d+", s) for s in text.split("/"))
    if (1 <= slashes <= 3 and versioned) or (not slashes and "@" in text):
        return Asked(Scheme.CANONICAL, text)
    if slashes == 1 and not text.startswith("pkg:"):
        return Asked(Scheme.HUGGINGFACE, normalize_input(text, Scheme.HUGGINGFACE))
    return Asked(Scheme.RAW, text)


def asked(text: str, input_format: InputFormat | None = None, scheme: Scheme | None = None) -> Asked:
    """A stated format counts before a stated scheme, and both before the looks of the input."""
    if input_format is not None:
        s = input_format.scheme
        owner, slash, _ = text.removeprefix(_PURL).partition("/")
        named = s is Scheme.PURL and text.startswith(_PURL) and slash
        return Asked(s, normalize_input(text, s), owner if named else "")
    return Asked(scheme, normalize_input(text, scheme)) if scheme is not None else detect(text)


def _bracket(text: str, left: str, right: str) -> tuple[str, str]:
    """(text before, inside) of the bracket that ends a text."""
    at = text.rfind(left)
    return (text[:at], text[at + 1 : -1]) if at >= 0 and text.endswith(right) else (text, "")


def _segments(text: str) -> tuple[list[str], str, str | None]:
    """(path segments, date, modifier key or None) of a canonical reference."""
    text, attribute = _bracket(text, "[", "]")
    text, identity = _bracket(text, "{", "}")
    date = ""
    if "@" in text:
        text, _, date = text.rpartition("@")
    mods = [*identity.split(","), *attribute.split(",")] if identity or attribute else None
    return text.split("/"), date, None if mods is None else ",".join(order_modifiers(mods))


def _path_filter(path: list[str], date: str, mods: str | None) -> Column:
    cond = F.col("family") == path[0]
    for column, part in zip(("variant", "version"), path[1:3]):
        if part:
            cond = cond & (F.col(column) == part)
    if date:
        cond = cond & (F.col("date") == date)
    return cond if mods is None else cond & (C.modifier_key(F.col("modifier")) == mods)


def canonical_filter(text: str) -> Column:
    """Rows that a canonical reference means: the identifier, a family, or the parts of a path.

    A path of four loses its first part, the provider; one of three only for rows whose family is its
    second part and not its first. Parts that are left out match anything; modifiers compare as a set.
    """
    path, date, mods = _segments(text)
    cond = (F.col("model_id") == text) | (F.col("family") == text)
    if not path[0]:
        return cond
    if len(path) == 4:
        return cond | _path_filter(path[1:], date, mods)
    if len(path) == 3:
        shifted = (F.col("family") != path[0]) & (F.col("family") == path[1])
        return cond | F.when(shifted, _path_filter(path[1:], date, mods)).otherwise(_path_filter(path, date, mods))
    return cond | _path_filter(path, date, mods)


def rehosts(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(within..., provider): who offers the rows besides their publisher, each once."""
    return rows.where(F.col("provider") != C.canonical_provider(F.col("family"))).select(*within, "provider").distinct()


def _family_variant(models: DataFrame, text: str) -> DataFrame | None:
    """Rows of family-variant: the first hyphen at which a known family and a variant of it meet."""
    for m in re.finditer("-", text):
        family, variant = text[: m.start()], text[m.end() :]
        if family and variant and family_known(family):
            rows = models.where((F.col("family") == family) & (F.col("variant") == variant))
            if not rows.isEmpty():
                return rows
    return None


def _group_key(scheme_by_id: Column) -> Column:
    parts = F.struct(
        F.col("family").alias("family"), F.col("variant").alias("variant"), F.col("version").alias("version"), C.modifier_key(F.col("modifier")).alias("modifier"),
        F.col("date").alias("date"), C.context_n(F.col("model_id")).alias("context"),
    )
    return F.when(scheme_by_id, F.concat(F.lit("id:"), F.col("model_id"))).otherwise(F.to_json(parts))


def resolve(models: DataFrame, text: str, input_format: InputFormat | None = None, scheme: Scheme | None = None) -> DataFrame:
    """The rows that ``text`` means, in the order of provider and identifier.

    Raises ``NotFound`` if there are none and ``Ambiguous``, with one candidate for each model and the
    other providers that offer them, if they are rows of several models. ``models`` needs a
    ``modifier`` column.
    """
    a = asked(text, input_format, scheme)
    rows = models.where(canonical_filter(a.text) if a.scheme is Scheme.CANONICAL else F.col("model_id") == a.text)
    missed = ""
    if a.hint:
        named = rows.where(F.col("provider") == a.hint)
        if a.scheme is Scheme.PURL and named.isEmpty() and not rows.isEmpty():
            missed = a.hint
        else:
            rows = named
    used = a.scheme
    if used is Scheme.RAW and not re.search("[/@:]", text) and rows.isEmpty():
        rows, used = models.where(canonical_filter(text)), Scheme.CANONICAL
        if rows.isEmpty():
            rows = _family_variant(models, text)
    if rows is None or rows.isEmpty():
        raise NotFound("model", text)
    by_id = used is not Scheme.CANONICAL or rows.where(F.col("model_id") != a.text).isEmpty()
    publisher = C.canonical_provider(F.col("family"))
    grouped = rows.withColumn("_group", _group_key(F.lit(by_id or bool(missed))))
    if not missed and grouped.select("_group").distinct().limit(2).count() == 1:
        own = rows.where((publisher != "") & (F.col("provider") == publisher))
        chosen = own if used is Scheme.CANONICAL and not by_id and not own.isEmpty() else rows
        return chosen.orderBy("provider", "model_id")
    first = grouped.groupBy("_group").agg(F.min(F.struct("provider", "model_id")).alias("_seq"))
    one = one_per_group(grouped, ["_group"]).join(first, "_group").orderBy("_seq").drop("_group", "_seq")
    raise Ambiguous(text, used.value, [r.asDict(recursive=True) for r in one.toLocalIterator()], [r.provider for r in rehosts(rows).orderBy("provider").toLocalIterator()], missed)


_SEP = "\x00"


def _opened_inputs(inputs: DataFrame) -> DataFrame:
    """(input, text, by_id, missed, stage, kind, key): the keys of each input in the stages in which they are tried.

    Kinds: ``id``, ``offer`` (provider and identifier), ``family``, ``member`` (family and variant), and
    ``path`` with the flags of the parts that a canonical path states.
    """
    x = F.col("input")
    rest = F.when(x.startswith(_PURL), F.substr(x, F.lit(len(_PURL) + 1)))
    after = lambda t: F.when(F.instr(t, "/") > 0, F.substr(t, F.instr(t, "/") + 1)).otherwise(t)
    slashes = F.length(x) - F.length(F.replace(x, F.lit("/"), F.lit("")))
    versioned = F.contains(x, F.lit("@")) | F.exists(F.split(x, "/"), lambda t: t.rlike(r"^\d+\.\d+$"))
    scheme = F.when(rest.isNotNull(), "purl").when((slashes.between(1, 3) & versioned) | ((slashes == 0) & F.contains(x, F.lit("@"))), "canonical")
    scheme = scheme.when((slashes == 1) & ~x.startswith("pkg:"), "huggingface").otherwise("raw")
    rows = inputs.where("input is not null").select("input").distinct().withColumns({"scheme": scheme, "text": F.when(rest.isNotNull(), after(rest)).when((slashes == 1) & (scheme == "huggingface"), after(x)).otherwise(x), "hint": F.when(F.instr(rest, "/") > 0, F.substring_index(rest, "/", 1))})

    # A canonical path: [attribute] and {identity} behind, then the date, then up to four parts.
    t = F.col("text")
    last = lambda text, pattern: (F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text), F.regexp_extract(text, pattern, 2))
    no_attribute, attribute = last(t, r"(?s)^(.*)\[([^\[]*)\]$")
    bare, identity = last(no_attribute, r"(?s)^(.*)\{([^{]*)\}$")
    dated, date = last(bare, r"(?s)^(.*)@([^@]*)$")
    mods = F.when((identity != "") | (attribute != ""), C.modifier_key(F.split(F.concat_ws(",", identity, attribute), ",")))
    rows = rows.withColumns({"path": F.split(dated, "/"), "date": date, "mods": mods})
    n = F.size("path")
    at = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(""))

    def path_key(first: int) -> Column:
        parts = [(at(first + 1), at(first + 1) != ""), (at(first + 2), at(first + 2) != ""), (F.col("date"), F.col("date") != ""), (F.col("mods"), F.col("mods").isNotNull())]
        flags = F.concat(F.lit("path"), *[F.when(given, "1").otherwise("0") for _, given in parts])
        return _key(1, flags, F.concat_ws(_SEP, at(first), *[F.when(given, value) for value, given in parts]))

    def _key(stage, kind, key, missed=False) -> Column:
        return F.struct(F.lit(stage).cast("int").alias("stage"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key"), F.lit(missed).alias("missed"))

    canonical = F.array(_key(1, "id", t), _key(1, "family", t))
    whole = F.when(at(0) == "", F.array().cast("array<struct<stage:int,kind:string,key:string,missed:boolean>>")).when(n == 4, F.array(path_key(1))).when((n == 3) & (at(0) != at(1)), F.array(path_key(0), path_key(1))).otherwise(F.array(path_key(0)))
    cuts = F.filter(F.sequence(F.lit(1), F.length(t)), lambda i: (F.substr(t, i, F.lit(1)) == "-") & C.is_known_family(F.substr(t, F.lit(1), i - 1), False) & (i < F.length(t)))
    members = F.transform(cuts, lambda i: F.struct((i + 2).cast("int").alias("stage"), F.lit("member").alias("kind"), F.concat(F.substr(t, F.lit(1), i - 1), F.lit(_SEP), F.substr(t, i + 1)).alias("key"), F.lit(False).alias("missed")))
    plain = F.when(t.rlike("[/@:]") | (t == ""), F.array(_key(1, "id", t))).otherwise(F.concat(F.array(_key(1, "id", t), _key(2, "family", t)), members))
    named = F.array(_key(1, "offer", F.concat("hint", F.lit(_SEP), t)), _key(2, "id", t, True))
    keys = F.when(F.col("scheme") == "canonical", F.concat(canonical, whole)).when(F.col("hint").isNotNull() & (F.col("hint") != ""), named).when(F.col("scheme") == "raw", plain).otherwise(F.array(_key(1, "id", t)))
    return rows.select("input", "text", (F.col("scheme") == "canonical").alias("canonical"), F.inline(keys))


def _opened_models(models: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(kind, key, model_id, tuple, n_rows, first, own): rows counted per key and model, the first offer and the publisher's."""
    mods = C.modifier_key(F.col("modifier"))
    given = [("variant", F.col("variant")), ("version", F.col("version")), ("date", F.col("date")), ("mods", mods)]
    keys = {
        "id": F.col("model_id"), "offer": F.concat("provider", F.lit(_SEP), "model_id"), "family": F.col("family"), "member": F.when(F.col("variant") != "", F.concat("family", F.lit(_SEP), "variant")),
        **{k: F.concat_ws(_SEP, "family", *[c for (_, c), flag in zip(given, k[4:]) if flag == "1"]) for k in kinds if k.startswith("path")},
    }
    publisher = C.canonical_provider(F.col("family"))
    offer = F.struct("provider", "model_id")
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), keys[k].alias("key")) for k in sorted(kinds)])
    opened = models.select("model_id", _group_key(F.lit(False)).alias("tuple"), offer.alias("first"), F.when((publisher != "") & (F.col("provider") == publisher), offer).alias("own"), F.inline(wanted))
    return opened.where("key is not null and key <> ''").groupBy("kind", "key", "model_id", "tuple").agg(F.count("*").alias("n_rows"), F.min("first").alias("first"), F.min("own").alias("own"))


def resolve_batch(models: DataFrame, inputs: DataFrame) -> DataFrame:
    """(input, status, n_rows, n_models, provider, model_id) for a table of inputs (input), read as ``resolve`` reads them by their looks.

    ``status`` is ``ok`` (one model; of canonical references the row of the publisher, else the first),
    ``ambiguous`` or ``not_found``. A purl whose owner offers no such model is ambiguous, as the model
    is offered by others. Null inputs are left out, repeated ones answered once. Matching rows are
    counted per key and model before they meet the inputs, so an input that means a third of the
    catalog is aggregated on the way. ``models`` needs a ``modifier`` column.
    """
    keys = cut(_opened_inputs(inputs))
    kinds = [r.kind for r in keys.select("kind").distinct().collect()]  # at most 4 and the 16 sets of parts of a path
    if not kinds:
        return inputs.select("input", F.lit("").alias("status"), *[F.lit(0).cast("bigint").alias(c) for c in ("n_rows", "n_models")], *[F.lit("").alias(c) for c in ("provider", "model_id")]).limit(0)
    hits = keys.join(_opened_models(models, kinds), ["kind", "key"])
    first = hits.groupBy("input").agg(F.min("stage").alias("stage"))
    matched = hits.join(first, ["input", "stage"])
    # A model that matches under several keys of a stage is one.
    once = matched.groupBy("input", "stage", "text", "canonical", "missed", F.col("model_id").alias("m"), "tuple").agg(F.max("n_rows").alias("n_rows"), F.min("first").alias("first"), F.min("own").alias("own"))
    known = once.groupBy("input").agg(
        F.sum("n_rows").alias("n_rows"), F.count_distinct("m").alias("n_ids"), F.count_distinct("tuple").alias("n_tuples"), F.min("first").alias("first"), F.min("own").alias("own"),
        F.bool_and(F.col("m") == F.col("text")).alias("same_id"), F.bool_or("missed").alias("missed"), F.bool_or(F.col("canonical") | ((F.col("stage") > 1) & ~F.col("missed"))).alias("canonical"),
    )
    by_path = F.col("canonical") & ~F.col("same_id")
    n_models = F.when(by_path, F.col("n_tuples")).otherwise(F.col("n_ids"))
    one = (n_models == 1) & ~F.col("missed")
    shown = F.when(by_path, F.coalesce("own", "first")).otherwise(F.col("first"))
    joined = keys.select("input").distinct().join(known, "input", "left")
    return joined.select(
        "input",
        F.when(F.col("n_rows").isNull(), "not_found").when(one, "ok").otherwise("ambiguous").alias("status"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(n_models, F.lit(0)).cast("bigint").alias("n_models"),
        F.when(one, shown["provider"]).alias("provider"),
        F.when(one, shown["model_id"]).alias("model_id"),
    )


def show(static: DataFrame, cached: DataFrame, text: str, **options) -> DataFrame:
    """The most recent row of what ``text`` means, looked up in both catalogs; equal stamps go to the first."""
    from lodeatlas.operators.merge import merge_models

    refs = resolve(static, text, **options).select("model_id", "provider")
    merged = merge_models(static, cached).join(refs, ["model_id", "provider"], "left_semi")
    return merged.orderBy(F.desc(F.coalesce("last_synced", F.lit(""))), "provider", "model_id").limit(1)
