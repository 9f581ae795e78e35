"""Quality and change analysis of a catalog."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeatlas.functions.decompose import family_known, order_modifiers
from lodeatlas.functions.enums import is_enforced_family
from lodeatlas.plans.session import ship_package

TUPLE = ("family", "variant", "version")


# --- counts --------------------------------------------------------------------------------------


def raw_families(models: DataFrame) -> DataFrame:
    return models.where("raw_family <> ''").select("raw_family").distinct()


def count_providers(models: DataFrame) -> DataFrame:
    return models.agg(F.countDistinct("provider").alias("n_providers"))


def version_duplicates(models: DataFrame) -> DataFrame:
    """(provider, family, variant, version, n_ids, model_id): the rows of versions that a provider lists more than once.

    Groups are counted before they are shuffled and no list is made of their rows, so one version may
    hold any share of the table.
    """
    group = ["provider", *TUPLE]
    rows = models.where("version <> ''").select(*group, "model_id")
    counted = rows.groupBy(*group).agg(F.count("*").alias("n_ids")).where("n_ids > 1")
    return rows.join(counted, group)


def dotted_versions(models: DataFrame) -> DataFrame:
    return models.where(F.contains(F.col("version"), F.lit("."))).select("provider", "model_id", "version")


def reason_counts(failed: DataFrame) -> DataFrame:
    return failed.groupBy("reason").agg(F.count("*").alias("n"))


def quality_counters(normalized: DataFrame, reason: str) -> DataFrame:
    """Rows, rows with a version, rows reported for ``reason``."""
    return normalized.agg(F.count("*").alias("n_rows"), F.count_if(F.col("version") != "").alias("n_versioned"), F.count_if(F.coalesce(F.col("reason") == reason, F.lit(False))).alias("n_reported"))


def unreached(entries: DataFrame, models: DataFrame, on: Sequence[str] = ("family", "variant")) -> DataFrame:
    """Entries of a curated list that no row has."""
    return entries.join(models.select(*on).distinct(), list(on), "left_anti")


# --- disagreement between providers ----------------------------------------------------------------


def divergence(models: DataFrame, parts: Sequence[str] = TUPLE) -> DataFrame:
    """(model_id, n_rows, n_tuples, families): identifiers of several rows that are decomposed differently.

    The distinct tuples of an identifier are formed before they are listed.
    """
    each = models.groupBy("model_id", *parts).agg(F.count("*").alias("n"))
    per_id = each.groupBy("model_id").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_tuples"), F.array_sort(F.collect_set(F.when(F.col("family") != "", F.col("family")))).alias("families"))
    return per_id.where("n_rows > 1 and n_tuples > 1")


def divergence_category(families: Column) -> Column:
    """A: same but for letter case; B: same but for a version at the end; C: one extends another; D: else."""
    low = F.transform(families, F.lower)
    stripped = F.transform(low, lambda f: F.regexp_replace(f, r"[0-9.\-]+$", ""))
    one = lambda xs: F.size(F.array_distinct(xs)) <= 1
    extends = F.exists(low, lambda a: F.exists(low, lambda b: F.startswith(a, F.concat(b, F.lit("-")))))
    return (
        F.when(F.size(families) <= 1, "C")
        .when(one(low), "A")
        .when(one(stripped) & (F.element_at(stripped, 1) != ""), "B")
        .when(extends, "C")
        .otherwise("D")
    )


def mislabel_pairs(diverging: DataFrame) -> DataFrame:
    """(family_a, family_b, n_ids): pairs of different families of one identifier (category D). A catalog knows few families per identifier."""
    d = diverging.where(divergence_category(F.col("families")) == "D")
    pairs = d.select("model_id", F.explode("families").alias("family_a"), "families").select("model_id", "family_a", F.explode("families").alias("family_b"))
    return pairs.where("family_a < family_b").groupBy("family_a", "family_b").agg(F.count("*").alias("n_ids"))


# --- changes between two states ----------------------------------------------------------------------


def drift(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(key..., change): added, removed and changed rows; null equals null only."""
    o, n = old.select(*key, F.struct(*values).alias("_o")), new.select(*key, F.struct(*values).alias("_n"))
    both = o.join(n, list(key), "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def set_difference(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., side): keys of one side only; empty if the sets are equal."""
    only = lambda a, b, side: a.select(*key).distinct().join(b.select(*key).distinct(), list(key), "left_anti").withColumn("side", F.lit(side))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def gate(changed: DataFrame, allowed: DataFrame, parts: Sequence[str] = TUPLE) -> DataFrame:
    """Changed rows (model_id, parts) that the list of allowed results doesn't have as they are."""
    listed = allowed.select("model_id", F.struct(*parts).alias("_allowed"))
    return changed.join(listed, "model_id").where(F.struct(*[F.col(p) for p in parts]) != F.col("_allowed")).drop("_allowed")


# --- classification of a changed decomposition ---------------------------------------------------------


@dataclass(frozen=True)
class Parts:
    family: str = ""
    variant: str = ""
    version: str = ""
    modifiers: tuple[str, ...] = ()

    @property
    def key(self) -> tuple:
        return self.family, self.variant, self.version, order_modifiers(self.modifiers)

    def has_modifier(self, word: str) -> bool:
        return word.lower() in {m.lower() for m in self.modifiers}


def _name(ident: str) -> str:
    return ident.lower().rpartition("/")[2]


def value_in_id(value: str, ident: str) -> bool:
    """Whether an identifier says a value, with points and hyphens alike, or all of its words somewhere."""
    low, name = value.lower(), _name(ident).replace("@", "-")
    if not low:
        return False
    if low in name or low.replace(".", "-") in name.replace(".", "-"):
        return True
    words = [w for w in re.split("[-.]", low) if w]
    return len(words) > 1 and all(re.search("[a-z]", w) for w in words) and set(words) <= set(re.findall("[a-z0-9]+", name))


def resurfaces(value: str, after: Parts) -> bool:
    """Whether a lost value is found in another field."""
    if value in (after.variant, after.version, after.family) or after.has_modifier(value):
        return True
    return bool(after.version) and value.lower().lstrip("abcdefghijklmnopqrstuvwxyz") == after.version


def _kept(before: str, now: str, after: Parts, version: bool, ident: str) -> bool:
    if not before or now.startswith(before):
        return True
    if not version and now and before.startswith(now + "-"):
        return all(after.has_modifier(t) for t in before[len(now) + 1 :].split("-"))
    return version and not now and re.fullmatch(r"\d{1,2}", before) is not None and re.search(rf"(?:^|\D){before}-(?:19|20)\d\d(?:\D|$)", _name(ident)) is not None


def loses_field(before: Parts, after: Parts, ident: str) -> bool:
    """Whether a variant, version or modifier that the identifier says is gone and found nowhere else."""
    lost = [b for b, a, v in ((before.variant, after.variant, False), (before.version, after.version, True)) if not _kept(b, a, after, v, ident)]
    lost += [m for m in before.modifiers if not after.has_modifier(m)]
    return any(value_in_id(x, ident) and not resurfaces(x, after) for x in lost)


def only_enriched(before: Parts, after: Parts) -> bool:
    """Only empty fields were filled and modifiers added."""
    fields = [(before.family, after.family), (before.variant, after.variant), (before.version, after.version)]
    grown = all(after.has_modifier(m) for m in before.modifiers)
    return before.key != after.key and all(not b or b == a for b, a in fields) and grown


def is_reduction(short: str, long: str) -> bool:
    s, l = short.lower(), long.lower()
    return bool(s) and s != l and l.startswith(s) and bool(re.match("[-0-9]", l[len(s) :]))


def classify_change(ident: str, before: Parts, after: Parts, all_before: Sequence[Parts], all_after: Sequence[Parts], allowed: Parts | None = None) -> str:
    """fix, improvement or regression of a decomposition that changed from ``before`` to ``after``.

    ``all_before`` and ``all_after`` are the decompositions of the identifier by all its providers; an
    ``allowed`` result must be met exactly.
    """
    if allowed is not None:
        return "fix" if after.key == allowed.key else "regression"
    safe = not loses_field(before, after, ident)
    reduction = is_reduction(after.family, before.family)
    cleared = before.family != after.family and (not after.family or (len(after.family) < len(before.family) and before.family.lower().startswith(after.family.lower())))
    agreed = len({t.key for t in all_after}) == 1
    seen = any(t.key == after.key != before.key for t in all_before)
    if len({t.key for t in all_before}) > 1 and (agreed or seen) and safe and (reduction or not cleared):
        return "fix"
    if only_enriched(before, after):
        return "improvement"
    same = lambda *fields: all(getattr(before, f) == getattr(after, f) for f in fields)
    rest_same = same("family", "version") and order_modifiers(before.modifiers) == order_modifiers(after.modifiers) and before.variant != after.variant
    version_like = lambda t: bool(re.fullmatch(r"[a-z0-9.\-]+", t)) and bool(re.search(r"\d", t))
    registered = family_known(after.family) and not family_known(before.family)
    rules = (
        rest_same and after.variant and before.variant and after.variant.startswith(before.variant),
        rest_same and after.variant and version_like(before.variant) and not version_like(after.variant),
        safe and reduction and ((after.variant and before.family == f"{after.family}-{after.variant}") or registered),
        safe and before.family != after.family and is_enforced_family(after.family),
        safe and after.variant and before.family == after.family + after.variant,
        safe and before.family.lower() == "text-embedding" and before.family != after.family and family_known(after.family),
        rest_same and not after.variant and (not value_in_id(before.variant, ident) or before.variant == before.version),
        safe and same("family"),
        safe and before.family != after.family and registered,
    )
    return "improvement" if any(rules) else "regression"


def diff_decompositions(before: DataFrame, after: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(provider, model_id, change) of the rows of (provider, model_id, family, variant, version, modifier) that changed.

    The decompositions of all providers of an identifier are made distinct before they are listed.
    """
    ship_package(before.sparkSession)
    parts = F.struct("family", "variant", "version", F.coalesce("modifier", F.array().cast("array<string>")).alias("modifier"))
    b, a = (df.select("provider", "model_id", parts.alias(n)) for df, n in ((before, "b"), (after, "a")))
    changed = b.join(a, ["provider", "model_id"]).where(F.col("a") != F.col("b"))
    lists = lambda df, n: df.groupBy("model_id").agg(F.collect_set(n).alias(f"all_{n}"))
    wide = changed.join(lists(b, "b"), "model_id").join(lists(a, "a"), "model_id")
    listed = allowed.select("model_id", parts.alias("allowed")) if allowed is not None else None
    wide = wide.join(listed, "model_id", "left") if listed is not None else wide.withColumn("allowed", F.lit(None).cast(wide.schema["a"].dataType))

    def run(batches):
        for pdf in batches:
            read = lambda d: None if d is None else Parts(d["family"], d["variant"], d["version"], tuple(d["modifier"]))
            pdf["change"] = [
                classify_change(r.model_id, read(r.b), read(r.a), [read(x) for x in r.all_b], [read(x) for x in r.all_a], read(r.allowed)) for r in pdf.itertuples()
            ]
            yield pdf[["provider", "model_id", "change"]]

    return wide.mapInPandas(run, "provider string, model_id string, change string")


#: Characters that would end a cell or line, and how they are written.
_ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
_TABBED = {"sep": "\t", "header": True, "emptyValue": "", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _escaped(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def _unescaped(text: Column) -> Column:
    """An escaped backslash must not be read as the start of another escape, so it steps aside first."""
    text = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for plain, written in _ESCAPES[1:]:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return F.replace(text, F.lit("\x00"), F.lit("\\"))


def dump_decompositions(normalized: DataFrame, path: str) -> None:
    """Write provider, id, raw_family, family, variant, version, modifier as tab-separated text with a header.

    Tabs, line ends and backslashes inside a value are escaped, so a file can be read in parts.
    """
    mods = F.coalesce(F.array_join("modifier", ","), F.lit(""))
    rows = normalized.select("provider", F.col("model_id").alias("id"), "raw_family", *TUPLE, mods.alias("modifier"))
    rows.select(*[_escaped(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns]).write.options(**_TABBED).csv(path)


def load_decompositions(spark, path: str) -> DataFrame:
    rows = spark.read.options(**_TABBED, nullValue="\x01").csv(path)
    filled = rows.select(*[_unescaped(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns])
    mods = F.when(F.col("modifier") != "", F.split("modifier", ","))
    return filled.withColumn("modifier", mods).withColumnRenamed("id", "model_id")
