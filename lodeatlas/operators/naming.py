"""Names of constants for the rows of a catalog."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeatlas.plans.prefix import prefix_sums
from lodeatlas.plans.session import cut, ship_package

# How brands are written.
BRANDS = {
    "ai": "AI", "api": "API", "chatgpt": "ChatGPT", "llm": "LLM", "io": "IO", "sap": "SAP", "ovh": "OVH", "cn": "CN", "ams": "AMS", "sgp": "SGP", "aws": "AWS",
    "nvidia": "Nvidia", "togetherai": "TogetherAI", "llmgateway": "LlmGateway", "iflowcn": "iFlowCN", "nearai": "NearAI", "gmicloud": "GMICloud",
    "openrouter": "OpenRouter", "deepseek": "DeepSeek", "minimax": "MiniMax", "openai": "OpenAI", "deepinfra": "DeepInfra", "huggingface": "HuggingFace",
    "moonshotai": "MoonshotAI", "xai": "xAI", "github": "GitHub", "gitlab": "GitLab", "gpt": "GPT", "glm": "GLM", "qwen": "Qwen", "olmo": "OLMo",
    "internlm": "InternLM", "smollm": "SmolLM", "wizardlm": "WizardLM", "codellama": "CodeLlama",
}


def style(token: str, keep_case: bool = False) -> str:
    """A token as part of a name: a brand, digits with what follows them, else with a capital."""
    brand = BRANDS.get(token.lower())
    if brand or not token:
        return brand or ""
    m = re.match(r"(\d+)(.*)\Z", token, re.S)
    if m:
        rest = m[2]
        return m[1] + (BRANDS.get(rest.lower()) or (rest if keep_case else rest[:1].upper() + rest[1:]))
    return token.lower()[:1].upper() + token.lower()[1:]


def identifier(slug: str, display_name: str = "") -> str:
    """A slug as one word; words of the display name say how theirs are written."""
    hints = {w.lower(): w for w in display_name.split()}
    out = []
    for tok in re.split("[-.]", slug):
        hint = hints.get(tok.lower())
        plain = tok and tok.lower() not in BRANDS and not tok[0].isdigit()
        out.append(hint[:1].upper() + hint[1:] if plain and hint else style(tok))
    return "".join(out)


def provider_name(slug: str, display_name: str = "") -> str:
    return "Provider" + identifier(slug, display_name)


def family_name(slug: str, display_name: str = "") -> str:
    return "Family" + identifier(slug, display_name)


def part(token: str) -> str:
    """A token of an identifier; the pieces of a compound are joined by underscores."""
    if token.lower() in BRANDS:
        return BRANDS[token.lower()]
    pieces = [p for p in re.split(r"[\W_]+", token) if p]
    return "_".join(style(p, True) for p in pieces) if len(pieces) > 1 else style(token, True)


def strip_date(name: str, date: str) -> tuple[str, bool]:
    """A name without the known date it ends with (yyyymmdd, yyyy-mm-dd, mm-yyyy or mm-dd), and whether it had it."""
    if not date:
        return name, False
    fields = date.split("-", 2)
    forms = [date.replace("-", ""), date]
    if len(fields) == 3:
        forms += [f"{fields[1]}-{fields[0]}", f"{fields[1]}-{fields[2]}"]
    for form in forms:
        if name.endswith(form):
            return name[: -len(form)].rstrip("-."), True
    return name, False


def _pieces(text: str) -> list[str]:
    return [p for p in re.split(r"[\W_]+", text) if p]


def constant_name(ident: str, provider: str, family: str, version: str, date: str, modifiers: list[str], provider_ident: str = "") -> str:
    """Model__Provider__tokens__version__Modifiers__yyyymmdd; empty without a family."""
    if not family:
        return ""
    name = ident.rpartition("/")[2].lstrip("@")
    mods = {m for m in modifiers}
    while mods and "-" in name and name.rpartition("-")[2].lower() in mods:
        name = name.rpartition("-")[0].rstrip("-.")
    name, dated = strip_date(name.replace("@", "-"), date)
    if version:
        for form in (version.replace(".", "-"), version):
            if name.endswith(("-" + form, "." + form)):
                name = name[: -len(form) - 1].rstrip("-.")
                break
    owner = provider_ident or identifier(provider) or "Unknown"
    out = ["Model", owner, "__".join(filter(None, map(part, _pieces(name))))]
    out += [version.replace(".", "_")] if version else []
    out += ["".join(map(part, modifiers))] if modifiers else []
    out += [date.replace("-", "")] if dated and date else []
    return "__".join(out)


def version_segment(ident: str, family: str, variant: str, date: str) -> str:
    """What an identifier says besides family, variant and date."""
    name, _ = strip_date(ident.rpartition("/")[2].lstrip("@").replace("@", "-"), date)
    known = {t.lower() for text in (family, variant) for t in re.split("[-.]", text) if t}
    return "_".join(filter(None, (part(t) for t in _pieces(name) if t.lower() not in known)))


def constants(normalized: DataFrame) -> DataFrame:
    """(provider, model_id, name): a unique constant name for every row with a family.

    Rows whose names collide get their version segment if these tell all of them apart, else a number
    in the order of their identifiers. The numbers are distributed prefix sums, so any number of rows
    may collide. Rows of equal provider and identifier are one.
    """
    ship_package(normalized.sparkSession)

    @F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("segment", T.StringType())]))
    def named(ident: pd.Series, provider: pd.Series, family: pd.Series, variant: pd.Series, version: pd.Series, date: pd.Series, mods: pd.Series) -> pd.DataFrame:
        rows = [
            (constant_name(i, p, f, ve, d, list(m) if m is not None else []), version_segment(i, f, va, d))
            for i, p, f, va, ve, d, m in zip(ident, provider, family, variant, version, date, mods)
        ]
        return pd.DataFrame(rows, columns=["name", "segment"])

    text = [F.coalesce(c, F.lit("")) for c in ("model_id", "provider", "family", "variant", "version", "date")]
    keyed = normalized.select("provider", "model_id", named(*text, F.col("modifier")).alias("n"))
    rows = cut(keyed.groupBy("provider", "model_id").agg(F.min("n").alias("n")).select("provider", "model_id", "n.name", "n.segment").where("name <> ''"))
    per_segment = rows.groupBy("name", "segment").agg(F.count("*").alias("n"))
    groups = per_segment.groupBy("name").agg(F.sum("n").alias("n_rows"), (F.min(F.col("segment") != "") & (F.max("n") == 1)).alias("told_apart"))
    counted = rows.join(groups, "name")
    segmented = F.when(F.col("told_apart"), F.concat_ws("__", "name", "segment")).otherwise(F.col("name"))
    once = cut(counted.select("provider", "model_id", F.when(F.col("n_rows") == 1, F.col("name")).otherwise(segmented).alias("name"), ((F.col("n_rows") > 1) & ~F.col("told_apart")).alias("clash")))
    named_once = _numbered(once).select("provider", "model_id", "name")
    again = cut(named_once.join(named_once.groupBy("name").agg(F.count("*").alias("n_rows")), "name").withColumn("clash", F.col("n_rows") > 1))
    return _numbered(again).select("provider", "model_id", "name")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows whose names clash get a number in the order of their identifiers; only these are sorted."""
    clashing = rows.where("clash")
    if clashing.isEmpty():
        return rows
    sums = prefix_sums(clashing, ["name"], ["model_id", "provider"], F.lit(1), "before")
    return rows.where("not clash").unionByName(sums.withColumn("name", F.concat(F.col("name"), F.lit("_"), F.col("before") + 1)).drop("before"))
