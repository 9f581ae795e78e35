"""Matching entities across sources without keys, by loopy belief propagation.

Offers and catalog rows are read into the same attributes. Rows that read alike form a class, so that
copies are never paired with each other one by one. Candidate pairs (offer, class) share provider,
family and the digits of the version, and at least two of variant, modifiers and size; how these agree,
and the weak evidence of price, context window and month, give each pair a weight. Pairs that differ in
more are left out: their weight is below -9, so they could never be believed.

The factors are one-to-one: an offer takes at most one class, and a class is taken by one offer; each
further offer is not forbidden, as the same model is offered again and again, but costs the class a
factor. So an offer that fits two classes alike goes to the one that no other offer claims. Messages
between the two kinds of factors go through joins over the table of pairs until they settle; the beliefs
are marginal match probabilities, and they alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeatlas.llm.names import NameDictionary, fillers_beside, frequent_words
from lodeatlas.llm.offers import Vendors, read_context, read_model, read_month, read_offer, read_price
from lodeatlas.plans.session import cut, ship_package
from lodeatlas.plans.skew import salted_join

#: Families and providers are held by every task; their number is checked against this.
MOST_NAMES = 500_000
#: Log weights of a pair against no match at all. Agreement and disagreement of each attribute.
PRIOR = -4.0
AGREE = {"variant": 4.0, "modifiers": 4.0, "size": 4.0}
DIFFER = {"variant": -6.0, "modifiers": -6.0, "size": -8.0}
#: A size left out, where the provider has one size and where it has several.
ONE_SIZE, SEVERAL_SIZES = 3.0, -6.0
#: A version whose dot was lost; each letter that was mistyped.
LOST_DOT, EDIT = -1.5, -0.3
#: Price within a quarter, context window within three percent, same month.
PRICE, CONTEXT, MONTH = 1.0, 1.0, 0.7
#: What each further offer of the same class costs.
REUSE = 0.05
#: The change of a message below which it has settled; rounds after which messages are damped, so that
#: circles of pairs can't swing, and rounds at most. What is left of the change is part of the result.
SETTLED, UNDAMPED, ROUNDS = 1e-3, 8, 200
#: Probability from which an offer is matched.
LEAST_BELIEF = 0.5

_READ = "provider string, family string, variant string, version string, size string, modifiers string, edits int, context double, price double, month string"


def _held_names(listings: DataFrame, families: DataFrame, providers: DataFrame) -> tuple[NameDictionary, Vendors]:
    """The dictionary of families and providers, and the words that listings put around them."""
    entries = families.where("family is not null").select("family", F.coalesce("variant", F.lit("")).alias("variant")).distinct()
    makers = providers.where("provider is not null").select("provider").distinct()
    n = entries.count() + makers.count()
    if n > MOST_NAMES:
        raise ValueError(f"{n} names exceed the {MOST_NAMES} that are sent to every task")
    names, pairs = [r.provider for r in makers.toLocalIterator()], [(r.family, r.variant) for r in entries.toLocalIterator()]
    around = frequent_words(listings, "title")
    bare = NameDictionary(pairs, names)
    return NameDictionary(pairs, names, fillers_beside(around, bare)), Vendors(names, frequent_words(listings, "vendor_name"))


def _rows(key: str, out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.string()] * 6, pa.int32(), pa.float64(), pa.float64(), pa.string()]
    names = [key, *(x.split()[0] for x in _READ.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)


def read_listings(listings: DataFrame, held) -> DataFrame:
    """(listing_id, provider, attributes): one row per provider that the vendor's name may mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vendors = held.value
        for batch in batches:
            out = []
            for key, title, vendor, hint, context, price, released in zip(*(c.to_pylist() for c in batch.columns)):
                o = read_offer(title, names)
                family, variant = o.family, o.variant
                if not family and hint:
                    said = names.read(hint)
                    family = said.family
                if family:
                    for p in vendors.find(vendor):
                        out.append((key, p, family, variant, o.version, o.size, o.modifiers, o.edits, read_context(context), read_price(price), read_month(released)))
            yield _rows("listing_id", out)

    rows = listings.where("listing_id is not null").select(F.col("listing_id").cast("bigint"), "title", "vendor_name", "family_hint", "context_text", "price_text", "released")
    return rows.mapInArrow(run, f"listing_id bigint, {_READ}")


def read_models(models: DataFrame, held) -> DataFrame:
    """(row_id, provider, attributes) of the catalog rows whose family can be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _ = held.value
        for batch in batches:
            out = []
            for key, provider, model_id, shown, family, variant, version, context, price, released in zip(*(c.to_pylist() for c in batch.columns)):
                o = read_model(model_id, shown, family, variant, version, names)
                if o.family:
                    out.append((key, provider, o.family, o.variant, o.version, o.size, o.modifiers, o.edits, context, price, read_month(released)))
            yield _rows("row_id", out)

    rows = models.where("row_id is not null and provider is not null").select(
        F.col("row_id").cast("bigint"), "provider", "model_id", "display_name", "family", "variant", "version", F.col("context_window").cast("double"), F.col("cost_input").cast("double"), "release_date"
    )
    return rows.mapInArrow(run, f"row_id bigint, {_READ}")


def _near(a: Column, b: Column, share: float) -> Column:
    return F.coalesce(F.abs(a - b) <= share * F.greatest(F.abs(a), F.abs(b)), F.lit(False))


def candidate_pairs(offers: DataFrame, rows: DataFrame) -> DataFrame:
    """(listing_id, class_id, weight): offers and classes of one provider, family and version that agree in two attributes more.

    The rows of a class are summed up before they are shuffled; offers of a hot block are spread.
    """
    digits = F.replace("version", F.lit("."), F.lit(""))
    same = ["provider", "family", "digits", "variant", "modifiers"]
    summed = {"class_id": ("min", "row_id"), "low": ("min", "price"), "high": ("max", "price"), "least": ("min", "context"), "most": ("max", "context"), "first": ("min", "month"), "last": ("max", "month")}
    fine = rows.withColumn("digits", digits).groupBy(*same, "size", "version").agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in summed.items()])
    # As many as one model of one provider has sizes and ways to set the dot of its version.
    each = fine.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("size", "version", *summed))).alias("each"))
    # A version whose dot was lost belongs to the dotted one, if there is only one.
    dotted = F.size(F.array_distinct(F.transform(F.filter("each", lambda x: (x["size"] == F.col("size")) & x["version"].contains(".")), lambda x: x["version"])))
    one = each.select(*same, "each", F.size(F.array_distinct(F.transform("each", lambda x: x["size"]))).alias("n_sizes"), F.explode("each").alias("x")).select(*same, "each", "n_sizes", "x.*")
    apart = one.withColumn("apart", F.when(dotted > 1, F.col("version")).otherwise("")).drop("each")
    classes = apart.groupBy(*same, "size", "n_sizes", "apart").agg(F.max("version").alias("class_version"), *[getattr(F, f)(n).alias(n) for n, (f, _) in summed.items()])
    asked = offers.select("provider", "family", digits.alias("digits")).distinct()
    classes = cut(classes.join(asked, ["provider", "family", "digits"], "left_semi"))
    # The key of a pair of attributes that may agree; a size that was left out agrees with any.
    keys = lambda size: F.array(F.concat_ws("\x00", F.lit("vm"), "variant", "modifiers"), F.concat_ws("\x00", F.lit("vs"), "variant", size), F.concat_ws("\x00", F.lit("ms"), "modifiers", size))
    o = offers.select("listing_id", "provider", "family", digits.alias("digits"), *[F.col(c).alias(f"o_{c}") for c in ("variant", "version", "size", "modifiers", "edits", "context", "price", "month")], F.explode(keys(F.col("size"))).alias("key"))
    c = classes.withColumn("key", F.explode(F.array_distinct(F.concat(keys(F.col("size")), keys(F.lit(""))))))
    joined = salted_join(o, c, ["provider", "family", "digits", "key"], ["listing_id"])
    said = lambda a: F.when(F.col(f"o_{a}") == F.col(a), AGREE[a]).otherwise(DIFFER[a])
    left_out = (F.col("o_size") == "") & (F.col("size") != "")
    size = F.when(left_out, F.when(F.col("n_sizes") == 1, ONE_SIZE).otherwise(SEVERAL_SIZES)).otherwise(said("size"))
    price = _near(F.col("o_price"), F.col("low"), 0.25) | _near(F.col("o_price"), F.col("high"), 0.25)
    context = _near(F.col("o_context"), F.col("least"), 0.03) | _near(F.col("o_context"), F.col("most"), 0.03)
    month = F.coalesce(F.col("o_month").between(F.col("first"), F.col("last")), F.lit(False))
    weight = (
        F.lit(PRIOR) + said("variant") + said("modifiers") + size
        + F.when(F.col("o_version") == F.col("class_version"), 0.0).otherwise(LOST_DOT)
        + EDIT * F.col("o_edits") + F.when(price, PRICE).otherwise(0.0) + F.when(context, CONTEXT).otherwise(0.0) + F.when(month, MONTH).otherwise(0.0)
    )
    return joined.select("listing_id", "class_id", weight.alias("weight")).groupBy("listing_id", "class_id").agg(F.max("weight").alias("weight"))


def propagate(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pairs`` (listing_id, class_id, weight, ...) with ``belief``, the marginal probability of each pair, and ``residual``.

    An offer's pairs are few. The pairs of a class may be very many: they are summed before they are
    shuffled, and the sum goes back to them spread. Rounds go on until no message moves by more than
    SETTLED; ``residual`` is the last move of the pair's message, above SETTLED only where ``rounds``
    were not enough.
    """
    kept = [c for c in pairs.columns if c != "weight"]
    state = cut(pairs.withColumns({"w": F.exp(F.least(F.col("weight"), F.lit(30.0))), "mu": F.lit(1.0), "residual": F.lit(0.0)}))
    for k in range(rounds):
        offers = state.groupBy("listing_id").agg(F.sum(F.col("w") * F.col("mu")).alias("s"))
        # From an offer to a class: how much it wants this class when all else it could take is counted.
        sent = state.join(offers, "listing_id").withColumn("m", F.col("w") / (1 + F.greatest(F.col("s") - F.col("w") * F.col("mu"), F.lit(0.0))))
        sent = cut(sent.withColumn("q", F.log1p(REUSE * F.col("m"))).drop("s", "m"))
        classes = sent.groupBy("class_id").agg(F.sum("q").alias("total"))
        # From a class to an offer: the share of its settings that are left when this offer takes it.
        others = F.exp(F.least(F.greatest(F.col("total") - F.col("q"), F.lit(0.0)), F.lit(60.0)))
        answered = salted_join(sent, classes, ["class_id"], ["listing_id"]).withColumn("new", others / (1 + (others - 1) / REUSE))
        new = F.col("new") if k < UNDAMPED else (F.col("new") + F.col("mu")) / 2
        state = cut(answered.select(*kept, "w", new.alias("mu"), F.abs(F.col("new") - F.col("mu")).alias("residual")))
        if (state.agg(F.max("residual")).first()[0] or 0.0) < SETTLED:
            break
    offers = state.groupBy("listing_id").agg(F.sum(F.col("w") * F.col("mu")).alias("s"))
    return state.join(offers, "listing_id").select(*kept, (F.col("w") * F.col("mu") / (1 + F.col("s"))).alias("belief"), "residual")


def pair_beliefs(listings: DataFrame, models: DataFrame, families: DataFrame, providers: DataFrame) -> DataFrame:
    """(row_id, listing_id, belief, residual) of every candidate pair; of rows that read alike the smallest row_id stands for all."""
    ship_package(listings.sparkSession)
    held = listings.sparkSession.sparkContext.broadcast(_held_names(listings, families, providers))
    offers, rows = cut(read_listings(listings, held)), cut(read_models(models, held))
    return propagate(candidate_pairs(offers, rows)).withColumnRenamed("class_id", "row_id").select("row_id", "listing_id", "belief", "residual")


def match_offers(listings: DataFrame, models: DataFrame, families: DataFrame, providers: DataFrame) -> DataFrame:
    """(row_id, listing_id, belief): the catalog row that a listing offers, with its probability.

    A listing has at most one row: the pair of the largest belief, if that is at least ``LEAST_BELIEF``.
    Of rows that read alike the smallest row_id stands for all. Listings without a title or vendor, or
    with an unknown one, have no row; ties between classes go to the smaller row_id; a listing_id that
    occurs twice is one listing.
    """
    beliefs = pair_beliefs(listings, models, families, providers)
    best = beliefs.groupBy("listing_id").agg(F.max_by(F.struct("row_id", "belief"), F.struct("belief", -F.col("row_id"))).alias("b"))
    return best.select(F.col("b.row_id").alias("row_id"), "listing_id", F.col("b.belief").alias("belief")).where(F.col("belief") >= LEAST_BELIEF)
