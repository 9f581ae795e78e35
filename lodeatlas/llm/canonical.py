"""Mapping free-entered values to a canonical list.

Values are read with a dictionary of the canonical names, the makers around them and the filler words
learned from the values themselves (``names.py``). A list that one task can hold is read in one pass. A
longer one is held in parts: every part is asked which of its names occur in a value, then which are
similar to what these leave, and the value is read with the names that were found. What a value says
depends on those names only, so the parts make no difference to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.llm.names import ENDING_SHARE, NameDictionary, fillers_beside, frequent_words, squeeze
from lodeatlas.plans.session import cut, ship_package
from lodeatlas.plans.skew import salted_join

#: Names of entries and makers that are sent to every task at once; a longer list is asked in parts.
NAMES_PER_PART = 100_000
#: Values kept per task, so that a value that is typed again and again is read once.
REMEMBERED = 200_000

_BLANK = r"^[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]*$"
_READ = "ref_id bigint, edits int, left_over int"
_NAMES = "array<struct<kind:int,name:string>>"


def standing_for(got, of_family: set[str], refs: dict[tuple[str, str], int]) -> int:
    """The entry that a reading stands for: of its variants the first that the family has, else 0; "" if it has none."""
    if not got.family:
        return 0
    variants = list(dict.fromkeys(got.variants))
    own = [v for v in variants if v in of_family]
    return refs.get((got.family, own[0] if own else variants[0] if variants else ""), 0)


def _reader(held: Broadcast):
    """Readings of (row_id, value) with the whole dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, refs = held.value
        memo: dict[str, tuple[int, int, int]] = {}

        def resolve(value: str) -> tuple[int, int, int]:
            got = names.read(value)
            return standing_for(got, names.of_family.get(got.family, ()), refs), got.edits, len(got.rest)

        for batch in batches:
            out = []
            for value in batch.column(1).to_pylist():
                hit = memo.get(value)
                if hit is None:
                    hit = resolve(value)
                    if len(memo) < REMEMBERED:
                        memo[value] = hit
                out.append(hit)
            ref, edits, rest = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ref, pa.int64()), pa.array(edits, pa.int32()), pa.array(rest, pa.int32())], names=["row_id", "ref_id", "edits", "left_over"])

    return run


_PAIRS = pa.list_(pa.struct([("kind", pa.int32()), ("name", pa.string())]))


def _toucher(held: Broadcast, numbered: bool):
    """(value, names): the names of one part that a value touches; of (value, names), by similarity to what those leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held.value
        for batch in batches:
            values = batch.column(0).to_pylist()
            exact = batch.column(1).to_pylist() if batch.num_columns > 1 else None
            out = []
            for i, value in enumerate(values):
                words, _ = part.words_of(value, numbered)
                hits = part.touched_exactly(words) if exact is None else part.touched_by_similarity(words, NameDictionary.of_names((x["kind"], x["name"]) for x in exact[i]))
                out.append([{"kind": k, "name": n} for k, n in sorted(hits)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _PAIRS)], names=["value", "names"])

    return run


def _final_reader(numbered: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, names = (c.to_pylist() for c in batch.columns)
            got = []
            for value, found in zip(values, names):
                mini = NameDictionary.of_names((x["kind"], x["name"]) for x in found)
                got.append(mini.read_words(*mini.words_of(value, numbered)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g.family for g in got]), pa.array([list(dict.fromkeys(g.variants)) for g in got], pa.list_(pa.string())), pa.array([g.edits for g in got], pa.int32()), pa.array([len(g.rest) for g in got], pa.int32())],
                names=["value", "family", "variants", "edits", "left_over"],
            )

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ref, family, variant = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze(f) for f in family]), pa.array([squeeze(v) for v in variant])], names=["ref_id", "family", "variant"])


def _in_parts(values: DataFrame, listed: DataFrame, makers: DataFrame, often: list[str], endings: set[str], numbered: bool, parts: int) -> DataFrame:
    """(value, ref_id, edits, left_over) of different values, with a dictionary that is asked in parts."""
    sc = values.sparkSession.sparkContext

    def dictionary(k: int, fillers: set[str]) -> NameDictionary:
        mine = lambda df, c: df.where(F.pmod(F.xxhash64(c), F.lit(parts)) == k).toLocalIterator()
        return NameDictionary(((r.family, r.variant) for r in mine(listed, "family")), (r[0] for r in mine(makers, makers.columns[0])), fillers, endings)

    fillers = set(often)
    for k in range(parts):
        fillers &= fillers_beside(fillers, dictionary(k, set()))

    def ask(df: DataFrame) -> DataFrame:
        answers = None
        for k in range(parts):
            held = sc.broadcast(dictionary(k, fillers if k == 0 else set()))
            got = cut(df.mapInArrow(_toucher(held, numbered), f"value string, names {_NAMES}"))
            held.unpersist()
            answers = got if answers is None else answers.unionByName(got)
        return answers

    # As many names as touch one value.
    gathered = lambda df: df.groupBy("value").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    exact = cut(gathered(ask(values)))
    names = gathered(ask(exact).unionByName(exact))
    readings = cut(names.mapInArrow(_final_reader(numbered), "value string, family string, variants array<string>, edits int, left_over int"))
    keys = listed.select("ref_id", "family", "variant").mapInArrow(_keyed, "ref_id bigint, family string, variant string").groupBy("family", "variant").agg(F.min("ref_id").alias("ref_id"))
    said = F.when(F.size("variants") == 0, F.array(F.lit(""))).otherwise(F.col("variants"))
    asked = readings.select("value", "family", F.posexplode(said).alias("at", "variant"))
    first = asked.join(keys, ["family", "variant"]).groupBy("value").agg(F.min_by("ref_id", "at").alias("ref_id"))
    return readings.join(first, "value", "left").select("value", F.coalesce("ref_id", F.lit(0)).cast("bigint").alias("ref_id"), "edits", "left_over")


def resolve_values(rows: DataFrame, entries: DataFrame, makers: DataFrame) -> DataFrame:
    """(row_id, ref_id, edits, left_over) for rows (row_id, value): the entry each value stands for, 0 for none.

    ``entries`` has ref_id, family, variant; of several entries of the same name the smallest ref_id
    counts. ``makers`` has one column of names that may stand around a value and mean nothing. A value
    with a variant that its family does not have stands for no entry, one without a variant for the
    entry whose variant is "". Blank and null values are left out. A value as near to two names stands
    for neither. The number of entries and makers only decides in how many parts they are asked.
    """
    spark = rows.sparkSession
    ship_package(spark)
    maker = F.col(makers.columns[0])
    makers = makers.where(maker.isNotNull()).select(maker.alias("maker")).distinct()
    listed = entries.where("family is not null and trim(family) <> ''").select(F.col("ref_id").cast("bigint").alias("ref_id"), "family", F.coalesce("variant", F.lit("")).alias("variant"))
    facts = listed.agg(F.count("*"), F.max(F.concat("family", "variant").rlike(r"\p{N}"))).first()
    n_makers = makers.count()
    last = makers.select(F.regexp_extract(F.lower("maker"), r"[^\p{L}](\p{L}+)[^\p{L}]*$", 1).alias("word")).where("word <> ''")
    endings = {squeeze(r.word) for r in last.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, ENDING_SHARE * n_makers)).toLocalIterator()}
    values = rows.where(F.col("value").isNotNull() & ~F.col("value").rlike(_BLANK)).select(F.col("row_id").cast("bigint").alias("row_id"), "value")
    often = frequent_words(values, "value")
    parts = max(1, -(-(facts[0] + n_makers) // NAMES_PER_PART))
    if parts > 1:
        found = _in_parts(cut(values.select("value").distinct()), cut(listed), cut(makers), often, endings, bool(facts[1]), parts)
        return salted_join(values, found, ["value"], ["row_id"]).select("row_id", "ref_id", "edits", "left_over")
    refs: dict[tuple[str, str], int] = {}
    pairs = []
    for r in listed.toLocalIterator():
        pairs.append((r.family, r.variant))
        key = (squeeze(r.family), squeeze(r.variant))
        refs[key] = min(refs.get(key, r.ref_id), r.ref_id)
    held_makers = [r.maker for r in makers.toLocalIterator()]
    names = NameDictionary(pairs, held_makers, fillers_beside(often, NameDictionary(pairs, held_makers, (), endings)), endings)
    return values.mapInArrow(_reader(spark.sparkContext.broadcast((names, refs))), f"row_id bigint, {_READ}")
