"""Evaluation texts leaking into training text: a positional inverted index and phrase intersection.

The terms of the index are pairs of neighbouring words. Postings (term, document, position) are stored
for the terms that occur in evaluation items, over the whole texts of all documents, in one pass for any
number of items: a Bloom filter of bounded size, built from all of them, leaves out nearly all other
terms, and the joins that follow leave out the rest. Every
window of an item that would count as a leak holds a rarest term; the lists of these terms are shifted
by their position in the item and give the possible alignments of item and document. The lists of all
other terms of the item are then intersected with those alignments on exact (document, position), and
the longest unbroken run is the exact phrase match. A frequent term is only ever looked up, never used
to propose, so its long list meets no other long list.

Proximity matches come from the same lists: around an alignment proposed by the rarest term of a window
that the corpus has at all, the terms of the item that stand near their expected place are put together to stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeatlas.llm.words import words
from lodeatlas.plans.session import cut, ship_package
from lodeatlas.plans.skew import salted_join

#: Words in a row that count as a leak.
RUN_WORDS = 12
#: Bits of the filter for each term of the items, and bits at most (128 MB).
BITS_PER_TERM, MOST_BITS = 16, 1 << 30
#: Words whose hashes a task remembers.
REMEMBERED = 500_000
#: Proximity: places that a term may have moved, terms in a row that may be missing, and the share of a
#: stretch's terms that must be there.
NEAR_PLACES, NEAR_GAP, NEAR_SHARE = 4, 4, 0.6

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(tokens: list[str], memo: dict[str, int]) -> np.ndarray:
    out = []
    for w in tokens:
        h = memo.get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            if len(memo) < REMEMBERED:
                memo[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def pair_terms(hashes: np.ndarray) -> np.ndarray:
    """A 63-bit term for each pair of neighbouring words."""
    if len(hashes) < 2:
        return np.zeros(0, np.int64)
    mixed = (hashes[:-1] * _BASE) ^ (hashes[1:] + (hashes[:-1] >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _BASE
    return (mixed >> np.uint64(1)).astype(np.int64)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}
    for batch in batches:
        ids, pos, terms = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            t = pair_terms(_word_hashes(words(text), memo))
            ids.append(np.full(len(t), item, np.int64))
            pos.append(np.arange(len(t), dtype=np.int32))
            terms.append(t)
        cat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        yield pa.RecordBatch.from_arrays([pa.array(cat(ids, np.int64)), pa.array(cat(pos, np.int32)), pa.array(cat(terms, np.int64))], names=["item_id", "pos", "term"])


def term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter with two places for each term: 64-bit words of 2^k bits.

    Its words are put together by the executors; at most MOST_BITS / 64 of them are gathered. More
    terms than fit make it let more other terms pass, which costs postings but no result.
    """
    n = terms.select("term").distinct().count()
    bits = 1 << 10
    while bits < min(BITS_PER_TERM * n, MOST_BITS):
        bits *= 2
    places = F.array(F.col("term").bitwiseAND(F.lit(bits - 1)), F.shiftright("term", 31).bitwiseAND(F.lit(bits - 1)))
    each = terms.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit"))
    words = each.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _passes(held: np.ndarray, terms: np.ndarray) -> np.ndarray:
    mask = np.int64((len(held) << 6) - 1)
    out = np.ones(len(terms), bool)
    for p in (terms & mask, (terms >> np.int64(31)) & mask):
        out &= ((held[p >> np.int64(6)] >> (p & np.int64(63)).astype(np.uint64)) & np.uint64(1)) == 1
    return out


def _postings(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        memo: dict[str, int] = {}
        for batch in batches:
            lists = [words(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            hashes = _word_hashes([w for x in lists for w in x], memo)
            starts = np.cumsum(sizes) - sizes
            row = np.repeat(np.arange(len(lists)), sizes)
            pos = np.arange(len(hashes)) - starts[row]
            terms = pair_terms(hashes)
            # The last word of a text makes no pair with the first of the next one.
            at = np.flatnonzero((row[:-1] == row[1:]) & _passes(bits, terms)) if len(terms) else np.zeros(0, np.int64)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(terms[at]), batch.column(0).take(pa.array(row[at])), pa.array(pos[at].astype(np.int32))], names=["term", "doc_id", "pos"])

    return run


def build_index(documents: DataFrame, held: np.ndarray) -> DataFrame:
    """(term, doc_id, pos): the postings of the terms that a filter lets pass, in all documents."""
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    return cut(rows.mapInArrow(_postings(documents.sparkSession.sparkContext.broadcast(held)), "term bigint, doc_id bigint, pos int"))


def _anchors(run: int):
    def pick(item: pd.DataFrame) -> pd.DataFrame:
        """The positions of the rarest term of each window of ``run`` terms of one item."""
        item = item.sort_values("pos")
        n = item["n"].to_numpy()
        if len(n) < run:
            return item.head(0)[["item_id", "pos", "term"]]
        windows = np.lib.stride_tricks.sliding_window_view(n, run)
        return item.iloc[np.unique(windows.argmin(axis=1) + np.arange(len(windows)))][["item_id", "pos", "term"]]

    return pick


def _proposals(items: DataFrame, index: DataFrame, window: int, absent: int = 0) -> DataFrame:
    """(item_id, doc_id, shift): where the rarest term of a window of the item stands in a document.

    A term that no document has counts as standing in ``absent`` places.
    """
    seen = index.groupBy("term").agg(F.count("*").alias("n"))
    weighed = items.join(seen, "term", "left").select("item_id", "pos", "term", F.coalesce("n", F.lit(absent)).cast("bigint").alias("n"))
    anchors = weighed.groupBy("item_id").applyInPandas(_anchors(window), "item_id bigint, pos int, term bigint")
    # A passage of boilerplate may stand in a third of the documents, so the postings of its terms are spread.
    return salted_join(index.withColumnRenamed("pos", "at"), anchors, ["term"], ["doc_id"]).select("item_id", "doc_id", (F.col("at") - F.col("pos")).alias("shift")).distinct()


def _alignments(items: DataFrame, index: DataFrame, run: int) -> DataFrame:
    """(item_id, doc_id, shift, first, n): unbroken runs of at least ``run`` terms that lie alike in both."""
    proposed = cut(_proposals(items, index, run))
    wanted = proposed.join(items, "item_id").select("item_id", "doc_id", "shift", "pos", "term", (F.col("pos") + F.col("shift")).alias("at"))
    hits = wanted.join(index.withColumnRenamed("pos", "at"), ["term", "doc_id", "at"], "left_semi")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("item_id", "doc_id", "shift").orderBy("pos"))
    runs = hits.select("item_id", "doc_id", "shift", "pos", island.alias("island"))
    return runs.groupBy("item_id", "doc_id", "shift", "island").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where(F.col("n") >= run).drop("island")


def _indexed(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    ship_package(documents.sparkSession)
    listed = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    terms = cut(listed.mapInArrow(_item_terms, "item_id bigint, pos int, term bigint").distinct())
    return terms, build_index(documents, term_filter(terms))


def leaks(documents: DataFrame, items: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(item_id, doc_id, item_from, doc_from, n_words): every unbroken run of at least ``run_words`` words.

    ``item_from`` and ``doc_from`` count words from 0. Letter case, punctuation, markup, entities,
    invisible characters and white space do not matter. Null and empty texts and items shorter than
    the run give no rows; ids that are null are left out; repeated rows of an id add nothing. The
    corpus is read once, whatever the number of items.
    """
    found = _alignments(*_indexed(documents, items), run_words - 1)
    return found.select(
        "item_id", "doc_id", F.col("first").cast("bigint").alias("item_from"), (F.col("first") + F.col("shift")).cast("bigint").alias("doc_from"), (F.col("n") + 1).cast("bigint").alias("n_words")
    ).distinct()


def near_leaks(documents: DataFrame, items: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(item_id, doc_id, item_from, item_to, n_terms): stretches of an item that stand in a document with changes.

    A stretch has at least ``run_words`` words of the item. Of its pairs of neighbouring words at least
    NEAR_SHARE stand in the document at most NEAR_PLACES from where an alignment expects them, with at
    most NEAR_GAP missing in a row. Exact passages are stretches too. Null and empty texts give no rows.
    """
    terms, index = _indexed(documents, items)
    proposed = cut(_proposals(terms, index, run_words - 1, absent=2**62))
    wanted = proposed.join(terms, "item_id").select("item_id", "doc_id", "shift", "pos", "term")
    moved = F.abs(F.col("at") - F.col("pos") - F.col("shift")) <= NEAR_PLACES
    there = wanted.join(index.withColumnRenamed("pos", "at"), ["term", "doc_id"]).where(moved).select("item_id", "doc_id", "shift", "pos").distinct()
    line = Window.partitionBy("item_id", "doc_id", "shift").orderBy("pos")
    starts = there.withColumn("new", (F.col("pos") - F.lag("pos").over(line) > NEAR_GAP + 1).cast("int"))
    stretch = starts.withColumn("stretch", F.sum(F.coalesce("new", F.lit(0))).over(line)).groupBy("item_id", "doc_id", "shift", "stretch").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n"))
    long = stretch.where((F.col("b") - F.col("a") + 2 >= run_words) & (F.col("n") >= NEAR_SHARE * (F.col("b") - F.col("a") + 1)))
    # Alignments next to each other see the same stretch; the fullest one stands for it.
    best = long.groupBy("item_id", "doc_id", "a").agg(F.max_by(F.struct("b", "n"), F.struct("n", "b")).alias("x"))
    return best.select("item_id", "doc_id", F.col("a").cast("bigint").alias("item_from"), (F.col("x.b") + 1).cast("bigint").alias("item_to"), F.col("x.n").cast("bigint").alias("n_terms"))
