"""Keyword-stuffed and link-list pages.

A page is read as a sequence of terms with the breaks (punctuation, line ends, tags) between them. What
makes a term count as stuffing is measured around it, and each signal is enough by itself:

* recurrence gaps: nearly every word near it stands within a gap shorter than a sentence of its next or last
  occurrence (numbers aside, as in lists of prices; within a longer gap where nothing looks like sentences), or
  most pairs of neighbouring terms do; sentences repeat some words, but hardly any pairs of words;
* positional autocorrelation: in its lag window many terms equal the term a fixed lag before them, which
  is the mark of a template;
* links: a large share of the terms near it are words of links;
* noun lists: hardly any function word stands near it, and what stands there is written as a list, in items of a few terms or without any break at all, and is no list of quantities.

Only the last signal needs function words. They are those of the corpus itself: the short words that stand
between two words in a large share of all documents of a language. Keywords may be repeated very often, but
in few documents, and parts of names stand beside numbers and breaks. A language too rare to have learned words is still told apart by the form of its text. Code
and table rows are no stuffing. The statistics are one aggregation that combines before it shuffles;
after it every page is judged in one pass.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.llm.words import INVISIBLE
from lodeatlas.plans.session import cut, ship_package

#: Terms on each side of a term that make its neighbourhood.
REACH = 12
#: Largest gap at which an occurrence counts as recurring, and largest lag of the autocorrelation: keywords
#: come back within the length of a sentence, a sentence that is repeated comes back later.
GAP, LAGS = 20, 20
#: The gap where nothing looks like sentences: items of other numbers of words than these, hardly any function word.
FAR_GAP, SENTENCE_WORDS, MOST_FUNCTION = 60, (9, 47), 0.1
#: Terms of one lag window.
LAG_WINDOW = 96
#: Share of recurring terms, and of recurring pairs of neighbours, from which repetition is unnatural.
LEAST_RECURRING, LEAST_PAIRS = 0.75, 0.5
#: Autocorrelation that shows a template, and the equal terms it must rest on.
LEAST_CORRELATION, LEAST_EQUAL = 0.3, 6
#: Share of words of links in a neighbourhood that makes it a list of links.
LEAST_LINKS = 0.35
#: Terms with one function word at most that may be a list of nouns; most terms of one item of a list;
#: terms without any break that are no sentence; least share of such terms around, most share of numbers.
NOUN_RUN, ITEM_TERMS, UNBROKEN, LEAST_LISTED, MOST_NUMBERS = 24, 3, 30, 0.7, 0.2
#: Characters whose terms are judged at once, and terms that a task numbers before it starts afresh.
BLOCK_CHARACTERS, REMEMBERED = 1_000_000, 500_000
#: A page with a larger share of stuffing is found.
MOST_STUFFED = 0.5

#: Letters of a function word at most, and the share of a language's documents that have it at least.
FUNCTION_LETTERS, FUNCTION_SHARE = 5, 0.2
#: A language is learned from so many documents at least, and from this share of all documents.
LEAST_DOCUMENTS, LEAST_LANGUAGE = 20, 0.001

_MARKS = "".join(chr(c) for c in range(0x300, 0x10000) if unicodedata.category(chr(c)).startswith("M"))
# What ends an item or sentence, and the marks put around links and code.
BREAKS = ",;:!?|#•·…。、！？，；：।؟،؛\n."
LINK_ON, LINK_OFF, CODE_ON, CODE_OFF = "\x01", "\x02", "\x03", "\x04"
_MARKERS = LINK_ON + LINK_OFF + CODE_ON + CODE_OFF
_PLAIN = re.compile(rf"[^\W_]+|[{_MARKERS}]|[{re.escape(BREAKS[:-1])}]|\.(?=\s|\Z)")
_MARKED = re.compile(rf"(?:[^\W_]|[{_MARKS}])+|[{_MARKERS}]|[{re.escape(BREAKS[:-1])}]|\.(?=\s|\Z)")
_CONTROL = re.compile(rf"[{_MARKERS}]")
_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]\x01-\x04]+")
_FENCE = re.compile(r"^```.*?(?:^```[^\n]*$|\Z)", re.M | re.S)
_TABLE_ROW = re.compile(r"^[ \t]*\|.*\|[ \t]*$", re.M)
#: A line of a program: an assignment, call, block or statement. Lines with links are none.
_CODE_LINE = re.compile(
    r"""^(?!.*(?:https?://|www\.))[ \t]*(?:
      [\w.\[\]"']+[ ]?(?:[-+*/|&]?=|:=|->|=>)[ ]?\S.*
      | (?:[\w.]+[ ])*[\w.]+\(.*\)?[:;{,)\]]*
      | (?:def|class|if|elif|else|for|while|try|except|finally|with|switch|case|func|fn)\b.*[:{]
      | (?:return|import|from|raise|yield|var|let|const|public|private|include|package|using)\b[^.?!]*;?
      | ["'\w.-]+["']?:[ ]*["'\[{\d].*
      | [\[\]{}();,]+
      | (?://|\#!|/\*|\*/|<\?|@)\S.*
    )[ \t]*$""",
    re.M | re.X,
)
_CODE_SIGN = re.compile(r"[=(){}\[\];]")
_HREF = re.compile(r"<a\b[^<>]*?href\s*=\s*[\"']?([^\"'<>\s]+)[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
#: Runs of scripts that put no spaces between words; they are read as pairs of neighbouring letters.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿ぁ-ヿ㐀-䶿一-鿿ｦ-ﾝ々]+")


def _pairs(m: re.Match) -> str:
    run = m[0]
    return " " + " ".join(run[i : i + 2] for i in range(max(1, len(run) - 1))) + " "


def tokens_of(text: str | None) -> list[str]:
    """The terms of a text in order, with breaks and the marks around links and code between them."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _CONTROL.sub(" ", text).casefold()
    if "```" in text:
        text = _FENCE.sub(lambda m: f"{CODE_ON}{m[0].replace('`', ' ')}{CODE_OFF}", text)
    if "|" in text:
        text = _TABLE_ROW.sub(lambda m: f"{CODE_ON}{m[0]}{CODE_OFF}", text)
    if "<" in text:
        text = _TAG.sub(" ", _HREF.sub(r" \1 ", text))
    if "\n" in text and _CODE_SIGN.search(text):
        text = _CODE_LINE.sub(lambda m: f"{CODE_ON}{m[0]}{CODE_OFF}", text)
    if "http" in text or "www." in text:
        # A link counts with all of its words.
        text = _URL.sub(lambda m: f" {LINK_ON}{' '.join(_WORD.findall(m[0]))}{LINK_OFF} ", text)
    if plain:
        return _PLAIN.findall(text)
    return _MARKED.findall(_UNSPACED.sub(_pairs, text))


class Numbers(dict):
    """A number for each term: breaks and marks first, then function words, then others; numerals are odd."""

    def __init__(self, function_words: Sequence[str] = ()):
        super().__init__((c, i) for i, c in enumerate(_MARKERS + BREAKS))
        self.n_breaks = len(self)
        for w in sorted(set(function_words)):
            self.setdefault(w, len(self))
        self.n_known = len(self)

    def __missing__(self, term: str) -> int:
        self[term] = n = 2 * len(self) + term[0].isdecimal()
        return n


def _near(key: np.ndarray, gap: int) -> np.ndarray:
    """Whether each place stands within ``gap`` of the next or last place of the same key."""
    order = np.argsort(key, kind="stable")
    again = (key[order][1:] == key[order][:-1]) & (np.diff(order) <= gap)
    out = np.zeros(len(key), bool)
    out[order[1:][again]] = True
    out[order[:-1][again]] = True
    return out


def _again(key: np.ndarray, gap: int) -> np.ndarray:
    """Whether the same key stands within ``gap`` before each place."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][(key[order][1:] == key[order][:-1]) & (np.diff(order) <= gap)]] = True
    return out


def judge(texts: Sequence[str | None], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, terms in stuffing, largest share of recurring terms, largest autocorrelation) of each text."""
    lists = [tokens_of(t) for t in texts]
    sizes = np.array([len(x) for x in lists])
    code = np.fromiter((numbers[t] for x in lists for t in x), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(lists)), sizes)
    is_link = np.cumsum((code == 0).astype(np.int32) - (code == 1)) > 0
    is_code = np.cumsum((code == 2).astype(np.int32) - (code == 3)) > 0
    word = code >= numbers.n_breaks
    # Marks around links are breaks too: a link is an item of its own.
    segment = np.cumsum(~word)[word]
    code, doc, is_link, is_code = code[word], doc[word], is_link[word], is_code[word]
    n = np.bincount(doc, minlength=len(lists))
    if not len(code):
        return n, n * 0, n * 0.0, n * 0.0
    end = np.cumsum(n)
    low_of, high_of = (end - n)[doc], end[doc]
    at = np.arange(len(code))
    low, high = np.maximum(at - REACH, low_of), np.minimum(at + REACH + 1, high_of)

    def around(flags: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flags)]
        return (total[high] - total[low]) / (high - low)

    counted = ~is_code
    key = (doc.astype(np.int64) << 40) + code
    pair = np.zeros(len(key), bool)
    twins = (key[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ key[1:].astype(np.uint64)
    again = _near(twins, GAP) & (doc[:-1] == doc[1:])
    pair[:-1] |= again
    pair[1:] |= again
    # Short texts don't repeat enough to be judged by it.
    enough = high - low > REACH
    wordy = counted & ((code < numbers.n_known) | (code % 2 == 0))
    words = np.maximum(around(wordy), 4 / (2 * REACH + 1))
    recurring = around(_near(key, GAP) & wordy) / words * enough
    pairs = around(pair & counted) * enough
    links = around(is_link)

    # Sentences have different function words; the same one again and again is a keyword that others use in sentences.
    function = (code >= numbers.n_breaks) & (code < numbers.n_known) & ~_again(key, 2 * REACH)
    where = np.unique(segment.astype(np.int64) + (doc.astype(np.int64) << 32), return_inverse=True)[1]
    items = np.bincount(where)[where]
    unspaced = np.array([bool(t and _UNSPACED.search(t)) for t in texts])
    listed, unbroken = around(items <= ITEM_TERMS), around((items >= UNBROKEN) & ~unspaced[doc])
    spoken = np.bincount(where, weights=wordy)[where]
    sentences = around((spoken >= SENTENCE_WORDS[0]) & (spoken <= SENTENCE_WORDS[1]))
    apart = (around(function) < MOST_FUNCTION) & (sentences < 0.5)
    recurring = np.maximum(recurring, around(_near(key, FAR_GAP) & wordy) / words * enough * apart)
    numerals = around((code >= numbers.n_known) & (code % 2 == 1))
    nouns = (around(function | is_code) <= 1 / NOUN_RUN) & (n[doc] >= NOUN_RUN) & ((listed + unbroken >= LEAST_LISTED) & (numerals <= MOST_NUMBERS) | (unbroken >= LEAST_LISTED))

    starts = np.concatenate([np.arange(e - k, e, LAG_WINDOW) for e, k in zip(end, n)])
    width = np.diff(np.r_[starts, len(code)])
    best = np.zeros(len(starts))
    for lag in range(1, min(LAGS, len(key) - 1) + 1):
        same = np.zeros(len(key), np.int64)
        same[lag:] = (key[lag:] == key[:-lag]) & counted[lag:]
        best = np.maximum(best, np.add.reduceat(same, starts))
    best = np.where(best >= LEAST_EQUAL, best, 0) / width
    correlation = np.repeat(best, width)

    mask = counted & ((recurring >= LEAST_RECURRING) | (pairs >= LEAST_PAIRS) | (links >= LEAST_LINKS) | (correlation >= LEAST_CORRELATION) | nouns)
    filled = n > 0
    first = (end - n)[filled]
    most = lambda x: _spread(np.maximum.reduceat(x, first), filled)
    return n, np.bincount(doc, weights=mask, minlength=len(lists)).astype(np.int64), most(recurring), most(correlation)


def _spread(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    out = np.zeros(len(filled))
    out[filled] = values
    return out


def stuffed(text: str | None, function_words: Sequence[str] = ()) -> tuple[int, int, float]:
    """(terms, terms in stuffing, largest autocorrelation) of one text; zeros for null and empty texts."""
    n, m, _, c = judge([text], Numbers(function_words))
    return int(n[0]), int(m[0]), float(c[0])


def function_words(documents: DataFrame) -> list[str]:
    """The function words of the corpus: short words between words in a large share of the documents of a language.

    Languages are the labels as they are; wrong ones blur the shares a little, and labels of too few
    documents are not learned from. As there are at most 1 / LEAST_LANGUAGE languages, with at most
    (short words of a mean document) / FUNCTION_SHARE words each, what is gathered is bounded.
    """
    lang = F.lower(F.regexp_extract(F.coalesce("lang", F.lit("")), r"^\s*([A-Za-z]*)", 1)) if "lang" in documents.columns else F.lit("")
    rows = documents.where("text is not null").select(lang.alias("lang"), F.lower("text").alias("text"))
    short = F.regexp_extract_all("text", F.lit(rf"(?<=[\p{{L}}\p{{M}}][ \t])[\p{{L}}\p{{M}}]{{1,{FUNCTION_LETTERS}}}(?=[ \t]\p{{L}})"), F.lit(0))
    # "" stands for the document itself.
    words = rows.select("lang", F.explode(F.array_append(F.array_distinct(short), F.lit(""))).alias("word"))
    counts = cut(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    totals = counts.where("word = ''").select("lang", F.col("n").alias("docs"))
    least = max(LEAST_DOCUMENTS, LEAST_LANGUAGE * (totals.agg(F.sum("docs")).first()[0] or 0))
    learned = counts.where("word <> ''").join(totals.where(F.col("docs") >= least), "lang").where(F.col("n") >= FUNCTION_SHARE * F.col("docs"))
    return [r.word for r in learned.select("word").distinct().toLocalIterator()]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts in blocks of a bounded number of characters; a longer text is a block of its own."""
    texts = batch.column(1).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > BLOCK_CHARACTERS:
            yield batch.column(0).slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield batch.column(0).slice(start), texts[start:]


def stuffing(documents: DataFrame) -> DataFrame:
    """(doc_id, n_terms, n_stuffed, recurring, correlation) of every document; a null text has no terms.

    Repeated rows of an id give repeated rows. Columns other than doc_id, text and lang are ignored,
    whatever their names; lang may be missing.
    """
    ship_package(documents.sparkSession)
    known = documents.sparkSession.sparkContext.broadcast(function_words(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(known.value)
        for batch in batches:
            for ids, texts in _blocks(batch):
                if len(numbers) > REMEMBERED:
                    numbers = Numbers(known.value)
                n, m, r, c = judge(texts, numbers)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(r, pa.float64()), pa.array(c, pa.float64())], names=["doc_id", "n_terms", "n_stuffed", "recurring", "correlation"])

    rows = documents.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_terms bigint, n_stuffed bigint, recurring double, correlation double")


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id): documents with more than half of their terms in stuffing, each once."""
    found = stuffing(documents).where(F.col("n_stuffed") > MOST_STUFFED * F.col("n_terms"))
    return found.select("doc_id").where("doc_id is not null").distinct()
