"""A dictionary of names for noisy text: exact mentions by automaton, the rest by similarity.

The dictionary holds entries of a kind (family, variant, maker, filler). All spellings that are written
without a mistake are patterns of one Aho-Corasick automaton that runs over the letters of a text, with
the gaps between its words kept aside. The longest mentions that start and end at a gap, or at another
mention, win and do not overlap. What they leave is compared by similarity of token sets: the tokens left
against the tokens of the names, in any order, where a token stands for another one within an edit
distance (found by a deletion index) or without its vowels. Neighbouring tokens may have been split or
joined by mistake, so joined runs of them are tried as tokens too.

What a text says depends only on the names it touches: those that occur in its letters, and those that are
similar to what is left. ``touched_exactly`` and ``touched_by_similarity`` give them, so that a dictionary
too large for one task can be asked in parts and read with the names found (``canonical.py``).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeatlas.plans.session import cut

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "абвгдеёзікмнорстуухѕјԁһӏαβεικνορτυχωѵԛԝɑ",
    "a6brdee3ikmhopctyyxsjdhlabeiknoptuxwvqwa",
)
_WORD = re.compile(r"[a-z]+|[^\W\d_a-z]+|\d+")
_VOWELS = re.compile("[aeiou]")

#: Times and share of the different values from which a word is a filler.
FILLER_TIMES, FILLER_SHARE = 5, 0.002
#: Share of the makers that have a last word in common which may be left off.
ENDING_SHARE = 0.005
#: Readings kept per task, so that words that are typed again and again are read once.
REMEMBERED = 200_000
#: Least share of the tokens of a name that a token set must have, and of both sets together.
LEAST_TOKENS, LEAST_ALIKE = 0.5, 0.66


def fold(text: str) -> str:
    """Lower case, compatible forms unified, accents dropped, look-alike letters of other scripts replaced."""
    text = unicodedata.normalize("NFKC", text).casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        text = text.translate(_LOOKALIKES)
    return text


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; any value above ``most`` means more than that."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def deletions(word: str, most: int) -> set[str]:
    out = {word}
    for n in range(1, min(most, len(word) - 1) + 1):
        out.update("".join(word[i] for i in range(len(word)) if i not in gone) for gone in combinations(range(len(word)), n))
    return out


def allowed(length: int) -> int:
    """Edits that a name of this length may have."""
    return 0 if length < 3 else 1 if length < 7 else 2


class Similar:
    """Names within an edit distance or without vowels, by a deletion index."""

    def __init__(self, names: set[str], skeletons: bool = True):
        self.names = names
        self.index: dict[str, list[str]] = defaultdict(list)
        for n in names:
            for d in deletions(n, allowed(len(n))):
                self.index[d].append(n)
        self.bare: dict[str, list[str]] = defaultdict(list)
        if skeletons:
            for n in names:
                bare = _VOWELS.sub("", n)
                if len(bare) >= 3 and bare != n:
                    self.bare[bare].append(n)

    def near(self, word: str) -> list[tuple[int, str]]:
        """(edits, name) of all names within the edits they allow, closest first; 0 for the name itself only."""
        if word in self.names:
            return [(0, word)]
        hits: dict[str, int] = {}
        for d in deletions(word, allowed(len(word) + 1)):
            for n in self.index.get(d, ()):
                if n not in hits:
                    hits[n] = distance(word, n, allowed(len(n)))
        return sorted((e, n) for n, e in hits.items() if e <= allowed(len(n)))

    def touched(self, word: str) -> set[str]:
        """All names on which the answer for a word depends."""
        return {n for _, n in self.near(word)} | set(self.bare.get(word, ()))

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, name) of the closest name, or None; of equally close names none is closest."""
        close, bare = self.near(word), self.bare.get(word, ())
        if len(bare) == 1 and (not close or close[0][0] > 1):
            return 1, bare[0]
        if not close or (len(close) > 1 and close[1][0] == close[0][0]):
            return None
        return close[0]


class TokenSets:
    """Names of several tokens, by their tokens."""

    def __init__(self, names: dict[str, list[str]]):
        self.tokens = {n: frozenset(ts) for n, ts in names.items() if len(ts) > 1}
        self.with_token: dict[str, set[str]] = defaultdict(set)
        for n, ts in self.tokens.items():
            for t in ts:
                self.with_token[t].add(n)
        self.alike = Similar(set(self.with_token), skeletons=False)

    def touched(self, words: list[str]) -> set[str]:
        return {n for w in words for _, t in (self.alike.near(w) if len(w) > 1 else ()) for n in self.with_token[t]} | {n for w in words for n in self.with_token.get(w, ())}

    def find(self, words: list[str]) -> tuple[int, str, set[int]] | None:
        """(edits, name, places of the words used) of the name most alike; of equally like names none."""
        best: list[tuple[float, int, str, set[int]]] = []
        for n in self.touched(words):
            own, edits, used = self.tokens[n], 0, set()
            for t in own:
                fits = [(distance(w, t, allowed(len(t))), i) for i, w in enumerate(words) if i not in used]
                e, i = min(fits, default=(1, -1))
                if i >= 0 and e <= allowed(len(t)):
                    used.add(i)
                    edits += e
            alike = 2 * len(used) / (len(own) + len(words))
            if len(used) > LEAST_TOKENS * len(own) and alike >= LEAST_ALIKE:
                best.append((-alike, edits, n, used))
        best.sort(key=lambda b: b[:3])
        if not best or (len(best) > 1 and best[1][:2] == best[0][:2]):
            return None
        return best[0][1:]


@dataclass
class Reading:
    """What a text says: the family and variants found, the edits it took, numbers and left-over words in order."""

    family: str = ""
    variants: list[str] = field(default_factory=list)
    edits: int = 0
    rest: list[str] = field(default_factory=list)
    maker: str = ""


def spaced(name: str) -> str:
    """The words of a name in its unified form, with blanks between them."""
    return " ".join(_WORD.findall(fold(name)))


def squeeze(name: str) -> str:
    """The letters and digits of a name, by which it is known here."""
    return spaced(name).replace(" ", "")


def shared_endings(makers: Iterable[list[str]]) -> set[str]:
    """The last words that several makers, and a share of all of them, have in common; at most 1 / ENDING_SHARE."""
    makers = list(makers)
    last = Counter(words[-1] for words in makers if len(words) > 1)
    return {w for w, n in last.items() if n > 1 and n >= ENDING_SHARE * len(makers)}


#: Kinds of names.
FAMILY, VARIANT, MAKER, FILLER = range(4)


class NameDictionary:
    """Families with their variants, makers and fillers; picklable, a few megabytes for 10,000 families.

    ``fillers`` are words that mean nothing beside a name, learned from the texts (``frequent_words``).
    The last words that several makers share (as in "x labs", "y labs") may be left off. Names are
    known by their letters and digits.
    """

    def __init__(self, entries: Iterable[tuple[str, str]], makers: Iterable[str] = (), fillers: Iterable[str] = (), endings: Iterable[str] | None = None):
        pairs = {(spaced(f), spaced(v)) for f, v in entries}
        listed = [words for m in makers if (words := spaced(m).split())]
        shared = shared_endings(listed) if endings is None else set(endings)
        held = {"".join(w) for w in listed} | {"".join(w[:-1]) for w in listed if len(w) > 1 and w[-1] in shared}
        self._build({f for f, _ in pairs}, {v for _, v in pairs}, held, {spaced(x) for x in fillers} | shared)
        self.of_family: dict[str, set[str]] = defaultdict(set)
        for f, v in pairs:
            if v:
                self.of_family[squeeze(f)].add(squeeze(v))
        #: Whether digits belong to names; otherwise they are versions and the like.
        self.numbered = any(c.isdigit() for f, v in pairs for c in f + v)

    def _build(self, families: set[str], variants: set[str], makers: set[str], fillers: set[str]) -> None:
        self.families = {squeeze(f): f for f in sorted(families, reverse=True) if f}
        self.variants = {squeeze(v) for v in variants if v}
        self.makers = {m for m in makers if m and m not in self.families}
        self.fillers = {squeeze(x) for x in fillers if x} - self.families.keys() - self.variants
        self.like_family = Similar(set(self.families))
        self.family_tokens = TokenSets({k: f.split() for k, f in self.families.items()})
        self.like_maker = Similar({m for m in self.makers if len(m) >= 5}, skeletons=False)
        self.like_variant = Similar(self.variants, skeletons=False)
        self.longest = max(map(len, self.variants), default=0)
        self._automaton = None
        self._memo: dict[tuple, Reading] = {}

    @classmethod
    def of_names(cls, names: Iterable[tuple[int, str]]) -> NameDictionary:
        """The dictionary of single names (kind, name), without the pairs of families and variants."""
        kinds: list[set[str]] = [set() for _ in range(4)]
        for kind, name in names:
            kinds[kind].add(name)
        d = cls.__new__(cls)
        d._build(*kinds)
        d.of_family, d.numbered = defaultdict(set), True
        return d

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None, "_memo": {}}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for kind, names in ((FILLER, self.fillers), (MAKER, self.makers), (VARIANT, self.variants), (FAMILY, self.families)):
                for n in names:
                    a.add_word(n, (kind, n))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def _hits(self, joined: str) -> Iterable[tuple[int, tuple[int, str]]]:
        return self.automaton.iter(joined) if len(self.automaton) else ()

    def touched_exactly(self, words: list[str]) -> set[tuple[int, str]]:
        """(kind, name) of the names that occur anywhere in the joined words."""
        out = set()
        joined = "".join(words)
        for kind, names in enumerate((self.families, self.variants, self.makers, self.fillers)):
            hits = {n for _, (_, n) in self._hits(joined) if n in names}
            out |= {(kind, self.families[n] if kind == FAMILY else n) for n in hits}
        return out

    def touched_by_similarity(self, words: list[str], exact: NameDictionary) -> set[tuple[int, str]]:
        """(kind, name) of the names similar to what the names of ``exact`` leave of the words."""
        families: set[str] = set()
        out: set[tuple[int, str]] = set()
        for run in exact.unexplained(words)[1]:
            for i in range(len(run)):
                for j in range(i + 1, min(i + 3, len(run)) + 1):
                    for word, _ in exact.split("".join(run[i:j])):
                        if len(word) >= 3:
                            families |= self.like_family.touched(word)
            families |= self.family_tokens.touched(run)
            for w in run:
                out |= {(VARIANT, n) for n in self.like_variant.touched(w)} | {(MAKER, n) for n in self.like_maker.touched(w)}
        return out | {(FAMILY, self.families[n]) for n in families}

    def _mentions(self, words: list[str]) -> list[tuple[int, int, int, str]]:
        """Longest mentions (start, end, kind, name) over the joined words that do not overlap and end at gaps."""
        joined = "".join(words)
        gaps, at = {0}, 0
        for w in words:
            at += len(w)
            gaps.add(at)
        found = []
        for end, (kind, name) in self._hits(joined):
            start = end + 1 - len(name)
            # Short names must be whole words; longer ones may be glued to another mention.
            if (start in gaps and end + 1 in gaps) or len(name) >= 5 or (kind < MAKER and (start in gaps or end + 1 in gaps)):
                found.append((start, end + 1, kind, name))
        found.sort(key=lambda m: (-(m[1] - m[0]), m[2], m[0]))
        chosen: list[tuple[int, int, int, str]] = []
        for m in found:
            if all(m[1] <= c[0] or m[0] >= c[1] for c in chosen):
                chosen.append(m)
        while True:
            edges = gaps | {x for m in chosen for x in m[:2]}
            firm = [m for m in chosen if (m[0] in gaps or any(m[0] == c[1] for c in chosen)) and (m[1] in gaps or any(m[1] == c[0] for c in chosen))]
            if len(firm) == len(chosen) or not edges:
                return sorted(firm)
            chosen = firm

    def words_of(self, text: str, numbered: bool | None = None) -> tuple[list[str], list[str]]:
        """The words of a text that may name something, and its numbers if these belong to no names."""
        words = _WORD.findall(fold(text))
        if self.numbered if numbered is None else numbered:
            return words, []
        return [w for w in words if not w.isdigit()], [w for w in words if w.isdigit()]

    def read(self, text: str) -> Reading:
        """The reading of a text; numbers and words that mean nothing here stay in ``rest``."""
        return self.read_words(*self.words_of(text))

    def unexplained(self, words: list[str]) -> tuple[list[tuple[int, int, int, str]], list[list[str]]]:
        """The mentions in the words, and the runs of words between them."""
        free: list[list[str]] = [[]]
        cuts = [0]
        for w in words:
            cuts.append(cuts[-1] + len(w))
        mentions = self._mentions(words)
        joined, at = "".join(words), 0

        def loose(a: int, b: int) -> None:
            edges = sorted({a, b, *(c for c in cuts if a < c < b)})
            free[-1].extend(joined[x:y] for x, y in zip(edges, edges[1:]) if y > x)

        for start, end, _, _ in mentions:
            loose(at, start)
            free.append([])
            at = end
        loose(at, len(joined))
        return mentions, free

    def read_words(self, words: list[str], numbers: Sequence[str] = ()) -> Reading:
        key = tuple(words)
        known = self._memo.get(key)
        if known is None:
            known = self._read(words)
            if len(self._memo) < REMEMBERED:
                self._memo[key] = known
        return Reading(known.family, list(known.variants), known.edits, [*numbers, *known.rest], known.maker)

    def _read(self, words: list[str]) -> Reading:
        got = Reading()
        mentions, free = self.unexplained(words)
        # One family mention stands; with several, the last one, as makers stand in front.
        for _, _, kind, name in mentions:
            if kind == FAMILY:
                got.family = name
            elif kind == VARIANT:
                got.variants.append(name)
            elif kind == MAKER:
                got.maker = got.maker or name
        for run in free:
            self._similar(run, got)
        return got

    def _similar(self, run: list[str], got: Reading) -> None:
        """Read a run of unexplained words: the family first, then makers and variants."""
        left = list(run)
        if not got.family and left:
            best = None
            for i in range(len(left)):
                for j in range(i + 1, min(i + 3, len(left)) + 1):
                    for word, variant in self.split("".join(left[i:j])):
                        hit = self.like_family.find(word) if len(word) >= 3 else None
                        if hit:
                            rank = (hit[0] + (j - i - 1) * 0.1 + bool(variant) * 0.2, -(j - i))
                            if best is None or rank < best[0]:
                                best = (rank, {*range(i, j)}, hit, variant)
            if best is None and (set_of := self.family_tokens.find(left)):
                best = ((), set_of[2], set_of[:2], "")
            if best:
                _, used, hit, variant = best
                got.family, got.edits = hit[1], got.edits + hit[0]
                if variant:
                    got.variants.append(variant)
                left = [w for i, w in enumerate(left) if i not in used]
        for w in left:
            maker = self.like_maker.find(w) if len(w) >= 6 else None
            variant = self.like_variant.find(w) if len(w) >= 3 and w not in self.fillers else None
            if variant and (maker is None or variant[0] <= maker[0]):
                got.variants.append(variant[1])
                got.edits += variant[0]
            elif maker:
                got.maker = got.maker or maker[1]
            else:
                got.rest.append(w)

    def split(self, joined: str) -> Iterator[tuple[str, str]]:
        """The word itself, and what is left of it when a variant is glued to its end or front."""
        yield joined, ""
        for n in range(1, min(self.longest, len(joined) - 4) + 1):
            for piece, rest in ((joined[-n:], joined[:-n]), (joined[:n], joined[n:])):
                if piece in self.variants:
                    yield rest, piece


def frequent_words(values: DataFrame, text: str) -> list[str]:
    """Words that stand in so large a share of the different values that they can't tell these apart.

    At most 1 / FILLER_SHARE times the words of a mean value are frequent, so what is gathered is bounded.
    """
    spelled = values.where(F.col(text).isNotNull()).select(F.lower(text).alias("v")).distinct()
    words = spelled.select(F.explode(F.array_append(F.array_distinct(F.regexp_extract_all("v", F.lit(r"\p{L}+"), F.lit(0))), F.lit(""))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    rows = cut(counts.where(F.col("n") >= FILLER_TIMES))
    n = (rows.where("word = ''").first() or [None, 0])[1]
    often = [fold(r.word) for r in rows.where((F.col("word") != "") & (F.col("n") >= FILLER_SHARE * n)).toLocalIterator()]
    return sorted(set(often))


def fillers_beside(often: Iterable[str], names: NameDictionary) -> set[str]:
    """The frequent words that neither are a name of the dictionary nor may be a misspelt family."""
    held = names.families.keys() | names.variants | names.makers
    return {w for w in often if w not in held and not names.like_family.touched(w)}
