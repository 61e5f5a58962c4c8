"""Noise in text from scanned pages: found, and repaired into continuous paragraphs.

The words of all pages are counted once.  A text is then read as a stream of characters without its line
breaks, in which a word may have been split, merged with its neighbour, broken by a hyphen or misread; the
cheapest sequence of words under the counts (a noisy channel decoded by dynamic programming) tells which kinds
of damage are present, and is what the repair writes: a break mark that it drops, a confusion that it uses, a
blank that it adds or leaves out.  Stroke keys and word counts only find what a stretch may be read as.  Most of
a text consists of words beyond doubt; the lattice is built only around the others, with their neighbours.
Running headers and page numbers are lines at the edge of a page that carry the title of the file or the name of
a journal, or a number.  Paragraphs are the cheapest partition of the repaired lines, by dynamic programming.

The counts of a corpus of more than `REFERENCE` words are brought down to that many, so that a slip which a large
corpus repeats does not pass for a word; the words that reach the tasks are bounded by it too.

Defined results: null and blank texts have no damage and repair to themselves; of a record delivered again
find_noise gives its kinds once, repair_texts one row for each row it gets; a file without any title has headers
by journal name alone; words never seen elsewhere are left as they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each character written as the strokes it is confused by, so that words that scanning confuses
# (rn and m, ri and n, cl and d, li and h, ii and u, vv and w, e and c, i and l and 1 and !, o and 0, ...) come out equal.
STROKES = str.maketrans(
    {"0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "@": "a", "9": "g", "5": "s", "$": "s", "8": "b", "6": "b", "c": "e", "3": "e", "2": "z", "n": "rl", "m": "rrl", "d": "el", "h": "ll", "u": "ll", "w": "vv"}
)
NUMERALS = str.maketrans("lIi|!OoSsBZzgq", "11111005582299")  # fixed values: letters misread for digits
RATIO, LEAST = 8, 4  # how much commoner, and how common, the true word is
REFERENCE = 50_000_000  # words to which the counts of a larger corpus are brought down
MOST_WORDS = 3_000_000  # words seen twice in as many; more is an error
MOST_TITLES = 300_000  # files whose titles are broadcast, some 100 bytes each; more are joined in a shuffle, `SALTS` parts to a file
SALTS = 16
HEADER = 160  # characters of a running header at most
HEAD = 6  # strokes by which the beginnings of counted words are looked up
BREAK = "\x02"  # stands for a break mark and its gap
# Prices in a region: of a letter of an unknown word, a blank within a word, a blank that is missing, a break mark that stays.
UNKNOWN, SPLIT, MERGED, KEPT = 3.0, 3.0, 5.0, 25.0

_STRIP = ".,;:()[]{}\"'“”„«»‘’–—…?¿¡!*•§©-‐¬\xad"
# Joints of a token, and writing without blanks, whose characters are no part of a word that could be judged here.
_PARTS = re.compile("[-/–—‐+=·_’'\u0e00-\u0e7f\u3000-\u9fff\uac00-\ud7af\uff00-\uffef“”…]+")
_CLEAN_NUMBER = re.compile(r"[+\-–<>=≤≥~±]*\d[\d.,:%°]*")
_NUMBERISH = re.compile(r"[+\-–<>=]*[\dlIi|!OoSsBZzgq.,:]*\d[\dlIi|!OoSsBZzgq.,:]*%?|[SZBlIOo]\.\d+%?|\d+\.[SZBlIOo]%?|[SZBlIOo]{1,2}%")
_ODD_INSIDE = re.compile(r"[^\W\d_][0-9!|@$]+[^\W\d_]|^[0-9!|@$][^\W\d_]{3,}|[^\W\d_]{3,}[0|@$]$|[^\W\d_][!]$")
_GAP = re.compile(r"([-\xad‐¬])(?<=[\w!@|$][-\xad‐¬])([ \t]*\n[ \t\n]*|[ \t]+)(?=[\w!@|$])")
_TOKEN = re.compile(r"\S+")
_AFTER = re.compile(r"[\w!@|$]+")
_CODE = re.compile(r"[A-Z]\d")
_LATIN = re.compile(r"[a-zA-Z]")


def mend(text: str, judge: Callable[[str, str, str, str], str]) -> str:
    """The text with every mark and gap between two halves of a possible word replaced by judge(left, mark, gap, right)."""
    out, last = [], 0
    for m in _GAP.finditer(text):
        begin = m.start()
        while begin > last and (text[begin - 1].isalnum() or text[begin - 1] in "_!@|$"):
            begin -= 1
        left, right = text[begin : m.start()], _AFTER.match(text, m.end())
        if left and right and left[0].isalnum() and right[0][-1].isalnum():
            out += (text[last : m.start()], judge(left, m[1], m[2], right[0]))
            last = m.end()
    return "".join((*out, text[last:])) if out else text


def parts_at(token: str) -> list[tuple[int, int]]:
    """Where the words of a token stand in it, without marks and joints."""
    out, begin = [], 0
    for end, after in (*((m.start(), m.end()) for m in _PARTS.finditer(token)), (len(token), 0)):
        part = token[begin:end]
        left = len(part) - len(part.lstrip(_STRIP))
        if kept := part.strip(_STRIP):
            out.append((begin + left, begin + left + len(kept)))
        begin = after
    return out


def parts_of(token: str) -> list[str]:
    return [q for p in _PARTS.split(token.strip(_STRIP)) if (q := p.strip(_STRIP))]


def shape(part: str) -> str:
    return re.sub(r"\d", "0", part)


def counted(part: str) -> str:
    """The key under which a part of a token is counted: numbers by their shape, words in lower case."""
    return shape(part) if part[0].isdigit() or _NUMBERISH.fullmatch(part) else part.lower()


def count_parts(texts: DataFrame, least: int = 2, reference: int = REFERENCE) -> dict[str, float]:
    """How often each word (or shape of number) stands in all texts, or in `reference` words of them, of those seen `least` times; size checked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    # What a mark at a line's end may have broken is counted as neither word nor halves; a soft mark is none.
                    tokens.update(mend(text, lambda left, mark, gap, right: "" if mark in "\xad¬" else "\x7f" if "\n" in gap else mark + gap).split())
            out: Counter = Counter()
            for token, n in tokens.items():
                for part in parts_of(token):
                    out[counted(part)] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["part", "n"])

    counts = texts.mapInArrow(count, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).persist()
    try:
        scale = min(1.0, reference / max(counts.agg(F.sum("n")).first()[0] or 0, 1))
        rows = counts.where(F.col("n") * scale >= least).limit(MOST_WORDS + 1).collect()
    finally:
        counts.unpersist()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words")
    return {r.part: r.n * scale if scale < 1 else r.n for r in rows}


class Region(NamedTuple):
    """A stretch to decode: its atoms, where they stand in the text, and the gaps between them (None a blank, else a break)."""

    atoms: tuple[str, ...]
    spans: tuple[tuple[int, int], ...]
    gaps: tuple[tuple[str, str] | None, ...]


def token_before(text: str, at: int) -> tuple[int, int]:
    """Where the last token before a place stands; empty if there is none."""
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin and not text[begin - 1].isspace():
        begin -= 1
    return begin, end


def token_after(text: str, at: int) -> tuple[int, int]:
    m = _TOKEN.search(text, at)
    return m.span() if m else (len(text), len(text))


def occurrences(text: str, tokens: set[str]) -> list[tuple[int, int]]:
    """Where these tokens stand in the text, in order."""
    out = []
    for token in tokens:
        at, size = text.find(token), len(token)
        while at >= 0:
            if (not at or text[at - 1].isspace()) and (at + size == len(text) or text[at + size].isspace()):
                out.append((at, at + size))
            at = text.find(token, at + size)
    return sorted(out)


def regions(text: str, doubtful: set[str], breaks: list[tuple[str, str, str, str]]) -> Iterator[Region]:
    """Every run of doubtful tokens with the neighbours on either side that neither punctuation nor a blank line parts from it."""
    marks = iter(breaks)
    atoms: list[str] = []
    spans: list[tuple[int, int]] = []
    gaps: list[tuple[str, str] | None] = []

    def flush() -> Iterator[Region]:
        if atoms:
            yield Region(tuple(atoms), tuple(spans), tuple(gaps))
        atoms.clear()
        spans.clear()
        gaps.clear()

    def add(begin: int, end: int, own: tuple[int, int]) -> None:
        atoms.append(text[begin + own[0] : begin + own[1]])
        spans.append((begin + own[0], begin + own[1]))

    def beside(a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Whether two tokens that follow each other may hold one word."""
        return a[0] < a[1] and b[0] < b[1] and text[a[1] - 1].isalnum() and text[b[0]].isalnum() and text.count("\n", a[1], b[0]) < 2

    places = occurrences(text, doubtful)
    for i, (begin, end) in enumerate(places):
        before = token_before(text, begin)
        if beside(before, (begin, end)):
            if not atoms and (own := parts_at(text[before[0] : before[1]])):
                add(*before, own[-1])
        else:
            yield from flush()
        token = text[begin:end]
        for j, (b, e) in enumerate(parts_at(token)):
            if j:
                yield from flush()
            for k, half in enumerate(token[b:e].split(BREAK)):
                gap, place = None, (begin + b, begin + b + len(half))
                if k:
                    left, *gap, right = next(marks)
                    # Writing without blanks has no parts; there the halves are what stands beside the mark.
                    if not atoms[-1]:
                        atoms[-1], spans[-1] = left, (spans[-1][1] - len(left), spans[-1][1])
                    half, gap = half or right, tuple(gap)
                    place = (begin + b, begin + b + len(half))
                if atoms:
                    gaps.append(gap)
                atoms.append(half)
                spans.append(place)
                b += len(half) + 1
        after = token_after(text, end)
        following = places[i + 1] if i + 1 < len(places) else (len(text), len(text))
        if after == following and after[0] < after[1]:
            continue
        if atoms and beside((begin, end), after) and (own := parts_at(text[after[0] : after[1]])):
            gaps.append(None)
            add(*after, own[0])
            if len(own) == 1 and token_after(text, after[1]) == following and beside(after, following):
                continue  # the neighbour of both
        yield from flush()


class Reader:
    """Judges and repairs tokens under word counts."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = math.log(sum(counts.values()) + 1)
        self.alike: dict[str, tuple[int, str]] = {}
        for word, n in counts.items():
            if not word.isdigit() and word.isalpha():
                key = word.translate(STROKES)
                self.alike[key] = max(self.alike.get(key, (0, "")), (n, word))
        self.heads: dict[str, int] = {}  # beginning in strokes -> strokes of the longest word that begins so
        for word in counts:
            key = word.translate(STROKES)
            self.heads[key[:HEAD]] = max(len(key), self.heads.get(key[:HEAD], 0))
        self.longest = max(map(len, counts), default=0)
        self.clean: set[str] = set()
        self.reading = lru_cache(300_000)(self._reading)
        self.path = lru_cache(100_000)(self._path)

    def _reading(self, part: str) -> tuple[str, float] | None:
        """(true word, cost) if the part is a misread word or number, else None."""
        if _CLEAN_NUMBER.fullmatch(part) or not _LATIN.search(part):
            return None
        if _NUMBERISH.fullmatch(part) and not part.isalpha():
            if _CODE.match(part):
                return None
            true = part.translate(NUMERALS)
            own, other = self.counts.get(shape(part), 0), self.counts.get(shape(true), 0)
            return (true, self.total - math.log(other) + math.log(RATIO)) if other >= LEAST and other >= RATIO * own else None
        low = part.lower()
        n, other = self.alike.get(low.translate(STROKES), (0, ""))
        if other == low or len(other) < 2 or len(low) < 2:
            return None
        own, odd = self.counts.get(low, 0), bool(_ODD_INSIDE.search(part))
        if len(low) < 3 and not odd or not (n >= LEAST and n >= RATIO * max(own, 0.5) or odd and n > own):
            return None
        # At this price a word on its own is read as the other one if that is RATIO times commoner, an odd one if it is commoner.
        return other, self.total - math.log(n) + (0.0 if odd else math.log(RATIO))

    def misread(self, token: str) -> bool:
        return any(self.reading(p) is not None for p in parts_of(token))

    def known(self, word: str) -> int:
        return self.counts.get(word.lower(), 0)

    def broken(self, left: str, mark: str, gap: str, right: str) -> bool:
        """Whether a break mark between two halves is no hyphen of the word itself."""
        if mark in "\xad¬":
            return True
        joined, kept = self.known(left + right), min(self.known(left), self.known(right))
        if "\n" not in gap:
            return joined >= LEAST and joined > kept and right[:1].islower() or (self.reading(left + right) is not None and not self.known(right) and right[:1].islower())
        if left.isdigit() or right.isdigit():
            return False
        if joined:
            # A hyphen that belongs to the word leaves two words that are common on their own.
            return joined > kept or joined * RATIO > kept and not self.known(right)
        if kept >= LEAST:
            return False
        return self.reading(left + right) is not None or self.known(left) < LEAST or self.known(right) < LEAST

    def damage(self, text: str) -> tuple[bool, bool]:
        """(hyphenation, misreading) anywhere in the text, as the cheapest path over its doubtful regions has them."""
        breaks: list[tuple[str, str, str, str]] = []

        def note(left: str, mark: str, gap: str, right: str) -> str:
            breaks.append((left, mark, gap, right))
            return BREAK

        hyphen = bad = False
        marked = mend(text.replace(BREAK, " "), note)
        for r in regions(marked, self.doubtful(marked), breaks):
            # What can tell nothing new is not decoded.
            if not (bad and (hyphen or not any(r.gaps))):
                for _, _, joined, confused in self.path(r.atoms, r.gaps):
                    hyphen, bad = hyphen or joined, bad or confused is not None
        return hyphen, bad

    def doubtful(self, text: str) -> set[str]:
        return {t for t in set(text.split()) - self.clean if not self.certain(t)}

    def certain(self, token: str) -> bool:
        """Whether the token is beyond doubt: no break, and every part frequent or no word of Latin letters, and none misread."""
        for p in parts_of(token):
            if BREAK in p or self.reading(p) is not None or (len(p) > 1 and p.isalpha() and self.known(p) < LEAST and _LATIN.search(p)):
                return False
        if len(self.clean) < 2_000_000:
            self.clean.add(token)
        return True

    def _path(self, atoms: tuple[str, ...], gaps: tuple[tuple[str, str] | None, ...]) -> list[tuple[int, int, bool, str | None]]:
        """(begin, end, break mark dropped, true word if misread) of each word on the cheapest way to read the atoms' characters; a gap is a blank (None) or a break (mark, gap).

        A word may begin or end inside an atom (merged) or cross a blank (split) only if it is known or confused with
        a known one; one that crosses a break must be possible as a broken word.
        """
        chars, at, ends = "".join(atoms), 0, {}
        for atom, gap in zip(atoms, (*gaps, None)):
            at += len(atom)
            ends[at] = gap
        size, low = len(chars), chars.lower()
        low = low if len(low) == size else chars
        edges = {0, *ends}
        inner, broken_up = sorted(g for g in ends if g < size), any(gaps)
        whole = {b: e for b, e in zip((0, *ends), ends)}
        keys = [c.translate(STROKES) for c in low]
        key_at = [0, *accumulate(map(len, keys))]
        strokes = "".join(keys)
        cost, back = [0.0] + [math.inf] * size, [(0, False, None)] * (size + 1)
        counts, alike = self.counts, self.alike
        for begin in range(size):
            if cost[begin] == math.inf:
                continue
            low_key = key_at[begin]
            if far := self.heads.get(strokes[low_key : low_key + HEAD]):
                last = bisect_right(key_at, low_key + far) - 1
                reach = [*range(begin + 1, last + 1)]
            else:
                # No counted word begins like this, but for short ones.
                last = min(size, begin + HEAD)
                reach = [e for e in range(begin + 1, last + 1) if key_at[e] - low_key < HEAD or (begin in edges and e in edges)]
            if begin in edges:
                # What may be unknown runs from edge to edge.
                reach += [e for e in ends if e > last and (e <= begin + self.longest or whole[begin] == e)]
            for end in reach:
                atom = whole.get(begin) == end
                n, confused = counts.get(low[begin:end], 0), None
                close = atom or strokes[low_key : key_at[end]] in alike
                likely = close or n >= LEAST
                if not likely and not broken_up:
                    continue
                crossed = () if atom else inner[bisect_right(inner, begin) : bisect_left(inner, end)]
                marked = broken_up and any(ends[g] for g in crossed)
                if not (likely or marked):
                    continue
                piece = chars[begin:end]
                if atom and not n and not piece.isalpha():
                    n = self.counts.get(counted(piece), 0)
                price = self.total - math.log(n) if n else self.total + UNKNOWN * len(piece)
                if (r := self.reading(piece) if close else None) and r[1] < price:
                    confused, price = r
                if not atom:
                    if n < LEAST and confused is None and not (marked and begin in edges and end in edges and all(ends[g] for g in crossed)):
                        continue
                    if not all(self.broken(chars[begin:g], *ends[g], chars[g:end]) if ends[g] else min(self.known(chars[begin:g]), self.known(chars[g:end])) < LEAST for g in crossed):
                        continue
                    if end - begin < 2 and not (begin in edges and end in edges):
                        continue  # a letter left over is no word
                    price += SPLIT * sum(not ends[g] for g in crossed) + MERGED * (begin not in edges)
                    if confused is not None and not (begin in edges and end in edges):
                        # Short words lie in many a name that is seen once.
                        if end - begin < 4:
                            continue
                        price += 2 * MERGED
                if ends.get(begin):
                    price += KEPT
                if cost[begin] + price < cost[end]:
                    cost[end], back[end] = cost[begin] + price, (begin, marked, confused)
        words, end = [], size
        while end:
            begin, marked, confused = back[end]
            words.append((begin, end, marked, confused))
            end = begin
        return words[::-1]

    def repair(self, text: str) -> str:
        """The text with the words of the cheapest path: break marks gone, misread, split and merged words restored. Line breaks stay, behind a word that crossed one."""
        breaks: list[tuple[str, str, str, str]] = []

        def note(left: str, mark: str, gap: str, right: str) -> str:
            breaks.append((left, mark, gap, right))
            return BREAK

        marked = mend(text.replace(BREAK, " "), note)
        # A hyphen that stays at a line's end joins what it parts, another one is as it was.
        places = [m.start() for m in re.finditer(BREAK, marked)] if breaks else []
        kept = [mark if "\n" in gap else mark + gap for _, mark, gap, _ in breaks]

        def plain(begin: int, end: int) -> str:
            first, *rest = marked[begin:end].split(BREAK)
            before = bisect_left(places, begin)
            return first + "".join(kept[before + i] + part for i, part in enumerate(rest))

        out, last = [], 0
        for r in regions(marked, self.doubtful(marked), breaks):
            if r.spans[0][0] >= last:
                out += (plain(last, r.spans[0][0]), self._written(r, plain))
                last = r.spans[-1][1]
        return "".join((*out, plain(last, len(marked))))

    def _written(self, r: Region, plain: Callable[[int, int], str]) -> str:
        words = self.path(r.atoms, r.gaps)
        if all(true is None for *_, true in words) and [e - b for b, e, *_ in words] == list(map(len, r.atoms)):
            return plain(r.spans[0][0], r.spans[-1][1])
        edge, at = {}, 0  # characters of the atoms up to an edge -> what stands between two atoms
        for atom, (_, end), (begin, _) in zip(r.atoms, r.spans, r.spans[1:]):
            at += len(atom)
            edge[at] = plain(end, begin)
        chars, out = "".join(r.atoms), []
        lines = [place for place, gap in edge.items() if "\n" in gap]
        for begin, end, _, true in words:
            piece = chars[begin:end]
            # A word that crossed a line's end leaves it behind.
            line = "\n" if bisect_right(lines, begin) < bisect_left(lines, end) else ""
            after = edge.get(end, "" if end == len(chars) else " ")
            out.append((_cased(piece, true) if true is not None else piece) + (line if line and after.isspace() and "\n" not in after else after))
        return "".join(out)


def _cased(model: str, word: str) -> str:
    letters = [c for c in model if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


JOURNALS = "journal archives annals bulletin letters proceedings transactions review reviews reports gazette acta quarterly".split()  # fixed values: words that begin a journal's name
_NUMBER_LINE = re.compile(r"(?:[-–—\[(|~•]\s*)?(?:p(?:age|g)?\.?\s*)?(?P<n>[\dlIiOoSsBZzgq]{1,5}|[ivxlc]{1,7}|[IVXLC]{1,7})(?:\s*(?:of|/)\s*[\dlIiOoSBZzgq]{1,5})?(?:\s*[-–—\])|~•])?", re.I)
_MARKED = re.compile(r"^\s*(?:[-–—]\s*\S+\s*[-–—]|\[\S+\]|p(?:age|g)?\.?\s*\S+(?:\s*(?:of|/)\s*\S+)?|\S+\s*\||\|\s*\S+)\s*$", re.I)
_AT_EDGE = re.compile(r"^\s*(?:[-–—\[]\s*)?([\dlIOoSBZ]{1,5})(?:\s*[-–—\]|])?\s{2,}(?=\S)|(?<=\S)\s{2,}(?:[-–—\[|]\s*)?([\dlIOoSBZ]{1,5})\s*(?:[-–—\]])?\s*$")


@lru_cache(100_000)
def fold(text: str) -> str:
    """A line as strokes, without blanks and punctuation, for comparing a scanned header with a title."""
    return re.sub(r"[^\w!|@$]+|_", "", text.lower()).translate(STROKES)


def edge_lines(text: str, reach: int = 2) -> list[tuple[int, str]]:
    """(number, line) of the first and last non-blank lines."""
    lines = text.split("\n")
    head: list[tuple[int, str]] = []
    tail: list[tuple[int, str]] = []
    i, j = 0, len(lines) - 1
    while i <= j and len(head) < reach:
        if lines[i].strip():
            head.append((i, lines[i]))
        i += 1
    while j >= i and len(tail) < reach:
        if lines[j].strip():
            tail.append((j, lines[j]))
        j -= 1
    return head + tail[::-1]


def number_line(line: str) -> str | None:
    """The number of a line that is nothing but a page number."""
    m = _NUMBER_LINE.fullmatch(line.strip())
    if not m:
        return None
    n = m["n"]
    plain = any(c.isdigit() for c in n) or re.fullmatch(r"[ivxlc]+|[IVXLC]+", n) or _MARKED.match(line)
    return n if plain else None


def page_number_lines(text: str) -> list[int]:
    """Which lines at the edge of a record are its page number: a bare number stands alone there, one below another is a column of a table."""
    filled = edge_lines(text)
    found = {i for i, x in filled if len(x) < 40 and _MARKED.match(x) and number_line(x)}
    for at, beside in ((0, 1), (-1, -2)):
        if filled and len(filled[at][1]) < 40 and number_line(filled[at][1]) and not (len(filled) > 1 and number_line(filled[beside][1])):
            found.add(filled[at][0])
    return sorted(found)


def without_number(line: str) -> tuple[str, bool]:
    """A header line without the page number beside it, and whether there was one."""
    m = _AT_EDGE.search(line)
    return (line[: m.start()] + line[m.end() :], True) if m else (line, False)


def too_long(line: str) -> bool:
    """Whether a line has too many characters, blanks aside, for a header and a page number; its beginning tells of most lines."""
    return len(line) > HEADER and (len("".join(line[: 4 * HEADER].split())) > HEADER + 20 or len("".join(line.split())) > HEADER + 20)


def is_header(line: str, title: str | None) -> bool:
    """Whether a line carries the title, a shortened title or a journal's name."""
    if too_long(line):
        return False
    bare, _ = without_number(line)
    bare = re.sub(r"(\.{2,}|…)\s*$", "", bare.strip()).strip()
    words = bare.split()
    if len(words) < 2 or len(bare) > HEADER:
        return False
    if title:
        a, b = fold(bare), fold(title)
        if len(a) >= 7 and (b.startswith(a) or (len(a) >= 12 and a.startswith(b))):
            return True
    first = fold(words[0])
    return first in _FOLDED_JOURNALS and bool(re.fullmatch(r"[\w!@|$.]+ (?:of|0f|oi) [\w !@|$&-]+?(?:,? [\dlIOoSBZ]{4})?", bare)) and len(words) <= 9 and all(w[:1].isupper() or not w[:1].isalpha() or len(w) < 4 for w in words)


_FOLDED_JOURNALS = {fold(w) for w in JOURNALS}


def titles_of(pages: DataFrame) -> DataFrame:
    """(file, title): the commonest title of each file."""
    named = pages.where(F.col("title").isNotNull()).groupBy(F.col("file_name").alias("file"), "title").agg(F.count("*").alias("n"))
    return named.groupBy("file").agg(F.max_by("title", F.struct("n", "title")).alias("title"))


def find_noise(spark: SparkSession, records: DataFrame, counts: dict[str, int], titles: DataFrame) -> DataFrame:
    """(table_name, record_id, noise_kind) of records (table_name, record_id, file, text)."""
    shared = spark.sparkContext.broadcast(counts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            out: list[tuple] = []
            for name, key, file, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text or text.isspace():
                    continue
                hyphen, misread = reader.damage(text)
                lines = [re.sub(r"\s{3,}", "   ", x) for _, x in edge_lines(text) if not too_long(x)]
                out.append((name, key, file, bool(page_number_lines(text)), hyphen, misread, lines))
            columns = zip(*out) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
    names = ["table_name", "record_id", "file", "numbered", "hyphen", "misread", "lines"]
    seen = records.select("table_name", "record_id", "file", "text").mapInArrow(scan, "table_name string, record_id string, file string, numbered boolean, hyphen boolean, misread boolean, lines array<string>")
    # Only the few lines at a record's edges meet the titles, never its text.
    titled = seen.join(titles.select(F.col("file").alias("of"), "title"), F.col("file") == F.col("of"), "left").drop("of", "file")

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, key, numbered, hyphen, misread, lines, title in zip(*(c.to_pylist() for c in batch.columns)):
                heads = [x for x in lines if is_header(x, title)]
                number = numbered or any(without_number(x)[1] for x in heads)
                out += [(name, key, k) for k, on in (("hyphenation", hyphen), ("misread", misread), ("running_header", bool(heads)), ("page_number", number)) if on]
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["table_name", "record_id", "noise_kind"])

    return titled.mapInArrow(kinds, "table_name string, record_id string, noise_kind string").distinct()


_STOPS = frozenset(".!?。！？।؟…:")
SHORT = 60  # characters of a paragraph that is worth one


def paragraphs(lines: list[tuple[str, bool]]) -> list[str]:
    """Lines (text, whether a blank line follows) as paragraphs: the cheapest partition by dynamic programming."""
    n = len(lines)
    if not n:
        return []
    width = median(len(x) for x, _ in lines) if n > 2 else 70

    def cost(i: int) -> float:
        """Of a break after line i, against joining it to the next."""
        line, blank = lines[i]
        bare, follows = line.rstrip(), lines[i + 1][0].lstrip()
        c = 1.0
        c += -1.5 if bare.rstrip("\"')]”»")[-1:] in _STOPS else 2.0
        c += -1.0 if len(bare) < 0.7 * width else 0.8
        c += 1.5 if follows[:1].islower() else -0.3
        c += -2.0 if blank else 0.0
        c += 4.0 if bare[-1:] in "-\xad‐¬," else 0.0
        return c

    sizes = [0, *accumulate(len(x) for x, _ in lines)]
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    opened = [0.0] * (n + 1)  # the price of all up to a paragraph that begins there
    far, far_at = math.inf, 0  # the best beginning of a paragraph of SHORT characters or more
    first = 0  # the beginnings from here on are nearer
    for end in range(1, n + 1):
        begin = end - 1
        opened[begin] = best[begin] + (cost(begin - 1) if begin else 0.0)
        while first < end and sizes[end] - sizes[first] >= SHORT:
            if opened[first] <= far:
                far, far_at = opened[first], first
            first += 1
        best[end], back[end] = far, far_at
        for begin in range(first, end):
            if opened[begin] + 0.8 < best[end]:
                best[end], back[end] = opened[begin] + 0.8, begin
    cuts, end = [], n
    while end:
        cuts.append((back[end], end))
        end = back[end]
    return ["\n".join(x for x, _ in lines[b:e]) for b, e in reversed(cuts)]


def printed_lines(text: str, title: str | None) -> set[int]:
    """Which lines at the edge of a record are a running header or its page number."""
    return {i for i, x in edge_lines(text) if is_header(x, title)} | set(page_number_lines(text))


def lines_in_place(text: str, title: str | None) -> list[str]:
    """Each printed line of a passage between the lines before and after it, by which its page finds it again."""
    if not (gone := printed_lines(text, title)):
        return []
    filled = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
    beside = ["", *(x for _, x in filled), ""]
    return ["\n".join(beside[k : k + 3]) for k, (i, _) in enumerate(filled) if i in gone]


def placed_lines(text: str, places: list[str]) -> set[int]:
    """The lines of a page that its passages have at their edges; one without a line beside it must be the only one like it."""
    if not places:
        return set()
    filled = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
    beside, out = ["", *(x for _, x in filled), ""], set()
    for before, line, after in (p.split("\n") for p in places):
        at = [i for k, (i, x) in enumerate(filled) if x == line and before in ("", beside[k]) and after in ("", beside[k + 2])]
        if before or after or len(at) == 1:
            out.update(at)
    return out


def with_titles(records: DataFrame, titles: DataFrame) -> DataFrame:
    """records with the title of their file; a file may hold any share of the rows."""
    if titles.limit(MOST_TITLES + 1).count() <= MOST_TITLES:
        return records.join(F.broadcast(titles), "file", "left")
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)))
    return salted.join(titles.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["file", "_salt"], "left").drop("_salt")


def repair_texts(spark: SparkSession, records: DataFrame, counts: dict[str, float], titles: DataFrame) -> DataFrame:
    """(table_name, record_id, text): each row of records as continuous paragraphs without headers and page numbers."""
    shared = spark.sparkContext.broadcast(counts)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            out = []
            for name, key, text, title, places in zip(*(c.to_pylist() for c in batch.columns)):
                if text and not text.isspace():
                    gone = printed_lines(text, title) | placed_lines(text, places or [])
                    raw = reader.repair("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)).split("\n")
                    lines = [(x, i + 1 < len(raw) and not raw[i + 1].strip()) for i, x in enumerate(raw) if x.strip()]
                    text = "\n\n".join(" ".join(p.split()) for p in paragraphs(lines))
                out.append((name, key, text))
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["table_name", "record_id", "text"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(page, x) for page, text, title in zip(*(c.to_pylist() for c in batch.columns)) for x in lines_in_place(text, title)]
            columns = zip(*out) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["page_id", "place"])

    titled = with_titles(records.select("table_name", "record_id", "file", "text"), titles.select("file", "title")).select("table_name", "record_id", "text", "title")
    # A page loses the printed lines of its passages too, wherever in the page their edges fall; only those lines are joined.
    passages = titled.where("table_name = 'passage' and text is not null").select(F.regexp_replace("record_id", r":c\d+$", "").alias("page_id"), "text", "title")
    placed = passages.mapInArrow(places, "page_id string, place string").groupBy("page_id").agg(F.collect_set("place").alias("places"))
    # Only pages meet them, by their own key; the text of a passage is not shuffled.
    paged = titled.where("table_name = 'page_document'").join(placed, F.col("record_id") == F.col("page_id"), "left").select("table_name", "record_id", "text", "title", "places")
    others = titled.where("table_name <> 'page_document'").select("*", F.lit(None).cast("array<string>").alias("places"))
    return paged.unionByName(others).mapInArrow(repair, "table_name string, record_id string, text string")
