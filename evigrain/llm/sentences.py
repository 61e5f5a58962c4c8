"""Sentence boundaries across languages and scripts, learnt from the texts themselves.

Following Kiss and Strunk (2006), nothing is looked up: one pass over all texts counts, per language, how
often each word stands with and without a period, in which case, and which word follows a period.
Log-likelihood ratios over these counts give the abbreviations, the words that start sentences, and the pairs
that belong together across a period; the case of a word elsewhere is the orthographic evidence.  A second
pass classifies every period with them.  Thai has no mark at a sentence's end: there the same ratio tells
which blanks stand before something that does not begin a text.  Other marks (! ? and those of other scripts),
quotations and brackets have rules of their own.

A ratio grows with the size of the corpus, the thresholds of the method do not.  The counts of a language with
more than `REFERENCE` words are therefore brought down to that many, and how often an abbreviation may lack its
period is a share: a corpus ten times as large, with the same rates, gives the same model.

The counts are aggregated in the cluster; what comes to the driver are the words judged to be abbreviations,
starters and collocations, and common words that follow abbreviations, a part of the vocabulary whose size is
checked.

Defined results: null and blank texts have no sentence; a text without any boundary is one sentence; offsets
count code points; a record delivered again counts once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 2_000_000  # learnt words that may come to the driver; more is an error
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88  # thresholds of the method's authors
REFERENCE = 300_000  # words to which the counts of a larger language are brought down
LONGEST = 30  # letters of a word that can be an abbreviation: at the reference size no longer one reaches the threshold
OPENING = 4  # letters by which the beginning of a Thai stretch is told

# A script's language, and words frequent in one language only.
SCRIPTS = (("th", "฀-๿"), ("ja", "぀-ヿ"), ("zh", "一-鿿"), ("hi", "ऀ-ॿ"), ("ar", "؀-ۿ"), ("ru", "Ѐ-ӿ"), ("el", "Ͱ-Ͽ"))
FUNCTION_WORDS = {
    "en": "the of and was were with in for at is that not by from this had",
    "de": "der die das und nicht wurden den von mit war bei nach ist im ein eine aus sich des",
    "fr": "le les une était des du dans aucun et à pour sur pas était qui était nous ne",
    "es": "el los una por las del se en con fue que para y más no al",
}
_OF_WORD = {w: lang for lang, words in FUNCTION_WORDS.items() for w in words.split() if sum(w in v.split() for v in FUNCTION_WORDS.values()) == 1}
_SCRIPT = re.compile(f"[{''.join(span for _, span in SCRIPTS)}]")
_OF_SCRIPT = [(name, re.compile(f"[{span}]")) for name, span in SCRIPTS]
_LATIN = re.compile("[A-Za-z\u00c0-\u024f]")

OPENERS = "\"'([{«“„‘「『（【"
CLOSERS = "\"')]}»”“’」』）】"
_EDGE = OPENERS + CLOSERS + ",;:!?¿¡"
NUMBER, STOP = "##", "!"  # any number; what stands for a mark that surely ends a sentence
_NUMBER = re.compile(r"[+\-–]?\d[\d.,:/%–-]*")
_INITIALS = re.compile(r"[^\W\d_](?:\.[^\W\d_])*")


def languages(text: str, tokens: list[str]) -> tuple[str, bool]:
    """(main language, whether another one is mixed in): the script with most letters, each sign of writing without blanks as two; Latin script by its function words."""
    hits = [_OF_WORD[t] for t in tokens if t in _OF_WORD]
    if not text.isascii() and _SCRIPT.search(text):
        letters = {name: len(own.findall(text)) * (2 if name in ("ja", "zh") else 1) for name, own in _OF_SCRIPT}
        if letters["ja"]:
            letters["ja"], letters["zh"] = letters["ja"] + letters["zh"], 0
        name = max(letters, key=lambda x: letters[x])
        if letters[name] >= len(_LATIN.findall(text)):
            return name, len(hits) > 2 or sum(n >= 20 for n in letters.values()) > 1
        foreign = letters[name] >= 20  # a Greek letter or two are symbols
    else:
        foreign = False
    if not hits:
        return "en", foreign
    if hits.count(hits[0]) == len(hits):
        return hits[0], foreign
    top = Counter(hits).most_common(2)
    return top[0][0], foreign or top[1][1] > 2


@lru_cache(200_000)
def word_type(token: str) -> str:
    """The word as counted: lower case, without marks around it; numbers are one word.  A final period stays."""
    bare = token.strip(_EDGE)
    dotted = bare.endswith(".") and not bare.endswith("..")
    core = bare.rstrip(".") if dotted else bare
    return (NUMBER if _NUMBER.fullmatch(core) else core.lower()) + ("." if dotted else "")


def is_thai(c: str) -> bool:
    return "฀" <= c <= "๿"


_FIELDS = "lang string, word string, next string, n long, dotted long, lower long, upper long, numbers long"


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, next, n, dotted, lower, upper, numbers): of words (next null) how often they stand at all, with a
    period, in small letters, with a capital within a sentence, and with a period before a number; of words that
    follow a period how often they do, and (upper) not in small letters.  Beginnings of Thai stretches are words
    marked by \\x01: n after a blank, dotted at the start of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, bool, int]] = {}

        def told(token: str) -> tuple[str, bool, int]:
            """(word, whether it has a period, case: -1 small, 1 capital, 0 none)."""
            out = known.get(token)
            if out is None:
                kind, first = word_type(token), token.lstrip(OPENERS + "¿¡")[:1]
                if len(known) > 500_000:
                    known.clear()
                out = known[token] = (kind.rstrip(".") or kind, kind.endswith("."), -1 if first.islower() else 1 if first.isupper() else 0)
            return out

        total: dict[tuple, list[int]] = {}

        def add(key: tuple, n: int, dotted: int = 0, lower: int = 0, upper: int = 0, numbers: int = 0) -> None:
            own = total.get(key)
            if own is None:
                own = total[key] = [0, 0, 0, 0, 0]
            own[0] += n
            own[1] += dotted
            own[2] += lower
            own[3] += upper
            own[4] += numbers

        for batch in batches:
            tokens_of: dict[str, Counter] = {}
            after_of: dict[str, Counter] = {}
            pairs_of: dict[str, Counter] = {}
            for text in batch.column(0).to_pylist():
                if not text or not (tokens := text.split()):
                    continue
                lang, _ = languages(text, tokens)
                tokens_of.setdefault(lang, Counter()).update(tokens)
                after_of.setdefault(lang, Counter()).update(tokens[:1])
                pairs_of.setdefault(lang, Counter()).update([p for p in zip(tokens, tokens[1:]) if "." in p[0][-3:] or p[0][-1] in "!?"])
                if lang == "th":
                    if is_thai(tokens[0][0]):
                        add((lang, "\x01" + tokens[0][:OPENING], None), 0, 1)
                    for b in tokens[1:]:
                        if is_thai(b[0]):
                            add((lang, "\x01" + b[:OPENING], None), 1)
            for lang, pairs in pairs_of.items():
                after = after_of[lang]
                for (a, b), n in pairs.items():
                    after[b] += n
                    (word, dotted, _), (follower, _, case) = told(a), told(b)
                    if not dotted:
                        word = STOP if a.rstrip(CLOSERS)[-1:] in ("!", "?") else ""
                    if word and follower:
                        add((lang, word, follower), n, upper=n if case >= 0 else 0)
                    if dotted and follower:
                        if follower == NUMBER:
                            add((lang, word, None), 0, numbers=n)
            for lang, tokens_ in tokens_of.items():
                after = after_of[lang]
                for token, n in tokens_.items():
                    word, dotted, case = told(token)
                    # What is too long for a word counts for the size of the language only.
                    add((lang, word if len(word) <= LONGEST else "", None), n, n if dotted else 0, n if case < 0 else 0, n - after[token] if case > 0 else 0)
            if len(total) > 400_000:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    rows = texts.mapInArrow(count, _FIELDS)
    return rows.groupBy("lang", "word", "next").agg(*(F.sum(c).alias(c) for c in ("n", "dotted", "lower", "upper", "numbers")))


def _counted(total: dict[tuple, list[int]]) -> pa.RecordBatch:
    keys = list(zip(*total)) or [()] * 3
    sums = list(zip(*total.values())) or [()] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), *(pa.array(c, pa.int64()) for c in sums)], names=["lang", "word", "next", "n", "dotted", "lower", "upper", "numbers"])


def _log_binomial(k: Column, n: Column, p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def likelihood_ratio(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's ratio for b following a more often than elsewhere; negative if it does so less often."""
    p, p1, p2 = b / total, both / a, (b - both) / F.greatest(total - a, F.lit(1))
    ratio = 2 * (_log_binomial(both, a, p1) + _log_binomial(b - both, total - a, p2) - _log_binomial(both, a, p) - _log_binomial(b - both, total - a, p))
    return F.when(p1 > p2, ratio).otherwise(-ratio)


@dataclass
class Model:
    abbreviations: dict[str, dict[str, tuple[float, int]]] = field(default_factory=dict)  # language -> word -> (how often its capitalised followers are starters, against those of other words; of how many)
    starters: dict[str, set[str]] = field(default_factory=dict)
    collocations: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    common: dict[str, set[str]] = field(default_factory=dict)  # words that follow abbreviations and have no capital within a sentence
    within: set[str] = field(default_factory=set)  # beginnings of Thai stretches that go on with a sentence


def learn(texts: DataFrame, reference: int = REFERENCE) -> Model:
    """The word lists of each language, from all texts (one string column)."""
    spark, model = texts.sparkSession, Model()
    counts = count_words(texts).persist()
    try:
        words = counts.where("next is null and word <> '' and word not like '\x01%'")
        pairs = counts.where("next is not null")
        sizes = {r.lang: (r.n, r.dotted) for r in counts.where("next is null and word not like '\x01%'").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted")).collect() if r.n}
        if not sizes:
            return model

        def by_lang(values: dict[str, float]) -> Column:
            return F.create_map(*[F.lit(x) for lang, v in values.items() for x in (lang, float(v))])[F.col("lang")]

        total, scale = by_lang({lang: n for lang, (n, _) in sizes.items()}), by_lang({lang: min(1.0, reference / n) for lang, (n, _) in sizes.items()})
        rate = by_lang({lang: max(dotted, 1) / n for lang, (n, dotted) in sizes.items()})
        letters = F.length(F.regexp_replace("word", r"\.", "")).cast("double")
        inner = F.length("word") - letters + 1
        k, n = F.col("dotted").cast("double"), F.col("n").cast("double")
        ratio = 2 * scale * (_log_binomial(k, n, F.lit(0.99)) - _log_binomial(k, n, rate))
        # The method's penalty for every place without a period, for the share of such places in twenty at most.
        score = ratio * F.exp(-letters) * inner * F.pow(letters, -(n - k) / n * F.least(n * scale, F.lit(20.0)))
        word_like = F.col("word").rlike(r"\p{L}") & ~F.col("word").contains("…")
        initial = (letters == 1) & (k > 0)
        # A word that is common without a period ("no") is one with it, if what follows is mostly a number.
        before_number = (letters <= 5) & (F.col("numbers") * scale >= 5) & (F.col("numbers") >= 0.5 * k)
        found = _bounded(words.where((k > 0) & word_like & (initial | before_number | (score >= ABBREVIATION))).select("lang", "word"))
        abbreviations = F.broadcast(spark.createDataFrame([(r.lang, r.word) for r in found], "lang string, word string").withColumn("abbr", F.lit(True)))  # at most MOST_WORDS short words

        marked = pairs.join(abbreviations, ["lang", "word"], "left")
        ends = marked.where(F.col("abbr").isNull() & (F.col("word") != NUMBER))
        follow = ends.groupBy("lang", F.col("next").alias("word")).agg(F.sum("n").alias("after")).join(words, ["lang", "word"]).persist()
        breaks = {r.lang: r.n for r in follow.groupBy("lang").agg(F.sum("after").alias("n")).collect()}
        starting: dict[tuple[str, str], int] = {}
        usual: dict[str, float] = {}
        if breaks:
            after = F.col("after").cast("double")
            r = scale * likelihood_ratio(by_lang(breaks), F.greatest(n, after), after, total)
            for row in _bounded(follow.where((F.col("word") != NUMBER) & (r >= STARTER)).select("lang", "word", "n", "after")):
                starting[(row.lang, row.word)] = max(row.n, row.after)
                model.starters.setdefault(row.lang, set()).add(row.word)
                usual[row.lang] = usual.get(row.lang, 0.0) + row.after / breaks[row.lang]

        # Of the words after abbreviations and numbers only starters and numbers can change a decision: names after a title are many and tell nothing that the title does not.
        starters = F.broadcast(spark.createDataFrame([(*key,) for key in starting], "lang string, next string").withColumn("starts", F.lit(True)))  # at most MOST_WORDS words
        tied = marked.where(F.col("abbr") | (F.col("word") == NUMBER)).join(starters, ["lang", "next"], "left").persist()
        starts = F.coalesce(F.col("starts"), F.lit(False))
        sums = _bounded(tied.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"), F.sum(F.when(starts, F.col("upper")).otherwise(0)).alias("ends")))
        size = {(r.lang, r.word): r for r in sums}
        for r in found:
            own = size.get((r.lang, r.word))
            model.abbreviations.setdefault(r.lang, {})[r.word] = (min(1.0, own.ends / max(own.upper, 1) / max(usual.get(r.lang, 1.0), 1e-9)), own.upper) if own else (0.0, 0)
        numbers = {r.lang: r.n for r in words.where(F.col("word") == NUMBER).select("lang", "n").collect()}
        for r in _bounded(tied.where(F.col("abbr") & (starts | (F.col("next") == NUMBER)) & (F.col("n") > 1) & ((F.col("upper") > 0) | (F.col("next") == NUMBER))).select("lang", "word", "next", "n")):
            words_, b = sizes[r.lang][0], max(starting.get((r.lang, r.next), 0) if r.next != NUMBER else numbers.get(r.lang, 0), r.n)
            if min(1.0, reference / words_) * _ratio(size[(r.lang, r.word)].n, b, r.n, words_) >= COLLOCATION:
                model.collocations.setdefault(r.lang, set()).add((r.word, r.next))
        # Dates and ordinals: what follows numbers and hardly anything else that ends a sentence, beyond the numbers' share of all such ends.
        ended = {r.lang: r.n for r in sums if r.word == NUMBER}
        share = by_lang({lang: n / (n + breaks.get(lang, 0)) for lang, n in ended.items()} or {"": 1.0})
        dated = tied.where((F.col("word") == NUMBER) & (F.col("next") != NUMBER) & (F.col("n") > 1) & (F.col("upper") > 0)).select("lang", F.col("next").alias("word"), F.col("n").cast("double").alias("both"))
        dated = dated.join(follow.select("lang", "word", "after"), ["lang", "word"], "left")
        rest = F.coalesce(F.col("after"), F.lit(0)).cast("double")
        r = scale * likelihood_ratio(by_lang(ended or {"": 1}), F.col("both") + rest, F.col("both"), by_lang({lang: n + breaks.get(lang, 0) for lang, n in ended.items()} or {"": 1}))
        for row in _bounded(dated.where((r >= COLLOCATION) & (rest <= 0.2 * (F.col("both") + rest) * (1 - share))).select("lang", "word")):
            model.collocations.setdefault(row.lang, set()).add((NUMBER, row.word))
        # Words that have a capital at the start of a sentence only (nine times in ten): a capital after an abbreviation starts one.
        capital = tied.where(F.col("abbr") & ~starts & (F.col("upper") > 0) & (F.col("next") != NUMBER)).select("lang", F.col("next").alias("word")).distinct()
        common = words.where((F.col("lower") * scale >= 5) & (F.col("lower") >= 9 * F.col("upper"))).join(capital, ["lang", "word"], "left_semi")
        for r in _bounded(common.select("lang", "word")):
            model.common.setdefault(r.lang, set()).add(r.word)
        tied.unpersist()
        follow.unpersist()

        if "th" in sizes:
            openings = counts.where("lang = 'th' and word like '\x01%'")
            all_ = openings.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted")).first()
            if all_.dotted:
                size_ = float(all_.n + all_.dotted)
                shrink = min(1.0, reference / sizes["th"][0])
                both = F.col("dotted").cast("double")
                r = shrink * likelihood_ratio(F.lit(float(all_.dotted)), (F.col("n") + F.col("dotted")).cast("double"), both, F.lit(size_))
                model.within = {r.word[1:] for r in _bounded(openings.where((r <= -COLLOCATION) & (both * 5 <= (F.col("n") + both) * (all_.dotted / size_))).select("word"))}
    finally:
        counts.unpersist()
    return model


def _ratio(a: float, b: float, both: float, total: float) -> float:
    """likelihood_ratio of plain numbers."""

    def log_binomial(k: float, n: float, p: float) -> float:
        p = max(min(p, 1 - 1e-9), 1e-9)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    p, p1, p2 = b / total, both / a, (b - both) / max(total - a, 1)
    ratio = 2 * (log_binomial(both, a, p1) + log_binomial(b - both, total - a, p2) - log_binomial(both, a, p) - log_binomial(b - both, total - a, p))
    return ratio if p1 > p2 else -ratio


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} learnt words")
    return rows


_ANY = "".join(re.escape(c) for c in CLOSERS)
_MARK = re.compile(rf"[.!?。！？।॥؟…;]+[{_ANY}]*")
_THAI_GAP = re.compile(r"(?<=\S)\s+(?=\S)")
_QUOTED = re.compile(r"„[^“”„]*[“”]|“[^“”]*”|«[^«»]*»|「[^「」]*」|『[^『』]*』|（[^（）]*）|\([^()]*\)|\[[^\[\]]*\]|\"(?<!\w\")[^\"]*\"(?!\w)|【[^【】]*】")
_WIDE_END = "。！？।॥"


_REST = re.compile(r"\s*(\S*)")


def _before(text: str, start: int, at: int) -> str:
    """The word that ends before place at, not reaching back beyond start."""
    begin = at
    while begin > start and not text[begin - 1].isspace():
        begin -= 1
    return text[begin:at]


class Splitter:
    """Sentence ends of a text under a model."""

    def __init__(self, model: Model):
        self.model = model
        merged: dict[str, tuple[float, int]] = {}
        for words in model.abbreviations.values():
            for word, (ends, of) in words.items():
                before, n = merged.get(word, (0.0, 0))
                merged[word] = (ends * of + before, of + n)
        self.any_abbreviation = {word: ends / max(n, 1) for word, (ends, n) in merged.items()}
        self.abbreviations = {lang: {word: ends for word, (ends, _) in words.items()} for lang, words in model.abbreviations.items()}
        self.any_starter = set().union(*model.starters.values())
        self.any_collocation = set().union(*model.collocations.values())
        self.any_common = set().union(*model.common.values())

    def ends(self, text: str) -> list[int]:
        """Offsets just after the last non-blank character of each sentence."""
        if not text or text.isspace():
            return []
        lang, mixed = languages(text, text.split())
        m = self.model
        if mixed:
            words = self.any_abbreviation, self.any_starter, self.any_collocation, self.any_common
        else:
            words = self.abbreviations.get(lang, {}), m.starters.get(lang, set()), m.collocations.get(lang, set()), m.common.get(lang, set())
        spans = [m.span() for m in _QUOTED.finditer(text)]
        out: list[int] = []
        start, s, size = 0, 0, len(text)
        for m in _MARK.finditer(text):
            at, end = m.span()
            if end < size and text[at] == "." and (text[end].isdigit() or text[end].islower()):
                continue  # within a number or a word
            while s < len(spans) and spans[s][1] <= at:
                s += 1
            if s < len(spans) and spans[s][0] < at:
                begin, close = spans[s]
                if close > end:
                    continue  # inside a quotation or bracket
                if text[start:begin].strip():
                    # It closes a quotation inside a running sentence: that ends the sentence only before a clear new one.
                    if end == close and m.group()[0] in ".!?…" and end < size and not self._new(text, end, words[1]):
                        continue
                    if m.group()[0] in _WIDE_END + "？！" and end == close and end < size:
                        continue
                    if end == close and text[begin] in "([（【":
                        continue
            if self._ends(text, start, at, end, m.group(), *words):
                stop = end
                while m.group()[-1] in "\"“" and stop > at and text[stop - 1] in "\"“" and text[start:stop].count(text[stop - 1]) % 2 and text[stop - 1] == '"':
                    stop -= 1  # an opening quotation mark belongs to the next sentence
                out.append(stop)
                start = stop
        last = len(text.rstrip())
        if not out or out[-1] < last:
            out.append(last)
        if _OF_SCRIPT[0][1].search(text):
            out = sorted({*out, *(g.start() for g in _THAI_GAP.finditer(text) if self._thai(text, g.start(), g.end()))})
        return out

    def _thai(self, text: str, before: int, after: int) -> bool:
        """Whether a gap after a word with Thai letters parts sentences: not before what goes on with one, nor before a small letter."""
        follows = text[after]
        if text[before - 1] in ".,;:" or not (is_thai(follows) or follows.isupper() or follows in "\"“("):
            return False
        return any(is_thai(c) for c in _before(text, 0, before)) and not (is_thai(follows) and text[after : after + OPENING].split()[0] in self.model.within)

    @staticmethod
    def _new(text: str, end: int, starters: set[str]) -> bool:
        rest = _REST.match(text, end)[1]
        if not rest:
            return True
        first = rest.lstrip(OPENERS + "¿¡")
        return first[:1].isupper() or (first[:1].isdigit()) or word_type(rest).rstrip(".") in starters and not first[:1].islower()

    def _ends(self, text: str, start: int, at: int, end: int, mark: str, abbreviations: dict[str, float], starters: set[str], collocations: set[tuple[str, str]], common: set[str]) -> bool:
        size = len(text)
        kind = mark[0]
        if kind == ";":
            # The question mark of Greek.
            if not (at and "Ͱ" <= text[at - 1] <= "Ͽ" or at and text[at - 1].isdigit() and _OF_SCRIPT[6][1].search(text, start, at)):
                return False
            rest = _REST.match(text, end)[1]
            return not rest or not rest[0].islower()
        if end < size and not text[end].isspace():
            if kind in _WIDE_END:
                return True
            if kind == "…" or mark.startswith("……"):
                return "぀" <= text[end] <= "鿿" or at > 0 and "぀" <= text[at - 1] <= "鿿"
            if kind in "!?" and at and "぀" <= text[at - 1] <= "鿿":
                return True
            return self._glued(text, start, at, end, kind, abbreviations)
        follower = _REST.match(text, end)[1]
        if not follower or kind in _WIDE_END or kind in "！？؟":
            return True
        bare = follower.lstrip(OPENERS + "¿¡")
        first = bare[:1]
        if first.islower():
            # A word like "qSOFA" or "pH" that starts with a small letter may still open a sentence.
            inner = any(c.isupper() for c in bare)
            if kind in "!?":
                return inner or word_type(follower).rstrip(".") in starters and first not in "abcdefghijklmnopqrstuvwxyz"
            if not inner or kind != "." or mark.startswith(".."):
                if not (inner and (mark.startswith("..") or kind == "…")):
                    return word_type(follower).rstrip(".") in starters and self._plain(text, start, at, abbreviations) and kind == "."
        if kind in "!?":
            return bool(first) or follower[:1] in OPENERS + "–—-•"
        if kind == "…" or mark.startswith(".."):
            return not first.islower() or any(c.isupper() for c in bare)
        if not first and follower[0] in "–—-":
            return False
        token = _before(text, start, at) + "."
        word = word_type(token).rstrip(".")
        following = word_type(follower).rstrip(".")
        if word == NUMBER:
            return (NUMBER, following) not in collocations
        if following == NUMBER and token[0].isupper() and word not in abbreviations and (word, NUMBER) in self.any_collocation and word in self.any_abbreviation:
            return False  # a sentence of another language than most of its text
        known = word if word in abbreviations else self._tail(word)
        # A letter alone, or several with a period each, is an initial even where it was never seen.
        ends = abbreviations.get(known)
        if ends is None and (len(word) > 1 or token[0].isupper()) and _INITIALS.fullmatch(word):
            ends = 0.0
        if ends is None:
            return True
        if following == NUMBER:
            return (known, NUMBER) not in collocations and ends >= 0.3
        if following in starters:
            return (known, following) not in collocations or ends >= 0.3
        return ends >= 0.5 or following in common and first.isupper() and ends > 0.05

    @staticmethod
    def _glued(text: str, start: int, at: int, end: int, kind: str, abbreviations: dict[str, float]) -> bool:
        """A sentence that follows its predecessor without a blank: a whole word or number before the mark, a capitalised word after it."""
        if kind not in ".!?" or not at:
            return False
        follows = text[end:].lstrip(OPENERS + "¿¡")[:3] if text[end] in OPENERS + "¿¡" else text[end : end + 3]
        caseless = "\u0370" <= follows[:1] and follows[:1].isalpha() and not follows[:1].islower()
        if not (caseless or len(follows) > 1 and follows[0].isupper() and (follows[1].islower() or follows[1] == " ")):
            return False
        core = _before(text, start, at).lstrip(OPENERS).rstrip(CLOSERS)
        if kind != ".":
            return bool(core)
        if "." in core and not core[-1].isdigit() or not core:
            return False
        return (len(core) > 1 or core.isdigit()) and abbreviations.get(core.lower(), 1.0) >= 0.5

    @staticmethod
    def _tail(word: str) -> str:
        """The last part of a word joined by a hyphen or slash."""
        return re.split(r"[-/(\[]", word)[-1]

    @staticmethod
    def _plain(text: str, start: int, at: int, abbreviations: dict[str, float]) -> bool:
        word = word_type(_before(text, start, at) + ".").rstrip(".")
        return bool(word) and word not in abbreviations and word != NUMBER


def split_sentences(docs: DataFrame, model: Model, key: str = "passage_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, start_char, end_char, sentence) of every text, in order; docs may hold a record more than once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(model)
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = 0
                for i, end in enumerate(splitter.ends(t), 1):
                    while start < end and t[start].isspace():
                        start += 1
                    out.append((k, i, start, end, t[start:end]))
                    start = end
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=[key, "sentence_no", "start_char", "end_char", "sentence"])

    rows = docs.select(F.col(key).cast("string").alias(key), text).where(F.col(text).isNotNull())
    return rows.mapInArrow(split, f"`{key}` string, sentence_no int, start_char int, end_char int, sentence string")
