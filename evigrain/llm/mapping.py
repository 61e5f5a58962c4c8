"""Free-entered values mapped to a canonical list.

A multi-pattern automaton over the normalised names and aliases of a field finds the mentions embedded in
a value; the longest that do not overlap win.  A mention stands for the value if nothing but qualifiers is
left beside it.  Every other value goes to token-set similarity: each token of a name must have a partner
in the value within a few edits, whatever the order, while numbers, single letters and roman numerals must
agree exactly, as they name another thing.  What still has no entry is reported with term_id 0.

Defined results: null, empty, blank and missing-marked values give no row; a value equally close to two
entries has none (0); names are compared without regard to case, width, look-alike letters and punctuation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evigrain.operators.packed import edit_distance, split_packed

MISSING_MARKS = ("", "not reported", "n/a")  # fixed values
# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans("аеорсухікнтвмАЕОРСУХІКНТВМ", "aeopcyxikhtbmAEOPCYXIKHTBM")
# Words that qualify a value without changing what it is.
QUALIFIERS = (
    "high low elevated raised reduced decreased increased baseline initial peak first last log mean median max min admission "
    "measured at on in per sd day the a an of any incident risk time to all cause adjudicated secondary primary new overall level mmol l mg dl lab"
).split()
QUALIFYING_PHRASE = re.compile(r"\b(?:on|at|by) day \d+\b|\bper \d+ \w+\b|\bper sd\b")
ROMAN = re.compile(r"[ivx]+")


def normalise(text: str) -> str:
    """Lower case, one width, Latin look-alikes, words and numbers separated by single spaces; a plus sign stays at its word."""
    text = unicodedata.normalize("NFKC", text).translate(LOOK_ALIKES).casefold()
    return " ".join(re.findall(r"[^\W_]+\+?", text))


def bare(text: str) -> str:
    """Without bracketed remarks at the end."""
    return re.sub(r"\s*(?:\([^()]*\)|\[[^\[\]]*\])?[\s?*:.…]*$", "", text)


def exact_only(token: str) -> bool:
    """Tokens that name another thing if a single character differs."""
    return len(token) < 2 or token.isdigit() or bool(ROMAN.fullmatch(token)) or (len(token) < 3 and any(c.isdigit() for c in token))


def digits(text: str) -> list[str]:
    return sorted(re.findall(r"\d+", text))


def _pairs(text: str) -> int:
    """The neighbouring letters of a text as bits of one integer."""
    text = text.replace(" ", "")
    bits = 0
    for a, b in zip(text, text[1:]):
        bits |= 1 << ((ord(a) * 31 + ord(b)) % 509)
    return bits


class TermIndex:
    """One field's names and aliases."""

    def __init__(self, terms: Sequence[tuple[int, str]]):
        self.automaton = ahocorasick.Automaton()
        self.names: list[tuple[str, list[str], int, int]] = []
        ids: dict[str, int] = {}
        for term_id, name in sorted(terms):
            ids.setdefault(normalise(name), term_id)
        ids.pop("", None)
        for name, term_id in ids.items():
            self.automaton.add_word(f" {name} ", (name, term_id))
            self.names.append((name, name.split(), term_id, _pairs(name)))
        self.by_size: dict[int, list[tuple[str, list[str], int, int]]] = {}
        for entry in self.names:
            self.by_size.setdefault(sum(len(p) for p in entry[1] if p != "of"), []).append(entry)
        self.exact = ids
        joined: dict[str, set[int]] = {}
        for name, term_id in ids.items():
            joined.setdefault(name.replace(" ", ""), set()).add(term_id)
        self.joined = {name: i.pop() for name, i in joined.items() if len(i) == 1}
        self.acronyms = {normalise(n) for _, n in terms if len(n) < 5 and n.isupper()}
        if ids:
            self.automaton.make_automaton()
        self.find = lru_cache(200_000)(self._find)

    def _find(self, value: str, cut: bool) -> int:
        if not self.exact:
            return 0
        whole = normalise(value)
        if whole in self.exact:
            return self.exact[whole]
        short = normalise(bare(value))
        if short in self.exact:
            return self.exact[short]
        if short.replace(" ", "") in self.joined:
            return self.joined[short.replace(" ", "")]
        rest = QUALIFYING_PHRASE.sub(" ", short)
        mentioned = self._mention(rest)
        if mentioned:
            return mentioned
        if cut:
            started = {t for n, _, t, _ in self.names if len(short) >= max(5, len(n) * 0.4) and n.startswith(short)}
            if len(started) == 1:
                return started.pop()
        tokens = [t for t in rest.split() if t != "of"]
        core = [t for t in tokens if t not in QUALIFIERS]
        best = self._similar(tokens)
        if core and core != tokens:
            best = min(best, self._similar(core))
        return best[1]

    def _mention(self, text: str) -> int:
        """The entry whose name stands in the text with nothing but qualifiers around it; longest mentions first."""
        hits = []
        for end, (name, term_id) in self.automaton.iter(f" {text} "):
            hits.append((len(name), end - len(name) - 1, name, term_id))
        taken: list[tuple[int, int, int, int]] = []
        for size, start, name, term_id in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(start >= e or start + size <= s for s, e, _, _ in taken):
                taken.append((start, start + size, size, term_id))
        if not taken:
            return 0
        left = list(text)
        for s, e, _, _ in taken:
            left[s:e] = " " * (e - s)
        if any(t not in QUALIFIERS for t in "".join(left).split()):
            return 0
        return max(taken, key=lambda t: t[2])[3] if len({t[3] for t in taken}) == 1 or taken[0][2] > taken[1][2] else 0

    def _similar(self, tokens: list[str]) -> tuple[float, int]:
        """(edits a letter, entry) of the closest name; entry 0 if none is close or two are equally so."""
        if not tokens:
            return 9.0, 0
        joined = "".join(tokens)
        bits, size = _pairs(joined), len(joined)
        fixed, numbers = sorted(t for t in tokens if exact_only(t)), digits(" ".join(tokens))
        found: list[tuple[int, float, int]] = []
        for name, parts, term_id, own in (x for n in range(size - 4, size + 5) for x in self.by_size.get(n, ())):
            parts = [p for p in parts if p != "of"]
            length = sum(map(len, parts))
            if length < 3 or abs(length - size) > 4 or name in self.acronyms or digits(name) != numbers:
                continue
            if length > 5 and (bits & own).bit_count() * 3 < min(bits.bit_count(), own.bit_count()):
                continue
            allowed = 1 if length <= 6 else 2 if length <= 14 else 3 if length <= 22 else 4
            if sorted(p for p in parts if exact_only(p)) == fixed:
                edits = min(edit_distance(joined, "".join(parts), allowed), self._paired(tokens, parts, allowed))
                if edits <= allowed:
                    found.append((edits, edits / length, term_id))
        if not found:
            return 9.0, 0
        found.sort()
        close = {t for e, _, t in found if e == found[0][0]}
        return (found[0][1], found[0][2]) if len(close) == 1 else (found[0][1], 0)

    @staticmethod
    def _paired(tokens: list[str], parts: list[str], allowed: int) -> int:
        """Edits when every token is paired with one of the name, in any order."""
        if len(tokens) != len(parts):
            return allowed + 1
        free, total = list(tokens), 0
        for part in sorted(parts, key=len, reverse=True):
            edits, best = min((edit_distance(t, part, allowed) if not (exact_only(t) or exact_only(part)) else (0 if t == part else allowed + 1), t) for t in free)
            if edits > max(1, len(part) // 3):
                return allowed + 1
            total += edits
            free.remove(best)
        return total


def map_values(values: DataFrame, terms: Sequence[tuple[str, int, str]], cut_fields: Sequence[str] = ("outcome",)) -> DataFrame:
    """values (…, field_name, item_text) with term_id; terms: (field_name, term_id, name or alias), small enough to travel in a task."""
    lists: dict[str, list[tuple[int, str]]] = {}
    for field, term_id, name in terms:
        lists.setdefault(field, []).append((term_id, name))
    schema = T.StructType([*values.schema.fields, T.StructField("term_id", T.IntegerType())])
    position = {f: i for i, f in enumerate(values.columns)}

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {f: TermIndex(names) for f, names in lists.items()}
        for batch in batches:
            fields, texts = batch.column(position["field_name"]).to_pylist(), batch.column(position["item_text"]).to_pylist()
            found = [index[f].find(t, f in cut_fields) if f in index and t is not None else 0 for f, t in zip(fields, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "term_id"])

    return values.mapInArrow(match, schema)


def present(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin(*MISSING_MARKS), F.lit(False))


def map_fields(rows: DataFrame, terms: DataFrame, key: str = "row_id", outcome_chars: int = 80, most_terms: int = 20_000) -> DataFrame:
    """(key, field_name, item_no, item_text, term_id) for every value of predictor (packed) and outcome (single, up to outcome_chars)."""
    listed = terms.select("term_id", "field_name", "term_name", "aliases").limit(most_terms + 1).collect()
    if len(listed) > most_terms:
        raise ValueError(f"a canonical list has at most {most_terms} entries")
    names = [(r.field_name, r.term_id, n) for r in listed for n in (r.term_name, *(r.aliases or "").split("|")) if n]
    packed = split_packed(rows, key, ["predictor"], [n for f, _, n in names if f == "predictor"]).drop("n_items")
    outcome = (
        rows.where(present(F.col("outcome")) & (F.length("outcome") <= outcome_chars))
        .select(key, F.lit("outcome").alias("field_name"), F.lit(1).alias("item_no"), F.col("outcome").alias("item_text"))
        .distinct()
    )
    return map_values(packed.where(present(F.col("item_text"))).unionByName(outcome), names)
