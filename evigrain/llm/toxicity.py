"""Abusive, hateful or sexual content: a convolutional text classifier trained in numpy.

Words become hashed embeddings; filters of several widths slide over each sentence; the strongest answer of
each filter over a sentence (max pooling) feeds a logistic output.  A document scores as its worst sentence.
A rated document's loss is that of its currently worst sentence, raters are averaged, and the nets of several folds
are averaged; each is trained on all documents outside its fold.  The ratings are richer in offending documents
than the corpus, so the unrated documents stand beside them as presumed clean, at a low weight: each is shown in one
round of training, by its worst sentence as the net then stands, while the rated ones are shown in every round.
In a round, parts of the documents train copies of a net in tasks of their own, and their changes are averaged.
The threshold of each language is set on the ratings of all rated documents, scored by the net that was not trained
on them, with clean documents weighed to the share of offending ones among the scores of all documents; a language
with few ratings leans on those of all.

Nothing is sampled: every document takes part in training and is scored over its whole text.  Defined results: a
null, empty or blank text scores 0; a language without ratings takes the common threshold; without any positive
rating nothing is flagged.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrain.llm.sentences import languages

UNRATED_WEIGHT = 0.3  # of an unrated document in training; all of a round weigh no more than so much for each rated one
BUCKETS, DIM, WIDTHS, FILTERS = 65536, 16, (1, 2, 3), 24
SPAN, STEP = 24, 12  # a longer sentence is seen through windows of so many words, so that what is clean in it does not hide the rest
FOLDS, LEAN, PLATEAU = 3, 300.0, 0.01  # parts of the ratings left out in turn, one for each net; weight of all ratings in a language's threshold, in ratings; F1 given up for a threshold far from any score
OWN = 1_000.0  # weight of the nets' own boundary, one half, against the offending documents among the ratings: raters err
SHOWN, LEAST_EPOCHS, MOST_EPOCHS = 14_000, 6, 24  # few ratings are gone over more often: documents shown in training, within so many rounds
RATE, BATCH = 0.06, 64  # of Adagrad; documents in a step
PART, MOST_PARTS, BLOCK = 16_000, 64, 4_096  # rated documents for each copy of a net in training, copies at most (beyond, they see more documents each); words whose changes travel together
MOST_KNOWN = 300_000  # sentences whose score a task remembers
_SENTENCE = re.compile(r"\s(?:(?<=[.!?।؟;]\s)\s*|(?<=[\u0900-\u097f\u0e00-\u0e7f\u3040-\u9fff]\s)\s*(?=[a-zA-Z])|(?<=[a-zA-Z!?.]\s)\s*(?=[\u0900-\u097f\u0e00-\u0e7f\u3040-\u9fff]))|\n+")
_WIDE_END = re.compile("[。！？…]")  # ends a sentence without a blank
_ASCII_SENTENCE = re.compile(r"\s(?<=[.!?;]\s)\s*|\n+")  # the same for plain text
_WORD = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W\d_][\w'*$@]*|[*$@#]{2,}|[!?]")
_ASCII_WORD = re.compile(r"[a-z][\w'*$@]*|[*$@#]{2,}|[!?]")
_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff\xad]")
_SPELT = re.compile(r"(?<!\w)(?:[^\W\d_][.\-*_]){2,}[^\W\d_](?![\w.])|(?<!\w)(?:[^\W\d_][.\-*_]){3,}[^\W\d_](?!\w)")  # w.o.r.d
_MAY_BE_SPELT = re.compile(r"[.\-*_](?<=\w[.\-*_])\w[.\-*_]\w")
_DRAWN = re.compile(r"(.)\1{2,}")
_CODES = [chr(i if i < 0xD800 else i + 0x800) for i in range(BUCKETS)]  # a character for each word; the surrogates are none
_PLAIN = str.maketrans("@$013457", "asoleast")  # fixed values: signs written for letters


@lru_cache(500_000)
def code_of(word: str) -> str:
    """A word as the model sees it: letters told from signs written for them, drawn-out letters once; a character for its bucket."""
    if len(word) > 2 and word[0].isalpha() and any(c in "@$01345" for c in word):
        word = word.translate(_PLAIN)
    return _CODES[xxhash.xxh32_intdigest(_DRAWN.sub(r"\1", word)) % (BUCKETS - 1) + 1]


@lru_cache(100_000)
def windows_of(sentence: str) -> str:
    """The words of a sentence, small letters, numbers left out; a longer one as windows joined by blanks of 0."""
    if sentence.isascii():
        words = _ASCII_WORD.findall(sentence.lower())
    else:
        words = _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", sentence)).lower())
    h = "".join(map(code_of, words))
    return h if len(h) <= SPAN else "\0".join(h[i : i + SPAN] for i in range(0, len(h) - SPAN + STEP, STEP))


def body_of(text: str | None) -> str:
    """The sentences of a text, coded and joined by blanks of 0."""
    if not text:
        return ""
    if _MAY_BE_SPELT.search(text):
        text = _SPELT.sub(lambda m: re.sub(r"[.\-*_]", "", m[0]), text)
    if text.isascii():
        parts = _ASCII_SENTENCE.split(text)
    else:
        parts = _SENTENCE.split(_WIDE_END.sub("\\g<0>\n", text))
    return "\0".join(filter(None, map(windows_of, parts)))


def sentences_of(text: str | None) -> list[list[int]]:
    """The sentences of a text as the numbers of their words."""
    body = body_of(text)
    return [padded([s])[0, : len(s)].tolist() for s in body.split("\0")] if body else []


def padded(sentences: list[str]) -> np.ndarray:
    """Coded sentences as rows of equal length, with a margin of zeros so that every filter fits."""
    size = max(max(WIDTHS), max(map(len, sentences)))
    out = np.frombuffer("".join(s.ljust(size, "\0") for s in sentences).encode("utf-32-le"), np.uint32).astype(np.int32)
    out[out >= 0xE000] -= 0x800
    return out.reshape(len(sentences), size)


@dataclass
class Net:
    emb: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, seed: int, known: np.ndarray) -> Net:
        """Words that are not known say nothing."""
        r = np.random.default_rng(seed)
        emb = r.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        emb[0] = 0
        emb[~known] = 0
        return cls(emb, [r.normal(0, 0.25, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), np.array([-2.0], np.float32))

    def dense(self) -> list[np.ndarray]:
        """All parameters but those of single words."""
        return [*self.filters, *self.biases, self.out, self.bias]

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """(logits, what the backward step needs, pooled) of sentences of one length."""
        x = self.emb[ids]
        n, size, _ = x.shape
        pooled, memory = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            wins = np.concatenate([x[:, k : size - w + 1 + k] for k in range(w)], axis=2)
            z = wins @ f + b
            # A window that lies wholly in the margin is none.
            z = np.where((ids[:, : size - w + 1] > 0)[:, :, None], z, np.float32(-1e9))
            at = z.argmax(1)
            best = np.take_along_axis(z, at[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(best, 0))
            memory.append((wins, at, best))
        p = np.concatenate(pooled, axis=1)
        return p @ self.out + self.bias[0], memory, p


@dataclass
class Learner:
    """A net in training, with the sums of Adagrad for its parameters and the number of steps that changed each word."""

    net: Net
    known: np.ndarray
    emb_sums: np.ndarray
    dense_sums: list[np.ndarray]
    steps: np.ndarray

    @classmethod
    def new(cls, seed: int, known: np.ndarray) -> Learner:
        net = Net.new(seed, known)
        return cls(net, known, np.full_like(net.emb, 1e-6), [np.full_like(v, 1e-6) for v in net.dense()], np.zeros(BUCKETS, np.int64))

    def __getstate__(self) -> tuple:
        """Only the rows of known words travel."""
        rows = np.flatnonzero(self.known)
        return rows, self.net.emb[rows], self.net.filters, self.net.biases, self.net.out, self.net.bias, self.emb_sums[rows], self.dense_sums

    def __setstate__(self, state: tuple) -> None:
        rows, emb, filters, biases, out, bias, sums, self.dense_sums = state
        self.known, self.steps = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)
        self.known[rows] = True
        self.net = Net(np.zeros((BUCKETS, DIM), np.float32), filters, biases, out, bias)
        self.net.emb[rows] = emb
        self.emb_sums = np.full_like(self.net.emb, 1e-6)
        self.emb_sums[rows] = sums

    def change(self, at: int, grad: np.ndarray) -> None:
        value, total = self.net.dense()[at], self.dense_sums[at]
        total += grad * grad
        value -= RATE * grad / np.sqrt(total)

    def change_words(self, at: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        unique, first = np.unique(at[order], return_index=True)
        g = np.add.reduceat(grad[order], first)
        self.emb_sums[unique] += g * g
        self.net.emb[unique] -= RATE * g / np.sqrt(self.emb_sums[unique])
        self.steps[unique] += 1

    def learn(self, shown: list[tuple[list[str], float, float, bool]], r: np.random.Generator, late: bool, last: bool) -> None:
        """One step on documents: (sentences, target, weight, whether rated); of an unrated one its worst sentence at the round's beginning."""
        net = self.net
        flat = [s for own, _, _, rated in shown if rated for s in own]
        logits = logits_of([net], flat)[0] if flat else np.zeros(0)
        picked, labels, mass, at = [], [], [], 0
        for own, target, weight, rated in shown:
            if not rated:
                picked.append(own[0])
                labels.append(0.0)
                mass.append(weight)
                continue
            logit = logits[at : at + len(own)]
            at += len(own)
            if target >= 0.5:
                worst = int(logit.argmax())
                picked.append(own[worst])
                labels.append(target)
                # Late in training, a rating that no sentence bears out counts little: raters err.
                mass.append(weight * (max(0.15, 1 / (1 + float(np.exp(-min(max(logit[worst], -30), 30))))) if late else 1.0))
            else:
                for rank, i in enumerate(np.argsort(-logit)[:4]):
                    picked.append(own[int(i)])
                    labels.append(target)
                    mass.append(weight * (1.0 if rank == 0 else 0.5))
        ids, labels, mass = padded(picked), np.array(labels, np.float32), np.array(mass, np.float32)
        if not last:
            ids = np.where(r.random(ids.shape) < 0.15, 0, ids)
        logit, memory, pooled = net.forward(ids)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if late:  # an unrated document that looks offending may be so
            unrated = np.repeat([not rated for *_, rated in shown], [1 if not rated or target >= 0.5 else min(4, len(own)) for own, target, _, rated in shown])
            mass = np.where(unrated, mass * np.maximum(0.1, 1 - p), mass)
        g = ((p - labels) * mass / len(picked)).astype(np.float32)
        gp = g[:, None] * net.out[None, :]
        rows, n = np.arange(len(picked)), len(WIDTHS)
        where, grads = [], []
        for j, w in enumerate(WIDTHS):
            wins, at, best = memory[j]
            gz = gp[:, j * FILTERS : (j + 1) * FILTERS] * (best > 0)
            chosen = wins[rows[:, None], at]
            gx = (net.filters[j].T[None] * gz[:, :, None]).reshape(len(picked), FILTERS, w, DIM)
            self.change(j, np.einsum("nfd,nf->df", chosen, gz) + 1e-4 * net.filters[j])
            self.change(n + j, gz.sum(0))
            for k in range(w):
                word, grad = ids[rows[:, None], at + k].ravel(), gx[:, :, k].reshape(-1, DIM)
                live = self.known[word] & (gz.ravel() != 0)
                where.append(word[live])
                grads.append(grad[live])
        self.change(2 * n, pooled.T @ g + 1e-4 * net.out)
        self.change(2 * n + 1, np.array([g.sum()], np.float32))
        where = np.concatenate(where)
        if len(where):
            self.change_words(where, np.concatenate(grads))

    def changes(self, before: Learner) -> Iterator[tuple[int, bytes]]:
        """(block, what a part has changed since the round's beginning): block 0 for all words, then the words by number."""
        yield 0, pickle.dumps([a - b for a, b in zip([*self.net.dense(), *self.dense_sums], [*before.net.dense(), *before.dense_sums])])
        for first in range(0, BUCKETS, BLOCK):
            rows = first + np.flatnonzero(self.steps[first : first + BLOCK])
            if len(rows):
                yield 1 + first // BLOCK, pickle.dumps((rows, self.steps[rows], self.net.emb[rows] - before.net.emb[rows], self.emb_sums[rows] - before.emb_sums[rows]))

    def take(self, block: int, change: bytes) -> None:
        made = pickle.loads(change)
        if block == 0:
            for value, more in zip([*self.net.dense(), *self.dense_sums], made):
                value += more
        else:
            rows, _, emb, sums = made
            self.net.emb[rows] += emb
            self.emb_sums[rows] += sums


def mean_change(block: int, changes: Iterator[bytes]) -> bytes:
    """The mean of the changes that the parts made; a word's over the steps that changed it, as not every part has it."""
    if block == 0:
        total, n = None, 0
        for change in changes:
            made, n = pickle.loads(change), n + 1
            total = made if total is None else [a + b for a, b in zip(total, made)]
        return pickle.dumps([(t / n).astype(np.float32) for t in total])
    steps, emb, sums = np.zeros((BLOCK, 1)), np.zeros((BLOCK, DIM)), np.zeros((BLOCK, DIM))
    for change in changes:
        rows, n, e, s = pickle.loads(change)
        at, n = rows % BLOCK, n[:, None]
        steps[at] += n
        emb[at] += n * e
        sums[at] += n * s
    at = np.flatnonzero(steps[:, 0])
    return pickle.dumps(((block - 1) * BLOCK + at, steps[at, 0], (emb[at] / steps[at]).astype(np.float32), (sums[at] / steps[at]).astype(np.float32)))


def logits_of(nets: list[Net], sentences: list[str]) -> np.ndarray:
    """(nets, sentences): the answers of each net; sentences of like length go through the filters of all together.

    A filter over a window is a sum of one term for each place in it, and a term depends on one word: the terms
    of the words at hand are worked out once.
    """
    out = np.zeros((len(nets), len(sentences)), np.float32)
    if not sentences:
        return out
    words = np.unique(padded(["".join(sentences)]))
    words = np.append(0, words[words > 0])
    place = np.zeros(BUCKETS, np.int32)
    place[words] = np.arange(len(words))
    embs = [n.emb[words] for n in nets]
    terms = [[np.hstack([e @ n.filters[j][k * DIM : (k + 1) * DIM] for e, n in zip(embs, nets)]) for k in range(w)] for j, w in enumerate(WIDTHS)]
    biases = [np.hstack([n.biases[j] for n in nets]) for j in range(len(WIDTHS))]
    order = sorted(range(len(sentences)), key=lambda i: len(sentences[i]))
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        ids = padded([sentences[i] for i in part])
        dead = np.where(ids > 0, np.float32(0), np.float32(-1e9))[:, :, None]
        ids = place[ids]
        size, pooled = ids.shape[1], []
        for w, own, bias in zip(WIDTHS, terms, biases):
            z = own[0][ids[:, : size - w + 1]]
            for k in range(1, w):
                z += own[k][ids[:, k : size - w + 1 + k]]
            # A window that lies wholly in the margin is none.
            z += dead[:, : size - w + 1]
            pooled.append(np.maximum(z.max(1) + bias, 0).reshape(len(part), len(nets), FILTERS))
        for i, net in enumerate(nets):
            out[i, part] = np.concatenate([p[:, i] for p in pooled], axis=1) @ net.out + net.bias[0]
    return out


@dataclass
class Fitted:
    nets: list[Net]
    left_out: np.ndarray  # scores of the rated documents by the net that did not see them
    truth: np.ndarray
    langs: list[str]
    counts: np.ndarray | float = 1.0  # how many documents each stands for


def best_threshold(scores: np.ndarray, truth: np.ndarray, weights: np.ndarray, rate: float) -> float:
    """The middle, in log-odds, of the thresholds around the best F1 that give up `PLATEAU` of it at most, drawn to one half by `OWN` ratings.

    Clean documents are weighed to a share of `rate` offending ones.
    """
    scores, at = np.unique(scores, return_inverse=True)  # equal scores are on one side
    good, bad = np.bincount(at, weights * truth), np.bincount(at, weights * ~truth)
    if not good.sum() or not bad.sum():
        return 0.5
    bad = bad * good.sum() * (1 - rate) / rate / bad.sum()
    order = np.argsort(-scores)
    hits, wrong = np.cumsum(good[order]), np.cumsum(bad[order])
    f1 = 2 * hits / (hits + wrong + good.sum())
    near, best = f1 >= f1.max() - PLATEAU, int(f1.argmax())
    first, last = best, best
    while first > 0 and near[first - 1]:
        first -= 1
    while last + 1 < len(order) and near[last + 1]:
        last += 1
    odds = lambda p: float(np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))))
    below = scores[order[last + 1]] if last + 1 < len(order) else 0.0
    middle = (odds(scores[order[first]]) + odds(below)) / 2 * good.sum() / (good.sum() + OWN)
    return 1 / (1 + float(np.exp(-middle)))


def thresholds(model: Fitted, rate: float) -> dict[str, float]:
    """language -> threshold; "" for languages without a rating."""
    out, counts = {}, model.counts * np.ones(len(model.truth))
    for lang in {"", *model.langs}:
        own = np.array([x == lang for x in model.langs], float)
        out[lang] = best_threshold(model.left_out, model.truth, counts * (own + (LEAN / counts.sum() if lang else 1.0)), rate)
    return out


def tokens_of(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, source, lang, body, toxic, n, fold, at) of every document: coded sentences, the mean of its ratings and their number."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, texts = batch.columns
            texts = texts.to_pylist()
            bodies = [body_of(t) for t in texts]
            langs = [languages(t or "", (t or "").lower().split())[0] for t in texts]
            yield pa.RecordBatch.from_arrays([ids, sources, pa.array(langs, pa.string()), pa.array(bodies, pa.string())], names=["doc_id", "source", "lang", "body"])

    means = ratings.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"), F.count("*").alias("n"))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(code, "doc_id long, source string, lang string, body string")
    return made.join(means, "doc_id", "left").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))


def words_seen(tokens: DataFrame) -> np.ndarray:
    """(folds, words): in how many documents of each fold a word stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(FOLDS)]
        for batch in batches:
            for fold, body in zip(*(c.to_pylist() for c in batch.columns)):
                seen[fold].update(set(body))
        for fold, own in enumerate(seen):
            own.pop("\0", None)
            ids = padded(["".join(own)])[0, : len(own)] if own else []
            yield pa.RecordBatch.from_arrays([pa.array([fold] * len(own), pa.int32()), pa.array(ids, pa.int32()), pa.array(list(own.values()), pa.int64())], names=["fold", "word", "n"])

    out = np.zeros((FOLDS, BUCKETS), np.int64)
    for r in tokens.select("fold", "body").mapInArrow(count, "fold int, word int, n long").groupBy("fold", "word").agg(F.sum("n").alias("n")).collect():  # at most FOLDS * BUCKETS rows
        out[r.fold, r.word] = r.n
    return out


def fit(spark: SparkSession, tokens: DataFrame, parts: int | None = None) -> list[Net]:
    """A net for each fold, trained on every document outside the fold; none without a positive rating.

    In a round each part of the rated documents trains a copy of the net in a task of its own, and the copies' changes
    are averaged.  The unrated documents are dealt out to the rounds but the first, each to one.
    """
    rated = F.col("toxic").isNotNull()
    found = {r.fold: r for r in tokens.groupBy("fold").agg(F.count_if(rated).alias("rated"), F.count_if(F.col("toxic") >= 0.5).alias("bad"), F.count_if(~rated).alias("unrated")).collect()}
    bad = sum(r.bad for r in found.values())
    if not bad:
        return []
    # A net whose ratings would have no offending document among them sees its own fold, too.
    sees = {f: [g for g in found if g != f or found[f].bad == bad] for f in range(FOLDS)}
    n_rated, n_unrated = ({f: sum(getattr(found[g], kind) for g in sees[f]) for f in sees} for kind in ("rated", "unrated"))
    rounds = min(MOST_EPOCHS, max(LEAST_EPOCHS, SHOWN // max(1, 2 * max(n_rated.values()))))
    parts = parts or min(MOST_PARTS, -(-max(n_rated.values()) // PART))
    beside = {f: UNRATED_WEIGHT * min(1.0, n_rated[f] * (rounds - 1) / max(n_unrated[f], 1)) for f in sees}
    seen = words_seen(tokens)
    learners = [Learner.new(f, sum(seen[g] for g in sees[f]) > 1) for f in range(FOLDS)]
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(parts)).cast("int").alias("part")
    nets_of = F.array(*[F.array(*[F.lit(f) for f in sees if g in sees[f]]) for g in range(FOLDS)])[F.col("fold")]
    # Raters who disagree leave less weight; more raters give more.
    weight = (F.abs(F.col("toxic") - 0.5) + 0.1) * 2 * F.sqrt(F.least("n", F.lit(3)))
    marked = tokens.where(F.length("body") > 0)
    known = marked.where(rated).select(F.explode(nets_of).alias("net"), part, "doc_id", F.col("toxic").cast("double").alias("target"), weight.cast("double").alias("weight"), "body")
    unknown = marked.where(~rated).select("doc_id", part, nets_of.alias("nets"), "body", (F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds - 1)) + 1).alias("round"))
    for at in range(rounds):
        shared = spark.sparkContext.broadcast(learners)
        shown = known
        if at:
            worst = unknown.where(F.col("round") == at).select("doc_id", "part", "nets", "body").mapInArrow(worst_sentences(shared, beside), "net int, part int, doc_id long, target double, weight double, body string")
            shown = known.union(worst)
        dealt = shown.repartitionById(FOLDS * parts, F.col("net") * parts + F.col("part")).sortWithinPartitions(F.xxhash64(F.lit(at), "doc_id"), "doc_id", "body")
        made = dealt.mapInArrow(train_part(shared, at, rounds), "net int, part int, block int, made binary")
        if parts > 1:
            blocks = 1 + BUCKETS // BLOCK
            made = made.repartitionById(FOLDS * blocks, F.col("net") * blocks + F.col("block")).sortWithinPartitions("net", "block", "part").mapInArrow(merge, "net int, part int, block int, made binary")
        for r in made.collect():  # at most a change for each parameter of each net
            learners[r.net].take(r.block, r.made)
        shared.unpersist()
    return [x.net for x in learners]


def worst_sentences(shared: Broadcast, beside: dict[int, float]):
    """For every unrated document and net that sees it, the worst sentence as the net stands now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, scores = [x.net for x in shared.value], {}
        for batch in batches:
            ids, parts, seers, bodies = (c.to_pylist() for c in batch.columns)
            bodies = [b.split("\0") for b in bodies]
            if len(scores) > MOST_KNOWN:
                scores.clear()
            fresh = [s for s in dict.fromkeys(chain.from_iterable(bodies)) if s not in scores]
            scores.update(zip(fresh, logits_of(nets, fresh).round(3).T.tolist()))  # rounded, as the last digits change with the batch
            rows = [(f, part, i, max(own, key=lambda s: (scores[s][f], s))) for i, part, own, nets_of in zip(ids, parts, bodies, seers) for f in nets_of]
            net, part, doc, body = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(net, pa.int32()), pa.array(part, pa.int32()), pa.array(doc, pa.int64()), pa.array([None] * len(rows), pa.float64()), pa.array([beside[f] for f in net], pa.float64()), pa.array(body, pa.string())], names=["net", "part", "doc_id", "target", "weight", "body"])

    return run


def train_part(shared: Broadcast, at: int, rounds: int):
    """A round of training on one part of one net's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        waiting = []
        for batch in batches:
            nets, parts, _, targets, weights, bodies = (c.to_pylist() for c in batch.columns)
            if learner is None and nets:
                net, part = nets[0], parts[0]
                before, r = shared.value[net], np.random.default_rng([net, part, at])
                learner = pickle.loads(pickle.dumps(before))
            waiting += [(b.split("\0"), t, w, t is not None) for t, w, b in zip(targets, weights, bodies)]
            while len(waiting) >= BATCH:
                learner.learn(waiting[:BATCH], r, at >= rounds // 2, at == rounds - 1)
                waiting = waiting[BATCH:]
        if waiting:
            learner.learn(waiting, r, at >= rounds // 2, at == rounds - 1)
        if learner is not None:
            for block, made in learner.changes(before):
                yield pa.RecordBatch.from_arrays([pa.array([net], pa.int32()), pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([made], pa.binary())], names=["net", "part", "block", "made"])

    return run


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts' changes of a block, sorted by net and block, into their mean."""
    rows = ((r["net"], r["block"], r["made"]) for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
    for (net, block), own in groupby(rows, key=lambda r: r[:2]):
        made = mean_change(block, (r[2] for r in own))
        yield pa.RecordBatch.from_arrays([pa.array([net], pa.int32()), pa.array([0], pa.int32()), pa.array([block], pa.int32()), pa.array([made], pa.binary())], names=["net", "part", "block", "made"])


def score_documents(spark: SparkSession, docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) for every document."""
    tokens = tokens_of(docs, ratings).persist()  # words as numbers; every round reads them
    nets = fit(spark, tokens)
    if not nets:
        tokens.unpersist()
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.lit(0.0).alias("score"), F.lit(False).alias("flagged"))
    shared = spark.sparkContext.broadcast(nets)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets, known = shared.value, {}
        for batch in batches:
            parts = [b.split("\0") if b else [] for b in batch.column("body").to_pylist()]
            # A sentence that comes back in many documents of a task is scored once.
            if len(known) > MOST_KNOWN:
                known.clear()
            fresh = [s for s in dict.fromkeys(chain.from_iterable(parts)) if s not in known]
            if fresh:
                p = 1 / (1 + np.exp(-np.clip(logits_of(nets, fresh), -30, 30).astype(float)))
                known.update(zip(fresh, np.vstack([p, p.mean(0)]).T.tolist()))
            best = [max((known[s][-1] for s in own), default=0.0) for own in parts]
            rated = [None if t is None else max((known[s][f] for s in own), default=0.0) for own, f, t in zip(parts, batch.column("fold").to_pylist(), batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "source", "lang", "toxic"]).columns, pa.array(best, pa.float64()), pa.array(rated, pa.float64())], names=["doc_id", "source", "lang", "toxic", "score", "left_out"])

    scored = tokens.select("doc_id", "source", "lang", "toxic", "fold", "body").mapInArrow(score, "doc_id long, source string, lang string, toxic double, score double, left_out double").persist()  # no texts
    n, offending = scored.agg(F.count("*"), F.count_if(F.col("score") >= 0.5)).first()
    tokens.unpersist()
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), "left_out"))
    # All ratings, counted by language and by score to a hundredth of the log-odds: of fixed size.
    counted = scored.where(F.col("toxic").isNotNull()).groupBy("lang", (F.col("toxic") >= 0.5).alias("bad"), F.round(F.log(p / (1 - p)) * 100).alias("odds")).count().collect()
    counted.sort(key=lambda r: (r.odds, r.lang, r.bad))
    model = Fitted(nets, 1 / (1 + np.exp(-np.array([r.odds for r in counted]) / 100)), np.array([r.bad for r in counted]), [r.lang for r in counted], np.array([r["count"] for r in counted], float))
    limits = thresholds(model, min(max(offending, 1) / max(n, 1), 0.5))
    known = F.create_map(*[x for lang, t in limits.items() for x in (F.lit(lang), F.lit(t))])
    return scored.select("doc_id", "source", "score", (F.col("score") >= F.coalesce(known[F.col("lang")], F.lit(limits[""]))).alias("flagged"))


def toxic_rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, flagged_rate, mean_score)."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("flagged_rate"), F.avg("score").alias("mean_score"))
