"""Toxicity after noisy-channel deobfuscation.

A character trigram model is counted over all documents. Tokens that may be
disguised (digits and signs among letters, letters repeated, letters and signs
spaced out) become lattices: each character may stand for itself, for the
letters that it is used for, or for nothing, at a price; runs of spaced letters
may hold several words. Viterbi decoding finds the cheapest reading under the
character model. The words of a text and the
restored ones are then scored by a logistic model of words and word beginnings,
which is fitted on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, pieces

#: Most labelled documents that the classifier is fitted on, and most features that it keeps.
SAMPLE, FEATURES = 20_000, 4_000
#: Documents of the sample in which a feature must be toxic, and the share of its documents.
LEAST_TOXIC, LEAST_SHARE = 5, 0.5
#: Letters of the word beginnings that count as features.
BEGINNINGS = (4, 5, 7)
#: The letters that digits and signs are used for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = ".-_*~"
#: Prices in nats: a sign for a letter, a dropped repeat or separator, anything else dropped.
SIGN, REPEAT, DROP = 0.7, 0.6, 5.0

LETTERS = "abcdefghijklmnopqrstuvwxyz"
N = len(LETTERS) + 1  # and the gap between words
_FOLD = {}
for _letter, _forms in {"a": "àáâãäåāæ", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "s": "ß", "u": "ùúûü", "y": "ýÿ"}.items():
    _FOLD.update(dict.fromkeys(_forms, _letter))
_CODES = np.full(256, N - 1, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _i
for _form, _letter in _FOLD.items():
    for _c in (_form, _form.upper()):
        if len(_c) == 1 and ord(_c) < 256:
            _CODES[ord(_c)] = LETTERS.index(_letter)

_WORDS = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1")
_SIGNS = frozenset(STANDS_FOR)
_BETWEEN = f"[ {re.escape(SEPARATORS)}]"
_LETTER, _SIGN = r"[^\W\d_]", f"[{re.escape(''.join(STANDS_FOR))}]"


def _spaced(one: str) -> re.Pattern[str]:
    """Three or more of ``one`` with a separator or two between them, and no letter or digit beside them."""
    return re.compile(rf"(?<![^\W_]){one}(?:{_BETWEEN}{{1,2}}{one}){{2,}}(?![^\W_])")


_SPACED, _SPACED_LETTERS = _spaced(f"(?:{_LETTER}|{_SIGN})"), _spaced(_LETTER)
_GAPS = re.compile(f"{_BETWEEN}+")
_EDGES = " " + SEPARATORS + "".join(STANDS_FOR)


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all of ``text``; a table of fixed size, summed in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for _, texts in pieces(batches):
            codes = _CODES[np.frombuffer("  ".join(texts).encode("latin-1", "replace"), np.uint8)]
            total += np.bincount(codes[:-2] * N * N + codes[1:-1] * N + codes[2:], minlength=N**3) if len(codes) > 2 else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    out = np.zeros(N**3)
    for gram, n in docs.select(F.lit(0).alias("_"), F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out


class Restorer:
    """Reads disguised tokens: ``costs[p, q, c]`` is what letter c costs after p, q."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(N, N, N) + 0.05
        self.costs = -np.log(counts / counts.sum(2, keepdims=True))
        self.known: dict[tuple[str, bool], str] = {}

    def _readings(self, c: str, before: str) -> list[tuple[int, float]]:
        """(letter or -1 for none, price) of a character after another."""
        c = _FOLD.get(c, c)
        if c in LETTERS:
            own = [(LETTERS.index(c), 0.0)]
            return own + [(-1, REPEAT)] if c == _FOLD.get(before, before) else own
        out = [(LETTERS.index(x), SIGN) for x in STANDS_FOR.get(c, "")]
        return out + [(-1, REPEAT if c in SEPARATORS or c == before else DROP)]

    def read(self, token: str, gaps: bool = False) -> str:
        """The cheapest reading of a lower-case token; with ``gaps``, of several words if that is cheaper."""
        if (known := self.known.get((token, gaps))) is not None:
            return known
        gap = N - 1
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(gap, gap): (0.0, None)}
        before = ""
        for c in token:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, price in self._readings(c, before):
                for (p, q), (cost, path) in best.items():
                    state, total, way = ((p, q), cost + price, path) if letter < 0 else ((q, letter), cost + price + self.costs[p, q, letter], (letter, path))
                    if state not in after or total < after[state][0]:
                        after[state] = (total, way)
            if gaps:
                for (p, q), (cost, path) in [x for x in after.items() if x[0][1] != gap]:
                    total = cost + self.costs[p, q, gap]
                    if (q, gap) not in after or total < after[q, gap][0]:
                        after[q, gap] = (total, (gap, path))
            best, before = after, c
        _, path = min((cost + self.costs[p, q, gap], i) for i, ((p, q), (cost, _)) in enumerate(best.items()))
        path = list(best.values())[path][1]
        letters = []
        while path:
            letters.append(LETTERS[path[0]] if path[0] < gap else " ")
            path = path[1]
        word = "".join(reversed(letters))
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[token, gaps] = word
        return word

    def restored(self, low: str) -> list[str]:
        """The readings of all tokens of a lower-case text that may be disguised."""
        out = []
        if not _SIGNS.isdisjoint(low):
            for token in low.split():
                if not token.isalpha() and not _SIGNS.isdisjoint(token):
                    token = token.strip(".,;:?!\"'()[]")
                    if not token.isalpha() and any(c in LETTERS for c in token):
                        out.append(self.read(token))
        # Letters are dropped from a word only where the model finds it cheaper without them.
        out += [read for w in set(_WORDS.findall(low)) if _REPEATED.search(w) and (read := self.read(w)) != w]
        for run in _SPACED.findall(low):
            if not any(c.isalpha() for c in run):
                continue
            # Signs at the ends, and among letters, may be used as signs: the run is read with and without them.
            for part in dict.fromkeys([run, run.strip(_EDGES), *_SPACED_LETTERS.findall(run)]):
                token = _GAPS.sub("", part)
                out += [self.read(token), *self.read(token, True).split()]
        return [w for w in dict.fromkeys(out) if w]


def features(text: str, restorer: Restorer) -> set[str]:
    """Words and beginnings (marked ^; ^^ where two words or more begin so) of the text and its restored tokens."""
    low = text.lower()
    words = set(_WORDS.findall(low))
    words.update(restorer.restored(low))
    found = set(words)
    for n in BEGINNINGS:
        begun = ["^" + w[:n] for w in words if len(w) > n]
        once = set(begun)
        found |= once
        if len(begun) > len(once):
            found.update("^" + b for b, k in Counter(begun).items() if k > 1)
    return found


@dataclass
class Model:
    """What scoring needs: the character model, and the weight of each feature."""

    counts: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def score(self, text: str, restorer: Restorer) -> float:
        z = self.bias + sum(self.weights[f] for f in self.weights.keys() & features(text, restorer))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _fit(hits: list[list[int]], toxic: np.ndarray, n: int, ridge: float = 0.05, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression over present features.

    Newton steps on a diagonal that bounds the curvature: each text's share of it
    counts once for each of its features, so that features that always come
    together don't overshoot.
    """
    size = np.array([len(h) for h in hits])
    owner = np.repeat(np.arange(len(hits)), size)
    own = np.fromiter((i for h in hits for i in h), np.int64, len(owner))
    weights, bias = np.zeros(n), float(np.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(owner, weights[own], len(hits)), -40, 40)))
        curve = np.maximum(p * (1 - p), 1e-3) * (size + 1)
        slope = np.bincount(own, (p - toxic)[owner], n) + ridge * weights
        weights -= np.clip(slope / (np.bincount(own, curve[owner], n) + ridge), -1, 1)
        bias -= float(np.clip((p - toxic).sum() / curve.sum(), -1, 1))
    return weights, bias


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; that of a null id is that of an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """The model from all texts, and from at most ``sample`` rows of ``labels`` (doc_id, toxic) whose remainder is not 0.

    The rows are those with the smallest hash of their doc_id. Rows with a null label or
    id are left out. Without labels of both kinds, every text scores the share of toxic labels, or 0.
    """
    model = Model(trigrams(docs))
    usable = labels.where("toxic is not null and doc_id is not null").where(remainder() != 0).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    counts = model.counts

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts)
        for toxic, texts in pieces(batches, 1 << 19):
            found = [list(features(t, restorer)) for t in texts]
            yield pa.RecordBatch.from_arrays([toxic, pa.array(found, pa.list_(pa.string()))], ["toxic", "features"])

    # The sample is bounded, so it is sent to the documents, which stay where they are.
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    known = cut(known.select("toxic", "text").mapInArrow(listed, "toxic int, features array<string>"))
    totals = known.agg(F.count("*"), F.sum("toxic")).first()
    if not totals[0] or totals[1] in (0, totals[0]):
        share = (totals[1] or 0) / totals[0] if totals[0] else 0.0
        model.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return model
    each = known.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    telling = each.where((F.col("bad") >= LEAST_TOXIC) & (F.col("bad") >= LEAST_SHARE * F.col("n")))
    names = [r["feature"] for r in telling.orderBy(F.desc("bad"), "feature").limit(most).collect()]
    place = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(place[f] for f in own if f in place) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["toxic", "hits"])

    rows = known.mapInArrow(present, "toxic int, hits array<int>").collect()  # the sample's telling features alone
    weights, model.bias = _fit([list(r["hits"]) for r in rows], np.array([r["toxic"] for r in rows], float), len(names))
    model.weights = dict(zip(names, weights.tolist()))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts score what a text without features does."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: trigrams and at most FEATURES weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        restorer = Restorer(own.counts)
        for ids, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([own.score(t, restorer) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with its columns. Scores are made in the pass that filters."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        restorer = Restorer(own.counts)
        for texts in batches:
            yield pd.Series([own.score(t or "", restorer) < threshold for t in texts], dtype=bool)

    return docs.where(clean(F.col("text").cast("string")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, fit(docs, labels)).select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
