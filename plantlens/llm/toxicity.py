"""Toxic spans by a linear-chain conditional random field, and document scores from its forward recursion.

The field has two states, clean and toxic. A token's features are hashed: the word, its beginnings of three to five
characters, its last three, and the words before and after it. Only documents are labelled, so the field is trained on
bags of tokens: a clean document is one whose tokens are all clean, a toxic one has a toxic token somewhere. The
probability that all tokens are clean is exact (one path over the sum of all), and so are the gradients of both kinds.
Fitting takes a bounded sample of the labelled training rows: its features are a table, each round sums the gradients of
its rows with Spark, and the driver holds weights only. Forward-backward marginals give the offending spans.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.llm.common import WORD, fold_remainder, hashes_of, slices, stage_table, words_of

#: Up to this many labels are broadcast to join the documents; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Hashed features, and one weight more for all tokens.
FEATURES = 1 << 20
SPANS = "array<struct<start:int,end:int,p:double>>"
#: Features of a word by itself; two more are those of its neighbours.
OWN = 5


@dataclass(frozen=True)
class ToxicitySettings:
    """The field is fitted to at most `sample` rows of each label, chosen by a hash of the id whatever their length.

    noise is the part of toxic labels that no token explains; rest is the strength of the pull towards zero weights.
    """

    folds: int = 3
    held_fold: int = 1
    sample: int = 2000
    threshold: float = 0.7
    rounds: int = 20
    noise: float = 0.001
    rest: float = 0.02
    parts: int = 12


def _scan(m: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, .. of n 2x2 matrices (4, n), row by row, each scaled to a sum of one.

    Blocks are multiplied side by side, and the blocks' products by the same function again.
    """

    def times(a, b):
        return np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])

    n = m.shape[1]
    width = min(n, max(8, int(np.sqrt(n))))
    blocks = -(-n // width)
    padded = np.empty((4, blocks * width))
    padded[:, :n], padded[:, n:] = m, np.array([1.0, 0.0, 0.0, 1.0])[:, None]
    steps = np.ascontiguousarray(padded.reshape(4, blocks, width).transpose(2, 0, 1))
    for t in range(width):
        now = times(steps[t - 1], steps[t]) if t else steps[0]
        steps[t] = now / now.sum(axis=0)
    if blocks > 1:
        whole = _scan(steps[-1])
        for t in range(width):
            now = times(whole[:, :-1], steps[t][:, 1:])
            steps[t][:, 1:] = now / now.sum(axis=0)
    return steps.transpose(1, 2, 0).reshape(4, -1)[:, :n]


def word_features(words: pa.Array) -> np.ndarray:
    """(words, OWN + 2) hashed features; punctuation around a word doesn't count."""
    core = pc.utf8_trim(words, string.punctuation)
    parts = [core, *(pc.utf8_slice_codeunits(core, 0, k) for k in (3, 4, 5)), pc.utf8_slice_codeunits(core, -3, None), core, core]
    salted = lambda k, h: (h ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)
    coded = [p.dictionary_encode() for p in parts]
    return np.stack([salted(k, hashes_of(c.dictionary)).astype(np.int32)[c.indices.to_numpy(zero_copy_only=False)] for k, c in enumerate(coded)], axis=1) if len(words) else np.zeros((0, OWN + 2), np.int32)


@dataclass
class Field:
    """weights of FEATURES hashed features and of all tokens; moves between the states; curve of the documents."""

    prior: float
    weights: np.ndarray = field(default_factory=lambda: np.concatenate([np.zeros(FEATURES), [-6.0]]).astype(np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray | None = None

    def unary(self, rows: np.ndarray, codes: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Score of the toxic state of each token; codes are places in the table of the words' features."""
        of_word = self.weights[features]
        inner, before, after = rows[1:] == rows[:-1], of_word[:, OWN], of_word[:, OWN + 1]
        score = self.weights[FEATURES] + of_word[:, :OWN].sum(axis=1)[codes]
        score[1:] += before[codes[:-1]] * inner
        score[:-1] += after[codes[1:]] * inner
        return score

    def forward(self, rows: np.ndarray, unary: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps (4, tokens), first tokens, forward probabilities (2, tokens), and log probability that all of a text is clean.

        All texts are one row of matrices; that of a text's first token forgets what came before it.
        """
        first = np.ones(len(rows), bool)
        first[1:] = rows[1:] != rows[:-1]
        clean = -np.logaddexp(0, unary)
        seen = np.stack([np.exp(clean), np.exp(clean + unary)])
        step = np.where(first, 1.0, np.exp(self.moves).reshape(4, 1)) * seen[[0, 1, 0, 1]]
        alpha = _scan(step)[:2]  # the first token of all forgets its start, so any row will do
        alpha = alpha / alpha.sum(axis=0)
        before = np.concatenate([[[1.0], [0.0]], alpha[:, :-1]], axis=1)
        scale = before[0] * (step[0] + step[1]) + before[1] * (step[2] + step[3])
        path = clean - np.log(scale) + np.where(first, 0.0, self.moves[0, 0])
        return step, first, alpha, np.minimum(np.bincount(rows, weights=path, minlength=texts), 0.0)

    @staticmethod
    def backward(step: np.ndarray) -> np.ndarray:
        """Backward probabilities (2, tokens), scaled."""
        beta = np.full((2, step.shape[1]), 0.5)
        if step.shape[1] > 1:
            back = _scan(step[[0, 2, 1, 3]][:, :0:-1])  # transposed, from the last
            beta[:, :-1] = np.stack([back[0] + back[2], back[1] + back[3]])[:, ::-1]
        return beta / beta.sum(axis=0)

    def marginals(self, rows: np.ndarray, unary: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Toxic probability of each token, log probability that all of a text is clean, and expected moves of each text."""
        step, first, alpha, all_clean = self.forward(rows, unary, texts)
        beta = self.backward(step)
        gamma = alpha * beta
        before = np.concatenate([[[1.0], [0.0]], alpha[:, :-1]], axis=1)
        pairs = before[[0, 0, 1, 1]] * step * beta[[0, 1, 0, 1]]
        pairs = np.where(first, 0.0, pairs / pairs.sum(axis=0))
        return gamma[1] / gamma.sum(axis=0), all_clean, np.stack([np.bincount(rows, weights=p, minlength=texts) for p in pairs], axis=1)

    def gradient(self, rows: np.ndarray, codes: np.ndarray, features: np.ndarray, toxic: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slopes of the log likelihood of the texts' labels by weights and by moves, and the evidence of each text."""
        p, all_clean, moves = self.marginals(rows, self.unary(rows, codes, features), len(toxic))
        none, some = np.exp(all_clean), -np.expm1(all_clean)
        pull = np.where(toxic, (1 - noise) * none / (noise + (1 - noise) * some), -1.0)
        token = p * pull[rows]
        inner = rows[1:] == rows[:-1]
        n = len(features)
        own = np.bincount(codes, weights=token, minlength=n)
        before = np.bincount(codes[:-1], weights=token[1:] * inner, minlength=n)
        after = np.bincount(codes[1:], weights=token[:-1] * inner, minlength=n)
        each = np.stack([own] * OWN + [before, after], axis=1)
        slope = np.bincount(features.ravel(), weights=each.ravel(), minlength=FEATURES + 1)
        slope[FEATURES] = token.sum()
        still = np.zeros_like(moves)
        still[:, 0] = np.bincount(rows[1:][inner], minlength=len(toxic))
        return slope, (pull[:, None] * (moves - still)).sum(axis=0), evidence(all_clean)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each text; row and probability of the tokens of texts that have a toxic one at even odds."""
        rows, p, all_clean = np.zeros(0, np.int64), np.zeros(0), np.zeros(len(texts))
        if self.curve is None:
            return np.full(len(texts), self.prior), rows, p
        rows, codes, words = words_of(texts)
        if len(rows):
            step, _, alpha, all_clean = self.forward(rows, self.unary(rows, codes, word_features(words)), len(texts))
            open_ = np.flatnonzero((all_clean < np.log(0.5))[rows])
            gamma = alpha[:, open_] * self.backward(step[:, open_])
            rows, p = rows[open_], gamma[1] / gamma.sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence(all_clean), -30, 30))), rows, p


def evidence(all_clean: np.ndarray) -> np.ndarray:
    """Log odds that a text has a toxic token, within bounds."""
    return np.clip(np.log(np.maximum(-np.expm1(all_clean), 1e-12)) - all_clean, -12, 12)


def _sample_features(rows: DataFrame) -> DataFrame:
    """(toxic, text) to (toxic, codes, features): places of the words in the text's own table of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, codes, words = words_of(batch.column("text").slice(k, 1))
                lists = [pa.array([x], pa.list_(pa.int32())) for x in (codes.astype(np.int32), word_features(words).ravel())]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(k, 1), *lists], ["toxic", "codes", "features"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, codes array<int>, features array<int>")


def _bags(batch: pa.RecordBatch, tokens: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rows, codes, features and labels of some texts with about so many tokens."""
    ends = np.cumsum(batch.column("codes").value_lengths().to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + tokens, side="right")))
        part = batch.slice(start, end - start)
        n, m = (part.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in ("codes", "features"))
        rows, base = np.repeat(np.arange(len(n)), n), np.cumsum(m // (OWN + 2)) - m // (OWN + 2)
        codes = part.column("codes").flatten().to_numpy(zero_copy_only=False) + base[rows]
        yield rows, codes, part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, OWN + 2), part.column("toxic").to_numpy(zero_copy_only=False) == 1
        start = end


def fit(sample: DataFrame, n: int, settings: ToxicitySettings, model: Field) -> Field:
    """Adam's steps over the gradients of all n rows of sample (toxic, codes, features)."""
    spark, part = sample.sparkSession, n / (1.4 * settings.sample)
    moment, size = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5)
    for step in range(1, settings.rounds + 1):
        sent = spark.sparkContext.broadcast(model)

        def slopes(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(FEATURES + 5)
            for batch in batches:
                for rows, codes, features, toxic in _bags(batch):
                    if len(rows):
                        weights, moves, _ = sent.value.gradient(rows, codes, features, toxic, settings.noise)
                        total += np.concatenate([weights, moves])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "slope"])

        got = sample.mapInArrow(slopes, "at int, slope double").groupBy("at").agg(F.sum("slope").alias("slope")).toArrow()  # bounded: FEATURES + 5
        slope = np.zeros(FEATURES + 5)
        slope[got.column("at").to_numpy()] = got.column("slope").to_numpy()
        slope -= settings.rest * part * np.concatenate([model.weights[:-1], [0.0], model.moves.ravel()])
        moment, size = 0.8 * moment + 0.2 * slope, 0.95 * size + 0.05 * slope**2
        # features with small slopes, those of a few texts only, move less than others
        move = 0.3 * (moment / (1 - 0.8**step)) / (np.sqrt(size / (1 - 0.95**step)) + 0.5 * part)
        move[FEATURES] *= 0.3
        model = Field(model.prior, (model.weights + move[: FEATURES + 1]).astype(np.float32), model.moves + move[FEATURES + 1 :].reshape(2, 2))
        sent.unpersist()
    return model


def train(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> Field:
    """Learns from the labelled rows of docs outside the held-out fold. Without labels of both kinds it knows a prior only."""
    learn = labels.where("toxic in (0, 1)").where(fold_remainder(F.col("doc_id"), settings.folds) != settings.held_fold)
    learn = learn.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))  # a document that is ever marked is toxic
    side = F.broadcast(learn) if learn.count() <= BROADCAST_LABELS else learn
    ids = stage_table(docs.select("doc_id").join(side, "doc_id").groupBy("doc_id", "toxic").agg(F.count("*").alias("n")), "toxicity-ids")
    held = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    n_toxic, n_clean = held.get(1, 0), held.get(0, 0)
    prior = (n_toxic + 1) / (n_toxic + n_clean + 2)
    if not n_toxic or not n_clean:
        return Field(prior)
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = [ids.where(F.col("toxic") == x).orderBy(order, "doc_id").limit(settings.sample).select("doc_id", "toxic") for x in (1, 0)]
    # repeated rows come once
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stage_table(_sample_features(texts.repartition(settings.parts, "doc_id")), "toxicity-sample")
    model = fit(sample, min(n_toxic, settings.sample) + min(n_clean, settings.sample), settings, Field(prior))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, codes, features, toxic in _bags(batch):
                found = evidence(np.zeros(len(toxic)))
                if len(rows):
                    found = sent.value.gradient(rows, codes, features, toxic, settings.noise)[2]
                yield pa.RecordBatch.from_arrays([pa.array(toxic.astype(np.int32)), pa.array(found)], ["toxic", "evidence"])

    found = sample.mapInArrow(weigh, "toxic int, evidence double").toPandas()  # bounded: 2 x sample
    toxic = found["toxic"].to_numpy() == 1
    if toxic.any() and not toxic.all():
        weight = np.where(toxic, n_toxic / toxic.sum(), n_clean / (~toxic).sum())
        model.curve = _logistic(found["evidence"].to_numpy(), toxic, weight / weight.sum() * len(weight))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method for the curve of the labels over the evidence."""
    x, curve, pull = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2), np.diag([1e-6, 1e-3]) * weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + pull
        curve = curve + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - pull @ curve)
    return curve


def score_documents(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, held_out, score, predicted and spans.

    spans are the offsets in code points of words that are toxic with a probability of at least one half. A null or empty
    text, and one without words, scores as a text without any toxic word. Repeated rows come as often as in docs, equal
    texts have equal scores, and columns other than doc_id and text may have any name. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score, rows, p = sent.value.score(part.column("text"))
                spans, first = [[] for _ in range(part.num_rows)], np.searchsorted(rows, np.arange(part.num_rows))
                for r in np.unique(rows[p >= 0.5]).tolist():
                    for k, m in enumerate(re.finditer(WORD, part.column("text")[r].as_py())):
                        if p[first[r] + k] >= 0.5:
                            spans[r].append({"start": m.start(), "end": m.end(), "p": float(p[first[r] + k])})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                predicted = pa.array((score >= settings.threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), predicted, pa.array(spans, kind)], ["doc_id", "held_out", "score", "predicted", "spans"])

    held = fold_remainder(F.col("doc_id"), settings.folds) == settings.held_fold
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, f"doc_id long, held_out boolean, score double, predicted int, spans {SPANS}")


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> DataFrame:
    """docs without the rows that are predicted toxic; columns stay as they are, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(sent.value.score(part.column("text"))[0] < settings.threshold))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
