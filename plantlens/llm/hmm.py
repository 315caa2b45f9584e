"""Language-model scoring with a hidden Markov model over word classes.

A token is emitted in two steps: its state emits a class (one of a fixed number of hash buckets, or the end of the text),
and the class emits the word, with probability (c + 0.5) / (C + 0.5 * (V + 1)) from the counts of the training texts. So
the model is normalised over all words, unknown ones included, while states hold a table of bounded size.

Baum-Welch: each task runs the scaled forward-backward recursion over its texts and sends expected counts, which Spark
adds up; the driver holds states x classes numbers only. Word counts and the sum over each text's words are joins; words
with more than 1 / HEAVY of all tokens (at most HEAVY of them, whatever the input) are looked up in the task instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import fold_remainder, hashes_of, slices, stage_table, words_of
from plantlens.llm.packed import Layout

#: No more words than this are looked up from a broadcast: those with at least this part of all tokens.
HEAVY = 1 << 20


@dataclass(frozen=True)
class LmSettings:
    """classes: a power of two. Texts of more than `piece` tokens go through memory in pieces, and the forward and backward
    vectors are carried over their borders, so that results don't depend on it."""

    states: int = 6
    classes: int = 8192
    rounds: int = 4
    piece: int = 1 << 17
    seed: int = 5


class Model:
    """start (K), moves (K, K) and emits (K, classes + 1); the last class is the end of a text."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, np.ascontiguousarray(emits.T)

    @classmethod
    def first(cls, share: np.ndarray, settings: LmSettings) -> Model:
        """States that differ from the overall shares of the classes by chance."""
        rng, k = np.random.default_rng(settings.seed), settings.states
        emits = share * rng.gamma(2.0, size=(k, len(share)))
        moves = np.full((k, k), 0.2 / k) + 0.8 * np.eye(k)
        return cls(np.full(k, 1 / k), moves, emits / emits.sum(axis=1, keepdims=True))


class _Packed(Layout):
    """Class codes of sequences in time-major order."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        super().__init__(starts, lengths)
        self.codes = self.pack(codes)

    def forward(self, model: Model, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward probabilities and the scale of each token; the log scales add up to the log likelihood.

        first: probabilities of the states of the first tokens, those of the start unless given.
        """
        seen = model.emits[self.codes]
        scale, ones, a = np.empty(len(seen)), np.ones(seen.shape[1]), None
        for s, n in self.steps():
            a = (a[:n] @ model.moves if s.start else model.start if first is None else first) * seen[s]
            scale[s] = c = a @ ones
            a /= c[:, None]
            seen[s] = a
        return seen, scale

    def log10_likelihood(self, model: Model) -> np.ndarray:
        """Of each sequence, in the order that was given."""
        logs = np.log10(self.forward(model)[1])
        out = np.zeros(len(self.order))
        total = np.zeros(self.live[0])
        for s, n in self.steps():
            total[:n] += logs[s]
        out[self.order] = total
        return out

    def expected_counts(self, model: Model, first: np.ndarray | None = None, beyond: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of starts, moves and emissions, by the backward recursion over the scaled forward probabilities.

        beyond: what the recursion brings from the text's next piece, for a single sequence; the last value is what it
        brings to the piece before.
        """
        alpha, scale = self.forward(model, first)
        after = np.empty_like(alpha)  # emission times backward probability over scale
        gamma, back = np.empty_like(alpha), beyond
        for s, n in reversed(list(self.steps())):
            beta = np.ones((n, alpha.shape[1]))
            if back is not None:
                beta[: len(back)] = back @ model.moves.T
            gamma[s] = alpha[s] * beta
            after[s] = back = model.emits[self.codes[s]] * beta / scale[s][:, None]
        moves = model.moves * (alpha[self.before()].T @ after[self.live[0] :])
        if beyond is not None:
            moves += model.moves * np.outer(alpha[-1], beyond)
        emits = np.stack([np.bincount(self.codes, weights=g, minlength=len(model.emits)) for g in gamma.T])
        return gamma[: self.live[0]].sum(axis=0), moves, emits, back


def _pieces(codes: np.ndarray, piece: int) -> list[_Packed]:
    return [_Packed(codes, np.array([k]), np.array([min(piece, len(codes) - k)])) for k in range(0, len(codes), piece)]


def long_likelihood(codes: np.ndarray, model: Model, piece: int) -> float:
    """log10 likelihood of one long sequence, piece by piece."""
    first, total = None, 0.0
    for pack in _pieces(codes, piece):
        alpha, scale = pack.forward(model, first)
        total += float(np.log10(scale).sum())
        first = alpha[-1:] @ model.moves
    return total


def long_counts(codes: np.ndarray, model: Model, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of one long sequence: forward for the states at the borders, then piece by piece from the last."""
    packs, firsts = _pieces(codes, piece), [None]
    for pack in packs[:-1]:
        firsts.append(pack.forward(model, firsts[-1])[0][-1:] @ model.moves)
    moves, emits, beyond, start = np.zeros_like(model.moves), np.zeros(model.emits.T.shape), None, None
    for pack, first in zip(reversed(packs), reversed(firsts)):
        start, m, e, beyond = pack.expected_counts(model, first, beyond)
        moves, emits = moves + m, emits + e
    return start, moves, emits


def _packs(column: pa.ListArray, tokens: int, piece: int) -> Iterator[tuple[np.ndarray, _Packed | np.ndarray]]:
    """Rows with their packed sequences, of about so many tokens and similar lengths at a time; longer ones by themselves."""
    codes = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts, order = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable")
    fits = order[lengths[order] <= piece]
    ends, first = np.cumsum(lengths[fits]), 0
    while first < len(fits):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + tokens, side="right")))
        rows = fits[first:last]
        yield rows, _Packed(codes, starts[rows], lengths[rows])
        first = last
    for row in order[lengths[order] > piece]:
        yield np.array([row]), codes[starts[row] : starts[row] + lengths[row]]


def word_counts(docs: DataFrame) -> DataFrame:
    """(text, held_out) to (word, n_train, n_all), words by their hash; the end of a text is the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int((~held).sum())]), pa.array([len(held)])], ["word", "n_train", "n_all"])
            for part in slices(batch):
                rows, codes, words = words_of(part.column("text"))
                trained = ~part.column("held_out").to_numpy(zero_copy_only=False)[rows]
                n_all, n_train = np.bincount(codes, minlength=len(words)), np.bincount(codes[trained], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array(hashes_of(words).view(np.int64)), pa.array(n_train), pa.array(n_all)], ["word", "n_train", "n_all"])

    parts = docs.select("text", "held_out").mapInArrow(run, "word long, n_train long, n_all long")
    return parts.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def class_sequences(docs: DataFrame, classes: int) -> DataFrame:
    """(key, held_out, text) to (key, held_out, codes): the class of each word and that of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, codes, words = words_of(part.column("text"))
                n = np.bincount(rows, minlength=part.num_rows) + 1
                out = np.full(n.sum(), classes, np.int16)
                out[np.arange(len(rows)) + rows] = (hashes_of(words) % np.uint64(classes)).astype(np.int16)[codes]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "uid", "held_out")), pa.ListArray.from_arrays(offsets, pa.array(out))], ["doc_id", "uid", "held_out", "codes"])

    return docs.mapInArrow(run, "doc_id long, uid long, held_out boolean, codes array<short>")


def baum_welch(sequences: DataFrame, share: np.ndarray, settings: LmSettings) -> Model:
    """Trains on (codes). Expected counts are smoothed by the overall shares of the classes."""
    model, k = Model.first(share, settings), settings.states
    for _ in range(settings.rounds):

        def count(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(k), np.zeros((k, k)), np.zeros((k, len(share)))]
            for batch in batches:
                for _, pack in _packs(batch.column("codes"), 400_000, settings.piece):
                    found = pack.expected_counts(model) if isinstance(pack, _Packed) else long_counts(pack, model, settings.piece)
                    for t, x in zip(total, found):
                        t += x
            flat = np.concatenate([t.ravel() for t in total])
            cells = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], ["cell", "n"])

        cells = sequences.select("codes").mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        flat = np.zeros(k + k * k + k * len(share))
        for cell, n in cells.toPandas().itertuples(index=False):  # bounded: states x classes
            flat[cell] = n
        start, moves, emits = flat[:k] + 1.0, flat[k : k + k * k].reshape(k, k) + 1.0, flat[k + k * k :].reshape(k, -1) + 100.0 * share
        model = Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))
    return model


def score_texts(docs: DataFrame, folds: int = 5, held_fold: int = 1, settings: LmSettings = LmSettings()) -> DataFrame:
    """Scores all texts of docs (doc_id, text) by a model that learns from those outside the held-out fold.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word frequencies) and score (hidden
    Markov model), both log10 probabilities. A null text counts as empty: it is the end token alone. Repeated rows are
    scored as often as they come. An empty table gives an empty result; with no training text all words are unknown.
    doc_id is a number; columns other than doc_id and text aren't read, so they may have any name.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), (fold_remainder(F.col("doc_id"), folds) == held_fold).alias("held_out"), "text")
    classes = settings.classes
    of_class = F.when(F.col("word").isNull(), classes).otherwise(F.expr(f"cast(pmod(word, {classes}L) as int)"))
    counts = stage_table(word_counts(docs).withColumn("class", of_class), "hmm-counts")
    trained = F.col("n_train") > 0
    by_class = counts.groupBy("class").agg(F.sum("n_train").alias("n"), F.count_if(trained).alias("v"), F.sum("n_all").alias("all")).toPandas()  # bounded: classes + 1
    n_class, v_class = np.zeros(classes + 1), np.zeros(classes + 1)
    n_class[by_class["class"]], v_class[by_class["class"]] = by_class["n"], by_class["v"]
    n_train, v_train, n_all = float(n_class.sum()), float(v_class.sum()), float(by_class["all"].sum())
    unknown, over = 0.5, n_train + 0.5 * (v_train + 1)
    heavy = counts.where(F.col("word").isNotNull() & (F.col("n_all") >= max(2.0, n_all / HEAVY))).select("word", "n_train").toPandas().sort_values("word")  # at most HEAVY
    end_count = int(n_class[classes])
    lookup = docs.sparkSession.sparkContext.broadcast((heavy["word"].to_numpy(np.int64), heavy["n_train"].to_numpy(np.float64), n_class, v_class))

    sequences = stage_table(class_sequences(docs, classes), "hmm-classes")
    share = (n_class + 1.0) / (n_class + 1.0).sum()
    model = baum_welch(sequences.where("not held_out"), share, settings)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for rows, pack in _packs(batch.column("codes"), 400_000, settings.piece):
                score[rows] = pack.log10_likelihood(sent.value) if isinstance(pack, _Packed) else long_likelihood(pack, sent.value, settings.piece)
            n = batch.column("codes").value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "uid", "held_out")), n, pa.array(score)], ["doc_id", "uid", "held_out", "n_tokens", "classes_score"])

    def word_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with the sums over the heavy words of each text, and rows with the other words and how often they come."""
        words, counts, n_class, v_class = lookup.value
        names = ["doc_id", "uid", "word", "n", "known", "base", "inner"]
        for batch in batches:
            for part in slices(batch):
                rows, codes, found = words_of(part.column("text"))
                word = hashes_of(found)
                at = np.minimum(np.searchsorted(words, word.view(np.int64)), max(0, len(words) - 1))
                is_heavy = words[at] == word.view(np.int64) if len(words) else np.zeros(len(word), bool)
                c = np.where(is_heavy, counts[at] if len(words) else 0.0, 0.0)
                k = (word % np.uint64(classes)).astype(np.int64)
                base, inner = np.log10((c + 0.5) / over), np.log10((c + 0.5) / (n_class[k] + 0.5 * (v_class[k] + 1)))
                h = is_heavy[codes]
                add = lambda x: pa.array(np.bincount(rows[h], weights=x[codes[h]], minlength=part.num_rows))  # noqa: E731, B023
                ids, uids, n = part.column("doc_id"), part.column("uid"), part.num_rows
                yield pa.RecordBatch.from_arrays([ids, uids, uids, pa.array(np.zeros(n, np.int64)), add((c > 0) * 1.0), add(base), add(inner)], names)
                pair, many = np.unique(rows[~h] * len(found) + codes[~h], return_counts=True)
                row, code = pa.array(pair // max(1, len(found))), pair % max(1, len(found))
                empty = pa.nulls(len(pair), pa.float64())
                yield pa.RecordBatch.from_arrays([ids.take(row), uids.take(row), pa.array(word[code].view(np.int64)), pa.array(many.astype(np.int64)), empty, empty, empty], names)

    parts = docs.mapInArrow(word_terms, "doc_id long, uid long, word long, n long, known double, base double, inner double")
    tables = docs.sparkSession.createDataFrame([(i, float(n), float(v)) for i, (n, v) in enumerate(zip(n_class, v_class))], "class int, n_class double, v_class double")
    rare_counts = counts.where(F.col("word").isNotNull() & (F.col("n_train") > 0)).select("word", F.col("n_train").alias("c"))
    # a text's own row has n = 0 and, so that such rows spread over the join, its uid for a word
    terms = parts.join(rare_counts, "word", "left").withColumn("class", F.expr(f"cast(pmod(word, {classes}L) as int)"))
    terms = terms.join(F.broadcast(tables), "class")  # classes + 1 rows
    c, own = F.coalesce("c", F.lit(0.0)), F.col("n") == 0
    terms = terms.select(
        "doc_id", "uid", own.cast("int").alias("copies"), F.when(own, F.col("known")).otherwise(F.col("n") * (c > 0).cast("int")).alias("known"),
        F.when(own, F.col("base")).otherwise(F.col("n") * F.log10((c + unknown) / F.lit(over))).alias("base"),
        F.when(own, F.col("inner")).otherwise(F.col("n") * F.log10((c + 0.5) / (F.col("n_class") + 0.5 * (F.col("v_class") + 1)))).alias("inner"),
    )
    sums = terms.groupBy("doc_id", "uid").agg(*[F.sum(x).alias(x) for x in ("copies", "known", "base", "inner")])
    scored = sequences.mapInArrow(likelihoods, "doc_id long, uid long, held_out boolean, n_tokens long, classes_score double").alias("s")
    joined = scored.join(sums.alias("w"), F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.uid") == F.col("w.uid")))
    each = lambda x: F.col(f"w.{x}") / F.col("w.copies")
    return joined.select(
        "s.doc_id", "s.held_out", "s.n_tokens", (F.round(each("known")).cast("long") + F.lit(int(end_count > 0))).alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (each("base") + float(np.log10((end_count + 0.5) / over))).alias("base_score"), (F.col("s.classes_score") + each("inner")).alias("score"),
    )
