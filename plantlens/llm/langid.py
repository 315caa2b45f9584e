"""Language identification by unigram models whose segmentations are summed out.

The vocabulary is a fixed public one of word pieces; it isn't trained. Each language has a probability for every piece. A word
has many segmentations into pieces, and its probability in a language is the sum over all of them, which a forward algorithm
takes in one pass over the word: the sum at a place is over the pieces that end there. A text is scored in every language as
the product over its words and the language's share of the training texts; the best language is its prediction.

Probabilities are learned by expectation maximisation, where the backward pass gives each piece its expected count over all
segmentations: first on a bounded sample of the labelled texts, then once over all of them.

A task cuts its texts into words and runs the passes over all distinct words of a slice at once, place by place from their
beginnings. Substrings are looked up by rolling 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import fold_remainder, shared_folder, slices, stage_table

UNKNOWN = "und"
#: A word begins with this mark in the vocabulary.
MARK = "▁"
#: Columns of languages that go through the passes together, and characters of words.
TOGETHER, AT_ONCE = 8, 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LangSettings:
    """sample: distinct texts of each language that the first `rounds` of training take. span: longer words are cut after so
    many characters, and no piece crosses a cut. languages: more than this raise an error, as models are held in memory."""

    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    sample: int = 400
    rounds: int = 3
    smoothing: float = 0.05
    span: int = 64
    languages: int = 256


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A number of 64 mixed bits for each character."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


class Pieces:
    """The vocabulary: hashes of its pieces with their numbers in buckets by their upper bits, and the numbers of single bytes."""

    BUCKET_BITS = 19

    def __init__(self, model: bytes):
        import sentencepiece

        held = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = held.get_piece_size()
        self.bytes = np.array([k for k in range(self.size) if held.is_byte(k)], np.int64)
        plain = {k: held.id_to_piece(k) for k in range(self.size) if not (held.is_byte(k) or held.is_control(k) or held.is_unknown(k))}
        plain = {k: name for k, name in plain.items() if MARK not in name[1:]}
        self.longest = max(map(len, plain.values()))
        hashes = np.array([_hash(name) for name in plain.values()], np.uint64)
        order = np.argsort(hashes)
        buckets = (hashes[order] >> np.uint64(64 - self.BUCKET_BITS)).astype(np.int64)
        self.begins = np.searchsorted(buckets, np.arange(1 << self.BUCKET_BITS)).astype(np.int32)
        self.held = np.bincount(buckets, minlength=1 << self.BUCKET_BITS).astype(np.int8)
        self.fullest = int(self.held.max())
        self.hashes = np.append(hashes[order], np.uint64(0))  # so that an empty last bucket has a place to look at
        self.numbers = np.append(np.array(list(plain), np.int32)[order], np.int32(-1))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, or -1."""
        bucket = (hashes >> np.uint64(64 - self.BUCKET_BITS)).astype(np.int64)
        at = self.begins[bucket]
        out = np.where(self.hashes[at] == hashes, self.numbers[at], np.int32(-1))
        more = np.nonzero(self.held[bucket] > 1)[0]  # few buckets hold several
        for k in range(1, self.fullest):
            more = more[(out[more] < 0) & (self.held[bucket[more]] > k)]
            found = self.hashes[at[more] + k] == hashes[more]
            out[more[found]] = self.numbers[at[more[found]] + k]
        return out


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    return Pieces(model)


def _powers(odd: int, n: int) -> list[np.uint64]:
    return [np.uint64(pow(odd, k, 1 << 64)) for k in range(n)]


def _hash(text: str) -> np.uint64:
    """The sum of mixed characters times powers of an odd number, modulo 2^64."""
    mixed = _mixed(_codes([text]))
    return (mixed * np.array(_powers(int(_ODD), len(mixed)), np.uint64)).sum(dtype=np.uint64)


class Lattice:
    """All segmentations of some spans, the longest spans first: at each place lie those that are long enough.

    number[p][m - 1] is the piece of m characters at place p of each span that is long enough, or the row `none`. A character
    that is no piece itself has a further number and is the sequence of its bytes.
    """

    def __init__(self, spans: list[str], pieces: Pieces):
        codes, lengths = _codes(spans), np.array([len(s) for s in spans], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        starts, longest = (np.cumsum(lengths) - lengths)[self.order], int(lengths.max(initial=0))
        self.many = np.searchsorted(-lengths[self.order], -np.arange(longest + 2), side="right")  # spans of at least p characters
        self.length, self.pieces = longest, pieces
        forth, back = _powers(int(_ODD), longest + 1), _powers(pow(int(_ODD), -1, 1 << 64), longest + 1)
        sums, chars = [np.zeros(len(spans), np.uint64)], []
        for p in range(longest):
            n = self.many[p + 1]
            chars.append(codes[starts[:n] + p])
            sums.append(sums[p][:n] + _mixed(chars[p]) * forth[p])
        self.number = []
        for p in range(longest):
            ends = range(p + 1, min(longest, p + pieces.longest) + 1)
            self.number.append([pieces.find((sums[q] - sums[p][: self.many[q]]) * back[p]) for q in ends])
        alone = [np.nonzero(sizes[0] < 0)[0] for sizes in self.number]
        self.rare, which = np.unique(np.concatenate([c[a] for c, a in zip(chars, alone)] or [codes[:0]]), return_inverse=True)
        self.none, at = pieces.size + len(self.rare), 0
        for sizes, a in zip(self.number, alone):
            sizes[0][a] = pieces.size + which[at : at + len(a)]
            at += len(a)
            for numbers in sizes[1:]:
                numbers[numbers < 0] = self.none
        self.spelled = [pieces.bytes[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in self.rare.tolist()]

    def weights(self, logs: np.ndarray) -> np.ndarray:
        """Log probability by number, from those of the pieces by language."""
        spelled = np.array([logs[b].sum(axis=0) for b in self.spelled]).reshape(len(self.rare), logs.shape[1])
        return np.concatenate([logs, spelled, np.full((1, logs.shape[1]), -np.inf)])

    def forward(self, weights: np.ndarray) -> list[np.ndarray]:
        """For each place, the log probability of what lies before it, over all segmentations."""
        out = [np.zeros((self.many[0], weights.shape[1]))]
        for q in range(1, self.length + 1):
            n = self.many[q]
            out.append(_log_sum([out[q - m][:n] + weights[self.number[q - m][m - 1]] for m in range(1, min(q, self.pieces.longest) + 1)], n))
        return out

    def backward(self, weights: np.ndarray) -> list[np.ndarray]:
        """For each place, the log probability of what lies behind it."""
        out = [np.zeros((self.many[p], weights.shape[1])) for p in range(self.length + 1)]
        for p in reversed(range(self.length)):
            n = self.many[p + 1]
            out[p][:n] = _log_sum([weights[numbers] + out[p + m][: len(numbers)] for m, numbers in enumerate(self.number[p], 1)], n)
        return out

    def _whole(self, ahead: list[np.ndarray]) -> np.ndarray:
        """Log probability of each span, the longest first."""
        return np.concatenate([ahead[q][self.many[q + 1] : self.many[q]] for q in range(self.length, -1, -1)])

    def likelihoods(self, logs: np.ndarray) -> np.ndarray:
        """Log probability of each span by language, over all segmentations."""
        out = np.zeros((len(self.order), logs.shape[1]))
        out[self.order] = self._whole(self.forward(self.weights(logs)))
        return out

    def expected(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in one language (logs has one column), where spans occur so many times."""
        weights = self.weights(logs)
        ahead, behind = self.forward(weights), self.backward(weights)
        rest = np.log(times[self.order]) - self._whole(ahead)[:, 0]
        counts = np.zeros(self.none + 1)
        for p, sizes in enumerate(self.number):
            for m, numbers in enumerate(sizes, 1):
                n = len(numbers)
                counts += np.bincount(numbers, np.exp(ahead[p][:n, 0] + weights[numbers, 0] + behind[p + m][:n, 0] + rest[:n]), len(counts))
        for n, spelled in zip(counts[self.pieces.size :], self.spelled):
            np.add.at(counts, spelled, n)
        return counts[: self.pieces.size]


def _log_sum(terms: list[np.ndarray], n: int) -> np.ndarray:
    """log of the sum of exp of some terms; the first has all n rows and is finite, others may have the first rows only."""
    top = terms[0].copy()
    for t in terms[1:]:
        np.maximum(top[: len(t)], t, out=top[: len(t)])
    total = np.exp(terms[0] - top)
    for t in terms[1:]:
        total[: len(t)] += np.exp(t - top[: len(t)])
    return top + np.log(total)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row, code and list of the words of some texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(keep).dictionary_encode()
    return rows.filter(keep).to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _lattices(words: list[str], pieces: Pieces, span: int) -> Iterator[tuple[Lattice, np.ndarray]]:
    """Lattices over the spans of words, some words of like length at a time, with each span's word."""
    spans, owner, size = [], [], 0
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        word = MARK + words[k]
        cut = [word] if len(word) <= span else [word[a : a + span] for a in range(0, len(word), span)]
        spans += cut
        owner += [k] * len(cut)
        size += len(word)
        if size >= AT_ONCE:
            yield Lattice(spans, pieces), np.array(owner)
            spans, owner, size = [], [], 0
    if spans:
        yield Lattice(spans, pieces), np.array(owner)


def _columns(logs: np.ndarray) -> Iterator[slice]:
    for a in range(0, logs.shape[1], TOGETHER):
        yield slice(a, min(a + TOGETHER, logs.shape[1]))


def word_likelihoods(words: list[str], pieces: Pieces, logs: np.ndarray, span: int) -> np.ndarray:
    """Log probability of each word by language; logs: of the pieces by language."""
    out = np.zeros((len(words), logs.shape[1]))
    for lattice, owner in _lattices(words, pieces, span):
        for c in _columns(logs):
            found = lattice.likelihoods(logs[:, c])
            for k in range(found.shape[1]):
                out[:, c.start + k] += np.bincount(owner, found[:, k], len(words))
    return out


def _expected_counts(texts: DataFrame, model, logs: np.ndarray, settings: LangSettings) -> np.ndarray:
    """Expected counts of pieces by language over texts (lang_index, text), added up by Spark."""
    context, many = texts.sparkSession.sparkContext, logs.shape[1]
    sent, span = context.broadcast(logs), settings.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs, total = pieces_of(model.value), sent.value, np.zeros(sent.value.shape)
        for batch in batches:
            for part in slices(batch):
                rows, codes, words = _words(part.column("text"))
                language = part.column("lang_index").to_numpy(zero_copy_only=False).astype(np.int64)
                for k in np.unique(language).tolist():
                    own = codes[language[rows] == k]
                    used, times = np.unique(own, return_counts=True)
                    for lattice, owner in _lattices([words[c] for c in used.tolist()], pieces, span):
                        total[:, k] += lattice.expected(logs[:, k : k + 1], times[owner].astype(float))
        pa.default_memory_pool().release_unused()
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang_index", "n"])

    counts = texts.select("lang_index", "text").mapInArrow(run, "piece int, lang_index int, n double").groupBy("piece", "lang_index").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    out = np.zeros(logs.shape)
    out[counts["piece"].to_numpy(), counts["lang_index"].to_numpy()] = counts["n"].to_numpy()
    return out


def _logs(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log probabilities of pieces from counts; each piece has a further `smoothing`."""
    return np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * len(counts)))


@dataclass(frozen=True)
class LangModel:
    languages: list[str]
    priors: np.ndarray
    logs: np.ndarray


def train(labelled: DataFrame, settings: LangSettings = LangSettings()) -> LangModel:
    """labelled (text, lang), nulls in lang left out, to a model of every language. Null texts count as empty ones."""
    spark = labelled.sparkSession
    shared_folder(spark)
    labelled = labelled.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("texts")).orderBy("lang").limit(settings.languages + 1).collect()
    if len(known) > settings.languages:
        raise ValueError(f"more than {settings.languages} languages")
    with open(settings.vocabulary, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    logs = np.full((pieces_of(model.value).size, len(known)), -np.log(pieces_of(model.value).size))
    if known:
        # a language's texts whose hash is below its threshold are about `sample` distinct ones
        limits = [(r.lang, k, int(min(1.0, settings.sample / max(1, r.texts)) * (1 << 32))) for k, r in enumerate(known)]
        table = F.broadcast(spark.createDataFrame(limits, "lang string, lang_index int, below long"))  # settings.languages rows at most
        coded = labelled.join(table, "lang")
        key = F.xxhash64("text")
        chosen = coded.where(F.pmod(key, F.lit(1 << 32)) < F.col("below")).withColumn("key", key).dropDuplicates(["lang_index", "key"])
        sample = stage_table(chosen.select("lang_index", "text"), "language-sample")
        for texts in [sample] * settings.rounds + [coded]:
            logs = _logs(_expected_counts(texts, model, logs, settings), settings.smoothing)
    n = np.array([r.n for r in known], float)
    return LangModel([r.lang for r in known], np.log(n / max(1.0, n.sum())), logs)


def predict(docs: DataFrame, model: LangModel, settings: LangSettings = LangSettings()) -> DataFrame:
    """doc_id, lang_pred and score (the prediction's share of the probability of all languages) of every whole text.

    A null text, or one without a letter, is `und`, with score 0; so are all if the model has no language. Ties go to the
    language that comes first by code point. Repeated rows are rows of their own; a null doc_id stays null; an empty table
    gives none. Other columns aren't read, so they may have any name.
    """
    context = docs.sparkSession.sparkContext
    with open(settings.vocabulary, "rb") as f:
        sent = context.broadcast((f.read(), model))
    span = settings.span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = sent.value
        pieces = pieces_of(vocabulary)
        for batch in batches:
            for part in slices(batch):
                total = np.tile(held.priors, (part.num_rows, 1))
                rows, codes, words = _words(part.column("text"))
                scores = word_likelihoods(words, pieces, held.logs, span)
                for k in range(len(held.languages)):
                    total[:, k] += np.bincount(rows, scores[codes, k], part.num_rows)
                best = total.argmax(axis=1) if held.languages else np.zeros(part.num_rows, int)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True, initial=-np.inf)).sum(axis=1) if held.languages else np.zeros(part.num_rows)
                sure = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & bool(held.languages)
                names = pa.array([held.languages[b] if s else UNKNOWN for b, s in zip(best, sure)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), names, pa.array(np.where(sure, share, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), F.when(lettered, F.col("text")).alias("text"), lettered.alias("lettered"))
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that no model is learned from: crc32 of the id as text is a multiple of 5."""
    return fold_remainder(doc_id, 5) == 0


def identify(docs: DataFrame, settings: LangSettings = LangSettings()) -> DataFrame:
    """docs (doc_id, text, lang) to doc_id, held_out, lang_pred and score; learned from the rows that aren't held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), settings)
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, settings)
