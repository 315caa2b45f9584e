"""Edit-aware token counts: a segment tree of pre-token runs for each document, updated where edits touch it.

A leaf is a run of pre-tokens of about `leaf_chars` characters. Leaves begin at a single white space character between
others; there the pre-tokeniser always begins a new pre-token, whatever comes before or after, so that the counts of the
leaves add up to that of the text. An edit re-encodes the leaves that it touches, and neighbours where it changes the
characters that make a beginning of a leaf safe; then the sums above them are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import slices

#: Fixed value: the public pre-tokeniser pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 256
EDITS = "array<struct<at:int,drop:int,put:string>>"
TREE = "lengths array<int>, counts array<int>"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(vocabulary: bytes):
    encode = _encoding(vocabulary).encode_ordinary  # its batch form starts threads, which cost more than a leaf
    return lambda texts: [len(encode(t)) for t in texts]


def safe(text: str, i: int) -> bool:
    """Whether a pre-token begins at i whatever stands further off: a lone white space character between others."""
    return 0 < i < len(text) - 1 and text[i].isspace() and not text[i - 1].isspace() and not text[i + 1].isspace()


def cut(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """Leaves of at least leaf_chars characters, except the last."""
    out, start = [], 0
    while start < len(text):
        end = text.find(" ", start + leaf_chars)
        while end > 0 and not safe(text, end):
            end = text.find(" ", end + 1)
        end = end if end > 0 else len(text)
        out.append(text[start:end])
        start = end
    return out or [""]


class SegmentTree:
    """Sums of leaf values; node 1 is the root, node i has children 2 i and 2 i + 1, leaves come last."""

    def __init__(self, sums: np.ndarray):
        self.sums, self.leaves = sums, len(sums) // 2

    @classmethod
    def over(cls, values: list[int]) -> SegmentTree:
        size = 1 << max(0, len(values) - 1).bit_length()
        levels = [np.concatenate([np.asarray(values, np.int64), np.zeros(size - len(values), np.int64)])]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        return cls(np.concatenate([np.zeros(1, np.int64), *reversed(levels)]))

    def put(self, leaf: int, value: int) -> None:
        node = leaf + self.leaves
        delta = value - self.sums[node]
        while node and delta:
            self.sums[node] += delta
            node //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds place at, and where it begins; a place at the end is in the last leaf that isn't empty."""
        node, start = 1, 0
        at = min(at, int(self.sums[1]) - 1)
        while node < self.leaves:
            node *= 2
            if at - start >= self.sums[node]:
                start += int(self.sums[node])
                node += 1
        return node - self.leaves, start

    def total(self) -> int:
        return int(self.sums[1])


def apply_edit(text: str, lengths: SegmentTree, counts: SegmentTree, edit: tuple[int, int, str], count) -> tuple[str, int]:
    """The text after the edit, with both trees updated, and how many characters were encoded again."""
    at = min(max(0, edit[0]), len(text))
    end = min(len(text), at + max(0, edit[1]))
    put = edit[2] or ""
    new = text[:at] + put + text[end:]
    shift = len(new) - len(text)
    first, start = lengths.find(at) if text else (0, 0)
    last, last_start = lengths.find(max(at, end - 1)) if text else (0, 0)
    stop = last_start + int(lengths.sums[lengths.leaves + last])
    # the beginning of a leaf rests on the character before it and the next one: take neighbours in until both ends are sound
    while start > 0 and (at <= start + 1 or not safe(new, start)):
        first, start = lengths.find(start - 1)
    while stop < len(text) and (end >= stop or not safe(new, stop + shift)):
        last, last_start = lengths.find(stop)
        stop = last_start + int(lengths.sums[lengths.leaves + last])
    region = new[start : stop + shift]
    lengths.put(first, len(region))
    counts.put(first, count([region])[0])
    for leaf in range(first + 1, last + 1):
        lengths.put(leaf, 0)
        counts.put(leaf, 0)
    return new, len(region)


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs (doc_id, text, edits) with the trees of their texts: lengths and counts, sums in heap order.

    A null text counts as empty. The vocabulary file is read on the driver and sent to the tasks, its size is fixed.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value)
        for batch in batches:
            for part in slices(batch):
                cuts = [cut(t or "", leaf_chars) for t in part.column("text").to_pylist()]
                n, at, trees = count([leaf for c in cuts for leaf in c]), 0, []
                for c in cuts:
                    trees.append((SegmentTree.over([len(x) for x in c]).sums, SegmentTree.over(n[at : at + len(c)]).sums))
                    at += len(c)
                made = [pa.array([t[k] for t in trees], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], ["doc_id", "text", "edits", "lengths", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits").mapInArrow(run, f"doc_id long, text string, edits {EDITS}, {TREE}")


def apply_edits(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Applies the edits of each row of build_trees, one after the other; places refer to the text as it then stands.

    Returns doc_id, text (edited), lengths and counts (updated trees), tokens_before, tokens_after, n_edits, chars_encoded
    (again) and n_chars (of the edited text). Places beyond the text are taken as its end; null edits are none.
    """
    sent = trees.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(sent.value)
        for batch in batches:
            for part in slices(batch, max_bytes=2 << 20):
                rows = []
                for text, edits, *sums in zip(*(part.column(c).to_pylist() for c in ("text", "edits", "lengths", "counts"))):
                    text, encoded = text or "", 0
                    lengths, counts = (SegmentTree(np.array(s, np.int64)) for s in sums)
                    before = counts.total()
                    for e in edits or []:
                        text, n = apply_edit(text, lengths, counts, (e["at"], e["drop"], e["put"]), count)
                        encoded += n
                    rows.append((text, lengths.sums, counts.sums, before, counts.total(), len(edits or []), encoded, len(text)))
                types = [pa.string(), *[pa.list_(pa.int32())] * 2, *[pa.int64()] * 5]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "text", "lengths", "counts", "tokens_before", "tokens_after", "n_edits", "chars_encoded", "n_chars"])

    return trees.mapInArrow(run, f"doc_id long, text string, {TREE}, tokens_before long, tokens_after long, n_edits long, chars_encoded long, n_chars long")


def sample_edits(doc_id: Column, text: Column, many: int = 3) -> Column:
    """Edits for trying the operator: for each row a few at places that depend on its id."""
    puts = F.array(*[F.lit(x) for x in (" the", "x", "", "\n\n", " 42", "é", " ", "don't stop")])
    length = F.coalesce(F.length(text), F.lit(0))
    one = lambda k: F.struct(
        F.pmod(F.xxhash64(F.lit(3 * k), doc_id), length + 1).cast("int").alias("at"),
        F.pmod(F.xxhash64(F.lit(3 * k + 1), doc_id), F.lit(12)).cast("int").alias("drop"),
        F.element_at(puts, F.pmod(F.xxhash64(F.lit(3 * k + 2), doc_id), F.lit(8)).cast("int") + 1).alias("put"),
    )
    return F.array(*[one(k) for k in range(many)])
