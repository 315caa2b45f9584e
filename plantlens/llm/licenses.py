"""License scans: an exact set-similarity join of text blocks with license templates, and exact phrases.

A block is a window of words; its length is a power of two of at least twice the words of the templates that it is for,
and windows overlap by half, so that every passage as long as a template lies in one whole. A block meets a template if
it holds at least `containment` of the template's distinct words. Words are ordered by their frequency in the whole
corpus, rare ones first. A block can only meet a template if it holds a word of the template's prefix (prefix filter),
enough template words altogether (length filter), and enough of them from the first common word on (positional filter);
what passes is compared exactly. Templates are constants, so their table is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import row_key, slices, stage_table

#: Phrases that are labels by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Well-known notices of public licenses, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any "
        "kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event "
        "shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising "
        "from, out of or in connection with the Software or the use or other dealings in the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions "
        "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
)
CONTAINMENT = 0.9
#: A-Z to a-z, and what is no ASCII letter or digit to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    """The words of a text in UTF-8, with separators as spaces."""
    return (text or "").encode().translate(_FOLD)


def template_sets(templates=TEMPLATES) -> list[tuple[str, int, list[bytes]]]:
    """Label, words of its blocks and distinct words of each template."""
    words = [(label, fold(text).split()) for label, text in templates]
    return [(label, 1 << max(4, 2 * len(w) - 1).bit_length(), sorted(set(w))) for label, w in words]


def word_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """How often each of some words comes in all texts; bounded by the words asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                seen = Counter(b" ".join(map(fold, part.column("text").to_pylist())).split())
                total.update({w: seen[w] for w in words if w in seen})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return {bytes(w): n for w, n in docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()}


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(index of the first word, label) of each place of a phrase."""
    out = []
    for phrase, label in PHRASES.items():
        *before, last = phrase.encode().split()
        at = -1
        for _ in range(words.count(last)):
            at = words.index(last, at + 1)
            if at >= len(before) and words[at - len(before) : at] == before:
                out.append((at - len(before), label))
    return out


def blocks_of(hits: np.ndarray, width: int, wanted: set[int], prefix: set[int]) -> list[dict]:
    """Blocks of `width` words with a word of the prefix, and the wanted ranks in each; hits are (place, rank), places ascending."""
    hits = hits[np.isin(hits[:, 1], list(wanted))]
    inside = hits[:, 0] // (width // 2)
    block, rank = np.concatenate([inside, inside - 1]), np.concatenate([hits[:, 1], hits[:, 1]])
    many = int(rank.max(initial=0)) + 1
    found = np.stack(np.divmod(np.unique(np.maximum(block, 0) * many + rank), many), axis=1)
    starts = np.flatnonzero(np.diff(found[:, 0], prepend=-1))
    hot = np.logical_or.reduceat(np.isin(found[:, 1], list(prefix)), starts) if len(starts) else []
    ends = np.append(starts[1:], len(found))
    return [{"width": width, "block": int(found[a, 0]), "ranks": found[a:e, 1].tolist()} for a, e, h in zip(starts, ends, hot) if h]


def scan_licenses(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Of each row of docs (doc_id, text): words, places of phrases, and labels with the best containment.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score: 1 where a phrase
    stands, else the largest containment of a template that is met, else 0. A null text counts as empty, and has nulls
    for first_word and last_word; no rows give no rows. Repeated rows come as often as in docs. Columns other than doc_id
    (a number) and text aren't read, so they may have any name.
    """
    sets = template_sets(templates)
    frequency = word_frequencies(docs, {w for *_, s in sets for w in s})
    order = sorted({w for *_, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: r for r, w in enumerate(order)}
    ranked = [(label, width, sorted(rank[w] for w in s)) for label, width, s in sets]
    needed = [int(-(-len(s) * round(containment * 1000) // 1000)) for *_, s in ranked]
    heads = [(r, i, width, label, s, m) for (label, width, s), m in zip(ranked, needed) for i, r in enumerate(s[: len(s) - m + 1])]
    widths = {w: ({r for _, v, s in ranked if v == w for r in s}, {h[0] for h in heads if h[2] == w}) for _, w, _ in ranked}
    hint = re.compile(rb"(?<![^ ])(?:%s)(?![^ ])" % b"|".join(re.escape(order[r]) for r in sorted({h[0] for h in heads})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    folded = fold(text)
                    words, places, blocks = folded.split(), [], []
                    if b"license" in folded:
                        places = phrase_places(words)
                    if hint.search(folded):
                        hits = np.array([(i, rank[w]) for i, w in enumerate(words) if w in rank])
                        blocks = [b for width, (wanted, prefix) in widths.items() for b in blocks_of(hits, width, wanted, prefix)]
                    starts = [p for p, _ in places]
                    rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), blocks))
                types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("width", pa.int32()), ("block", pa.int64()), ("ranks", pa.list_(pa.int32()))]))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "uid", "vid")), *columns], ["doc_id", "uid", "vid", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text"), "text")
    scanned = stage_table(
        rows.mapInArrow(run, "doc_id long, uid long, vid long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<width:int,block:long,ranks:array<int>>>"),
        "licenses",
    )

    table = docs.sparkSession.createDataFrame(heads, "rank int, i int, width int, label string, template_ranks array<int>, needed int")
    blocks = scanned.select("uid", "vid", F.explode("blocks").alias("b")).select("uid", "vid", "b.width", "b.ranks", F.posexplode("b.ranks").alias("j", "rank"))
    rest = 1 + F.least(F.size("template_ranks") - F.col("i") - 1, F.size("ranks") - F.col("j") - 1)
    pairs = blocks.join(F.broadcast(table), ["width", "rank"]).where((F.size("ranks") >= F.col("needed")) & (rest >= F.col("needed")))
    overlap = F.size(F.array_intersect("ranks", "template_ranks"))
    met = pairs.where(overlap >= F.col("needed")).select("uid", "vid", "label", (overlap / F.size("template_ranks")).alias("containment"))
    met = met.groupBy("uid", "vid").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return scanned.drop("blocks").join(met, ["uid", "vid"], "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
