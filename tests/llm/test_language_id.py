import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.llm import langid, queries

SCHEMA = "doc_id long, text string, lang string, score string, lang_index int, held_out string"


@pytest.fixture(scope="module")
def vocabulary():
    with open(langid.LangSettings().vocabulary, "rb") as f:
        return f.read()


def segmentations(text, names):
    """All ways to cut text into pieces; a character without a piece is its bytes."""
    if not text:
        return [[]]
    out = []
    for n in range(1, min(len(text), 16) + 1):
        if text[:n] in names:
            heads = [names[text[:n]]]
        elif n == 1:
            heads = [names[f"<0x{b:02X}>"] for b in text[0].encode("utf-8", "surrogatepass")]
        else:
            continue
        out += [heads + rest for rest in segmentations(text[n:], names)]
    return out


def named(vocabulary):
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
    return {held.id_to_piece(k): k for k in range(held.get_piece_size()) if not held.is_control(k) and not held.is_unknown(k)}


WORDS = ["hello", "Straße", "日本語", "a", "naïve", "\U0001f9ff", "xqzt", "the", "queños", "ööö", "b"]


def test_likelihoods_and_counts_sum_over_all_segmentations(vocabulary):
    pieces, names = langid.Pieces(vocabulary), named(vocabulary)
    logs = np.log(np.random.default_rng(3).dirichlet(np.full(pieces.size, 0.5), 3).T + 1e-13)
    got = langid.word_likelihoods(WORDS, pieces, logs, 64)
    want, counts = [], np.zeros(pieces.size)
    for k, word in enumerate(WORDS):
        ways = segmentations(langid.MARK + word, names)
        scores = np.array([logs[w].sum(axis=0) for w in ways])
        want.append(np.logaddexp.reduce(scores, axis=0))
        for way, share in zip(ways, np.exp(scores[:, 0] - want[-1][0])):
            np.add.at(counts, way, (k + 1) * share)
    assert np.allclose(got, want)
    (lattice, owner), *more = langid._lattices(WORDS, pieces, 64)
    assert not more and np.allclose(lattice.expected(logs[:, :1], owner + 1.0), counts)


def test_long_words_are_cut_and_nothing_is_lost(vocabulary):
    pieces = langid.Pieces(vocabulary)
    logs = np.full((pieces.size, 2), -np.log(pieces.size))
    word = "".join(random.Random(2).choice("abcé漢") for _ in range(5000))
    spans = [(langid.MARK + word)[a : a + 64] for a in range(0, 5001, 64)]
    lattice = langid.Lattice(spans, pieces)
    assert np.allclose(langid.word_likelihoods([word], pieces, logs, 64), lattice.likelihoods(logs).sum(axis=0))
    assert np.isfinite(lattice.likelihoods(logs)).all()


def test_training_raises_the_likelihood(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").select(F.lit(0).alias("lang_index"), "text").cache()
    model, pieces, settings = spark.sparkContext.broadcast(vocabulary), langid.Pieces(vocabulary), langid.LangSettings(smoothing=1e-6)
    words = " ".join(r.text or "" for r in docs.collect()).split()
    logs, scores = np.full((pieces.size, 1), -np.log(pieces.size)), []
    for _ in range(4):
        scores.append(langid.word_likelihoods(words, pieces, logs, 64).sum())
        counts = langid._expected_counts(docs, model, logs, settings)
        logs = langid._logs(counts, settings.smoothing)
    assert scores[0] < scores[1] < scores[2] < scores[3]
    assert scores[3] > 0.75 * scores[0]  # negative sums: at least a quarter is gained


def test_defined_cases(spark):
    texts = {"en": "the cat and the dog sat there with them", "fr": "le chat et la souris dans les maisons où nous étions"}
    rows = [(k, texts[lang], lang, "x", 1, "y") for k, lang in enumerate(["en", "fr"] * 20)]
    odd = [(900, None, "en"), (901, "", "fr"), (902, "12 ... 34", "en"), (903, "les maisons", None), (None, "the dogs with them", "en"), (904, "the " * 30000, None)]
    rows += [(*r, None, None, None) for r in odd] + [rows[0]]
    got = [tuple(r) for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows) and all(0 <= r[3] <= 1 for r in got)
    by_id = {r[0]: r for r in got}
    assert [by_id[k][2:] for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by_id[903][2] == "fr" and by_id[None][2] == "en" and by_id[904][2] == "en" and by_id[None][1] is True
    assert all(r[2] == lang for r in got if r[0] is not None and r[0] < 40 for lang in [["en", "fr"][r[0] % 2]])


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none).collect() == []
    got = langid.identify(spark.createDataFrame([(1, "words", None, None, None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string"), langid.LangSettings(languages=2))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op12_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
