import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from plantlens.llm import hmm, toxicity


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    for c in "\t\n\v\f\r":
        text = (text or "").replace(c, " ")
    return [w for w in lower(text).split(" ") if w] + [None]


def test_base_scores_and_counts(docs, corpus, no_docs):
    settings = hmm.LmSettings(states=3, classes=64, rounds=2, piece=50)
    got = hmm.score_texts(docs, settings=settings).collect()
    assert len(got) == len(corpus)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(t for r in corpus if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in corpus:
        k = tokens(r[1])
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in k)
        want[(r[0], held(r[0]), len(k), sum(c[t] > 0 for t in k), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert hmm.score_texts(no_docs, settings=settings).count() == 0


def test_forward_is_exact():
    rng = np.random.default_rng(0)
    share = np.full(5, 0.2)
    model = hmm.Model.first(share, hmm.LmSettings(states=2))
    codes = rng.integers(0, 5, 9)
    pack = hmm._Packed(codes, np.array([0, 5]), np.array([5, 4]))
    got = pack.log10_likelihood(model)
    for k, (s, n) in enumerate(((0, 5), (5, 4))):
        total = 0.0
        for path in range(2**n):
            states = [(path >> t) & 1 for t in range(n)]
            p = model.start[states[0]] * model.emits[codes[s], states[0]]
            for t in range(1, n):
                p *= model.moves[states[t - 1], states[t]] * model.emits[codes[s + t], states[t]]
            total += p
        assert abs(got[k] - math.log10(total)) < 1e-9
    start, moves, emits, _ = pack.expected_counts(model)
    assert abs(start.sum() - 2) < 1e-9 and abs(moves.sum() - 7) < 1e-9 and abs(emits.sum() - 9) < 1e-9


def test_pieces_give_what_the_whole_gives():
    rng = np.random.default_rng(1)
    model = hmm.Model.first(np.full(5, 0.2), hmm.LmSettings(states=3))
    codes = rng.integers(0, 5, 57)
    whole = hmm._Packed(codes, np.array([0]), np.array([57]))
    for piece in (1, 7, 56, 57, 100):
        assert abs(hmm.long_likelihood(codes, model, piece) - whole.log10_likelihood(model)[0]) < 1e-9
        for a, b in zip(hmm.long_counts(codes, model, piece), whole.expected_counts(model)):
            assert np.allclose(a, b)


def test_training_raises_the_likelihood(spark):
    rows = [(i, " ".join(("red green blue" if i % 2 else "uno dos tres").split() * 10)) for i in range(200)]
    got = hmm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), settings=hmm.LmSettings(states=2, classes=64, rounds=8))
    r = got.where("held_out").toPandas()
    assert r["score"].sum() > 1.2 * r["base_score"].sum()


def test_toxic_spans(spark, no_docs):
    rng = np.random.default_rng(2)
    plain, bad = [f"word{i}" for i in range(60)], ["vile", "foul", "nasty"]
    rows, labels = [], []
    for i in range(600):
        t = list(rng.choice(plain, 30))
        toxic = i % 4 == 0
        if toxic:
            for k in rng.integers(0, 30, 3):
                t[k] = str(rng.choice(bad)).upper() + "!"
        rows.append((i, " ".join(t)))
        if i % 5:
            labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "é " * 5000 + "vile"), (3, rows[3][1]), (None, "foul foul")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        expected = any(b in (text[r.doc_id] or "").lower() for b in bad)
        assert (r.predicted == 1) == expected and 0 <= r.score <= 1
        assert all((text[r.doc_id][s.start : s.end].lower().strip("!") in bad) for s in r.spans) and bool(r.spans) == expected
    kept = toxicity.drop_toxic(docs.withColumnRenamed("doc_id", "doc_id").selectExpr("*", "1 AS score", "2 AS predicted"), marks)
    assert kept.columns == ["doc_id", "text", "score", "predicted"] and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.score_documents(no_docs, marks).count() == 0
    alone = toxicity.score_documents(docs, marks.where("toxic = 5")).collect()
    assert len({r.score for r in alone}) == 1


def test_marginals_by_brute_force():
    field = toxicity.Field(0.1)
    rng = np.random.default_rng(4)
    field.moves = rng.normal(size=(2, 2))
    lengths, rows = [4, 1, 5], np.repeat(np.arange(3), [4, 1, 5])
    unary = rng.normal(size=10)
    p, all_clean, moves = field.marginals(rows, unary, 3)
    first = 0
    for r, n in enumerate(lengths):
        weight = {}
        for path in range(2**n):
            y = [(path >> t) & 1 for t in range(n)]
            weight[path] = math.exp(sum(u * a for u, a in zip(unary[first:], y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        z = sum(weight.values())
        for t in range(n):
            assert abs(p[first + t] - sum(w for k, w in weight.items() if (k >> t) & 1) / z) < 1e-9
        assert abs(all_clean[r] - math.log(weight[0] / z)) < 1e-9 and abs(moves[r].sum() - (n - 1)) < 1e-9
        first += n
    assert field.score(pa.array(["a", None]))[0].tolist() == [0.1, 0.1]


def test_slopes_are_those_of_the_likelihood():
    field, rng = toxicity.Field(0.1), np.random.default_rng(5)
    field.moves = rng.normal(size=(2, 2))
    field.weights = field.weights.astype(float)
    rows, codes, features = np.array([0, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 2, 0, 1]), rng.integers(0, 40, (3, toxicity.OWN + 2))
    field.weights[:40], field.weights[-1], toxic = rng.normal(size=40), -1.0, np.array([True, False, True])

    def likelihood(f):
        clean = f.marginals(rows, f.unary(rows, codes, features), 3)[1]
        return np.where(toxic, np.log(0.1 + 0.9 * -np.expm1(clean)), clean).sum()

    slope, moves, _ = field.gradient(rows, codes, features, toxic, 0.1)
    for at in [0, 7, 23, 39, toxicity.FEATURES]:
        up = toxicity.Field(0.1, field.weights.copy(), field.moves)
        up.weights[at] += 1e-6
        assert abs((likelihood(up) - likelihood(field)) / 1e-6 - slope[at]) < 1e-4
    for k in range(4):
        up = toxicity.Field(0.1, field.weights, field.moves.copy())
        up.moves[k // 2, k % 2] += 1e-6
        assert abs((likelihood(up) - likelihood(field)) / 1e-6 - moves[k]) < 1e-4


def test_stems_carry_over_to_unseen_words(spark):
    """Toxic words with endings that no training text has."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    plain, rows = [word() for _ in range(200)], []
    for i in range(900):
        t = list(rng.choice(plain, 40))
        if i % 3 == 0:
            t[int(rng.integers(40))] = "zorko" + word()
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = [r for r in toxicity.score_documents(docs, marks).collect() if r.held_out]
    hit = [r.predicted for r in got if r.doc_id % 3 == 0]
    assert sum(hit) >= 0.95 * len(hit) and not any(r.predicted for r in got if r.doc_id % 3)
