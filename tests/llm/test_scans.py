import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.llm import hamming, jpeg, licenses, pii, token_counts

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def spans(text):
    return sorted((m.start(), r, m.end(), k) for r, k in enumerate(FORMATS) for m in re.finditer(FORMATS[k], text or "") if valid(k, m[0]))


def test_base_spans(spark, docs, corpus, no_docs):
    odd = ["a@b.com_c@d.org e@f", "x" * 3000 + "@y.zz", "1.2.3.4.5 256.1.1.1 001.2.3.4 9" * 3, "4111 1111-1111 1111 4111111111111111, 12 34", "+1 (555) 123-4567 +44.20.7946.0958 +1 2", "🙂 é a@b.co 🙂 10.0.0.1", "7" * 40, "+1+1+1 " + "+1 " * 30, "a.@b.c.d..e", "5" * 5000, None, ""]
    rng = random.Random(1)
    odd += ["".join(rng.choice("ab1.2 @+-_()%9\n") for _ in range(200)) for _ in range(150)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in pii.pii_report(rows).collect():
        want = spans(odd[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest(), odd[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in FORMATS]
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(r.spans.split(","))
    assert pii.pii_report(docs).count() == len(corpus) and pii.pii_report(no_docs).count() == 0


def test_patterns_find_further_identifiers(spark):
    rows = [(i, f"hello there, reach me under {i}@mail.org today") for i in range(20)] + [(50, "please reach me under agent7 today"), (51, "we saw agent7 there")]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "email:22:28" and got[51] == ""


def test_masking_keeps_columns(spark, docs):
    rows = spark.createDataFrame([(1, "at 10.0.0.1, a@b.co!", "p"), (2, None, "q"), (3, "none", "r")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.mask_documents(rows).collect()}
    assert got[1].text == "at <IP>, <EMAIL>!" and got[2].text is None and got[3].text == "none" and got[1].spans == "p"
    assert pii.mask_documents(docs).columns == docs.columns


def test_texts_with_many_spans(spark):
    parts = [f"w{i} user{i}@mail.example.com x {i % 300}.2.3.4, +1 (555) 123-{i % 9000 + 1000} é{i}" for i in range(1500)]
    rows = spark.createDataFrame([(1, " ".join(parts), 1.0)] * 3, "doc_id long, text string, spans double")
    want = spans(rows.first().text)
    for r in pii.pii_report(rows).collect():
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= set(r.spans.split(","))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
    ip = lambda i: "<IP>" if i % 300 < 256 else f"{i % 300}.2.3.4"
    assert {r.text for r in pii.mask_documents(rows).collect()} == {" ".join(f"w{i} <EMAIL> x {ip(i)}, <PHONE> é{i}" for i in range(1500))}
    overlapping = spark.createDataFrame([("0123456789" * 40, [(i, 0, i + 15, "card") for i in range(5, 300)])], f"text string, spans array<{pii.SPAN}>")
    assert overlapping.select(pii.mask(F.col("text"), F.col("spans")).alias("t")).first().t == "01234<CARD>" + ("0123456789" * 40)[314:]


def test_license_scan(spark, docs, corpus, no_docs):
    texts = [
        "x " * 70 + "Released under the MIT\nLicense. Apache-license; GNU general   public license v3", "Licensed under CC BY-NC 4.0.", "released under the license", None, "", "É MIT license é", "mitlicense mit.license",
        "word " * 5000 + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(rows).collect()}
    assert got[0].base_labels == ["apache", "gpl", "mit"] and got[0].n_base == 3 and (got[0].first_word, got[0].last_word) == (73, 78)
    assert got[1].labels == ["cc-by-nc"] and got[1].n_base == 0 and got[1].first_word is None and got[1].score == 1.0
    assert got[2].labels == [] and got[3].n_words == 0 and got[4].score == 0.0
    assert got[5].base_labels == ["mit"] and got[5].first_word == 1 and got[6].base_labels == ["mit"] and got[6].n_words == 3
    assert got[7].labels == ["mit"] and 0.9 <= got[7].score < 1
    assert licenses.scan_licenses(docs).count() == len(corpus) and licenses.scan_licenses(no_docs).count() == 0


def naive_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {x for _, x in places}, 0.0
    for label, template in licenses.TEMPLATES:
        t = re.findall(r"[a-z0-9]+", template.lower())
        width = 1 << max(4, 2 * len(t) - 1).bit_length()
        for start in range(0, max(1, len(words)), width // 2):
            share = len(set(t) & set(words[start : start + width])) / len(set(t))
            if share >= licenses.CONTAINMENT:
                labels.add(label)
                best = max(best, share)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), tuple(sorted({x for _, x in places})), tuple(sorted(labels)), round(1.0 if places else best, 9)


def test_licenses_match_a_naive_scan(spark, docs, corpus):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in corpus]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            parts += ["word"] * rng.randint(0, 300) + [w for w in t if rng.random() > rng.choice((0, 0.03, 0.3))] + rng.choice((["MIT", "License."], ["general", "public-license"], ["é"]))
        rows.append((1000 + i, " ".join(parts)))
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(r.labels), round(r.score, 9))
    assert Counter(map(key, got)) == Counter((i, *naive_licenses(t)) for i, t in rows)


def test_license_scan_is_linear(spark):
    began = time.perf_counter()
    words = [b"license"] * 1_000_000
    assert licenses.phrase_places(words) == [] and licenses.phrase_places([b"mit", b"license"] * 400_000)[-1] == (799_998, "mit")
    assert len(licenses.blocks_of(np.stack([np.arange(1_000_000), np.zeros(1_000_000, int)], axis=1), 64, {0}, {0})) == 31_250
    assert time.perf_counter() - began < 5


def test_jpeg_round_trip(spark, docs, corpus, no_docs):
    got = jpeg.decode_media(jpeg.encode_media(docs)).collect()
    want = Counter()
    for r in corpus:
        b = (r[1] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want[(r[0], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert jpeg.decode_media(jpeg.encode_media(no_docs)).count() == 0
    broken = spark.createDataFrame([(1, 2, bytearray(b"no image")), (2, 0, None), (3, 0, bytearray(b""))], "doc_id long, n_bytes long, media binary")
    assert all(r.feature is None for r in jpeg.decode_media(broken).collect())


def test_jpeg_of_runs_and_colour():
    """A file by hand: three components, 2x1 sampling, runs of zeros, no restart intervals."""
    seg = jpeg._segment
    # codes 00, 010, 011 for DC sizes 0, 1, 2, and for AC: end of block, size 1, two zeros and size 1
    dc = bytes([0, 1, 2] + [0] * 13 + [0, 1, 2])
    ac = bytes([0, 1, 2] + [0] * 13 + [0x00, 0x01, 0x21])
    bits = ""
    for luma in ("11", "00"):  # two luma blocks: DC +3, then DC -3
        bits += "011" + luma
        bits += "011" + "1" + "00"  # run of two zeros, then +1, then end of block
    bits += "00" * 4  # two chroma blocks: DC 0, end of block
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 8, 0, 16, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    file = b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC4, b"\x00" + dc + b"\x10" + ac) + seg(0xC0, frame) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    frame, c = jpeg.decode_files([file])[0]
    assert (frame.width, frame.height) == (16, 8) and c[:, 0].tolist() == [3, 0] and c[0, 3] == 1 and c[1, 3] == 1 and np.count_nonzero(c) == 3
    assert jpeg.thumbnail(frame, c).tolist() == [[131, 128]]


@pytest.mark.parametrize("flips", [1 << 15, 20])
def test_top_k_matches_brute_force(spark, monkeypatch, flips):
    monkeypatch.setattr(hamming, "FLIPS", flips)
    rng = np.random.default_rng(1)
    codes = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    rows = [(i, codes[int(rng.integers(40))] ^ int(1 << int(rng.integers(60))) if i % 3 else codes[0]) for i in range(400)] + [(900, None), (3, None)]
    index = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming.top_k(index, index.where("id % 50 = 0"), 5).collect():
        got.setdefault(r.query, []).append((r.distance, r.id, r.rank))
    have = [r for r in rows if r[1] is not None]
    for q, c in have:
        if q % 50 == 0:
            want = sorted((((c ^ x) & (2**64 - 1)).bit_count(), i) for i, x in have if i != q)[:5]
            assert [(d, i) for d, i, _ in sorted(got[q], key=lambda x: x[2])] == want
    assert hamming.top_k(index.where("id < 0"), index.where("id < 0"), 5).count() == 0
    assert hamming.top_k(index.where("id in (0, 1)"), index.where("id = 0"), 5).count() == 1


def test_edited_counts_match_a_new_count():
    count = token_counts._counter(token_counts._vocabulary(token_counts.VOCABULARY))
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "cat", " 42", "\n", "  ", "é", "don't ", "x", "🙂"]) for _ in range(rng.randint(0, 120)))
        leaves = token_counts.cut(text, rng.choice((4, 30)))
        lengths, counts = token_counts.SegmentTree.over([len(x) for x in leaves]), token_counts.SegmentTree.over(count(leaves))
        assert counts.total() == count([text])[0]
        for _ in range(8):
            edit = (rng.randint(0, len(text) + 2), rng.choice((0, 1, 3, 500)), rng.choice(("", " ", "\n\n", "a b", "'s", "é x y z " * 9)))
            text, _ = token_counts.apply_edit(text, lengths, counts, edit, count)
            assert counts.total() == count([text])[0] and lengths.total() == len(text)


def test_edits_as_rows(docs, corpus, no_docs):
    edited = lambda d: token_counts.apply_edits(token_counts.build_trees(d.select("doc_id", "text", token_counts.sample_edits(F.col("doc_id"), F.col("text")).alias("edits"))))
    count = token_counts._counter(token_counts._vocabulary(token_counts.VOCABULARY))
    rows = edited(docs).collect()
    assert len(rows) == len(corpus) and all(r.tokens_after == count([r.text])[0] for r in rows)
    assert edited(no_docs).count() == 0


def test_hidden_seeds_are_found_again(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    one = {
        0: lambda: f"{word()}.{rng.randint(10, 99)}@mail.example.com", 1: lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        2: lambda: f"token = \"{rng.getrandbits(160):040x}\"", 3: lambda: "key AKIA7" + "".join(rng.choice("ABCDEFGHJKMNPQRSTUVWXYZ23456789") for _ in range(15)),
    }
    rows = [(i, f"{word()} {word()} {one[i % 4]()} {word()} 12 {word()}") for i in range(400)] + [(900, 'my token = "ABCD12"'), (901, "10.0.0.1 and 999.1.1.300 but 4111111111111112")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, part = pii.PiiSettings(), pii.PiiSettings(hidden=0.33)
    ends = lambda s: Counter((r.doc_id, x.start, x.end) for r in pii.find_spans(docs, s).collect() for x in [*r.base, *r.found])
    every = ends(whole)
    assert (900, 12, 18) in every and (901, 13, 24) not in every and (901, 29, 45) not in every and {i for i, *_ in every} >= set(range(400))
    hidden = [r for r in pii.find_spans(docs, part).collect() if r.doc_id < 400]
    assert sum(bool(x.kind) for r in hidden for x in r.found) >= 230  # 200 secrets, and a third of 200 base spans by patterns only


def test_left_words_may_be_mentions(spark):
    texts = ["members A-101, A-102,\n A-103", "7 line2 X9912345", "a " * 60 + "b c3 d4"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(pii._mentions(F.col("text")).alias("m"))
    got = {r.m[-1].core: [(m.left1, " ".join(m.left2.split())) for m in r.m] for r in frame.collect()}
    assert got["A-103"] == [("members", ""), ("a-101,", "members a-101,"), ("a-102,", "a-101, a-102,")]
    assert got["X9912345"] == [("", ""), ("7", ""), ("line2", "7 line2")]
    assert got["d4"][-1] == ("c3", "b c3")
    rows = [(i, f"call line2 name{chr(97 + i)}@host.org") for i in range(8)] + [(9, "call line2 X9912345")]
    spans = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[9] == "email:11:19"
