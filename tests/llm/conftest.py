import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, uid string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, repeats, near copies and columns whose names clash with results."""
    rng = random.Random(3)
    rows = []
    for i in range(160):
        text = words(rng, rng.randint(1, 120))
        rows.append((i, text, "en", f"s{i % 7}" if i % 3 else "s0", len(text), 0.5, "x", "y"))
    for i, base in enumerate((5, 5, 5, 17, 17, 40)):
        t = rows[base][1].split()
        if i % 2:
            t[len(t) // 2] = "changed"
        rows.append((200 + i, " ".join(t), "en", "s0", 1, None, None, None))
    rows += [(300, None, None, None, None, None, None, None), (301, "", "", "", 0, 0.0, "", ""), (302, " \n\t ", "en", "s1", 4, 0.0, "", ""), (303, words(rng, 9000), "en", "s2", 9, 0.0, "", "")]
    rows += [rows[10], rows[10], (None, "text without an id", "en", "s3", 1, 1.0, "", ""), (304, "Ünïcode Ça VA 漢字 🙂 end", "fr", "z", 1, 1.0, "", "")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
