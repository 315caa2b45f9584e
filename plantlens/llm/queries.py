"""The queries of the training-data operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import conversations, hamming, hard_negatives, hmm, jpeg, langid, licenses, mixing, packing, pii, sigtree, token_counts, toxicity
from plantlens.llm.common import word_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.plan_mix(sized).select("doc_id", "size", "source_size", "target", "taken", F.size("shards").alias("n_takes"), F.array_join("shards", ",").alias("shards"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_count(F.col("text")))


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    offsets = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.array_join(offsets, ",").alias("spans"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.sample_edits(F.col("doc_id"), F.col("text")).alias("edits"))
    return token_counts.apply_edits(token_counts.build_trees(docs)).drop("text", "lengths", "counts")


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.duplicate_classes(_table(spark, sf_dir, "documents"))


def op8_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where(F.col("id") % 50 == 0), 10)


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.decode_media(jpeg.encode_media(_table(spark, sf_dir, "documents"))).drop("thumbnail")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, id_ = _table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(hard_negatives.usable(F.col("embedding"))).select(id_.alias("id"), label.alias("label"), hard_negatives.quantised(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return conversations.repair(conversations.damaged(turns, F.crc32(named) % 20))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_hmm": op4_hmm,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_signature_trees": op7_signature_trees,
    "op8_bootstrapped_pii": op8_bootstrapped_pii,
    "op9_multi_index_hashing": op9_multi_index_hashing,
    "op10_jpeg": op10_jpeg,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_id": op12_language_id,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op9_multi_index_hashing": """
        WITH c AS (SELECT vec_id AS id, list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1::UBIGINT ELSE 0::UBIGINT END), lambda a, b: a * 2 + b) AS code FROM embeddings),
        d AS (SELECT q.id AS query, c.id, bit_count(xor(q.code, c.code))::INTEGER AS distance FROM c AS q, c WHERE q.id % 50 = 0 AND q.id <> c.id)
        SELECT query, rank, id, distance FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY distance, id))::INTEGER AS rank FROM d) WHERE rank <= 10""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v AS a, v AS b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank
            FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_conversation_repair": r"""
        WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
        src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations),
        h AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS k FROM src, tab),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
        p AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM p),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
        clo(a, b, c, s, l) AS (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', 'user:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 0, '', ''), (1, 2, 3, 'I', 'user:' || chr(10)), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
            (2, 2, 0, '', ''), (2, 3, 3, 'I', 'assistant:' || chr(10)), (3, 3, 0, '', ''), (3, 2, 3, 'I', 'user:' || chr(10))),
        mv(e, a, b, init) AS (VALUES ('D', 0, 0, ''), ('D', 1, 1, ''), ('D', 2, 2, ''), ('D', 3, 3, ''), ('K', 0, 1, 's'), ('K', 0, 2, 'u'), ('K', 1, 2, 'u'), ('K', 3, 2, 'u'), ('K', 2, 3, 'a'), ('R', 0, 2, ''), ('R', 1, 2, ''), ('R', 3, 2, ''), ('R', 2, 3, '')),
        r AS (SELECT conv_id, 0::BIGINT AS i, b AS st, struct_pack(cost := c, audit := s, lines := l) AS m FROM (SELECT DISTINCT conv_id FROM f) AS u, clo WHERE a = 0
            UNION ALL SELECT r.conv_id, any_value(f.i), clo.b, min(struct_pack(cost := r.m.cost + clo.c + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, audit := concat(r.m.audit, e, clo.s),
                lines := concat(r.m.lines, CASE e WHEN 'K' THEN concat(role, ':', text, chr(10)) WHEN 'R' THEN concat(CASE mv.b WHEN 2 THEN 'user' ELSE 'assistant' END, ':', text, chr(10)) ELSE '' END, clo.l)))
            FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1 JOIN mv ON mv.a = r.st AND (e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR init = left(role, 1))) JOIN clo ON clo.a = mv.b GROUP BY r.conv_id, clo.b),
        q AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
            count(*) FILTER (WHERE i > 1 AND concat(left(before, 1), left(role, 1)) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
        g AS (SELECT q.*, (SELECT min(m) FROM r WHERE r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.i = q.n AND r.st IN (0, 3)) AS m FROM q)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit,
            sha256(coalesce(left(m.lines, greatest(length(m.lines) - 1, 0)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id""",
}
