"""Queries of votes, fits, searches, vectors and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import numbers
from plantlens.operators import aggregates
from plantlens.registry import Registry, table
from plantlens.streaming import incremental

REGISTRY = Registry()
query = REGISTRY.query


@query("""
    WITH s AS (SELECT p_size AS x, (p_retailprice * 10)::BIGINT % 50 AS y FROM part), g AS (SELECT dx, dy FROM generate_series(0, 40) a(dx), generate_series(0, 60) b(dy))
    SELECT dx::INTEGER AS dx, dy::INTEGER AS dy, count(*) FILTER ((x + dx) % 50 = (y + dy) % 50) AS n_fit FROM s, g GROUP BY dx, dy ORDER BY n_fit DESC, dx, dy LIMIT 1""")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin of a 41 x 61 grid that most samples agree with. Samples are counted by value before they meet the grid."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") % 50).alias("x"), (F.floor(F.round(F.col("p_retailprice") * 10)) % 50).alias("y"))
    samples = part.groupBy("x", "y").agg(F.count("*").alias("w"))
    grid = spark.range(41 * 61).select(F.floor(F.col("id") / 61).cast("int").alias("dx"), (F.col("id") % 61).cast("int").alias("dy"))
    fits = (F.col("x") + F.col("dx")) % 50 == (F.col("y") + F.col("dy")) % 50
    scored = samples.join(F.broadcast(grid), fits).groupBy("dx", "dy").agg(F.sum("w").alias("n_fit"))
    return scored.orderBy(F.desc("n_fit"), "dx", "dy").limit(1)


@query("""
    WITH v AS (SELECT label, ((embedding[1] > 0)::INT * 4 + (embedding[2] > 0)::INT * 2 + (embedding[3] > 0)::INT) AS octant FROM embeddings), c AS (SELECT octant, label, count(*) AS votes FROM v GROUP BY ALL),
    r AS (SELECT *, votes / sum(votes) OVER (PARTITION BY octant) AS share, row_number() OVER (PARTITION BY octant ORDER BY votes DESC, label) AS r FROM c)
    SELECT octant, label, votes, round(share, 9) AS share, share >= 0.15 AS accepted FROM r WHERE r = 1""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda i, w: F.when(F.col("embedding")[i] > 0, w).otherwise(0)
    rows = table(spark, sf_dir, "embeddings").select("label", (bit(0, 4) + bit(1, 2) + bit(2, 1)).alias("octant"))
    return aggregates.share_vote(rows, ["octant"], "label", F.lit(1), 0.15).withColumn("share", F.round("share", 9))


@query("""
    WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings), c AS (SELECT label, p, avg(v) AS m FROM x GROUP BY ALL)
    SELECT vec_id, round(corr(v, m), 6) AS ncc FROM x JOIN c USING (label, p) GROUP BY vec_id""")
def vector_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised cross-correlation of each vector with the mean of its label; the means are few rows, joined whole."""
    vectors = table(spark, sf_dir, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("p", "v"))
    means = parts.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("centre"))
    pairs = vectors.join(centre, "label").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.col("centre").alias("b"))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    shifted = pairs.withColumns({"a": F.zip_with("a", F.array_repeat(mean(F.col("a")), F.size("a")), lambda v, m: v - m), "b": F.zip_with("b", F.array_repeat(mean(F.col("b")), F.size("b")), lambda v, m: v - m)})
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return shifted.select("vec_id", F.round(dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")), 6).alias("ncc"))


@query("""
    WITH s AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), f1 AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s), f2 AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s, f1 WHERE abs(y - f1.a * x - f1.b) <= 20000)
    SELECT round(regr_slope(y, x), 4) AS scale, round(regr_intercept(y, x), 2) AS origin, count(*) AS n FROM s, f2 WHERE abs(y - f2.a * x - f2.b) <= 20000""")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = aggregates.affine_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 20000.0, rounds=2)
    return fit.select(F.round("scale", 4).alias("scale"), F.round("origin", 2).alias("origin"), "n")


@query("""
    WITH s AS (SELECT lang, l.toxic = 1 AS t, n_chars > 2000 AS f FROM documents JOIN labels l USING (doc_id)), c AS (SELECT lang, count(*) FILTER (t AND f)::DOUBLE AS b, count(*) FILTER (t)::DOUBLE AS t, count(*) FILTER (f)::DOUBLE AS f FROM s GROUP BY lang)
    SELECT lang, round(b / nullif(f, 0), 9) AS precision, round(b / nullif(t, 0), 9) AS recall, round(2 * b / nullif(t + f, 0), 9) AS f1, round(b / nullif(t + f - b, 0), 9) AS iou FROM c""")
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and IoU of two sets, the figures of image comparison."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    metrics = rows.groupBy("lang").agg(*aggregates.set_metrics(F.col("toxic") == 1, F.col("n_chars") > 2000))
    return metrics.select("lang", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "iou")])


@query("""
    WITH g AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, q[len(q) // 2 + 1] AS middle FROM g""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q")).select("l_orderkey", numbers.upper_median(F.col("q"), 0.6).alias("middle"))


@query("""
    WITH p AS (SELECT c_custkey AS id, c_acctbal AS x, c_custkey % 100 * 50.0 AS y FROM customer)
    SELECT id, CASE WHEN floor((x + 1000) / 200) BETWEEN 0 AND 99 THEN lpad(floor((x + 1000) / 200)::INT::VARCHAR, 2, '0') END AS zone, round(sqrt(greatest(0 - x, 0, x - 5000) ** 2 + greatest(1000 - y, 0, y - 3000) ** 2), 6) AS box_distance, x BETWEEN 0 AND 5000 AND y BETWEEN 1000 AND 3000 AS inside FROM p""")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100 * 50.0).alias("y"))
    box = [F.col("x"), F.col("y"), *[F.lit(v) for v in (0.0, 1000.0, 5000.0, 3000.0)]]
    return p.select("id", numbers.zone(F.col("x"), F.lit(-1000), F.lit(200)).alias("zone"), F.round(numbers.box_distance(*box), 6).alias("box_distance"), numbers.in_box(*box).alias("inside"))


@query("""
    WITH g AS (SELECT *, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS started, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by Structured Streaming over the events, run until the input is used up; equal to the batch result."""
    return incremental.run_sessions(spark, f"{sf_dir}/events.parquet", "6 hours")


@query("""
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.run_windows(spark, f"{sf_dir}/events.parquet", "1 day")
