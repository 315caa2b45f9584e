"""Aggregates of the engine: totals, votes, fits, searches, digests and coverage. All aggregate before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_total(df: DataFrame, key: str, total: str, *aggregates: Column) -> DataFrame:
    """One row for each key and one for all, whose key reads `total`."""
    rows = df.rollup(key).agg(F.grouping(key).alias("__all"), *aggregates)
    return rows.withColumn(key, F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(key))).drop("__all")


def resolve_endpoint(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the number of different values, a status, and the value if it is the only one."""
    seen = df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("__v"))
    status = F.when(F.col("n_values") == 0, "UNRESOLVED").when(F.col("n_values") == 1, "RESOLVED").otherwise("AMBIGUOUS")
    return seen.withColumns({"status": status, "value": F.when(F.col("n_values") == 1, F.col("__v"))}).drop("__v")


def share_vote(df: DataFrame, keys: list[str], candidate: str, weight: Column, least_share: float = 0.5) -> DataFrame:
    """Winner of a weighted vote by key, with its share; rows under least_share are not accepted. Ties: least candidate."""
    votes = df.groupBy(*keys, candidate).agg(F.sum(weight).alias("votes"))
    whole = Window.partitionBy(*keys)
    ranked = votes.withColumns({"share": F.col("votes") / F.sum("votes").over(whole), "__rank": F.row_number().over(whole.orderBy(F.col("votes").desc(), candidate))})
    return ranked.where("__rank = 1").withColumn("accepted", F.col("share") >= least_share).drop("__rank")


def grid_search(samples: DataFrame, fits: Column, grid: DataFrame, order: list[str]) -> DataFrame:
    """The row of the grid that most samples fit, the first in order on ties; the grid's size is a parameter of the caller."""
    scored = samples.join(F.broadcast(grid)).groupBy(*order).agg(F.count_if(fits).alias("n_fit"))
    return scored.orderBy(F.col("n_fit").desc(), *order).limit(1)


def affine_fit(df: DataFrame, x: str, y: str, tolerance: float, rounds: int = 4) -> DataFrame:
    """Least squares y = scale * x + origin over the rows within tolerance of the fit before; one row."""
    fit = df.agg(F.regr_slope(y, x).alias("scale"), F.regr_intercept(y, x).alias("origin"), F.count("*").alias("n"))
    for _ in range(rounds):
        inside = df.join(F.broadcast(fit.select(F.col("scale").alias("__s"), F.col("origin").alias("__o")))).where(F.abs(F.col(y) - F.col("__s") * F.col(x) - F.col("__o")) <= tolerance)
        fit = inside.agg(F.regr_slope(y, x).alias("scale"), F.regr_intercept(y, x).alias("origin"), F.count("*").alias("n"))
    return fit


def digest(df: DataFrame, columns: list[Column], keys: list[str] | None = None) -> DataFrame:
    """Number of rows and a hash of all of them that doesn't depend on their order.

    Rows are hashed one by one and the hashes added up, so that no list of rows is gathered anywhere.
    """
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    halves = [F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    sums = grouped.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(h), F.lit(0)).alias(f"__{i}") for i, h in enumerate(halves)])
    return sums.withColumn("digest", F.sha2(F.concat_ws(":", "n_rows", F.col("__0").cast("string"), F.col("__1").cast("string")), 256)).drop("__0", "__1")


def coverage(relations: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(relation, category, n, total): how many rows of each relation meet each of its predicates."""
    out = None
    for name, (df, tests) in relations.items():
        one = df.agg(F.count("*").alias("total"), *[F.count_if(t).alias(k) for k, t in tests.items()])
        rows = one.select(F.lit(name).alias("relation"), "total", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("n")) for k in tests])).alias("c")).select("relation", "c.category", "c.n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def issues(rules: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(rule, severity, ref): the failures of all rules, each a query that returns (ref)."""
    out = None
    for rule, (severity, failures) in rules.items():
        rows = failures.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("ref").cast("string").alias("ref"))
        out = rows if out is None else out.unionByName(rows)
    return out


def set_metrics(truth: Column, found: Column) -> list[Column]:
    """Precision, recall, F1 and intersection over union of two conditions."""
    both, t, f = (F.count_if(c).cast("double") for c in (truth & found, truth, found))
    return [(both / F.nullif(f, F.lit(0.0))).alias("precision"), (both / F.nullif(t, F.lit(0.0))).alias("recall"), (2 * both / F.nullif(t + f, F.lit(0.0))).alias("f1"), (both / F.nullif(t + f - both, F.lit(0.0))).alias("iou")]


def learned_prefixes(pairs: DataFrame, prefix: str, candidate: str, item: str, support: int = 40, share: float = 0.98) -> DataFrame:
    """For each prefix the candidate that explains enough different items, and more of them than the runner-up."""
    whole = pairs.groupBy(prefix).agg(F.count_distinct(item).alias("n_items"))
    hits = pairs.groupBy(prefix, candidate).agg(F.count_distinct(item).alias("support"))
    order = Window.partitionBy(prefix).orderBy(F.col("support").desc(), candidate)
    top = hits.withColumns({"__rank": F.row_number().over(order), "runner_up": F.coalesce(F.lead("support").over(order), F.lit(0))}).where("__rank = 1").drop("__rank")
    scored = top.join(whole, prefix).withColumn("score", F.col("support") / F.col("n_items"))
    return scored.withColumn("accepted", (F.col("support") >= support) & (F.col("score") >= share) & (F.col("support") > F.col("runner_up")))
