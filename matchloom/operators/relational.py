"""Aggregates, pivots, set operations, samples and metrics of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binned_sum(rows: DataFrame, keys: list[str], x: Column, y: Column, x_edges: list[float], y_edges: list[float], value: str) -> DataFrame:
    """Sum of a value by keys and right-open bins of x and y, with 0 for bins without rows.

    The grid of bins is fixed and small; the keys are those that occur.
    """

    def bin_of(v: Column, edges: list[float]) -> Column:
        out = F.lit(None).cast("int")
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            out = F.when((v >= a) & (v < b), F.lit(i)).otherwise(out)
        return out

    sums = rows.withColumns({"bin_x": bin_of(x, x_edges), "bin_y": bin_of(y, y_edges)}).groupBy(*keys, "bin_x", "bin_y").agg(F.sum(value).alias("total"))
    grid = F.array(*[F.struct(F.lit(i).alias("bin_x"), F.lit(j).alias("bin_y")) for i in range(len(x_edges) - 1) for j in range(len(y_edges) - 1)])
    every = rows.select(*keys).distinct().select(*keys, F.explode(grid).alias("_b")).select(*keys, "_b.bin_x", "_b.bin_y")
    return every.join(sums, [*keys, "bin_x", "bin_y"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def pivot_sum(rows: DataFrame, row: str, column: str, members: list[str], value: str, total: str = "score") -> DataFrame:
    """One row per ``row`` with the sum of ``value`` for each member and their total; the members are named, so there is no extra pass."""
    out = rows.groupBy(row).agg(*[F.sum(F.when(F.col(column) == m, F.col(value)).otherwise(F.lit(0.0))).alias(m) for m in members])
    return out.withColumn(total, sum((F.col(m) for m in members[1:]), F.col(members[0])))


def pair_matrix(rows: DataFrame, row: str, column: str, members: list, value: str) -> DataFrame:
    """Row by column matrix of sums, 0 where a pair has none."""
    return rows.groupBy(row).pivot(column, members).agg(F.sum(value)).na.fill(0.0)


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in a stated order."""
    w = W.partitionBy(*keys).orderBy(*([o.desc() for o in order] if last else order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows per group in each task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def share_in_group(value: str | Column, keys: list[str]) -> Column:
    """x / sum(x) within the group, null where the sum is 0."""
    v = F.col(value) if isinstance(value, str) else value
    return F.try_divide(v, F.sum(v).over(W.partitionBy(*keys)))


def softmax(value: str, keys: list[str]) -> Column:
    """Softmax within the group, stable for large values."""
    w = W.partitionBy(*keys)
    shifted = F.exp(F.col(value) - F.max(value).over(w))
    return shifted / F.sum(shifted).over(w)


def sample(rows: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows without replacement, the same on every run: those of the least md5 of the key."""
    return rows.orderBy(F.md5(key.cast("string"))).limit(n)


def reasons(rows: DataFrame, rules: list[tuple[str, Column]], default: str = "kept") -> DataFrame:
    """Adds the first reason whose rule holds."""
    out = F.lit(default)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return rows.withColumn("reason", out)


def sync_accuracy(rows: DataFrame, category: str, found: str, true: str, widths=(5, 25, 50)) -> DataFrame:
    """Per category and in all: rows, matched rows, mean absolute frame error, and shares found exactly and within some frames."""
    error = F.abs(F.col(found) - F.col(true))
    share = lambda c: F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0))
    out = rows.rollup(category).agg(
        F.count("*").alias("n"), F.count(found).alias("matched"), F.avg(error).alias("mean_error"), share(error == 0).alias("exact"), *[share(error <= w).alias(f"within_{w}") for w in widths]
    )
    return out.withColumn(category, F.coalesce(category, F.lit("total")))


def binary_metrics(rows: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: precision, recall, F1, accuracy, Brier score, log loss and ROC-AUC (by counts per distinct score, ties at half)."""
    y, p = F.col(label).cast("double"), F.col(score)
    hit = (p >= threshold).cast("double")
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    loss = -(y * F.log(q) + (1 - y) * F.log(1 - q))
    plain = rows.agg(
        F.sum(hit * y).alias("tp"), F.sum(hit * (1 - y)).alias("fp"), F.sum((1 - hit) * y).alias("fn"), F.avg((hit == y).cast("double")).alias("accuracy"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss")
    )
    # equal scores collapse to one row before any order is needed
    by_score = rows.groupBy(p.alias("_s")).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))
    below = cumulative(by_score, "_s", "_neg")
    auc = below.agg(F.try_divide(F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)), F.sum("_pos") * F.sum("_neg")).alias("auc"))
    return plain.crossJoin(auc).select(
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        "accuracy",
        "brier",
        "log_loss",
        "auc",
    )


def cumulative(rows: DataFrame, order: str, value: str, buckets: int = 256) -> DataFrame:
    """Adds _below, the sum of ``value`` over rows of lower order, without sorting all rows in one task.

    Rows fall into buckets of equal width between the least and the greatest order; sums of whole buckets (at most ``buckets`` of them) are
    joined back to running sums inside each.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = (float(high) - float(low)) / buckets if low is not None and high > low else 1.0
    b = F.least(F.lit(buckets - 1), F.floor((F.col(order) - F.lit(float(low or 0.0))) / F.lit(width)).cast("int"))
    marked = rows.withColumn("_b", b)
    totals = marked.groupBy("_b").agg(F.sum(value).alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return marked.withColumn("_in", inside).join(F.broadcast(before), "_b").withColumn("_below", F.col("_in") + F.col("_before")).drop("_b", "_in", "_before")


def reciprocal_rank(rows: DataFrame, query: str, score: str, option: str, truth: str) -> DataFrame:
    """One row: mean reciprocal rank of the true option and the share ranked first."""
    w = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(option))
    ranked = rows.withColumn("_r", F.row_number().over(w)).where(F.col(option) == F.col(truth))
    return ranked.agg(F.count("*").alias("n"), F.avg(F.lit(1.0) / F.col("_r")).alias("mrr"), F.avg((F.col("_r") == 1).cast("double")).alias("top1"))


def long_to_wide(rows: DataFrame, keys: list[str], name: str, members: list[str], values: list[str]) -> DataFrame:
    """One row per key with a column for each member and value."""
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == m, F.col(v))).alias(f"{m}_{v}") for m in members for v in values])


def wide_to_long(rows: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return rows.unpivot(keys, columns, name, value)
