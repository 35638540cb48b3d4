"""Orders, budgets, carry-forward and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget(items: DataFrame, keys: list[str], order: list, direct: Column, weak: Column) -> DataFrame:
    """Items with evidence 'direct' for the first ``direct``, 'weak' for the next ``weak``, else 'none'."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return items.withColumn("evidence", F.when(n <= direct, "direct").when(n <= direct + weak, "weak").otherwise("none"))


def carry_forward(lines: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` at or before each line."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_start(spans: DataFrame, keys: list[str], start: str, last: Column) -> DataFrame:
    """Each span ends one before the next one's start, the last one at ``last``."""
    w = Window.partitionBy(*keys).orderBy(start)
    return spans.withColumn("end", F.coalesce(F.lead(start).over(w) - 1, last))


def depth_before(tokens: DataFrame, keys: list[str], order: str, delta: Column) -> DataFrame:
    """Sum of ``delta`` over all earlier rows of the key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("depth", F.coalesce(F.sum(delta).over(w), F.lit(0)))


def share_of_group(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    return counts.withColumn("share", F.try_divide(F.col(n).cast("double"), F.sum(n).over(Window.partitionBy(*keys))))


def unprocessed_limit(rows: DataFrame, done: Column, order: list, n: int) -> DataFrame:
    """Rows with process = true for the first n that are not done; the others pass through.

    The n-th row's order key is found by a bounded top-n, so no window over all rows is needed.
    """
    names = [c if isinstance(c, str) else str(c) for c in order]
    first = rows.where(~done).select(*names).orderBy(*names).limit(n).withColumn("_p", F.lit(True)).distinct()
    return rows.join(F.broadcast(first), names, "left").withColumn("process", ~done & F.coalesce("_p", F.lit(False))).drop("_p")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``, as a struct minimum."""
    rest = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def set_difference(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Rows in only one of two tables, counting repeats, with the side that has them."""
    a, b = left.select(*names), right.select(*names)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def merge_counters(rows: DataFrame, keys: list[str], counter: str) -> DataFrame:
    """Summed open-key counters in long form: keys, measure, n."""
    return rows.select(*keys, F.explode(counter).alias("measure", "v")).groupBy(*keys, "measure").agg(F.sum("v").alias("n"))


def reserved_budget(items: DataFrame, keys: list[str], order: list, direct: Column, weak: Column, reserved: Column) -> DataFrame:
    """As budget, but the items ``reserved`` take direct evidence before the others."""
    return budget(items, keys, [F.when(reserved, 0).otherwise(1), *order], direct, weak)


def values_so_far(lines: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The sorted set of non-null values at or before each line."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.array_sort(F.collect_set(value).over(w)))


def item_index(items: DataFrame, keys: list[str], order: list, name: str = "item_index") -> DataFrame:
    """Items numbered from 1 in their row."""
    return items.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def clamped_depth(tokens: DataFrame, keys: list[str], order: str, delta: Column) -> DataFrame:
    """Running sum of ``delta`` that never falls below 0: the prefix sum less its lowest value so far, if that is negative."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = tokens.withColumn("_s", F.sum(delta).over(w))
    return out.withColumn("depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def disjoint_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both tables' rows with the problem 'overlap' on keys that are in both."""
    both = left.unionByName(right, allowMissingColumns=True)
    shared = left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi").withColumn("problem", F.lit("overlap"))
    return both.join(shared, key, "left")


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows of several tables; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def longest_first(names):
    """Names by falling length, ties by name: the order of substitution."""
    return F.array_sort(names, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))


def first_rows(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in an explicit order."""
    return rows.orderBy(*order).limit(n)
