"""Null and truth rules of nested evaluation records, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: run that no comparison or funnel counts (fixed value)
EXCLUDED_RUNS = ("java-v2-mixed-gemma-panta-control-full",)


def truthy(flag) -> Column:
    """A nullable flag read as a condition: null is false."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))


def first_nonempty(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def first_nonzero(*numbers: Column) -> Column:
    """The first number that is neither null nor zero, else 0."""
    return F.coalesce(*[F.nullif(n, F.lit(0)) for n in numbers], F.lit(0))


def group_key(name: str) -> Column:
    """Grouping text of a column, where null reads as 'None'."""
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def known_or(name: str, default: str = "unknown") -> Column:
    """Grouping text where null and empty read as ``default``."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def not_in(name: str, values) -> Column:
    """NOT IN that keeps rows with a null value."""
    values = list(values)
    return ~F.coalesce(F.col(name).isin(values), F.lit(False)) if values else F.lit(True)


def ratio(top, bottom) -> Column:
    """top / bottom as a double; null where bottom is null or zero."""
    top, bottom = (F.col(x) if isinstance(x, str) else x for x in (top, bottom))
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def total(value) -> Column:
    """Sum in which nulls, and a group without rows, are 0."""
    return F.coalesce(F.sum(value), F.lit(0))


def count_where(condition) -> Column:
    return F.count(F.when(F.col(condition) if isinstance(condition, str) else condition, 1))


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``; null keys are keys too.

    A struct maximum (a partial aggregate) instead of a window, so that a hot
    key is reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    packed = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("_last")
    return rows.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def top_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def bucket_of(own: Column, *fallbacks: Column) -> Column:
    """Complexity bucket: the first non-empty of a chain, else 'unknown'."""
    return F.coalesce(first_nonempty(own, *fallbacks), F.lit("unknown"))


def fixed_order(value: Column, names) -> Column:
    """Sort position in a fixed list; unknown names come behind it."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0)), F.lit(1 << 30))


def three_decimals(value: Column) -> Column:
    """A double with three decimals, rounded by its exact binary value, and ties of that to even."""
    v = value.cast("double")
    scaled = F.abs(v) * (1 << 30)  # by a power of two, hence exact
    whole = F.floor(scaled)
    units, rest = (whole * 1000).cast("long"), (scaled - whole) * 1000
    n, over = F.shiftright(units, 30), F.pmod(units, F.lit(1 << 30)) - (1 << 29) + rest  # what lies above the half
    up = (over > 0) | (over == 0) & (n % 2 == 1)
    n = n + up.cast("long")
    text = F.concat(F.when(v < 0, "-").otherwise(""), F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.when(F.abs(v) < 1 << 20, text).otherwise(F.format_string("%.3f", v))


def fmt(value, missing: str = "N/A") -> Column:
    """A number with three decimals, or ``missing``."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull(), F.lit(missing)).otherwise(three_decimals(value))


def fmt_least(value, n, least: int = 10) -> Column:
    """As fmt, but 'suppressed' where fewer than ``least`` items stand behind the value."""
    n = F.col(n) if isinstance(n, str) else n
    return F.when(F.coalesce(n, F.lit(0)) < least, F.lit("suppressed")).otherwise(fmt(value))


def percent(top, bottom) -> Column:
    """top / bottom with three decimals; blank where bottom is 0."""
    top, bottom = (F.col(x) if isinstance(x, str) else x for x in (top, bottom))
    return F.when(bottom == 0, F.lit("")).otherwise(three_decimals(ratio(top, bottom)))


def bucket_chain(rows: DataFrame, own: str = "complexity_bucket", task: str = "task") -> Column:
    """A row's complexity bucket: its own, else its task's split, data set or bucket."""
    fields = {f.name for f in rows.schema[task].dataType.fields} if task in rows.columns else set()
    return bucket_of(F.col(own), *[F.col(f"{task}.{n}") for n in ("v2_primary_split", "dataset", "complexity_bucket") if n in fields])


def prompt_rank(prompt: Column, order) -> Column:
    """Sort key of a prompt: its place in a fixed list, unknown ones behind it by name."""
    return F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), prompt), F.lit(0)), F.lit(len(order) + 1)).alias("place"), prompt.alias("name"))


def row_keys(rows: DataFrame, *names: str) -> Column:
    """A row's key of several parts, where null reads as an empty text."""
    return F.struct(*[F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names])
