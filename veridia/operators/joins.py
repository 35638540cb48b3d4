"""Joins of evaluation records: evidence, cohorts, resume, completeness, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import last_wins, ratio, total


def attach_evidence(rows: DataFrame, evidence: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows with evidence columns: a row's own value wins, else the last evidence of its key."""
    last = last_wins(evidence, keys, order).select(*keys, *[F.col(c).alias(f"_e_{c}") for c in columns])
    own = [c for c in rows.columns if c not in columns]
    merged = [F.coalesce(F.col(c), F.col(f"_e_{c}")).alias(c) if c in rows.columns else F.col(f"_e_{c}").alias(c) for c in columns]
    return rows.join(last, keys, "left").select(*own, *merged)


def compare_cohorts(treatment: DataFrame, control: DataFrame, keys: list[str]) -> DataFrame:
    """Full comparison of (keys, numerator, denominator): scores and their difference.

    A missing side counts 0 of 0; the difference needs both scores. Both sides
    are aggregated in one pass, so the shuffle carries one partial row per key.
    """
    both = treatment.select(*keys, "numerator", "denominator", F.lit(True).alias("_t")).unionByName(control.select(*keys, "numerator", "denominator", F.lit(False).alias("_t")))
    return compare_tagged(both, "_t", keys)


def compare_tagged(both: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """As compare_cohorts, for one table whose flag ``tag`` marks the treatment: one scan, one aggregate."""
    side = lambda of, c: total(F.when(F.col(tag) == of, F.col(c)))
    out = both.groupBy(*keys).agg(*[side(of, c).cast(kind).alias(f"{name}_{c}") for of, name in ((True, "treatment"), (False, "control")) for c, kind in (("numerator", "double"), ("denominator", "long"))])
    t, c = ratio("treatment_numerator", "treatment_denominator"), ratio("control_numerator", "control_denominator")
    return out.select(*keys, "treatment_numerator", "treatment_denominator", t.alias("treatment_score"), "control_numerator", "control_denominator", c.alias("control_score"), (t - c).alias("treatment_minus_control"))


def resume(todo: DataFrame, done: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows whose key was not done yet (by this collector version, if one is given)."""
    if version is not None:
        done = done.where(F.col("collector_version") == version)
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def resume_with(todo: DataFrame, done: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows: those done by this collector version as they are, the others marked to be processed."""
    last = done.where(F.col("collector_version") == version).select(*keys).distinct().withColumn("_d", F.lit(True))
    return todo.join(last, keys, "left").withColumn("process", F.col("_d").isNull()).drop("_d")


def prior_selected(items: DataFrame, prior: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Items that an earlier run selected, with its columns; null keys match null keys."""
    p = prior.select(*[F.col(k).alias(f"_p_{k}") for k in keys], *[F.col(c).alias(f"prior_{c}") for c in columns]).dropDuplicates([f"_p_{k}" for k in keys])
    on = None
    for k in keys:
        same = items[k].eqNullSafe(p[f"_p_{k}"])
        on = same if on is None else on & same
    return items.join(p, on).drop(*[f"_p_{k}" for k in keys])


def missing_configurations(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected configurations that no row has, and found ones that were not expected."""
    a, b = expected.select(*keys).distinct(), found.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def provenance_mismatches(rows: DataFrame, tasks: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and problem: tasks missing, repeated, unknown, or different in a field."""
    seen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.min(f).alias(f"_r_{f}") for f in fields])
    both = tasks.select(key, *fields).withColumn("_t", F.lit(True)).join(seen, key, "full")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"_r_{f}"))
    problem = F.when(F.col("_t").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").when(differs, "different")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def exclusion_problems(register: DataFrame, tasks: DataFrame, key: str, field: str) -> DataFrame:
    """key and problem of an exclusion register's entries: unknown, entered twice, or of another ``field`` than the task."""
    n = register.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(field).alias("_f"))
    both = n.join(tasks.select(key, field).withColumn("_t", F.lit(True)), key, "left")
    problem = F.when(F.col("_t").isNull(), "unknown").when(F.col("_n") > 1, "duplicate").when(~F.col("_f").eqNullSafe(F.col(field)), "mismatch")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def not_excluded(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on no exclusion list; rows without a key stay."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def null_safe_semi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows whose keys occur on the right, where null equals null."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = left[k].eqNullSafe(r[f"_r_{k}"])
        on = same if on is None else on & same
    return left.join(r, on, "left_semi")


def mark_covered(items: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Items with a covered flag: whether their null-safe keys occur among the covered ones."""
    r = covered.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
    on = None
    for k in keys:
        same = items[k].eqNullSafe(r[f"_r_{k}"])
        on = same if on is None else on & same
    return items.join(r, on, "left").select(*items.columns, F.coalesce("_hit", F.lit(False)).alias("covered"))


def match_lines(items: DataFrame, mutants: DataFrame, keys: list[str]) -> DataFrame:
    """Items (lines array) with the set of mutant statuses on any of their lines; killed beats missed.

    Mutants become one small map from lines to statuses per row, which each item
    of the row looks up: one join, and no aggregate over items.
    """
    lines = mutants.groupBy(*keys, "line").agg(F.collect_set("status").alias("s")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("line", "s"))).alias("_at"))
    none = F.array().cast("array<string>")
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda x: F.coalesce(F.try_element_at("_at", x), none)))))
    out = items.join(lines, keys, "left").withColumn("statuses", F.when(F.col("_at").isNull(), none).otherwise(found)).drop("_at")
    reached = F.when(F.array_contains("statuses", "KILLED"), "covered").when(F.arrays_overlap("statuses", F.array(F.lit("SURVIVED"), F.lit("NO_COVERAGE"))), "missed")
    return out.withColumn("match", reached.when(F.size("statuses") > 0, "other").otherwise("unmutated"))


def completeness(found: DataFrame, models: list[str], strategies: list[str], tasks: DataFrame) -> DataFrame:
    """problem, key columns and n: expected rows that are missing, unexpected rows, and repeated ones.

    The expected grid is models x strategies x tasks, made by exploding two
    literal lists on each task: linear in the tasks, without a cross join.
    """
    keys = ["model", "strategy", "task"]
    grid = tasks.select("task").distinct().withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    seen = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = grid.withColumn("_e", F.lit(True)).join(seen, keys, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("problem", *keys, F.coalesce("n", F.lit(0)).alias("n"))


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """Points with the intervals (key, lo, hi) that hold them, by equal buckets of ``width`` instead of a nested loop."""
    cut = intervals.select(F.col(key).alias("_k"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_b"))
    on = (points[key] == cut["_k"]) & (F.floor(points[at] / width) == cut["_b"]) & points[at].between(cut["lo"], cut["hi"])
    return points.join(cut, on).drop("_k", "_b")


def override_from_total(groups: DataFrame, totals: DataFrame, name: str, group: str, column: str, flag: str) -> DataFrame:
    """Replace one group's value by a one-row total's if the total's flag is positive."""
    one = totals.agg(F.sum(flag).alias("_f"), F.sum(column).alias("_v"))
    use = (F.col(group) == name) & (F.col("_f") > 0)
    return groups.join(F.broadcast(one)).withColumn(column, F.when(use, F.col("_v")).otherwise(F.col(column))).drop("_f", "_v")


def changed_lines(original: str, mutant: str):
    """Lines in exactly one of two arrays, sorted."""
    return F.array_sort(F.array_union(F.array_except(original, mutant), F.array_except(mutant, original)))


def reach_status(line: str, covered: str):
    """reached / not_reached by a covered-line array, unknown without coverage."""
    return F.when(F.col(covered).isNull(), "unknown").when(F.array_contains(covered, F.col(line)), "reached").otherwise("not_reached")
