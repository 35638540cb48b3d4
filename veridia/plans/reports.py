"""Reports over saved profiles: small aggregates made by Spark, formatted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import BOUNDARY_CATEGORIES
from ..functions.semantics import EXCLUDED_RUNS, first_nonzero, fixed_order, not_in, truthy
from ..operators import aggregates as A
from ..operators import tables
from ..operators.joins import compare_cohorts
from ..sources.writers import markdown


def comparison_rows(profiles: DataFrame) -> DataFrame:
    """model, strategy, metric, construct, numerator, denominator of executed profiles.

    BVA counts matched and applicable boundary items per category; CFA sums
    scores over scorable items per construct, where control-flow evidence passed.
    """
    rows = profiles.where(truthy("execution_passed") & not_in("run_id", EXCLUDED_RUNS))
    keys = [F.coalesce(F.col(c), F.lit("None")).alias(n) for c, n in (("model_id", "model"), ("prompt_template", "strategy"))]
    part = lambda metric, construct, top, bottom: F.struct(F.lit(metric).alias("metric"), construct.alias("construct"), top.cast("double").alias("numerator"), bottom.cast("long").alias("denominator"))
    bva = lambda name, top, bottom: F.transform(F.coalesce(name, F.array().cast("array<struct<category:string>>")), lambda i: part("BVA", i["category"], F.lit(top), F.lit(bottom)))
    stats = F.map_entries(F.when(F.col("extreme_condition_mutation_status") == "passed", F.col("if_else_if_condition_by_construct")))
    cfa = F.transform(stats, lambda e: part("CFA", e["key"], F.coalesce(e["value"]["score_sum"], F.lit(0.0)), F.coalesce(e["value"]["scorable"], e["value"]["represented"], F.lit(0))))
    empty = F.array().cast("array<struct<metric:string,construct:string,numerator:double,denominator:bigint>>")
    long = F.concat(bva("boundary_applicable_items", 0, 1), bva("boundary_matched_items", 1, 0), F.coalesce(cfa, empty))
    return rows.select(*keys, F.explode(long).alias("x")).select("model", "strategy", "x.*")


def compare_profiles(treatment: DataFrame, control: DataFrame) -> DataFrame:
    """Scores of two profile sets and their difference, sorted by key."""
    keys = ["model", "strategy", "metric", "construct"]
    return compare_cohorts(comparison_rows(treatment), comparison_rows(control), keys).orderBy(*keys)


def _ran(profiles: DataFrame) -> DataFrame:
    return profiles.where(truthy("execution_passed"))


def control_flow_detail(profiles: DataFrame) -> DataFrame:
    """Control-flow adequacy per construct, in display order."""
    stats = _ran(profiles).select(F.explode("if_else_if_condition_by_construct").alias("construct", "s")).select("construct", "s.*")
    pit = _ran(profiles).select(F.explode("if_else_if_condition_pit_total_by_construct").alias("construct", "pit_total"), F.col("if_else_if_condition_pit_covered_by_construct").alias("c"))
    pit = pit.select("construct", "pit_total", F.coalesce(F.try_element_at("c", F.col("construct")), F.lit(0)).alias("pit_covered"))
    return tables.control_flow_detail(stats, pit).orderBy("place", "construct").drop("place")


def boundary_categories(profiles: DataFrame) -> DataFrame:
    """Coverage per boundary category in fixed order, over executed profiles, in all and for each prompt."""
    rows = _ran(profiles).withColumn("row_id", F.xxhash64("run_id", "task_id", "model_id", "prompt_template"))
    long = lambda c: rows.select("row_id", F.coalesce("prompt_template", F.lit("None")).alias("prompt"), F.explode(c).alias("i")).select("row_id", "prompt", F.col("i.category").alias("category"))
    applicable, matched = long("boundary_applicable_items"), long("boundary_matched_items")
    each = tables.category_by_prompt(applicable, matched)
    pairs = each.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prompt", "covered", "applicable"))), lambda x: F.concat_ws(" ", x["prompt"], F.concat_ws("/", x["covered"], x["applicable"]))), ", ").alias("by_prompt"))
    out = A.category_coverage(applicable, matched).join(pairs, "category")
    return out.orderBy(fixed_order(F.col("category"), BOUNDARY_CATEGORIES), "category")


def oracle_strength(profiles: DataFrame) -> DataFrame:
    """Oracle strength per construct over rows whose assertion evidence passed."""
    rows = _ran(profiles).where("assertion_mutation_status = 'passed'")
    stats = rows.select(F.explode("assertion_strength_by_construct").alias("construct", "s")).select("construct", "s.*")
    e = F.col("exception_behavior_excluding_broad_original_scope")
    fields = {"scorable": "scorable_items", "checked": "checked_items", "killed_by_oracle_items": "oracle_killed_items", "killed_incidentally_items": "incidentally_killed_items", "represented": "represented_items"}
    narrow = rows.select(*[e[fields.get(c, c)].alias(c) for c in tables.OVERRIDDEN], e["score_sum"].alias("score_sum"))
    hidden = rows.select(F.col("assertion_strength_unmeasurable_by_type_substitution_items").alias("n"))
    return tables.oracle_strength_detail(stats, narrow, hidden).orderBy("construct")


def return_subcategories(profiles: DataFrame) -> DataFrame:
    rows = _ran(profiles).where("assertion_mutation_status = 'passed'")
    stats = rows.select(F.explode("assertion_strength_return_subcategories").alias("subcategory", "s")).select("subcategory", "s.*")
    stats = stats.withColumn("degenerate_null", first_nonzero(F.col("degenerate_null"), F.col("degenerate_null_items")))
    return tables.subcategory_table(stats).orderBy("place").drop("place")


def sections(profiles: DataFrame) -> list[tuple[str, list[DataFrame]]]:
    """Titles and tables of the report, in order."""
    items = {c: F.col(f"assertion_strength_{c}").alias(c) for c in ("total_items", "reached_items", "represented_items", "scorable_items", "checked_items")}
    flow = {"total_items": "if_else_if_condition_total", "scorable_items": "if_else_if_condition_scorable"}
    measure = lambda f: F.aggregate(F.map_values(F.coalesce("if_else_if_condition_by_construct", F.create_map().cast(profiles.schema["if_else_if_condition_by_construct"].dataType))), F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s[f], F.lit(0)))
    branches = profiles.select("execution_passed", "target_is_private", F.col("extreme_condition_mutation_status").alias("extreme_status"), *[F.col(c).alias(n) for n, c in flow.items()], measure("represented").alias("represented_items"), measure("checked").alias("checked_items"))
    asserted = profiles.select("execution_passed", "target_is_private", "assertion_mutation_raw_status", "assertion_mutation_status", *items.values())
    failures = A.failure_counts(profiles).orderBy(F.desc("n"), "family", "category")
    return [
        ("Execution Funnel", [A.execution_funnel(profiles)]), ("Failure Classification", [failures, A.failure_stage_counts(profiles).orderBy(F.desc("n"), "stage")]), ("Boundary-Value Adequacy Details", [boundary_categories(profiles)]),
        ("Control-Flow Mutation Funnel", [A.control_flow_funnel(branches)]), ("Control-Flow Adequacy Details", [control_flow_detail(profiles)]), ("Assertion Mutation Funnel", [A.assertion_funnel(asserted)]),
        ("Oracle Strength Details", [oracle_strength(profiles), return_subcategories(profiles)]),
    ]


def summary(profiles: DataFrame) -> str:
    """Markdown report of seven sections."""
    return "\n\n".join(f"## {title}\n\n" + "\n\n".join(markdown(t) for t in held) for title, held in sections(profiles)) + "\n"
