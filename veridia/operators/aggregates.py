"""Item, row and group scores. All functions take and return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ITEM_OUTCOMES, NON_REPRESENTABLE, NOT_REPRESENTED, PRIMARY_CONSTRUCTS, control_flow_reason, variant_score
from ..functions.semantics import count_where, group_key, known_or, not_in, ratio, total, truthy


def execution_funnel(rows: DataFrame) -> DataFrame:
    """One row: total, compiled, executed, non_executable."""
    executed = count_where(truthy("execution_passed"))
    return rows.agg(F.count(F.lit(1)).alias("total"), count_where(truthy("compile_passed")).alias("compiled"), executed.alias("executed"), (F.count(F.lit(1)) - executed).alias("non_executable"))


def has_artifact(status: str = "assertion_mutation_raw_status"):
    return F.coalesce(~F.col(status).isin("", "missing"), F.lit(False))


def assertion_funnel(rows: DataFrame) -> DataFrame:
    """Nested stages of assertion evidence, over executed public rows with an artifact."""
    executed, public = truthy("execution_passed"), ~truthy("target_is_private")
    with_evidence = executed & public & has_artifact()
    part = lambda name: total(F.when(with_evidence, F.col(name))).cast("long")
    executed_n, public_n = count_where(executed), count_where(executed & public)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), executed_n.alias("executed"), public_n.alias("executed_public"), count_where(has_artifact()).alias("raw_evidence"),
        count_where(with_evidence).alias("with_evidence"), count_where(with_evidence & (F.col("assertion_mutation_status") == "passed")).alias("passed_evidence"),
        part("total_items").alias("obligations"), part("reached_items").alias("reached"), part("represented_items").alias("represented"), part("scorable_items").alias("scorable"), part("checked_items").alias("checked"),
        (F.count(F.lit(1)) - executed_n).alias("non_executable"), (executed_n - public_n).alias("executed_private"),
    )


def control_flow_funnel(rows: DataFrame) -> DataFrame:
    """Nested stages of control-flow evidence; obligations of rows whose evidence passed."""
    executed, public = truthy("execution_passed"), ~truthy("target_is_private")
    evidence = executed & public & F.coalesce(~F.col("extreme_status").isin("", "missing"), F.lit(False))
    passed = evidence & (F.col("extreme_status") == "passed")
    part = lambda name: total(F.when(passed, F.col(name))).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), count_where(executed).alias("executed"), count_where(executed & public).alias("executed_public"), count_where(evidence).alias("with_evidence"), count_where(passed).alias("passed_evidence"),
        part("total_items").alias("obligations"), part("represented_items").alias("represented"), part("scorable_items").alias("scorable"), part("checked_items").alias("checked"),
    )


def eligibility_funnel(rows: DataFrame, excluded) -> DataFrame:
    """Rows and obligations from all to executed and public, with rates."""
    rows = rows.where(not_in("run_id", excluded))
    executed, eligible = truthy("execution_passed"), truthy("execution_passed") & ~truthy("target_is_private")
    part = lambda name: total(F.when(eligible, F.col(name))).cast("long")
    out = rows.agg(F.count(F.lit(1)).alias("rows"), count_where(executed).alias("executed"), count_where(eligible).alias("eligible"), *[part(f"{n}_items").alias(n) for n in ("total", "reached", "represented", "checked")])
    return out.select(
        "*", ratio("executed", "rows").alias("executed_rate"), ratio("eligible", "executed").alias("eligible_rate"),
        ratio("reached", "total").alias("reached_rate"), ratio("represented", "reached").alias("represented_rate"), ratio("checked", "represented").alias("checked_rate"),
    )


def configuration_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("model_id", F.lit("?")).alias("model"), F.coalesce("prompt_template", F.lit("?")).alias("prompt")).agg(F.count(F.lit(1)).alias("n_rows"))


def failure_counts(rows: DataFrame) -> DataFrame:
    """family, category, n of the rows that did not execute."""
    failed = rows.where(~truthy("execution_passed"))
    return failed.groupBy(known_or("failure_family").alias("family"), known_or("failure_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def failure_stage_counts(rows: DataFrame) -> DataFrame:
    return rows.where(~truthy("execution_passed")).groupBy(known_or("error_stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def failure_cross_tab(rows: DataFrame, categories: list[str]) -> DataFrame:
    """One row per bucket with its failures and one column per 'family/category'."""
    failed = rows.where(~truthy("execution_passed"))
    name = F.concat_ws("/", known_or("failure_family"), known_or("failure_category"))
    return failed.groupBy(group_key("complexity_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *[count_where(name == c).alias(c) for c in categories])


def category_coverage(applicable: DataFrame, matched: DataFrame) -> DataFrame:
    """category: rows and items applicable and covered, and the item coverage rate."""
    both = applicable.select("row_id", "category", F.lit(0).alias("m")).unionAll(matched.select("row_id", "category", F.lit(1).alias("m")))
    return both.groupBy("category").agg(
        F.countDistinct(F.when(F.col("m") == 0, F.col("row_id"))).alias("applicable_rows"), F.countDistinct(F.when(F.col("m") == 1, F.col("row_id"))).alias("covered_rows"),
        count_where(F.col("m") == 0).alias("applicable_items"), count_where(F.col("m") == 1).alias("covered_items"),
        ratio(count_where(F.col("m") == 1), count_where(F.col("m") == 0)).alias("coverage_rate"),
    )


def row_boundary_score(items: DataFrame) -> DataFrame:
    """row_id, score: the mean over parameters of covered / applicable (a mean of ratios)."""
    each = items.groupBy("row_id", "parameter").agg(ratio(F.sum(F.col("covered").cast("int")), F.count(F.lit(1))).alias("r"))
    return each.groupBy("row_id").agg(F.avg("r").alias("score"))


def micro_macro(rows: DataFrame, score: str, top: str, bottom: str, keys: list | None = None) -> DataFrame:
    """Applicable rows, numerator, denominator, micro score, mean row score and mean mutation score of executed rows."""
    rows = rows.where(truthy("execution_passed") & F.col(score).isNotNull())
    grouped = rows.groupBy(*keys) if keys else rows
    return grouped.agg(
        F.count(F.lit(1)).alias("applicable_rows"), total(F.col(top).cast("double")).alias("numerator"), total(F.col(bottom)).cast("long").alias("denominator"),
        ratio(total(F.col(top).cast("double")), total(F.col(bottom))).alias("micro_score"), F.avg(score).alias("avg_row_score"), F.avg("mutation_score").alias("avg_mutation"),
    )


def joint_with_total(rows: DataFrame, key: str, tops_bottoms: dict[str, tuple[str, str]]) -> DataFrame:
    """Summed ratios per key and for 'all', in one pass over executed rows (a rollup)."""
    rows = rows.where(truthy("execution_passed")).withColumn("_k", group_key(key))
    sums = [c for n, (t, b) in tops_bottoms.items() for c in (total(F.col(t)).cast("double").alias(f"{n}_top"), total(F.col(b)).cast("long").alias(f"{n}_bottom"))]
    out = rows.rollup("_k").agg(*sums, F.grouping("_k").alias("_g"))
    out = out.withColumn("configuration", F.when(F.col("_g") == 1, "all").otherwise(F.col("_k")))
    return out.select("configuration", *[c for n in tops_bottoms for c in (f"{n}_top", f"{n}_bottom", ratio(f"{n}_top", f"{n}_bottom").alias(f"{n}_joint"))])


def scope_summary(items: DataFrame, keys: list[str], constructs=PRIMARY_CONSTRUCTS) -> DataFrame:
    """Per key, the counts and scores of items of the given constructs.

    Items flagged ``subsumed`` stay in total_items and become non-representable,
    and are in no other count.
    """
    items = items.where(F.col("construct").isin(*constructs))
    broad = truthy("subsumed")
    inside = lambda c: count_where(~broad & c)
    status, outcome, scored = F.col("status"), F.col("outcome"), F.col("score").isNotNull()
    odd = F.coalesce(status.isin(*NON_REPRESENTABLE), F.lit(False)) | F.coalesce(outcome.isin(*NON_REPRESENTABLE), F.lit(False))
    reached = ~F.coalesce(status == "not_reached", F.lit(False))
    out = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_items"), inside(reached).alias("reached_items"), inside(~reached).alias("not_reached_items"), inside(scored).alias("scorable_items"),
        (inside(odd) + count_where(broad)).alias("non_representable_items"), inside(scored & (F.col("score") > 0)).alias("checked_items"),
        inside(outcome == "killed_by_oracle").alias("oracle_killed_items"), inside(outcome == "killed_incidentally").alias("incidentally_killed_items"),
        inside(outcome == "survived").alias("survived_items"), inside(outcome == "survived_path_changed").alias("survived_path_changed_items"),
        inside(status == "coverage_unverified").alias("coverage_unverified_items"), count_where(broad).alias("unmeasurable_items"), inside(truthy("represented")).alias("represented_items"),
        total(F.when(~broad, F.col("score"))).alias("score_sum"), inside(F.coalesce(status.isin("not_generated", "out_of_scope"), F.lit(False))).alias("_missing"),
    )
    out = out.withColumn("pessimistic_denominator", F.col("scorable_items") + F.col("_missing")).drop("_missing")
    return out.select(
        "*", ratio("score_sum", "scorable_items").alias("score"), ratio("score_sum", "pessimistic_denominator").alias("pessimistic_score"),
        ratio("represented_items", "reached_items").alias("representability_rate"), ratio("scorable_items", "reached_items").alias("scorable_rate"),
    )


def variants_to_items(variants: DataFrame, keys: list[str], incidental: str = "zero") -> DataFrame:
    """Items from mutant variants (outcome, status, represented, sensitivity_only).

    Score: mean over represented variants that are not sensitivity-only.
    """
    own = truthy("represented")
    s = F.when(own & ~truthy("sensitivity_only"), variant_score(F.col("outcome"), incidental))
    out = variants.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("variants"), count_where(own).alias("represented_variants"), F.count(s).alias("scored_variants"), F.avg(s).alias("score"),
        F.max(s).alias("any_killed"), F.min(s).alias("all_killed"), *[F.bool_or(own & (F.col("outcome") == o)).alias(f"_o{i}") for i, o in enumerate(ITEM_OUTCOMES)],
        *[F.bool_or(~own & (F.coalesce("outcome", "status") == o)).alias(f"_s{i}") for i, o in enumerate(NOT_REPRESENTED)],
    )
    first = lambda names, p: F.coalesce(*[F.when(F.col(f"_{p}{i}"), F.lit(n)) for i, n in enumerate(names)])
    outcome = F.when(F.col("represented_variants") > 0, first(ITEM_OUTCOMES, "o")).otherwise(F.coalesce(first(NOT_REPRESENTED, "s"), F.lit("not_generated")))
    return out.withColumn("outcome", outcome).withColumn("represented", F.col("represented_variants") > 0).drop(*[c for c in out.columns if c.startswith(("_o", "_s"))])


def control_flow_items(variants: DataFrame, keys: list[str]) -> DataFrame:
    """Items from control-flow mutants: represented iff all attempted are killed or survived."""
    done = F.col("status").isin("killed", "survived")
    out = variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_variants"), count_where(done).alias("represented_variants"), count_where(F.col("status") == "killed").alias("killed"))
    full = F.col("represented_variants") == F.col("total_variants")
    out = out.withColumn("score", F.when(full, ratio("killed", "total_variants")))
    return out.withColumn("represented", full).withColumn("score_reason", control_flow_reason(full, F.col("score")))


def control_flow_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, scorable, score sum, score, checked and the pessimistic bound per key."""
    out = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count_where(truthy("represented")).alias("scorable"), total("score").alias("score_sum"), count_where(F.col("score") > 0).alias("checked"))
    return out.select("*", ratio("score_sum", "scorable").alias("score"), ratio("checked", "total").alias("pessimistic"))


def histogram_0_1_2(items: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Counts and shares of the oracle scores 0, 1 and 2, and the bins 0, (0,1), [1,2), 2."""
    s, n = F.col(score), F.count(F.lit(1))
    counts = [count_where(s == k).alias(f"n{k}") for k in (0, 1, 2)]
    bins = [count_where((s > 0) & (s < 1)).alias("low"), count_where((s >= 1) & (s < 2)).alias("high")]
    out = items.groupBy(*keys).agg(n.alias("n"), *counts, *bins)
    return out.select("*", *[ratio(f"n{k}", "n").alias(f"share{k}") for k in (0, 1, 2)])


def mutation_summary(rows: DataFrame, keys: list | None = None) -> DataFrame:
    """Macro mean and weighted mutation score with coverage means."""
    grouped = rows.groupBy(*keys) if keys else rows
    k, s, n = (total(F.col(c)).cast("long") for c in ("killed", "survived", "no_coverage"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("mutation_score").alias("scored_rows"), F.avg("mutation_score").alias("macro"), ratio(k, k + s + n).alias("weighted"),
        F.avg("line_rate").alias("avg_line_rate"), F.avg("branch_rate").alias("avg_branch_rate"),
    )


def mutant_status_counts(mutants: DataFrame, keys: list[str]) -> DataFrame:
    """Killed, survived, uncovered and all mutants with the score killed / (killed + survived + uncovered)."""
    names = {"killed": "KILLED", "survived": "SURVIVED", "no_coverage": "NO_COVERAGE"}
    out = mutants.groupBy(*keys).agg(F.count(F.lit(1)).alias("mutants_total"), *[count_where(F.col("status") == v).alias(n) for n, v in names.items()])
    return out.withColumn("score", ratio("killed", F.col("killed") + F.col("survived") + F.col("no_coverage")))


def object_rule_summary(items: DataFrame) -> DataFrame:
    """Scores by an item's set of operator rules, named by the sorted distinct rules joined with ';'."""
    rules = F.array_join(F.array_sort(F.array_distinct(F.col("rules"))), ";")
    return items.groupBy(rules.alias("rule")).agg(F.count(F.lit(1)).alias("total"), F.count("score").alias("scorable"), count_where(F.col("score") > 0).alias("checked"), total("score").alias("score_sum"), F.avg("score").alias("score"))


def token_top(tokens: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """Per key a map of its n most frequent tokens (ties by token)."""
    from ..functions.semantics import top_n

    counts = tokens.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    best = top_n(counts, keys, [F.desc("n"), "token"], n)
    return best.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "n")))).alias("tokens"))
