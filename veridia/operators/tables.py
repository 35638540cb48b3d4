"""The tables of reports, as DataFrames; rendering them is left to plans.reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import CONTROL_FLOW_DISPLAY, RETURN_SUBCATEGORIES, run_outcome
from ..functions.semantics import count_where, first_nonzero, fixed_order, fmt_least, group_key, known_or, prompt_rank, ratio, total, truthy

#: measures of an assertion construct (fixed names)
OUTCOMES = (
    "total", "represented", "scorable", "checked", "not_reached_items", "not_generated_items", "out_of_scope_items", "compile_error_items", "timeout_items",
    "killed_by_oracle_items", "killed_incidentally_items", "survived_items", "survived_path_changed_items", "coverage_unverified_items", "non_representable_items",
)
#: score, numerator and denominator of the three reported adequacies (fixed names)
ADEQUACIES = {
    "Boundary-Value Adequacy": ("boundary_strength_score", "boundary_covered_count", "boundary_applicable_count"),
    "Control-Flow Adequacy": ("if_else_if_condition_avg_item_score", "if_else_if_condition_checked_sum", "if_else_if_condition_scorable"),
    "Assertion Strength": ("assertion_strength_score", "assertion_strength_checked_items", "assertion_strength_scorable_items"),
}


def _sum(name, kind: str = "long") -> Column:
    return total(F.col(name) if isinstance(name, str) else name).cast(kind)


def category_by_prompt(applicable: DataFrame, matched: DataFrame) -> DataFrame:
    """category, prompt: covered and applicable items, one pass over a tagged union."""
    both = applicable.select("category", "prompt", F.lit(0).alias("m")).unionAll(matched.select("category", "prompt", F.lit(1).alias("m")))
    return both.groupBy("category", "prompt").agg(count_where(F.col("m") == 1).alias("covered"), count_where(F.col("m") == 0).alias("applicable"))


def control_flow_detail(stats: DataFrame, pit: DataFrame) -> DataFrame:
    """Per construct in display order: items, scores, bound, and the representability by mutants and by variants.

    ``stats``: (construct, total, scorable, represented, checked, score_sum,
    total_variants, represented_variants) of rows that ran; ``pit``: (construct,
    pit_total, pit_covered). A scorable count of 0 falls back on the represented
    one; items stand in for variants where there are none.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = n("total_variants") == 0
    variants = F.when(none, n("represented")).when((n("represented_variants") == 0) & (n("represented") > 0), n("represented")).otherwise(n("represented_variants"))
    rows = stats.select("construct", n("total").alias("total"), first_nonzero(F.col("scorable"), F.col("represented")).alias("scorable"), n("checked").alias("checked"), n("score_sum").alias("score_sum"), F.when(none, n("total")).otherwise(n("total_variants")).alias("tv"), variants.alias("rv"))
    out = rows.groupBy("construct").agg(_sum("total").alias("applicable"), _sum("scorable").alias("scorable"), _sum("checked").alias("checked"), _sum("score_sum", "double").alias("score_sum"), _sum("tv").alias("variants"), _sum("rv").alias("represented_variants"))
    mutants = pit.groupBy("construct").agg(_sum("pit_total").alias("pit_total"), _sum("pit_covered").alias("pit_covered"))
    out = out.where("applicable > 0").join(mutants, "construct", "left")
    return out.select(
        fixed_order(F.col("construct"), CONTROL_FLOW_DISPLAY).cast("long").alias("place"), "construct", "applicable", "scorable", "checked", ratio("score_sum", "scorable").alias("avg_item_score"), ratio("checked", "applicable").alias("pessimistic_bound"),
        ratio("pit_covered", "pit_total").alias("pit_representability"), "variants", "represented_variants", ratio("represented_variants", "variants").alias("variant_representability"),
    )


def outcome_breakdown(stats: DataFrame) -> DataFrame:
    """Per construct: the sums of all outcome counters, reached items and the scorable share of them."""
    out = stats.groupBy("construct").agg(*[_sum(c).alias(c) for c in OUTCOMES])
    out = out.withColumn("reached", F.col("total") - F.col("not_reached_items"))
    return out.withColumn("scorable_of_reached", ratio("scorable", "reached"))


#: columns of the oracle-strength table with the columns that replace those of exceptions (fixed names)
OVERRIDDEN = ("scorable", "checked", "killed_by_oracle_items", "killed_incidentally_items", "survived_items", "survived_path_changed_items", "coverage_unverified_items", "represented")


def oracle_strength_detail(stats: DataFrame, narrow: DataFrame, unmeasurable: DataFrame) -> DataFrame:
    """Per construct: counts, score and representability.

    ``narrow`` are the exception counters without items that a broad original
    catch hides; they replace those of exceptions where ``unmeasurable`` (one
    column, ``n``) sums to more than 0. Both totals are one row, so the join is
    with a single row.
    """
    sums = [c for c in OUTCOMES if c in stats.columns]
    out = stats.groupBy("construct").agg(*[_sum(c).alias(c) for c in sums], _sum("score_sum", "double").alias("score_sum"))
    one = narrow.agg(*[_sum(c).alias(f"_{c}") for c in OVERRIDDEN], _sum("score_sum", "double").alias("_score_sum"))
    hidden = unmeasurable.agg(_sum("n").alias("_hidden"))
    out = out.join(F.broadcast(one)).join(F.broadcast(hidden))
    use = (F.col("construct") == "exception_behavior") & (F.col("_hidden") > 0)
    out = out.withColumns({c: F.when(use, F.col(f"_{c}")).otherwise(F.col(c)) for c in (*OVERRIDDEN, "score_sum")})
    out = out.withColumn("reached", F.col("total") - F.col("not_reached_items"))
    return out.select(
        "construct", "total", "reached", "scorable", ratio("scorable", "reached").alias("scorable_of_reached"), "checked", "killed_by_oracle_items", "killed_incidentally_items", "survived_items", "survived_path_changed_items",
        "coverage_unverified_items", ratio("score_sum", "scorable").alias("score"), ratio("represented", "reached").alias("representability"), F.when(use, F.col("_hidden")).otherwise(0).alias("unmeasurable"),
    )


def subcategory_table(stats: DataFrame) -> DataFrame:
    """Return subcategories in their order, without 'object': counts, and rates that need at least 10 scorable items.

    ``applicable`` falls back on ``total``; absent subcategories count 0.
    """
    rows = stats.select(F.col("subcategory"), first_nonzero(F.col("applicable"), F.col("total")).alias("applicable"), "reached", "represented", "scorable", "checked", "score_sum", "degenerate_null")
    out = rows.groupBy("subcategory").agg(*[_sum(c).alias(c) for c in ("applicable", "reached", "represented", "scorable", "checked", "degenerate_null")], _sum("score_sum", "double").alias("score_sum"))
    names = [n for n in RETURN_SUBCATEGORIES if n != "object"]
    wanted = stats.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "subcategory string, place long")
    out = wanted.join(out, "subcategory", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "place", "subcategory", *[n(c) for c in ("applicable", "reached", "represented", "scorable", "checked")], fmt_least(F.round(ratio("score_sum", "scorable"), 6), "scorable").alias("score"),
        fmt_least(F.round(ratio("represented", "reached"), 6), "scorable").alias("representability"), n("degenerate_null"),
    )


def adequacies(rows: DataFrame, metrics: dict = ADEQUACIES) -> DataFrame:
    """Per metric, in one pass over the rows that ran: applicable rows, numerator, denominator, micro and macro score, mean mutation score."""
    rows = rows.where(truthy("execution_passed"))
    parts = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(s).cast("double").alias("score"), F.col(a).cast("double").alias("top"), F.col(b).cast("long").alias("bottom"), F.col("mutation_score").cast("double").alias("mutation")) for n, (s, a, b) in metrics.items()])
    long = rows.select(F.explode(parts).alias("x")).select("x.*").where("score IS NOT NULL")
    out = long.groupBy("metric").agg(F.count(F.lit(1)).alias("applicable_rows"), _sum("top", "double").alias("numerator"), _sum("bottom").alias("denominator"), F.avg("score").alias("avg_row_score"), F.avg("mutation").alias("avg_mutation"))
    return out.withColumn("micro_score", ratio("numerator", "denominator"))


def unresolved_rates(rows: DataFrame) -> DataFrame:
    """Target arguments and unresolvable ones per prompt and in all, by one rollup over the rows that ran."""
    rows = rows.where(truthy("execution_passed")).withColumn("_k", group_key("prompt_template"))
    out = rows.rollup("_k").agg(_sum("arguments").alias("arguments"), _sum("unresolved").alias("unresolved"), F.grouping("_k").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("_k")).alias("configuration"), "arguments", "unresolved", ratio("unresolved", "arguments").alias("rate"))


def oracle_levels(items: DataFrame, keys: list[str]) -> DataFrame:
    """Obligations per level 0, 1 and 2 with shares, mean level and mean mutation score; state changes do not count."""
    items = items.where(~F.coalesce(F.col("signal") == "state_change", F.lit(False)))
    level = F.coalesce(F.col("score").cast("int"), F.lit(0))
    grouped = items.groupBy(*keys) if keys else items.groupBy()
    out = grouped.agg(F.count(F.lit(1)).alias("items"), *[count_where(level == k).alias(f"o{k}") for k in (0, 1, 2)], F.avg("score").alias("avg_score"), F.avg("mutation_score").alias("avg_mutation"))
    return out.select("*", *[F.round(ratio(F.col(f"o{k}") * 100, "items"), 1).alias(f"o{k}_percent") for k in (0, 1, 2)])


def score_bins(rows: DataFrame, key: str, score: str) -> DataFrame:
    """Rows per group in the bins 0, (0, 1), [1, 2) and 2, with the mean."""
    s = F.col(score)
    rows = rows.where(truthy("execution_passed") & s.isNotNull())
    return rows.groupBy(group_key(key).alias("group")).agg(F.count(F.lit(1)).alias("rows"), F.avg(s).alias("avg_score"), count_where(s == 0).alias("zero"), count_where((s > 0) & (s < 1)).alias("below_one"), count_where((s >= 1) & (s < 2)).alias("below_two"), count_where(s == 2).alias("two"))


def label_mix(rows: DataFrame, label: str, labels, key: str = "prompt_template") -> DataFrame:
    """Applicable rows that ran per group, with the count and per cent of each label."""
    rows = rows.where(truthy("execution_passed") & (F.coalesce(F.col(label), F.lit("None")) != "not_applicable"))
    out = rows.groupBy(group_key(key).alias("group")).agg(F.count(F.lit(1)).alias("rows"), *[count_where(F.col(label) == n).alias(n) for n in labels])
    return out.select("*", *[F.round(ratio(F.col(n) * 100, "rows"), 1).alias(f"{n}_percent") for n in labels])


def outcome_counts(rows: DataFrame, outcomes) -> DataFrame:
    """Per model and pipeline: rows, and those of each outcome."""
    o = run_outcome(F.col("execution_passed"), F.col("failure_family"), F.col("failure_category"), F.col("error_stage"))["outcome"]
    named = rows.withColumn("outcome", o)
    return named.groupBy("model", "pipeline").agg(F.count(F.lit(1)).alias("total"), *[count_where(F.col("outcome") == n).alias(n) for n in outcomes])


def failure_details(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Per group and outcome, how often each detail occurs, most frequent first, ties by name."""
    out = rows.groupBy("model", "pipeline", "outcome", "detail").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("model", "pipeline", "outcome").orderBy(F.desc("n"), "detail"))
    out = out.withColumn("place", place)
    return out if most is None else out.where(F.col("place") <= most)


def exception_detail(rows: DataFrame) -> DataFrame:
    """Exception paths per prompt over the rows that ran and have any."""
    some = F.coalesce(F.col("exception_obligations"), F.lit(0)) > 0
    measures = ("exception_obligations", "exception_covered", "exception_asserted", "weak_handlers", "strong_exceptions", "weak_exceptions")
    rows = rows.where(truthy("execution_passed"))
    return rows.groupBy(group_key("prompt_template").alias("prompt")).agg(count_where(some).alias("applicable_rows"), *[_sum(F.when(some, F.col(c))).alias(c) for c in measures])


def cross_tab(items: DataFrame, keys: list[str], prompts: list[str], flag: str) -> DataFrame:
    """Items and flagged ones per key, in all and for each prompt."""
    hit = truthy(flag)
    sums = [c for p in prompts for c in (count_where((F.col("prompt") == p) & hit).alias(f"{p}_hit"), count_where(F.col("prompt") == p).alias(f"{p}_all"))]
    out = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("applicable"), count_where(hit).alias("checked"), *sums)
    return out.withColumn("score", ratio("checked", "applicable"))


def pooled_summary(rows: DataFrame) -> DataFrame:
    """One row over collected rows (score, score_sum, scorable, pessimistic_denominator, attempted, represented): pooled and macro scores, generation rate."""
    out = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("score").alias("scored_rows"), F.avg(F.col("score").cast("double")).alias("macro"), ratio(total("score_sum"), total("scorable")).alias("pooled"),
        ratio(total("score_sum"), total("pessimistic_denominator")).alias("pessimistic_pooled"), F.avg(ratio("score_sum", "pessimistic_denominator")).alias("pessimistic_macro"), ratio(total("represented"), total("attempted")).alias("generation_rate"),
    )
    return out


def operator_matrix(mutants: DataFrame, outcomes) -> DataFrame:
    """Per mutation rule: mutants, and those of each outcome."""
    return mutants.groupBy(known_or("operator_rule").alias("operator_rule")).agg(F.count(F.lit(1)).alias("total"), *[count_where(F.col("outcome") == o).alias(o) for o in outcomes])


def ordered_groups(rows: DataFrame, prompts) -> DataFrame:
    """Groups (model, pipeline) with their place: by model, then by the prompts' fixed order."""
    groups = rows.select("model", "pipeline").distinct()
    return groups.withColumn("place", F.row_number().over(Window.orderBy("model", prompt_rank(F.col("pipeline"), prompts))))


def mutant_categories(items: DataFrame) -> DataFrame:
    """Counters per category and status of mutants (categories array, status), in long form, with the category's total."""
    long = items.select(F.explode("categories").alias("category"), F.coalesce("status", F.lit("UNKNOWN")).alias("status"))
    out = long.groupBy("category", "status").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("total", F.sum("n").over(Window.partitionBy("category")))


def normalised_subcategories(stats: DataFrame) -> DataFrame:
    """Subcategory counters of any vintage in one form: missing ones are derived from those at hand."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = stats.withColumns({"total": first_nonzero(F.col("applicable").cast("long"), F.col("total").cast("long")), "score_sum": F.coalesce(F.col("score_sum").cast("double"), F.lit(0.0))})
    reached = F.coalesce(F.nullif(F.col("reached").cast("long"), F.lit(0)), F.greatest(F.lit(0), F.col("total") - n("not_reached_items")))
    out = out.withColumns({"reached": reached, "represented": n("represented"), "scorable": n("scorable"), "checked": n("checked"), "degenerate_null": first_nonzero(F.col("degenerate_null").cast("long"), F.col("degenerate_null_items").cast("long"))})
    return out.select("subcategory", "total", "reached", "represented", "scorable", "checked", "score_sum", ratio("score_sum", "scorable").alias("score"), ratio("represented", "reached").alias("representability"), "degenerate_null")
