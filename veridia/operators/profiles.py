"""Row profiles: what a row's obligations, mutants and evidence say of it, as wide rows.

Items come in long form (key, item columns) and are reduced per row; the wide
row is one join of small aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import PRIMARY_CONSTRUCTS, is_placeholder, ratio_label, row_failure
from ..functions.semantics import bucket_of, count_where, first_nonzero, ratio, total, truthy
from .aggregates import row_boundary_score, scope_summary

#: statuses of mutants that say a line is checked, or not (fixed values)
COVERED, MISSED = ("KILLED",), ("SURVIVED", "NO_COVERAGE")
CONDITION_MUTATOR = r"(?i)NegateConditionalsMutator|ConditionalsBoundaryMutator|conditional"
#: constructs whose adequacy is not reported (fixed values)
HIDDEN = ("side_effect_or_dependency", "interaction_dependency", "external_side_effect")


def _any(array: str, names) -> Column:
    return F.arrays_overlap(F.col(array), F.array(*map(F.lit, names)))


def item_mutants(items: DataFrame, mutants: DataFrame, keys: list[str]) -> DataFrame:
    """Items (keys, item_id, lines) with the statuses, mutators, descriptions and number of the mutants on their lines.

    Mutants are grouped by line first, so a line with many of them is one row of the join.
    """
    sets = {"status": "statuses", "mutator": "mutators", "description": "descriptions"}
    by_line = mutants.groupBy(*keys, "line").agg(*[F.collect_set(c).alias(n) for c, n in sets.items()], F.count(F.lit(1)).alias("n"))
    hit = items.select(*keys, "item_id", F.explode(F.array_distinct("lines")).alias("line")).join(by_line, [*keys, "line"])
    hit = hit.groupBy(*keys, "item_id").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))).alias(n) for n in sets.values()], F.sum("n").alias("mutants"))
    none = F.array().cast("array<string>")
    return items.join(hit, [*keys, "item_id"], "left").withColumns({n: F.coalesce(n, none) for n in sets.values()} | {"mutants": F.coalesce("mutants", F.lit(0))})


def represented_items(items: DataFrame, custom: Column | bool = False) -> DataFrame:
    """Items of item_mutants with how mutants represent them; a ternary counts only with custom evidence."""
    custom = F.lit(custom) if isinstance(custom, bool) else custom
    missing = (F.col("construct") == "ternary") & ~custom
    status = F.when(missing, "custom_extreme_missing").when(_any("statuses", COVERED), "killed").when(_any("statuses", MISSED), "survived_or_no_coverage").when(F.col("mutants") > 0, "other_status").otherwise("unmutated")
    return items.withColumn("representability", status)


def representability_profile(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: obligations in all, reached, unreached, of other status, unmutated, and the share that mutants cover."""
    n = lambda *names: count_where(F.col("representability").isin(*names))
    out = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), n("killed").alias("reached"), n("survived_or_no_coverage").alias("unreached"), n("other_status").alias("other_status"),
        n("unmutated", "custom_extreme_missing").alias("unmutated"), n("killed", "survived_or_no_coverage").alias("mutation_covered"),
    )
    return out.withColumn("mutation_coverage_rate", ratio("mutation_covered", "total"))


def construct_representability(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per row and construct: items, and those on whose lines any mutant lies."""
    seen = ~F.col("representability").isin("unmutated", "custom_extreme_missing")
    return items.groupBy(*keys, F.coalesce("construct", F.lit("unknown")).alias("construct")).agg(F.count(F.lit(1)).alias("pit_total"), count_where(seen).alias("pit_covered"))


def checked_conditions(items: DataFrame) -> DataFrame:
    """The if and else-if items with killed, represented, score and reason.

    Items have reached_true, reached_false, executed and the columns of
    item_mutants. Half a point for one outcome, one for both, none unless a
    condition mutant on the line was killed.
    """
    names = F.concat_ws(" ", "mutators", "descriptions")
    conditional = (names == "") | names.rlike(CONDITION_MUTATOR)
    killed, represented = _any("statuses", COVERED) & conditional, _any("statuses", COVERED + MISSED) & conditional
    outcomes = truthy("reached_true").cast("int") + truthy("reached_false").cast("int")
    score = F.when(truthy("executed") & killed & (outcomes == 2), 1.0).when(truthy("executed") & killed & (outcomes == 1), 0.5).otherwise(0.0)
    reason = F.when(F.col("score") == 1, "both_outcomes_reached_and_condition_mutant_killed").when(F.col("score") == 0.5, "one_outcome_reached_and_condition_mutant_killed").otherwise("not_reached_or_not_killed")
    rows = items.where(F.col("construct").isin("if", "else_if"))
    return rows.withColumns({"killed": killed, "represented": represented, "outcomes": outcomes, "score": score}).withColumn("reason", reason)


def condition_profile(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: the checked conditions' counts, sums and scores; the denominator is all conditions."""
    out = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("condition_total"), total("score").alias("checked_sum"), count_where(F.col("score") > 0).alias("checked_items"), count_where("represented").alias("represented"),
        count_where(F.col("outcomes") == 2).alias("both_reached"), count_where(F.col("outcomes") == 1).alias("one_reached"), count_where("killed").alias("killed"),
    )
    return out.select("*", ratio("checked_items", "condition_total").alias("checked_score"), ratio("checked_sum", "condition_total").alias("avg_item_score"), ratio("represented", "condition_total").alias("representability_rate"))


def evidence_profile(rows: DataFrame, items: str = "items") -> DataFrame:
    """Rows with collected control-flow evidence (status, stored counters, items with score and represented) as one profile.

    A stored counter that is null or 0 is counted from the items; rows whose
    status is not 'passed' have no profile.
    """
    has = lambda c: F.size(F.filter(F.coalesce(items, F.array().cast(rows.schema[items].dataType)), c))
    score = lambda x: x["score"].isNotNull()
    counted = {
        "total": F.size(F.coalesce(items, F.array().cast(rows.schema[items].dataType))), "scorable": has(score), "checked_items": has(lambda x: score(x) & (x["score"] > 0)),
        "fully_checked": has(lambda x: score(x) & (x["score"] == 1)), "represented": has(lambda x: truthy(x["represented"])),
    }
    stored = {"total": "total_conditions", "scorable": "scorable_conditions", "checked_items": "checked_items", "fully_checked": "fully_checked_items", "represented": "represented_items"}
    summed = F.aggregate(F.coalesce(items, F.array().cast(rows.schema[items].dataType)), F.lit(0.0), lambda a, x: a + F.coalesce(x["score"].cast("double"), F.lit(0.0)))
    own = [c for c in rows.columns if c not in (*stored.values(), "score_sum", items)]
    out = rows.where(F.coalesce(F.col("status") == "passed", F.lit(False))).select(
        *own, *[first_nonzero(F.col(c).cast("long"), counted[n].cast("long")).alias(n) for n, c in stored.items()], F.coalesce(F.nullif(F.col("score_sum").cast("double"), F.lit(0.0)), summed).alias("score_sum")
    )
    return out.select(
        "*", (F.col("checked_items") - F.col("fully_checked")).alias("partially_checked"), ratio("checked_items", "scorable").alias("checked_score"), ratio("score_sum", "scorable").alias("avg_item_score"),
        ratio("checked_items", "total").alias("pessimistic_score"), ratio("represented", "total").alias("representability_rate"),
    )


def branch_strength(rows: DataFrame) -> DataFrame:
    """Rows (execution_passed, total, reached, unreached, other_status, unmutated, mutation_covered) with reach score and label; nothing is reached by rows that did not run."""
    ran, n = truthy("execution_passed"), F.coalesce("total", F.lit(0))
    part = lambda c, otherwise=F.lit(0): F.when(n == 0, 0).when(ran, F.coalesce(c, F.lit(0))).otherwise(otherwise).cast("long")
    reached = F.least(part("reached"), n.cast("long"))
    score = F.when(n > 0, ratio(reached, n))
    return rows.select(
        *[c for c in rows.columns if c not in ("total", "reached", "unreached", "other_status", "unmutated", "mutation_covered", "mutation_coverage_rate")], n.cast("long").alias("branch_obligations"), reached.alias("branch_reached"),
        part("unreached").alias("branch_unreached"), part("other_status").alias("branch_other_status"), part("unmutated", n).alias("branch_unmutated"), part("mutation_covered").alias("branch_mutation_covered"),
        F.when(ran & (n > 0), ratio(F.coalesce("mutation_covered", F.lit(0)), n)).alias("branch_mutation_coverage_rate"), score.alias("branch_score"), ratio_label(score).alias("branch_strength"),
    )


SCOPE = ("total_items", "reached_items", "scorable_items", "non_representable_items", "checked_items", "oracle_killed_items", "incidentally_killed_items", "survived_items", "survived_path_changed_items", "coverage_unverified_items", "unmeasurable_items", "represented_items")
RATES = ("score", "pessimistic_score", "representability_rate", "scorable_rate")


def assertion_profile(rows: DataFrame, items: DataFrame, key: str, raw: str = "assertion_mutation_raw_status") -> DataFrame:
    """Rows with status, strength and counts of their return and exception items.

    Rows that did not run, or whose target is private, have a status of their own
    and count nothing; the raw status stays.
    """
    scope = scope_summary(items, [key], PRIMARY_CONSTRUCTS).select(key, *SCOPE, *RATES)
    gate = F.when(~truthy("execution_passed"), "skipped_original_not_executed").when(truthy("target_is_private"), "skipped_private_target_method")
    rows = rows.drop("assertion_mutation_status", *SCOPE, *RATES).withColumn("_gate", gate).join(scope, key, "left")
    counts = {c: F.when(F.col("_gate").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long") for c in SCOPE}
    rates = {c: F.when(F.col("_gate").isNull(), F.col(c)) for c in RATES}
    label = F.when(F.col("_gate").isNull() & F.coalesce(F.col(raw) == "passed", F.lit(False)), ratio_label(F.col("score"))).otherwise("not_applicable")
    own = [c for c in rows.columns if c not in (*SCOPE, *RATES, "_gate")]
    return rows.select(*own, F.coalesce("_gate", raw).alias("assertion_mutation_status"), label.alias("assertion_strength"), *[v.alias(f"assertion_strength_{n}") for n, v in (counts | rates).items()])


def category_profile(rows: DataFrame) -> DataFrame:
    """Rows (execution_passed, total, covered) with the obligations missed: all of them where the test did not run."""
    missed = F.when(truthy("execution_passed"), F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - F.coalesce("covered", F.lit(0)))).otherwise(F.coalesce("total", F.lit(0)))
    return rows.withColumn("missed", missed.cast("long"))


def side_effect_strength(rows: DataFrame) -> DataFrame:
    """Rows with the pooled state and interaction obligations, the checked ones and their ratio."""
    n = lambda c: F.coalesce(c, F.lit(0))
    every, checked = n("state_obligations") + n("interaction_obligations"), n("state_checked") + n("interaction_checked")
    return rows.withColumns({"side_effect_obligations": every, "side_effect_checked": checked, "side_effect_score": ratio(checked, every)}).withColumn("side_effect_strength", ratio_label(F.col("side_effect_score")))


def interaction_profile(items: DataFrame, setups: DataFrame, key: str) -> DataFrame:
    """Items (key, kind, case) with whether the test sets that case up; a void call's setup also shows the normal case."""
    found = setups.select(key, "kind", F.explode(F.when(F.col("case") == "void_or_side_effect", F.array(F.col("case"), F.lit("positive_normal"))).otherwise(F.array("case"))).alias("case")).distinct()
    return items.join(found.withColumn("_hit", F.lit(True)), [key, "kind", "case"], "left").withColumn("achieved", F.coalesce("_hit", F.lit(False))).drop("_hit")


def match_with_fallback(items: DataFrame, fallback: Column) -> DataFrame:
    """Items of item_mutants with covered: a killed mutant covers, only missed ones do not, otherwise the fallback decides."""
    only_missed = (F.col("mutants") > 0) & (F.size(F.array_except("statuses", F.array(*map(F.lit, MISSED)))) == 0)
    return items.withColumn("covered", F.when(_any("statuses", COVERED), True).when(only_missed, False).otherwise(truthy(fallback)))


def item_profile(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per row: items, covered and missed ones."""
    out = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count_where("covered").alias("covered"))
    return out.withColumn("missed", F.col("total") - F.col("covered"))


def null_unrequested(rows: DataFrame, requested: str, columns: list[str]) -> DataFrame:
    """Rows whose scores are null where mutation was not asked for."""
    return rows.withColumns({c: F.when(truthy(requested), F.col(c)) for c in columns})


def row_profile(rows: DataFrame, boundary: DataFrame, branches: DataFrame, conditions: DataFrame, assertions: DataFrame, key: str = "row_id") -> DataFrame:
    """The wide profile of raw rows.

    ``boundary``: (key, parameter, covered) items; ``branches``: items with their
    representability; ``conditions``: checked conditions; ``assertions``: mutation
    items. Stub tests of the generation tool count as failed. Rows without items
    of a kind count 0 and score null.
    """
    stub = is_placeholder(F.col("test_bytes"), F.col("test_preview")) & truthy("execution_passed")
    rows = rows.withColumns({"execution_passed": F.when(stub, False).otherwise(F.col("execution_passed")), "compile_passed": F.when(stub, False).otherwise(F.col("compile_passed")), "placeholder": stub})
    failure = row_failure(F.col("execution_passed"), F.col("placeholder"), F.coalesce("log", F.lit("")), F.coalesce("error_stage", F.lit("")))
    rows = rows.withColumn("failure", failure)
    public = F.when(truthy("target_is_private"), None)
    edge = boundary.groupBy(key).agg(F.count(F.lit(1)).alias("boundary_applicable_count"), count_where("covered").alias("boundary_covered_count")).join(row_boundary_score(boundary.withColumnRenamed(key, "row_id")).withColumnsRenamed({"row_id": key, "score": "boundary_strength_score"}), key)
    out = rows.join(edge, key, "left").join(representability_profile(branches, [key]), key, "left")
    out = branch_strength(out)
    checked = condition_profile(conditions, [key]).select(key, *[F.col(c).alias(f"if_else_if_condition_{c}") for c in ("condition_total", "checked_sum", "checked_items", "checked_score", "avg_item_score", "represented")])
    out = assertion_profile(out.join(checked, key, "left"), assertions, key)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    ran = truthy("execution_passed")
    gone = lambda c: F.when(ran, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0).alias(c)
    score = lambda c: F.when(ran, F.col(c)).when(F.col("if_else_if_condition_condition_total") > 0, 0.0).alias(c)
    kept = [c for c in out.columns if not c.startswith(("boundary_", "if_else_if_condition_")) and c not in ("failure", "complexity_bucket", "test_bytes", "test_preview", "log")]
    return out.select(
        *kept, bucket_of(F.col("complexity_bucket")).alias("complexity_bucket"), F.col("failure.family").alias("failure_family"), F.col("failure.category").alias("failure_category"),
        zero("boundary_applicable_count"), zero("boundary_covered_count"), F.coalesce(public, F.when(~truthy("target_is_private"), F.col("boundary_strength_score"))).alias("boundary_strength_score"),
        zero("if_else_if_condition_condition_total"), gone("if_else_if_condition_checked_sum"), F.when(ran, F.coalesce("if_else_if_condition_checked_items", F.lit(0))).otherwise(0).cast("long").alias("if_else_if_condition_checked_items"),
        score("if_else_if_condition_checked_score"), score("if_else_if_condition_avg_item_score"),
    )


def flatten_profile(rows: DataFrame, column: str, categories) -> DataFrame:
    """Rows without the nested profile, with <category>_total, _missed, _pit_total, _pit_missed and _evidence of each category."""
    fields = [F.col(f"{column}.{c}.{f}").alias(f"{c}_{f}") for c in categories for f in ("total", "missed", "pit_total", "pit_missed")]
    evidence = [F.array_join(F.coalesce(F.col(f"{column}.{c}.evidence"), F.array().cast("array<string>")), ",").alias(f"{c}_evidence") for c in categories]
    return rows.select(*[c for c in rows.columns if c != column], *fields, *evidence)


def _visible(name: str):
    return lambda x: ~F.coalesce(x[name].isin(*HIDDEN), F.lit(False))


def _reported(value: Column, kind: T.DataType) -> Column:
    """A value without hidden constructs, whatever its nesting."""
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if _shown(f.name)]
        return F.when(value.isNotNull(), F.struct(*[_reported(value[f.name], f.dataType).alias(f.name) for f in kept])) if kept else value
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StructType):
            for name in {"construct", "category"} & set(inner.names):
                value = F.filter(value, _visible(name))
        elif isinstance(inner, T.StringType):
            value = F.filter(value, lambda x: ~F.coalesce(x.isin(*HIDDEN), F.lit(False)))
        return F.transform(value, lambda x: _reported(x, inner)) if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)) else value
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        value = F.map_filter(value, lambda k, v: ~(k.isin(*HIDDEN) | k.startswith("side_effect_") | k.startswith("interaction_dependency_")))
        return F.transform_values(value, lambda k, v: _reported(v, kind.valueType)) if isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)) else value
    return value


def _shown(name: str) -> bool:
    return name not in HIDDEN and not name.startswith(("side_effect_", "interaction_dependency_"))


def report_view(rows: DataFrame) -> DataFrame:
    """Rows as reports show them: hidden constructs leave columns, structs, maps and arrays at any depth."""
    return rows.select(*[_reported(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields if _shown(f.name)])


def scoped_items(items: DataFrame, constructs) -> DataFrame:
    """The items of some constructs; all of them where none are named."""
    return items.where(F.coalesce("construct", F.lit("unknown")).isin(*constructs)) if constructs else items


def merge_constructs(old: DataFrame, new: DataFrame, constructs) -> DataFrame:
    """Old items with those of some constructs replaced by newly collected ones."""
    inside = F.coalesce("construct", F.lit("unknown")).isin(*constructs)
    return old.where(~inside).unionByName(new.where(inside), allowMissingColumns=True)


def compact(rows: DataFrame, fields: list[str], constructs=("if", "else_if")) -> DataFrame:
    """The columns that are released: some fields, items cut to their category, maps cut to two constructs."""
    out = []
    for f in (x for x in rows.schema.fields if x.name in fields):
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and "category" in f.dataType.elementType.names:
            c = F.transform(c, lambda x: F.struct(x["category"].alias("category")))
        elif isinstance(f.dataType, T.MapType):
            c = F.map_filter(c, lambda k, v: k.isin(*constructs))
        out.append(c.alias(f.name))
    return rows.select(*out)


def error_rows(tasks: DataFrame, measures: dict[str, str], stage: str = "model_error") -> DataFrame:
    """Rows of tasks whose generation failed: flags false, every measure null."""
    flags = {"compile_passed": F.lit(False), "execution_passed": F.lit(False), "error_stage": F.lit(stage)}
    return tasks.withColumns(flags | {n: F.lit(None).cast(t) for n, t in measures.items()})


def task_metadata(tasks: DataFrame, columns: list[str], key: str = "task_id") -> DataFrame:
    """One row of named metadata per task, sorted by task; columns that are not there are null."""
    own = [F.col(c) if c in tasks.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return tasks.select(key, *own).dropDuplicates([key]).orderBy(key)


def select_items(items: DataFrame, constructs=(), variant: str | None = None, limit: int | None = None, keys: list[str] | None = None, order: list | None = None) -> DataFrame:
    """Items to process: of some constructs, with a variant, and only the first few of each row."""
    out = scoped_items(items, constructs)
    out = out if variant is None else out.where(F.col("variant") == variant)
    if limit is None:
        return out
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return out.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
