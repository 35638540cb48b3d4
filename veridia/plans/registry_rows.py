"""Queries of the row profiles, report tables and remaining joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import semantics as S
from ..operators import joins as J
from ..operators import profiles as P
from ..operators import ranking as R
from ..operators import tables as B
from . import standins as T
from .base import query, six

RAN = "coalesce(execution_passed, false)"


@query("""SELECT category, prompt_template AS prompt, count(*) FILTER (covered) AS covered, count(*) AS applicable FROM ITEMS i JOIN ROWS r ON r.row_id = i.row_id WHERE execution_passed GROUP BY ALL""")
def category_by_prompt(spark, sf):
    rows = T.rows(spark, sf).where(S.truthy("execution_passed")).select("row_id", F.col("prompt_template").alias("prompt"))
    items = T.items(spark, sf).join(rows, "row_id")
    return B.category_by_prompt(items, items.where("covered"))


@query("""
    WITH N AS (SELECT flow AS construct, coalesce(total, 0) AS total, CASE WHEN scorable > 0 THEN scorable ELSE represented END AS s, checked, score_sum,
        CASE WHEN coalesce(total_variants, 0) = 0 THEN total ELSE total_variants END AS tv,
        CASE WHEN coalesce(total_variants, 0) = 0 OR coalesce(represented_variants, 0) = 0 THEN represented ELSE represented_variants END AS rv, pit_total, pit_covered FROM STATS)
    SELECT list_position(['if', 'else_if', 'case', 'default', 'catch', 'exception_path', 'ternary', 'other'], construct)::BIGINT AS place, construct, sum(total)::BIGINT AS applicable, sum(s)::BIGINT AS scorable, sum(checked)::BIGINT AS checked,
        round(sum(score_sum) / nullif(sum(s), 0), 6) AS avg_item_score, round(sum(checked) / sum(total), 6) AS pessimistic_bound, round(sum(pit_covered) / nullif(sum(pit_total), 0), 6) AS pit_representability,
        sum(tv)::BIGINT AS variants, sum(rv)::BIGINT AS represented_variants, round(sum(rv) / nullif(sum(tv), 0), 6) AS variant_representability FROM N GROUP BY construct HAVING sum(total) > 0""")
def control_flow_detail(spark, sf):
    stats = T.stats(spark, sf).drop("construct").withColumnRenamed("flow", "construct")
    return six(B.control_flow_detail(stats, stats))


_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in B.OUTCOMES)


@query(f"""WITH G AS (SELECT construct, {_SUMS} FROM STATS GROUP BY construct)
    SELECT *, total - not_reached_items AS reached, round(scorable / nullif(total - not_reached_items, 0), 6) AS scorable_of_reached FROM G""")
def outcome_breakdown(spark, sf):
    return six(B.outcome_breakdown(T.stats(spark, sf)))


@query(f"""WITH G AS (SELECT construct, {_SUMS}, sum(score_sum) AS score_sum FROM STATS GROUP BY construct),
    N AS (SELECT {', '.join(f'sum({c}) AS n_{c}' for c in B.OVERRIDDEN)}, sum(score_sum) AS n_sum, (SELECT sum(unmeasurable) FROM STATS) AS h FROM STATS WHERE construct = 'exception_behavior' AND unmeasurable = 0),
    X AS (SELECT construct, total, total - not_reached_items AS reached, construct = 'exception_behavior' AND h > 0 AS u, G.*, N.* FROM G, N)
    SELECT construct, total, reached, CAST(CASE WHEN u THEN n_scorable ELSE scorable END AS BIGINT) AS scorable, round(CASE WHEN u THEN n_scorable ELSE scorable END / nullif(reached, 0), 6) AS scorable_of_reached,
        {', '.join(f'CAST(CASE WHEN u THEN n_{c} ELSE {c} END AS BIGINT) AS {c}' for c in B.OVERRIDDEN if c not in ('scorable', 'represented'))},
        round(CASE WHEN u THEN n_sum / nullif(n_scorable, 0) ELSE score_sum / nullif(scorable, 0) END, 6) AS score, round(CASE WHEN u THEN n_represented ELSE represented END / nullif(reached, 0), 6) AS representability,
        CAST(CASE WHEN u THEN h ELSE 0 END AS BIGINT) AS unmeasurable FROM X""")
def oracle_strength_detail(spark, sf):
    stats = T.stats(spark, sf)
    narrow = stats.where("construct = 'exception_behavior' AND unmeasurable = 0")
    return six(B.oracle_strength_detail(stats, narrow, stats.select(F.col("unmeasurable").alias("n"))))


@query("""WITH G AS (SELECT subcategory, sum(coalesce(nullif(applicable, 0), nullif(total, 0), 0)) AS a, sum(reached) AS r, sum(represented) AS p, sum(scorable) AS s, sum(checked) AS c, sum(score_sum) AS z, sum(degenerate_null) AS d FROM STATS GROUP BY subcategory),
    W AS (SELECT * FROM (VALUES (1, 'boolean'), (2, 'numeric'), (3, 'string'), (4, 'collection'), (5, 'enum_or_class')) v(place, subcategory))
    SELECT CAST(place AS BIGINT) AS place, W.subcategory, CAST(coalesce(a, 0) AS BIGINT) AS applicable, CAST(coalesce(r, 0) AS BIGINT) AS reached, CAST(coalesce(p, 0) AS BIGINT) AS represented, CAST(coalesce(s, 0) AS BIGINT) AS scorable,
        CAST(coalesce(c, 0) AS BIGINT) AS checked, CASE WHEN coalesce(s, 0) < 10 THEN 'suppressed' ELSE printf('%.3f', round(z / s, 6)) END AS score, CASE WHEN coalesce(s, 0) < 10 THEN 'suppressed' ELSE printf('%.3f', round(p / r, 6)) END AS representability,
        CAST(coalesce(d, 0) AS BIGINT) AS degenerate_null FROM W LEFT JOIN G ON G.subcategory = W.subcategory""")
def return_subcategory_table(spark, sf):
    return B.subcategory_table(T.stats(spark, sf))


METRICS = {"cover": ("row_score", "checked_items", "total_items"), "flow": ("mutation_score", "reached_items", "total_items"), "assert": ("row_score", "checked_items", "scorable_items")}


@query("""WITH X AS (SELECT *, unnest([1, 2, 3]) AS k FROM ROWS WHERE execution_passed),
    L AS (SELECT CASE k WHEN 1 THEN 'cover' WHEN 2 THEN 'flow' ELSE 'assert' END AS metric, CASE k WHEN 2 THEN mutation_score ELSE row_score END AS s, CASE k WHEN 2 THEN reached_items ELSE checked_items END AS a, CASE k WHEN 3 THEN scorable_items ELSE total_items END AS b, mutation_score AS m FROM X)
    SELECT metric, count(*) AS applicable_rows, CAST(coalesce(sum(a), 0) AS DOUBLE) AS numerator, CAST(coalesce(sum(b), 0) AS BIGINT) AS denominator, round(avg(s), 6) AS avg_row_score, round(avg(m), 6) AS avg_mutation, round(sum(a) / nullif(sum(b), 0), 6) AS micro_score
    FROM L WHERE s IS NOT NULL GROUP BY metric""")
def adequacies(spark, sf):
    return six(B.adequacies(T.rows(spark, sf), METRICS))


@query("""WITH E AS (SELECT prompt_template AS configuration, total_items, checked_items FROM ROWS WHERE execution_passed UNION ALL SELECT 'all', total_items, checked_items FROM ROWS WHERE execution_passed)
    SELECT configuration, CAST(sum(total_items) AS BIGINT) AS arguments, CAST(sum(checked_items) AS BIGINT) AS unresolved, round(sum(checked_items) / nullif(sum(total_items), 0), 6) AS rate FROM E GROUP BY configuration""")
def unresolved_rates(spark, sf):
    return six(B.unresolved_rates(T.rows(spark, sf).withColumns({"arguments": F.col("total_items"), "unresolved": F.col("checked_items")})))


LEVELS_SQL = """WITH L AS (SELECT i.construct AS signal, r.prompt_template AS prompt, i.oracle_level % 3 AS s, r.mutation_score AS m FROM ITEMS i JOIN ROWS r ON r.row_id = i.row_id WHERE execution_passed)
    SELECT {keys} count(*) AS items, count(*) FILTER (s = 0) AS o0, count(*) FILTER (s = 1) AS o1, count(*) FILTER (s = 2) AS o2, round(avg(s), 6) AS avg_score, round(avg(m), 6) AS avg_mutation,
        round(100.0 * count(*) FILTER (s = 0) / count(*), 1) AS o0_percent, round(100.0 * count(*) FILTER (s = 1) / count(*), 1) AS o1_percent, round(100.0 * count(*) FILTER (s = 2) / count(*), 1) AS o2_percent FROM L GROUP BY ALL"""


def _levels(spark, sf, keys):
    rows = T.rows(spark, sf).where(S.truthy("execution_passed")).select("row_id", F.col("prompt_template").alias("prompt"), "mutation_score")
    items = T.items(spark, sf).select("row_id", F.col("construct").alias("signal"), (F.col("oracle_level") % 3).alias("score")).join(rows, "row_id")
    return six(B.oracle_levels(items, keys))


@query(LEVELS_SQL.format(keys=""))
def oracle_levels(spark, sf):
    return _levels(spark, sf, [])


@query(LEVELS_SQL.format(keys="prompt,"))
def oracle_levels_by_prompt(spark, sf):
    return _levels(spark, sf, ["prompt"])


@query(LEVELS_SQL.format(keys="signal,"))
def oracle_levels_by_signal(spark, sf):
    return _levels(spark, sf, ["signal"])


@query(LEVELS_SQL.format(keys="prompt, signal,"))
def oracle_levels_by_prompt_and_signal(spark, sf):
    return _levels(spark, sf, ["prompt", "signal"])


@query("""WITH E AS (SELECT coalesce(complexity_bucket, 'None') AS g, total_items / 4.0 AS s FROM ROWS WHERE execution_passed)
    SELECT g AS "group", count(*) AS rows, round(avg(s), 6) AS avg_score, count(*) FILTER (s = 0) AS zero, count(*) FILTER (s > 0 AND s < 1) AS below_one, count(*) FILTER (s >= 1 AND s < 2) AS below_two, count(*) FILTER (s = 2) AS two FROM E GROUP BY g""")
def score_bins_by_bucket(spark, sf):
    return six(B.score_bins(T.rows(spark, sf).withColumn("level", F.col("total_items") / 4.0), "complexity_bucket", "level"))


@query("""WITH E AS (SELECT prompt_template AS g, CASE total_items % 4 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'weak' WHEN 2 THEN 'medium' ELSE 'strong' END AS l FROM ROWS WHERE execution_passed)
    SELECT g AS "group", count(*) AS rows, count(*) FILTER (l = 'weak') AS weak, count(*) FILTER (l = 'medium') AS medium, count(*) FILTER (l = 'strong') AS strong, round(100.0 * count(*) FILTER (l = 'weak') / count(*), 1) AS weak_percent,
        round(100.0 * count(*) FILTER (l = 'medium') / count(*), 1) AS medium_percent, round(100.0 * count(*) FILTER (l = 'strong') / count(*), 1) AS strong_percent FROM E WHERE l <> 'not_applicable' GROUP BY g""")
def label_mix(spark, sf):
    label = F.get(F.array(*map(F.lit, ("not_applicable", "weak", "medium", "strong"))), (F.col("total_items") % 4).cast("int"))
    return B.label_mix(T.rows(spark, sf).withColumn("label", label), "label", ("weak", "medium", "strong"))


@query("""WITH G AS (SELECT coalesce(model_id, 'unknown-model') AS model, prompt_template AS pipeline, failure_family AS outcome, coalesce(failure_category, 'unknown') AS detail, count(*) AS n FROM ROWS GROUP BY ALL)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY model, pipeline, outcome ORDER BY n DESC, detail) AS INT) AS place FROM G) WHERE place <= 2""")
def failure_details(spark, sf):
    rows = T.rows(spark, sf).select(C.short_model(F.col("model_id")).alias("model"), F.col("prompt_template").alias("pipeline"), F.col("failure_family").alias("outcome"), F.coalesce("failure_category", F.lit("unknown")).alias("detail"))
    return B.failure_details(rows, 2)


@query(f"""SELECT prompt_template AS prompt, count(*) FILTER (total_items > 0) AS applicable_rows, CAST(sum(total_items) AS BIGINT) AS exception_obligations, CAST(coalesce(sum(reached_items) FILTER (total_items > 0), 0) AS BIGINT) AS exception_covered,
    CAST(sum(checked_items) AS BIGINT) AS exception_asserted, CAST(sum(scorable_items) AS BIGINT) AS weak_handlers, CAST(sum(represented_items) AS BIGINT) AS strong_exceptions, CAST(sum(checked_items) AS BIGINT) AS weak_exceptions FROM ROWS WHERE {RAN} GROUP BY ALL""")
def exception_paths_by_prompt(spark, sf):
    names = {"exception_obligations": "total_items", "exception_covered": "reached_items", "exception_asserted": "checked_items", "weak_handlers": "scorable_items", "strong_exceptions": "represented_items", "weak_exceptions": "checked_items"}
    return B.exception_detail(T.rows(spark, sf).withColumns({n: F.col(c) for n, c in names.items()}))


@query("""SELECT construct, category, count(*) AS applicable, count(*) FILTER (covered) AS checked, count(*) FILTER (prompt_template = '1-URGENT' AND covered) AS "1-URGENT_hit", count(*) FILTER (prompt_template = '1-URGENT') AS "1-URGENT_all",
    count(*) FILTER (prompt_template = '2-HIGH' AND covered) AS "2-HIGH_hit", count(*) FILTER (prompt_template = '2-HIGH') AS "2-HIGH_all", round(count(*) FILTER (covered) / count(*), 6) AS score FROM ITEMS i JOIN ROWS r ON r.row_id = i.row_id GROUP BY construct, category""")
def kind_case_cross_tab(spark, sf):
    items = T.items(spark, sf).join(T.rows(spark, sf).select("row_id", F.col("prompt_template").alias("prompt")), "row_id")
    return six(B.cross_tab(items, ["construct", "category"], ["1-URGENT", "2-HIGH"], "covered"))


@query("""WITH E AS (SELECT row_score AS s, checked_items / 2.0 AS z, scorable_items AS n, scorable_items + represented_items AS d, total_items AS a, represented_items AS r FROM ROWS)
    SELECT count(*) AS n_rows, count(s) AS scored_rows, round(avg(s), 6) AS macro, round(sum(z) / sum(n), 6) AS pooled, round(sum(z) / sum(d), 6) AS pessimistic_pooled, round(avg(z / nullif(d, 0)), 6) AS pessimistic_macro, round(sum(r) / sum(a), 6) AS generation_rate FROM E""")
def pooled_summary(spark, sf):
    rows = T.rows(spark, sf).select(F.col("row_score").alias("score"), (F.col("checked_items") / 2.0).alias("score_sum"), F.col("scorable_items").alias("scorable"), (F.col("scorable_items") + F.col("represented_items")).alias("pessimistic_denominator"), F.col("total_items").alias("attempted"), F.col("represented_items").alias("represented"))
    return six(B.pooled_summary(rows))


@query("""SELECT coalesce(operator_rule, 'unknown') AS operator_rule, count(*) AS total, count(*) FILTER (mutation_status = 'passed') AS passed, count(*) FILTER (mutation_status = 'failed') AS failed FROM RUNS GROUP BY ALL""")
def operator_matrix(spark, sf):
    return B.operator_matrix(T.runs(spark, sf).withColumn("outcome", F.col("mutation_status")), ["passed", "failed"])


@query("""WITH G AS (SELECT DISTINCT coalesce(model_id, 'None') AS model, prompt_template AS pipeline FROM ROWS)
    SELECT model, pipeline, CAST(row_number() OVER (ORDER BY model, coalesce(nullif(list_position(['3-MEDIUM', '1-URGENT'], pipeline), 0), 3), pipeline) AS INT) AS place FROM G""")
def ordered_groups(spark, sf):
    return B.ordered_groups(T.rows(spark, sf).select(S.group_key("model_id").alias("model"), F.col("prompt_template").alias("pipeline")), ("3-MEDIUM", "1-URGENT"))


@query("""WITH X AS (SELECT unnest(CASE WHEN construct = 'if' THEN ['branch_condition', 'weak_oracle'] WHEN construct = 'ternary' THEN ['branch_condition'] ELSE [] END) AS category, status FROM MUTANTS),
    G AS (SELECT category, status, count(*) AS n FROM X GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY category) AS BIGINT) AS total FROM G""")
def mutant_categories(spark, sf):
    both, one = F.array(F.lit("branch_condition"), F.lit("weak_oracle")), F.array(F.lit("branch_condition"))
    return B.mutant_categories(T.mutants(spark, sf).withColumn("categories", F.when(F.col("construct") == "if", both).when(F.col("construct") == "ternary", one)))


@query("""WITH N AS (SELECT row_id, subcategory, coalesce(nullif(applicable, 0), nullif(total, 0), 0) AS t, * EXCLUDE (row_id, subcategory, total, applicable) FROM STATS),
    R AS (SELECT *, coalesce(nullif(reached, 0), greatest(0, t - not_reached_items)) AS r FROM N)
    SELECT subcategory, CAST(t AS BIGINT) AS total, CAST(r AS BIGINT) AS reached, CAST(represented AS BIGINT) AS represented, CAST(scorable AS BIGINT) AS scorable, CAST(checked AS BIGINT) AS checked, score_sum, round(score_sum / nullif(scorable, 0), 6) AS score,
        round(represented / nullif(r, 0), 6) AS representability, CAST(coalesce(nullif(degenerate_null, 0), nullif(degenerate_null_items, 0), 0) AS BIGINT) AS degenerate_null FROM R""")
def normalised_subcategories(spark, sf):
    return six(B.normalised_subcategories(T.stats(spark, sf)))


# --- row profiles


def _branches(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", F.when(F.col("subcategory") == "string", "ternary").when(F.col("subcategory") == "boolean", "if").otherwise("else_if").alias("construct"), F.array("line", F.col("line") + 2).alias("lines"))
    mutants = T.mutants(spark, sf).select("row_id", "line", "status", F.concat("construct", F.lit("Mutator")).alias("mutator"), F.when(F.col("construct") == "if", "negated conditional").alias("description"))
    return P.represented_items(P.item_mutants(items, mutants, ["row_id"]))


BRANCHES = """I AS (SELECT row_id, item_id, CASE subcategory WHEN 'string' THEN 'ternary' WHEN 'boolean' THEN 'if' ELSE 'else_if' END AS construct, line FROM ITEMS),
    H AS (SELECT i.row_id, i.item_id, bool_or(status = 'KILLED') AS k, bool_or(status IN ('SURVIVED', 'NO_COVERAGE')) AS s, count(*) AS n, bool_or(m.construct = 'if') AS c, bool_and(status IN ('SURVIVED', 'NO_COVERAGE')) AS only_missed FROM I i JOIN MUTANTS m ON m.row_id = i.row_id AND (m.line = i.line OR m.line = i.line + 2) GROUP BY ALL),
    R AS (SELECT I.*, k, s, n, c, only_missed, CASE WHEN construct = 'ternary' THEN 'custom_extreme_missing' WHEN k THEN 'killed' WHEN s THEN 'survived_or_no_coverage' WHEN n > 0 THEN 'other_status' ELSE 'unmutated' END AS rep FROM I LEFT JOIN H ON H.row_id = I.row_id AND H.item_id = I.item_id)"""


@query(f"""WITH {BRANCHES} SELECT row_id, count(*) AS total, count(*) FILTER (rep = 'killed') AS reached, count(*) FILTER (rep = 'survived_or_no_coverage') AS unreached, count(*) FILTER (rep = 'other_status') AS other_status,
    count(*) FILTER (rep IN ('unmutated', 'custom_extreme_missing')) AS unmutated, count(*) FILTER (rep IN ('killed', 'survived_or_no_coverage')) AS mutation_covered, round(count(*) FILTER (rep IN ('killed', 'survived_or_no_coverage')) / count(*), 6) AS mutation_coverage_rate FROM R GROUP BY row_id""")
def representability_profile(spark, sf):
    return six(P.representability_profile(_branches(spark, sf), ["row_id"]))


@query(f"""WITH {BRANCHES} SELECT row_id, construct, count(*) AS pit_total, count(*) FILTER (rep NOT IN ('unmutated', 'custom_extreme_missing')) AS pit_covered FROM R GROUP BY ALL""")
def construct_representability(spark, sf):
    return P.construct_representability(_branches(spark, sf), ["row_id"])


def _conditions(spark, sf):
    rows = T.items(spark, sf).select("row_id", "item_id", F.col("covered").alias("reached_true"), "sensitivity_only").join(T.rows(spark, sf).select("row_id", F.col("execution_passed").alias("executed")), "row_id")
    return P.checked_conditions(_branches(spark, sf).join(rows.withColumnRenamed("sensitivity_only", "reached_false"), ["row_id", "item_id"]))


CONDITIONS = f"""{BRANCHES}, O AS (SELECT R.row_id, R.item_id, R.construct, coalesce(k, false) AND coalesce(c, false) AS killed, coalesce(k OR s, false) AND coalesce(c, false) AS rp, CAST(i.covered AS INT) + CAST(i.sensitivity_only AS INT) AS o, coalesce(execution_passed, false) AS x
        FROM R JOIN ITEMS i ON i.row_id = R.row_id AND i.item_id = R.item_id JOIN ROWS q ON q.row_id = R.row_id WHERE R.construct <> 'ternary'),
    Z AS (SELECT *, CASE WHEN x AND killed AND o = 2 THEN 1.0 WHEN x AND killed AND o = 1 THEN 0.5 ELSE 0.0 END AS score FROM O)"""


@query(f"""WITH {CONDITIONS} SELECT row_id, item_id, killed, rp AS represented, CAST(score AS DOUBLE) AS score,
    CASE score WHEN 1.0 THEN 'both_outcomes_reached_and_condition_mutant_killed' WHEN 0.5 THEN 'one_outcome_reached_and_condition_mutant_killed' ELSE 'not_reached_or_not_killed' END AS reason FROM Z""")
def checked_conditions(spark, sf):
    return _conditions(spark, sf).select("row_id", "item_id", "killed", "represented", "score", "reason")


@query(f"""WITH {CONDITIONS} SELECT row_id, count(*) AS condition_total, CAST(sum(score) AS DOUBLE) AS checked_sum, count(*) FILTER (score > 0) AS checked_items, count(*) FILTER (rp) AS represented, count(*) FILTER (o = 2) AS both_reached, count(*) FILTER (o = 1) AS one_reached,
    count(*) FILTER (killed) AS killed, round(count(*) FILTER (score > 0) / count(*), 6) AS checked_score, round(sum(score) / count(*), 6) AS avg_item_score, round(count(*) FILTER (rp) / count(*), 6) AS representability_rate FROM Z GROUP BY row_id""")
def condition_profile(spark, sf):
    return six(P.condition_profile(_conditions(spark, sf), ["row_id"]))


@query("""WITH I AS (SELECT row_id, list({'score': score, 'represented': represented}) AS items FROM ITEMS GROUP BY row_id),
    E AS (SELECT r.row_id, extreme_status, total_items % 3 AS tc, scorable_items AS sc, checked_items AS ci, checked_items % 2 AS fc, represented_items AS ri, CAST(checked_items % 2 AS DOUBLE) AS ss, coalesce(items, []) AS items FROM ROWS r LEFT JOIN I ON I.row_id = r.row_id WHERE extreme_status = 'passed'),
    N AS (SELECT row_id, coalesce(nullif(tc, 0), len(items)) AS total, coalesce(nullif(sc, 0), len(list_filter(items, lambda x: x.score IS NOT NULL))) AS scorable, coalesce(nullif(ci, 0), len(list_filter(items, lambda x: x.score > 0))) AS checked_items,
        coalesce(nullif(fc, 0), len(list_filter(items, lambda x: x.score = 1))) AS fully_checked, coalesce(nullif(ri, 0), len(list_filter(items, lambda x: x.represented))) AS represented, coalesce(nullif(ss, 0), list_sum(list_transform(items, lambda x: coalesce(x.score, 0))), 0) AS score_sum FROM E)
    SELECT row_id, 'passed' AS status, CAST(total AS BIGINT) AS total, CAST(scorable AS BIGINT) AS scorable, CAST(checked_items AS BIGINT) AS checked_items, CAST(fully_checked AS BIGINT) AS fully_checked, CAST(represented AS BIGINT) AS represented, CAST(score_sum AS DOUBLE) AS score_sum,
        CAST(checked_items - fully_checked AS BIGINT) AS partially_checked, round(checked_items / nullif(scorable, 0), 6) AS checked_score, round(score_sum / nullif(scorable, 0), 6) AS avg_item_score, round(checked_items / nullif(total, 0), 6) AS pessimistic_score, round(represented / nullif(total, 0), 6) AS representability_rate FROM N""")
def evidence_profile(spark, sf):
    items = T.items(spark, sf).groupBy("row_id").agg(F.collect_list(F.struct("score", "represented")).alias("items"))
    stored = {"total_conditions": F.col("total_items") % 3, "scorable_conditions": F.col("scorable_items"), "checked_items": F.col("checked_items"), "fully_checked_items": F.col("checked_items") % 2, "represented_items": F.col("represented_items"), "score_sum": (F.col("checked_items") % 2).cast("double")}
    rows = T.rows(spark, sf).select("row_id", F.col("extreme_status").alias("status"), *[c.alias(n) for n, c in stored.items()])
    return six(P.evidence_profile(rows.join(items, "row_id", "left")))


@query("""WITH S AS (SELECT row_id, count(*) AS t, count(*) FILTER (NOT subsumed AND score IS NOT NULL) AS s, count(*) FILTER (NOT subsumed AND score > 0) AS c, count(*) FILTER (NOT subsumed AND coalesce(status, '') <> 'not_reached') AS r, sum(score) FILTER (NOT subsumed) AS z
        FROM ITEMS WHERE construct IN ('return_behavior', 'exception_behavior') GROUP BY row_id),
    G AS (SELECT r.row_id, assertion_mutation_raw_status AS raw, CASE WHEN NOT coalesce(execution_passed, false) THEN 'skipped_original_not_executed' WHEN coalesce(target_is_private, false) THEN 'skipped_private_target_method' END AS g, S.* EXCLUDE row_id FROM ROWS r LEFT JOIN S ON S.row_id = r.row_id)
    SELECT row_id, raw, coalesce(g, raw) AS assertion_mutation_status, CASE WHEN g IS NULL AND raw = 'passed' AND s > 0 THEN 'applicable' ELSE 'not_applicable' END AS assertion_strength, CAST(CASE WHEN g IS NULL THEN coalesce(t, 0) ELSE 0 END AS BIGINT) AS total,
        CAST(CASE WHEN g IS NULL THEN coalesce(r, 0) ELSE 0 END AS BIGINT) AS reached, CAST(CASE WHEN g IS NULL THEN coalesce(c, 0) ELSE 0 END AS BIGINT) AS checked, CASE WHEN g IS NULL THEN round(z / nullif(s, 0), 6) END AS score FROM G""")
def assertion_profile(spark, sf):
    out = P.assertion_profile(T.rows(spark, sf), T.items(spark, sf), "row_id")
    a = lambda n: F.col(f"assertion_strength_{n}")
    return six(out.select("row_id", F.col("assertion_mutation_raw_status").alias("raw"), "assertion_mutation_status", "assertion_strength", a("total_items").alias("total"), a("reached_items").alias("reached"), a("checked_items").alias("checked"), a("score").alias("score")))


@query(f"""WITH E AS (SELECT row_id, {RAN} AS x, total_items AS n, coalesce(reached_items, 0) AS r, checked_items AS u, scorable_items AS o, represented_items AS m FROM ROWS)
    SELECT row_id, CAST(n AS BIGINT) AS branch_obligations, CAST(CASE WHEN n > 0 AND x THEN least(n, r) ELSE 0 END AS BIGINT) AS branch_reached, CAST(CASE WHEN n > 0 AND x THEN u ELSE 0 END AS BIGINT) AS branch_unreached, CAST(CASE WHEN n > 0 AND x THEN o ELSE 0 END AS BIGINT) AS branch_other_status,
        CAST(CASE WHEN n = 0 THEN 0 WHEN x THEN m ELSE n END AS BIGINT) AS branch_unmutated, CAST(CASE WHEN n > 0 AND x THEN m ELSE 0 END AS BIGINT) AS branch_mutation_covered, CASE WHEN n > 0 AND x THEN round(m / n, 6) END AS branch_mutation_coverage_rate,
        CASE WHEN n > 0 THEN round(CASE WHEN x THEN least(n, r) ELSE 0 END / n, 6) END AS branch_score, CASE WHEN n > 0 THEN 'applicable' ELSE 'not_applicable' END AS branch_strength FROM E""")
def branch_strength(spark, sf):
    names = {"total": "total_items", "reached": "reached_items", "unreached": "checked_items", "other_status": "scorable_items", "unmutated": "represented_items", "mutation_covered": "represented_items"}
    rows = T.rows(spark, sf).select("row_id", "execution_passed", *[F.col(c).alias(n) for n, c in names.items()])
    return six(P.branch_strength(rows).drop("execution_passed"))


@query(f"""SELECT row_id, total_items AS total, checked_items AS covered, CAST(CASE WHEN {RAN} THEN total_items - checked_items ELSE total_items END AS BIGINT) AS missed FROM ROWS""")
def category_profile(spark, sf):
    rows = T.rows(spark, sf).select("row_id", "execution_passed", F.col("total_items").alias("total"), F.col("checked_items").alias("covered"))
    return P.category_profile(rows).drop("execution_passed")


@query("""SELECT row_id, total_items + coalesce(reached_items, 0) AS side_effect_obligations, checked_items + scorable_items AS side_effect_checked, round((checked_items + scorable_items) / nullif(total_items + coalesce(reached_items, 0), 0), 6) AS side_effect_score,
    CASE WHEN total_items + coalesce(reached_items, 0) = 0 THEN 'not_applicable' ELSE 'applicable' END AS side_effect_strength FROM ROWS""")
def side_effect_strength(spark, sf):
    names = {"state_obligations": "total_items", "state_checked": "checked_items", "interaction_obligations": "reached_items", "interaction_checked": "scorable_items"}
    rows = T.rows(spark, sf).select("row_id", *[F.col(c).alias(n) for n, c in names.items()])
    return six(P.side_effect_strength(rows).drop(*names))


@query("""WITH U AS (SELECT DISTINCT row_id, construct, category FROM (SELECT row_id, construct, category FROM ITEMS WHERE covered UNION ALL SELECT row_id, construct, 'positive_normal' FROM ITEMS WHERE covered AND category = 'void_or_side_effect'))
    SELECT i.row_id, i.item_id, EXISTS (SELECT 1 FROM U WHERE U.row_id = i.row_id AND U.construct = i.construct AND U.category = i.category) AS achieved FROM ITEMS i""")
def interaction_profile(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", F.col("construct").alias("kind"), F.col("category").alias("case"), "covered")
    return P.interaction_profile(items, items.where("covered"), "row_id").select("row_id", "item_id", "achieved")


@query(f"""WITH {BRANCHES} SELECT R.row_id, R.item_id, CASE WHEN k THEN true WHEN only_missed THEN false ELSE i.covered END AS covered
    FROM R JOIN ITEMS i ON i.row_id = R.row_id AND i.item_id = R.item_id""")
def match_with_fallback(spark, sf):
    items = _branches(spark, sf).join(T.items(spark, sf).select("row_id", "item_id", F.col("covered").alias("fallback")), ["row_id", "item_id"])
    return P.match_with_fallback(items, F.col("fallback")).select("row_id", "item_id", "covered")


@query(f"SELECT row_id, CASE WHEN {RAN} THEN mutation_score END AS mutation_score, CASE WHEN {RAN} THEN row_score END AS row_score, total_items FROM ROWS")
def null_unrequested(spark, sf):
    return P.null_unrequested(T.rows(spark, sf), "execution_passed", ["mutation_score", "row_score"]).select("row_id", "mutation_score", "row_score", "total_items")


@query("""SELECT row_id, total_items AS a_total, checked_items AS a_missed, reached_items AS a_pit_total, scorable_items AS a_pit_missed, CASE WHEN checked_items > 0 THEN 'x,y' ELSE '' END AS a_evidence FROM ROWS""")
def flatten_profile(spark, sf):
    one = F.struct(F.col("total_items").alias("total"), F.col("checked_items").alias("missed"), F.col("reached_items").alias("pit_total"), F.col("scorable_items").alias("pit_missed"), F.when(F.col("checked_items") > 0, F.array(F.lit("x"), F.lit("y"))).alias("evidence"))
    return P.flatten_profile(T.rows(spark, sf).select("row_id", F.struct(one.alias("a")).alias("profile")), "profile", ["a"])


@query("""WITH G AS (SELECT row_id, list(construct) AS c FROM ITEMS GROUP BY row_id) SELECT row_id, len(list_filter(c, lambda x: x <> 'side_effect_or_dependency')) AS n, list_sort(list_distinct(list_filter(c, lambda x: x <> 'side_effect_or_dependency'))) AS k FROM G""")
def report_view(spark, sf):
    rows = T.items(spark, sf).groupBy("row_id").agg(F.collect_list(F.struct("construct", F.lit(1).alias("side_effect_n"))).alias("items"), F.map_from_entries(F.array_distinct(F.collect_list(F.struct("construct", F.lit(1).alias("v"))))).alias("by_construct"), F.count(F.lit(1)).alias("side_effect_score"))
    seen = P.report_view(rows)
    return seen.select("row_id", F.size("items").cast("long").alias("n"), F.array_sort(F.map_keys("by_construct")).alias("k"))


@query("""SELECT row_id, item_id, construct, 'new' AS source FROM ITEMS WHERE construct = 'return_behavior' UNION ALL SELECT row_id, item_id, construct, 'old' FROM ITEMS WHERE construct <> 'return_behavior'""")
def merged_constructs(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", "construct")
    return P.merge_constructs(items.withColumn("source", F.lit("old")), items.withColumn("source", F.lit("new")), ["return_behavior"])


@query("SELECT row_id, item_id FROM ITEMS WHERE construct IN ('return_behavior', 'exception_behavior')")
def scoped_items(spark, sf):
    return P.scoped_items(T.items(spark, sf), C.PRIMARY_CONSTRUCTS).select("row_id", "item_id")


@query("""SELECT row_id, item_id, construct FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY item_id, line, parameter) AS k FROM ITEMS WHERE construct = 'return_behavior' AND category = 'at_inferred_bound') WHERE k <= 1""")
def selected_items(spark, sf):
    items = T.items(spark, sf).withColumn("variant", F.col("category"))
    return P.select_items(items, ["return_behavior"], "at_inferred_bound", 1, ["row_id"], ["item_id", "line", "parameter"]).select("row_id", "item_id", "construct")


@query("SELECT p_partkey AS task_id, p_brand AS brand, CAST(NULL AS STRING) AS license FROM part")
def task_metadata(spark, sf):
    tasks = T.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_brand").alias("brand"))
    return P.task_metadata(tasks, ["brand", "license"])


@query("SELECT p_partkey AS task_id, false AS compile_passed, false AS execution_passed, 'model_error' AS error_stage, CAST(NULL AS DOUBLE) AS score FROM part")
def model_error_rows(spark, sf):
    return P.error_rows(T.table(spark, sf, "part").select(F.col("p_partkey").alias("task_id")), {"score": "double"})


# --- joins, orders and sets


@query("SELECT i.row_id, i.item_id, p.status AS prior_status FROM ITEMS i JOIN (SELECT row_id, line, min(item_id) AS m, min(status) FILTER (item_id = 1) AS status FROM ITEMS WHERE item_id = 1 GROUP BY ALL) p ON p.row_id = i.row_id AND p.line IS NOT DISTINCT FROM i.line")
def prior_selected_items(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", "line", "status")
    return J.prior_selected(items, items.where("item_id = 1"), ["row_id", "line"], ["status"]).select("row_id", "item_id", "prior_status")


@query("SELECT row_id, item_id, NOT EXISTS (SELECT 1 FROM ROWS r WHERE r.row_id = i.row_id AND assertion_mutation_status = 'passed') AS process FROM ITEMS i")
def resume_with_version(spark, sf):
    done = T.rows(spark, sf).select("row_id", F.col("assertion_mutation_status").alias("collector_version"))
    return J.resume_with(T.items(spark, sf).select("row_id", "item_id"), done, ["row_id"], "passed")


@query("""WITH F AS (SELECT DISTINCT coalesce(model_id, 'None') AS model, prompt_template AS strategy FROM ROWS), E AS (SELECT * FROM (VALUES ('BUILDING', '1-URGENT'), ('BUILDING', '7-NEVER'), ('NOBODY', '1-URGENT')) v(model, strategy))
    SELECT *, 'missing' AS problem FROM (SELECT * FROM E EXCEPT SELECT * FROM F) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM F EXCEPT SELECT * FROM E)""")
def missing_configurations(spark, sf):
    expected = spark.createDataFrame([("BUILDING", "1-URGENT"), ("BUILDING", "7-NEVER"), ("NOBODY", "1-URGENT")], "model string, strategy string")
    return J.missing_configurations(T.rows(spark, sf).select(S.group_key("model_id").alias("model"), F.col("prompt_template").alias("strategy")), expected, ["model", "strategy"])


@query("""WITH R AS (SELECT c_custkey AS k, min(c_nationkey % 24) AS f, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 97 = 0 WHERE c_custkey > 3 GROUP BY c_custkey),
    T AS (SELECT c_custkey AS k, c_nationkey AS f FROM customer WHERE c_custkey < 140)
    SELECT coalesce(R.k, T.k) AS k, CASE WHEN T.k IS NULL THEN 'unknown' WHEN R.k IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'different' END AS problem FROM T FULL JOIN R ON R.k = T.k
    WHERE T.k IS NULL OR R.k IS NULL OR n > 1 OR R.f IS DISTINCT FROM T.f""")
def provenance_mismatches(spark, sf):
    customer, orders = T.table(spark, sf, "customer"), T.table(spark, sf, "orders").where("o_orderkey % 97 = 0").select(F.col("o_custkey").alias("c_custkey"))
    rows = customer.where("c_custkey > 3").join(orders, "c_custkey", "left").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 24).alias("f"))
    return J.provenance_mismatches(rows, customer.where("c_custkey < 140").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("f")), "k", ["f"])


@query("""WITH G AS (SELECT s_suppkey + 5 AS k, s_nationkey AS f FROM supplier UNION ALL SELECT s_suppkey + 5, s_nationkey FROM supplier WHERE s_nationkey = 3), R AS (SELECT k, min(f) AS f, count(*) AS n FROM G GROUP BY k)
    SELECT R.k, CASE WHEN s_suppkey IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' ELSE 'mismatch' END AS problem FROM R LEFT JOIN supplier ON s_suppkey = R.k WHERE s_suppkey IS NULL OR n > 1 OR s_nationkey IS DISTINCT FROM R.f""")
def exclusion_problems(spark, sf):
    s = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("f"))
    register = s.select((F.col("k") + 5).alias("k"), "f")
    return J.exclusion_problems(register.unionAll(register.where("f = 3")), s, "k", "f")


@query("SELECT row_id FROM ROWS WHERE model_id IS NULL OR model_id NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey = 1)")
def rows_not_excluded(spark, sf):
    gone = T.table(spark, sf, "customer").where("c_custkey = 1").select(F.col("c_mktsegment").alias("model_id"))
    return J.not_excluded(T.rows(spark, sf).select("row_id", "model_id"), gone, "model_id").select("row_id")


def _at(spark, sf):
    """Items with a place in their row that is unique but for equal items."""
    return T.items(spark, sf).select("row_id", "item_id", "covered", "category", F.struct("item_id", "parameter", "line", "covered", "category").alias("at"))


@query("""SELECT row_id, item_id, array_to_string(list_sort(list_distinct(list(category) OVER (PARTITION BY row_id ORDER BY item_id, parameter, line, covered, category ROWS UNBOUNDED PRECEDING))), ',') AS so_far FROM ITEMS""")
def cases_so_far(spark, sf):
    return R.values_so_far(_at(spark, sf), ["row_id"], "at", "category", "c").select("row_id", "item_id", F.array_join("c", ",").alias("so_far"))


@query("SELECT row_id, item_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY line, item_id) AS INT) AS item_index FROM ITEMS")
def item_numbers(spark, sf):
    return R.item_index(T.items(spark, sf).select("row_id", "item_id", "line"), ["row_id"], ["line", "item_id"]).drop("line")


@query("""WITH S AS (SELECT *, sum(CASE WHEN covered THEN 1 ELSE -1 END) OVER (PARTITION BY row_id ORDER BY item_id, parameter, line, covered, category ROWS UNBOUNDED PRECEDING) AS s FROM ITEMS)
    SELECT row_id, item_id, CAST(s - least(0, min(s) OVER (PARTITION BY row_id ORDER BY item_id, parameter, line, covered, category ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM S""")
def clamped_depth(spark, sf):
    return R.clamped_depth(_at(spark, sf), ["row_id"], "at", F.when(F.col("covered"), 1).otherwise(-1)).select("row_id", "item_id", "depth")


@query("""SELECT row_id, item_id, CASE WHEN k <= 1 THEN 'direct' WHEN k <= 3 THEN 'weak' ELSE 'none' END AS evidence FROM (SELECT row_id, item_id, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN covered THEN 0 ELSE 1 END, item_id) AS k FROM ITEMS)""")
def reserved_evidence(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", "covered")
    return R.reserved_budget(items, ["row_id"], ["item_id"], F.lit(1), F.lit(2), F.col("covered")).drop("covered")


@query("""WITH A AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0), B AS (SELECT s_suppkey AS k FROM supplier), U AS (SELECT k FROM A UNION ALL SELECT k FROM B)
    SELECT k, CASE WHEN k IN (SELECT k FROM A) AND k IN (SELECT k FROM B) THEN 'overlap' END AS problem FROM U""")
def manifest_union(spark, sf):
    a = T.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return R.disjoint_union(a, T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@query("SELECT c_custkey AS k, c_name AS name, CAST(NULL AS BIGINT) AS n FROM customer UNION ALL SELECT s_suppkey, NULL, CAST(s_nationkey AS BIGINT) FROM supplier")
def concatenated_inputs(spark, sf):
    a = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return R.concatenated(a, T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("n")))


@query("SELECT r_regionkey, array_to_string(list(n_name ORDER BY length(n_name) DESC, n_name), ',') AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def names_longest_first(spark, sf):
    names = T.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("n"))
    return T.table(spark, sf, "region").join(names, "r_regionkey").select("r_regionkey", F.array_join(R.longest_first("n"), ",").alias("names"))


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
def first_tasks(spark, sf):
    return R.first_rows(T.table(spark, sf, "part").select("p_partkey", "p_size"), [F.desc("p_size"), "p_partkey"], 25)


def _raw_rows(spark, sf):
    runs = T.runs(spark, sf).select("row_id", "log", "test_bytes", "test_preview")
    return T.rows(spark, sf).drop("failure_family", "failure_category", "assertion_mutation_status", "total_items", "reached_items", "scorable_items", "represented_items", "checked_items").join(runs, "row_id")


@query(f"""WITH {CONDITIONS}, E AS (SELECT row_id, count(*) AS a, count(*) FILTER (covered) AS c FROM ITEMS GROUP BY row_id), P AS (SELECT row_id, avg(r) AS b FROM (SELECT row_id, parameter, avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END) AS r FROM ITEMS GROUP BY ALL) GROUP BY row_id),
    K AS (SELECT row_id, count(*) AS n, sum(score) AS s, count(*) FILTER (score > 0) AS h FROM Z GROUP BY row_id), Q AS (SELECT row_id, count(*) AS n, count(*) FILTER (rep = 'killed') AS k FROM R GROUP BY row_id),
    W AS (SELECT q.*, coalesce(q.execution_passed AND u.test_bytes <= 300 AND contains(u.test_preview, 'testPlaceHolder'), false) AS stub FROM ROWS q JOIN RUNS u ON u.row_id = q.row_id),
    X AS (SELECT *, coalesce(execution_passed, false) AND NOT stub AS ran FROM W)
    SELECT X.row_id, coalesce(nullif(complexity_bucket, ''), 'unknown') AS complexity_bucket, CASE WHEN ran THEN 'passed' WHEN stub THEN 'generation_failure' WHEN error_stage IN ('execute', 'execute_timeout') THEN 'execution_failure' WHEN error_stage = 'compile' THEN 'compile_failure' ELSE 'unknown' END AS failure_family,
        coalesce(E.a, 0) AS boundary_applicable_count, coalesce(E.c, 0) AS boundary_covered_count, CASE WHEN NOT coalesce(target_is_private, false) THEN round(P.b, 6) END AS boundary_strength_score, coalesce(Q.n, 0) AS branch_obligations, CASE WHEN ran THEN coalesce(Q.k, 0) ELSE 0 END AS branch_reached,
        coalesce(K.n, 0) AS conditions, CAST(CASE WHEN ran THEN coalesce(K.s, 0) ELSE 0 END AS DOUBLE) AS checked_sum, CASE WHEN ran THEN round(K.h / K.n, 6) WHEN K.n > 0 THEN 0.0 END AS checked_score
    FROM X LEFT JOIN E ON E.row_id = X.row_id LEFT JOIN P ON P.row_id = X.row_id LEFT JOIN K ON K.row_id = X.row_id LEFT JOIN Q ON Q.row_id = X.row_id""")
def row_profile(spark, sf):
    items = T.items(spark, sf)
    out = P.row_profile(_raw_rows(spark, sf), items.select("row_id", "parameter", "covered"), _branches(spark, sf), _conditions(spark, sf), items)
    return six(out.select(
        "row_id", "complexity_bucket", "failure_family", "boundary_applicable_count", "boundary_covered_count", "boundary_strength_score", "branch_obligations", "branch_reached", F.col("if_else_if_condition_condition_total").alias("conditions"),
        F.col("if_else_if_condition_checked_sum").alias("checked_sum"), F.col("if_else_if_condition_checked_score").alias("checked_score"),
    ))
