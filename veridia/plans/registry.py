"""All registered queries of the relational engine and their SQL.

A query applies one operator to records derived from the driver's tables; its
SQL says the same independently. Sums of doubles are rounded to six places on
both sides, as their order is free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import semantics as S
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import obligations as O
from ..operators import ranking as R
from . import standins as T
from .base import ORACLE_SQL, QUERIES, query, six

FLAGSHIP = "treatment_control_comparison"


@query("""
    WITH X AS (
        SELECT coalesce(model_id, 'None') AS model, prompt_template AS strategy, 'BVA' AS metric, category AS construct,
               CASE WHEN covered THEN 1.0 ELSE 0.0 END AS num, 1 AS den, r.row_id % 2 = 0 AS t
        FROM ROWS r JOIN ITEMS i ON r.row_id = i.row_id WHERE execution_passed AND coalesce(run_id, '') <> 'java-v2-mixed-gemma-panta-control-full'
        UNION ALL
        SELECT coalesce(model_id, 'None'), prompt_template, 'CFA', construct, coalesce(score, 0.0), CASE WHEN i.represented THEN 1 ELSE 0 END, r.row_id % 2 = 0
        FROM ROWS r JOIN ITEMS i ON r.row_id = i.row_id WHERE execution_passed AND coalesce(run_id, '') <> 'java-v2-mixed-gemma-panta-control-full' AND extreme_status = 'passed'),
    G AS (SELECT model, strategy, metric, construct,
        CAST(coalesce(sum(num) FILTER (t), 0) AS DOUBLE) AS tn, CAST(coalesce(sum(den) FILTER (t), 0) AS BIGINT) AS td,
        CAST(coalesce(sum(num) FILTER (NOT t), 0) AS DOUBLE) AS cn, CAST(coalesce(sum(den) FILTER (NOT t), 0) AS BIGINT) AS cd FROM X GROUP BY ALL)
    SELECT model, strategy, metric, construct, round(tn, 6) AS treatment_numerator, td AS treatment_denominator, round(tn / nullif(td, 0), 6) AS treatment_score,
           round(cn, 6) AS control_numerator, cd AS control_denominator, round(cn / nullif(cd, 0), 6) AS control_score,
           round(tn / nullif(td, 0) - cn / nullif(cd, 0), 6) AS treatment_minus_control FROM G""")
def treatment_control_comparison(spark, sf):
    rows, items = T.rows(spark, sf), T.items(spark, sf)
    rows = rows.where(S.truthy("execution_passed") & S.not_in("run_id", S.EXCLUDED_RUNS))
    both = rows.select("row_id", S.group_key("model_id").alias("model"), F.col("prompt_template").alias("strategy"), "extreme_status").join(items, "row_id")
    bva = F.struct(F.lit("BVA").alias("metric"), F.col("category").alias("construct"), F.col("covered").cast("double").alias("numerator"), F.lit(1).alias("denominator"))
    cfa = F.struct(F.lit("CFA").alias("metric"), F.col("construct").alias("construct"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("numerator"), F.col("represented").cast("int").alias("denominator"))
    pairs = F.when(F.col("extreme_status") == "passed", F.array(bva, cfa)).otherwise(F.array(bva))
    long = both.select("row_id", "model", "strategy", F.explode(pairs).alias("x")).select("row_id", "model", "strategy", "x.*")
    return six(J.compare_tagged(long.withColumn("treatment", F.col("row_id") % 2 == 0), "treatment", ["model", "strategy", "metric", "construct"]))


@query("""SELECT count(*) AS total, count(*) FILTER (compile_passed) AS compiled, count(*) FILTER (execution_passed) AS executed,
    count(*) - count(*) FILTER (execution_passed) AS non_executable FROM ROWS""")
def execution_funnel(spark, sf):
    return A.execution_funnel(T.rows(spark, sf))


@query("""
    WITH E AS (SELECT *, coalesce(execution_passed, false) AS x, NOT coalesce(target_is_private, false) AS p,
                      coalesce(assertion_mutation_raw_status, 'missing') NOT IN ('', 'missing') AS a FROM ROWS)
    SELECT count(*) AS rows, count(*) FILTER (x) AS executed, count(*) FILTER (x AND p) AS executed_public, count(*) FILTER (a) AS raw_evidence,
        count(*) FILTER (x AND p AND a) AS with_evidence, count(*) FILTER (x AND p AND a AND assertion_mutation_status = 'passed') AS passed_evidence,
        CAST(coalesce(sum(total_items) FILTER (x AND p AND a), 0) AS BIGINT) AS obligations, CAST(coalesce(sum(reached_items) FILTER (x AND p AND a), 0) AS BIGINT) AS reached,
        CAST(coalesce(sum(represented_items) FILTER (x AND p AND a), 0) AS BIGINT) AS represented, CAST(coalesce(sum(scorable_items) FILTER (x AND p AND a), 0) AS BIGINT) AS scorable,
        CAST(coalesce(sum(checked_items) FILTER (x AND p AND a), 0) AS BIGINT) AS checked, count(*) - count(*) FILTER (x) AS non_executable,
        count(*) FILTER (x) - count(*) FILTER (x AND p) AS executed_private FROM E""")
def assertion_funnel(spark, sf):
    return A.assertion_funnel(T.rows(spark, sf))


@query("""
    WITH E AS (SELECT *, coalesce(execution_passed, false) AS x, coalesce(execution_passed, false) AND NOT coalesce(target_is_private, false) AS xp,
                      coalesce(extreme_status, '') NOT IN ('', 'missing') AS a FROM ROWS)
    SELECT count(*) AS rows, count(*) FILTER (x) AS executed, count(*) FILTER (xp) AS executed_public, count(*) FILTER (xp AND a) AS with_evidence,
        count(*) FILTER (xp AND extreme_status = 'passed') AS passed_evidence,
        CAST(coalesce(sum(total_items) FILTER (xp AND extreme_status = 'passed'), 0) AS BIGINT) AS obligations, CAST(coalesce(sum(represented_items) FILTER (xp AND extreme_status = 'passed'), 0) AS BIGINT) AS represented,
        CAST(coalesce(sum(scorable_items) FILTER (xp AND extreme_status = 'passed'), 0) AS BIGINT) AS scorable, CAST(coalesce(sum(checked_items) FILTER (xp AND extreme_status = 'passed'), 0) AS BIGINT) AS checked FROM E""")
def control_flow_funnel(spark, sf):
    return A.control_flow_funnel(T.rows(spark, sf))


@query("""
    WITH E AS (SELECT *, coalesce(execution_passed, false) AS x, coalesce(execution_passed, false) AND NOT coalesce(target_is_private, false) AS p
               FROM ROWS WHERE coalesce(run_id, '') <> 'java-v2-mixed-gemma-panta-control-full'),
    G AS (SELECT count(*) AS rows, count(*) FILTER (x) AS executed, count(*) FILTER (p) AS eligible, CAST(coalesce(sum(total_items) FILTER (p), 0) AS BIGINT) AS total,
        CAST(coalesce(sum(reached_items) FILTER (p), 0) AS BIGINT) AS reached, CAST(coalesce(sum(represented_items) FILTER (p), 0) AS BIGINT) AS represented, CAST(coalesce(sum(checked_items) FILTER (p), 0) AS BIGINT) AS checked FROM E)
    SELECT *, round(executed / nullif(rows, 0), 6) AS executed_rate, round(eligible / nullif(executed, 0), 6) AS eligible_rate, round(reached / nullif(total, 0), 6) AS reached_rate,
        round(represented / nullif(reached, 0), 6) AS represented_rate, round(checked / nullif(represented, 0), 6) AS checked_rate FROM G""")
def eligibility_funnel(spark, sf):
    return six(A.eligibility_funnel(T.rows(spark, sf), S.EXCLUDED_RUNS))


@query("SELECT coalesce(model_id, '?') AS model, coalesce(prompt_template, '?') AS prompt, count(*) AS n_rows FROM ROWS GROUP BY ALL")
def configuration_counts(spark, sf):
    return A.configuration_counts(T.rows(spark, sf))


@query("""SELECT coalesce(nullif(failure_family, ''), 'unknown') AS family, coalesce(nullif(failure_category, ''), 'unknown') AS category, count(*) AS n
    FROM ROWS WHERE NOT coalesce(execution_passed, false) GROUP BY ALL""")
def failure_counts(spark, sf):
    return A.failure_counts(T.rows(spark, sf))


@query("SELECT coalesce(nullif(error_stage, ''), 'unknown') AS stage, count(*) AS n FROM ROWS WHERE NOT coalesce(execution_passed, false) GROUP BY ALL")
def failure_stage_counts(spark, sf):
    return A.failure_stage_counts(T.rows(spark, sf))


CROSS = ["compile_failure/type_mismatch", "execution_failure/timeout_or_hang", "unknown/unknown"]


@query("""
    WITH E AS (SELECT coalesce(complexity_bucket, 'None') AS bucket, coalesce(nullif(failure_family, ''), 'unknown') || '/' || coalesce(nullif(failure_category, ''), 'unknown') AS c FROM ROWS WHERE NOT coalesce(execution_passed, false))
    SELECT bucket, count(*) AS n, count(*) FILTER (c = 'compile_failure/type_mismatch') AS "compile_failure/type_mismatch",
        count(*) FILTER (c = 'execution_failure/timeout_or_hang') AS "execution_failure/timeout_or_hang", count(*) FILTER (c = 'unknown/unknown') AS "unknown/unknown" FROM E GROUP BY bucket""")
def failure_cross_tab(spark, sf):
    return A.failure_cross_tab(T.rows(spark, sf), CROSS)


@query("""SELECT category, count(DISTINCT row_id) AS applicable_rows, count(DISTINCT row_id) FILTER (covered) AS covered_rows, count(*) AS applicable_items,
    count(*) FILTER (covered) AS covered_items, round(count(*) FILTER (covered) / count(*), 6) AS coverage_rate FROM ITEMS GROUP BY category""")
def boundary_category_coverage(spark, sf):
    items = T.items(spark, sf)
    return six(A.category_coverage(items, items.where("covered")))


@query("""WITH P AS (SELECT row_id, parameter, avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END) AS r FROM ITEMS GROUP BY ALL)
    SELECT row_id, round(avg(r), 6) AS score FROM P GROUP BY row_id""")
def row_boundary_score(spark, sf):
    return six(A.row_boundary_score(T.items(spark, sf)))


@query("""SELECT count(*) AS applicable_rows, CAST(sum(checked_items) AS DOUBLE) AS numerator, CAST(sum(total_items) AS BIGINT) AS denominator, round(sum(checked_items) / sum(total_items), 6) AS micro_score,
    round(avg(row_score), 6) AS avg_row_score, round(avg(mutation_score), 6) AS avg_mutation FROM ROWS WHERE execution_passed AND row_score IS NOT NULL""")
def ratio_metrics(spark, sf):
    return six(A.micro_macro(T.rows(spark, sf), "row_score", "checked_items", "total_items"))


@query("""SELECT prompt_template, count(*) AS applicable_rows, CAST(sum(checked_items) AS DOUBLE) AS numerator, CAST(sum(total_items) AS BIGINT) AS denominator, round(sum(checked_items) / sum(total_items), 6) AS micro_score,
    round(avg(row_score), 6) AS avg_row_score, round(avg(mutation_score), 6) AS avg_mutation FROM ROWS WHERE execution_passed AND row_score IS NOT NULL GROUP BY prompt_template""")
def ratio_adequacy_by_prompt(spark, sf):
    return six(A.micro_macro(T.rows(spark, sf), "row_score", "checked_items", "total_items", ["prompt_template"]))


@query("""
    WITH E AS (SELECT * FROM ROWS WHERE execution_passed),
    K AS (SELECT prompt_template AS configuration, * FROM E UNION ALL SELECT 'all', * FROM E)
    SELECT configuration, CAST(coalesce(sum(checked_items), 0) AS DOUBLE) AS checked_top, CAST(coalesce(sum(total_items), 0) AS BIGINT) AS checked_bottom, round(sum(checked_items) / sum(total_items), 6) AS checked_joint,
        CAST(coalesce(sum(reached_items), 0) AS DOUBLE) AS reached_top, CAST(coalesce(sum(total_items), 0) AS BIGINT) AS reached_bottom, round(sum(reached_items) / sum(total_items), 6) AS reached_joint
    FROM K GROUP BY configuration""")
def joint_reached_checked(spark, sf):
    return six(A.joint_with_total(T.rows(spark, sf), "prompt_template", {"checked": ("checked_items", "total_items"), "reached": ("reached_items", "total_items")}))


SCOPE_SQL = """
    WITH E AS (SELECT *, coalesce(subsumed, false) AS b FROM ITEMS WHERE construct IN ('return_behavior', 'exception_behavior')),
    G AS (SELECT {key}, count(*) AS total_items, count(*) FILTER (NOT b AND coalesce(status, '') <> 'not_reached') AS reached_items, count(*) FILTER (NOT b AND status = 'not_reached') AS not_reached_items,
        count(*) FILTER (NOT b AND score IS NOT NULL) AS scorable_items,
        count(*) FILTER (b OR coalesce(status, '') IN ('not_generated', 'out_of_scope', 'compile_error', 'timeout', 'coverage_unverified') OR coalesce(outcome, '') IN ('not_generated', 'out_of_scope', 'compile_error', 'timeout', 'coverage_unverified')) AS non_representable_items,
        count(*) FILTER (NOT b AND score > 0) AS checked_items, count(*) FILTER (NOT b AND outcome = 'killed_by_oracle') AS oracle_killed_items, count(*) FILTER (NOT b AND outcome = 'killed_incidentally') AS incidentally_killed_items,
        count(*) FILTER (NOT b AND outcome = 'survived') AS survived_items, count(*) FILTER (NOT b AND outcome = 'survived_path_changed') AS survived_path_changed_items, count(*) FILTER (NOT b AND status = 'coverage_unverified') AS coverage_unverified_items,
        count(*) FILTER (b) AS unmeasurable_items, count(*) FILTER (NOT b AND represented) AS represented_items, CAST(coalesce(sum(score) FILTER (NOT b), 0) AS DOUBLE) AS score_sum,
        count(*) FILTER (NOT b AND score IS NOT NULL) + count(*) FILTER (NOT b AND status IN ('not_generated', 'out_of_scope')) AS pessimistic_denominator FROM E GROUP BY {key})
    SELECT *, round(score_sum / nullif(scorable_items, 0), 6) AS score, round(score_sum / nullif(pessimistic_denominator, 0), 6) AS pessimistic_score,
        round(represented_items / nullif(reached_items, 0), 6) AS representability_rate, round(scorable_items / nullif(reached_items, 0), 6) AS scorable_rate FROM G"""


@query(SCOPE_SQL.format(key="construct"))
def assertion_scope_by_construct(spark, sf):
    return six(A.scope_summary(T.items(spark, sf), ["construct"]))


@query(SCOPE_SQL.format(key="subcategory"))
def return_subcategory_summary(spark, sf):
    return six(A.scope_summary(T.items(spark, sf), ["subcategory"]))


@query(SCOPE_SQL.format(key="row_id"))
def assertion_scope_by_row(spark, sf):
    return six(A.scope_summary(T.items(spark, sf), ["row_id"]))


@query("""
    WITH V AS (SELECT *, CASE WHEN represented AND NOT sensitivity_only THEN CASE outcome WHEN 'killed_by_oracle' THEN 1.0 WHEN 'survived' THEN 0.0 WHEN 'killed_incidentally' THEN 0.0 END END AS s FROM ITEMS),
    G AS (SELECT row_id, construct, count(*) AS variants, count(*) FILTER (represented) AS represented_variants, count(s) AS scored_variants, round(avg(s), 6) AS score, CAST(max(s) AS DOUBLE) AS any_killed, CAST(min(s) AS DOUBLE) AS all_killed,
        bool_or(represented AND outcome = 'killed_by_oracle') AS o1, bool_or(represented AND outcome = 'killed_incidentally') AS o2, bool_or(represented AND outcome = 'survived_path_changed') AS o3,
        bool_or(NOT represented AND coalesce(outcome, status) = 'coverage_unverified') AS s1, bool_or(NOT represented AND coalesce(outcome, status) = 'out_of_scope') AS s2 FROM V GROUP BY row_id, construct)
    SELECT row_id, construct, variants, represented_variants, scored_variants, score, any_killed, all_killed, represented_variants > 0 AS represented,
        CASE WHEN represented_variants > 0 THEN CASE WHEN o1 THEN 'killed_by_oracle' WHEN o2 THEN 'killed_incidentally' WHEN o3 THEN 'survived_path_changed' ELSE 'survived' END
             WHEN s1 THEN 'coverage_unverified' WHEN s2 THEN 'out_of_scope' ELSE 'not_generated' END AS outcome FROM G""")
def variant_scores(spark, sf):
    return six(A.variants_to_items(T.items(spark, sf), ["row_id", "construct"]))


@query("""
    WITH I AS (SELECT row_id, construct, count(*) AS n, count(*) FILTER (flow_status IN ('killed', 'survived')) AS r, count(*) FILTER (flow_status = 'killed') AS k FROM MUTANTS GROUP BY row_id, construct)
    SELECT construct, count(*) AS total, count(*) FILTER (r = n) AS scorable, round(coalesce(sum(k / n) FILTER (r = n), 0), 6) AS score_sum, count(*) FILTER (r = n AND k > 0) AS checked,
        round(sum(k / n) FILTER (r = n) / nullif(count(*) FILTER (r = n), 0), 6) AS score, round(count(*) FILTER (r = n AND k > 0) / count(*), 6) AS pessimistic FROM I GROUP BY construct""")
def control_flow_summary(spark, sf):
    variants = T.mutants(spark, sf).withColumn("status", F.col("flow_status"))
    return six(A.control_flow_summary(A.control_flow_items(variants, ["row_id", "construct"]), ["construct"]))


@query("""SELECT construct, count(*) AS n, count(*) FILTER (s = 0) AS n0, count(*) FILTER (s = 1) AS n1, count(*) FILTER (s = 2) AS n2, count(*) FILTER (s > 0 AND s < 1) AS low, count(*) FILTER (s >= 1 AND s < 2) AS high,
    round(count(*) FILTER (s = 0) / count(*), 6) AS share0, round(count(*) FILTER (s = 1) / count(*), 6) AS share1, round(count(*) FILTER (s = 2) / count(*), 6) AS share2 FROM (SELECT construct, oracle_level / 2.0 AS s FROM ITEMS) GROUP BY construct""")
def oracle_histogram(spark, sf):
    return six(A.histogram_0_1_2(T.items(spark, sf).withColumn("s", F.col("oracle_level") / 2), ["construct"], "s"))


@query("""SELECT row_id, count(*) AS mutants_total, count(*) FILTER (status = 'KILLED') AS killed, count(*) FILTER (status = 'SURVIVED') AS survived, count(*) FILTER (status = 'NO_COVERAGE') AS no_coverage,
    round(count(*) FILTER (status = 'KILLED') / nullif(count(*) FILTER (status IN ('KILLED', 'SURVIVED', 'NO_COVERAGE')), 0), 6) AS score FROM MUTANTS GROUP BY row_id""")
def mutant_status_counts(spark, sf):
    return six(A.mutant_status_counts(T.mutants(spark, sf), ["row_id"]))


@query("""SELECT complexity_bucket, count(*) AS n_rows, count(mutation_score) AS scored_rows, round(avg(mutation_score), 6) AS macro, round(sum(checked_items) / nullif(sum(checked_items) + sum(scorable_items) + sum(represented_items), 0), 6) AS weighted,
    round(avg(row_score), 6) AS avg_line_rate, round(avg(row_score / 2), 6) AS avg_branch_rate FROM ROWS GROUP BY complexity_bucket""")
def mutation_summary(spark, sf):
    rows = T.rows(spark, sf).withColumns({"killed": F.col("checked_items"), "survived": F.col("scorable_items"), "no_coverage": F.col("represented_items"), "line_rate": F.col("row_score"), "branch_rate": F.col("row_score") / 2})
    return six(A.mutation_summary(rows, ["complexity_bucket"]))


@query("""WITH E AS (SELECT row_id, array_to_string(list_sort(list_distinct(list(subcategory))), ';') AS rule, avg(score) AS score FROM ITEMS GROUP BY row_id)
    SELECT rule, count(*) AS total, count(score) AS scorable, count(*) FILTER (score > 0) AS checked, round(coalesce(sum(score), 0), 6) AS score_sum, round(avg(score), 6) AS score FROM E GROUP BY rule""")
def object_rule_summary(spark, sf):
    items = T.items(spark, sf).groupBy("row_id").agg(F.collect_set("subcategory").alias("rules"), F.avg("score").alias("score"))
    return six(A.object_rule_summary(items))


@query("""WITH T AS (SELECT role, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM conversations), N AS (SELECT role, token, count(*) AS n FROM T WHERE token <> '' GROUP BY ALL),
    K AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, token) AS k FROM N) SELECT role, token, n FROM K WHERE k <= 50""")
def token_top(spark, sf):
    tokens = T.table(spark, sf, "conversations").select("role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''")
    return A.token_top(tokens, ["role"]).select("role", F.explode("tokens").alias("token", "n"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def attach_evidence(spark, sf):
    return J.attach_evidence(T.table(spark, sf, "documents").select("doc_id", "source"), T.table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"], ["quality", "toxic"])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_event_wins(spark, sf):
    return S.last_wins(T.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT row_id, item_id FROM ITEMS i WHERE NOT EXISTS (SELECT 1 FROM ROWS r WHERE r.row_id = i.row_id AND r.assertion_mutation_status = 'passed')")
def resume_pending(spark, sf):
    done = T.rows(spark, sf).select("row_id", F.col("assertion_mutation_status").alias("collector_version"))
    return J.resume(T.items(spark, sf).select("row_id", "item_id"), done, ["row_id"], "passed")


@query("""SELECT row_id, model_id, complexity_bucket, EXISTS (SELECT 1 FROM (SELECT DISTINCT model_id AS m, complexity_bucket AS b FROM ROWS WHERE extreme_status = 'failed' AND failure_category = 'timeout_or_hang' AND prompt_template = '5-LOW') c
    WHERE c.m IS NOT DISTINCT FROM ROWS.model_id AND c.b IS NOT DISTINCT FROM ROWS.complexity_bucket) AS covered FROM ROWS""")
def boundary_items_covered(spark, sf):
    rows = T.rows(spark, sf).select("row_id", "model_id", "complexity_bucket", "extreme_status")
    covered = T.rows(spark, sf).where("extreme_status = 'failed' AND failure_category = 'timeout_or_hang' AND prompt_template = '5-LOW'")
    return J.mark_covered(rows, covered, ["model_id", "complexity_bucket"]).drop("extreme_status")


@query("""WITH H AS (SELECT i.row_id, i.item_id, i.line, list_sort(list_distinct(list(m.status))) AS s FROM ITEMS i JOIN MUTANTS m ON m.row_id = i.row_id AND m.line BETWEEN i.line AND i.line + 2 GROUP BY ALL)
    SELECT i.row_id, i.item_id, array_to_string(coalesce(s, []), ',') AS statuses, CASE WHEN list_contains(s, 'KILLED') THEN 'covered' WHEN list_contains(s, 'SURVIVED') OR list_contains(s, 'NO_COVERAGE') THEN 'missed' WHEN len(s) > 0 THEN 'other' ELSE 'unmutated' END AS match
    FROM ITEMS i LEFT JOIN H ON H.row_id = i.row_id AND H.item_id = i.item_id AND H.line = i.line""")
def obligation_mutant_match(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", F.sequence("line", F.col("line") + 2).alias("lines"))
    out = J.match_lines(items, T.mutants(spark, sf), ["row_id"])
    return out.select("row_id", "item_id", F.array_join("statuses", ",").alias("statuses"), "match")


MODELS, PROMPTS = ["AUTOMOBILE", "BUILDING", "ROBOTICS"], ["1-URGENT", "2-HIGH", "6-NONE"]


@query("""
    WITH F AS (SELECT coalesce(model_id, 'None') AS model, prompt_template AS strategy, complexity_bucket AS task, count(*) AS n FROM ROWS WHERE complexity_bucket IS NOT NULL GROUP BY ALL),
    X AS (SELECT m.model, s.strategy, t.task FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('ROBOTICS')) m(model), (VALUES ('1-URGENT'), ('2-HIGH'), ('6-NONE')) s(strategy), (SELECT DISTINCT task FROM F) t)
    SELECT CASE WHEN F.n IS NULL THEN 'missing' WHEN X.model IS NULL THEN 'unexpected' ELSE 'duplicate' END AS problem, coalesce(X.model, F.model) AS model, coalesce(X.strategy, F.strategy) AS strategy,
        coalesce(X.task, F.task) AS task, coalesce(F.n, 0) AS n FROM X FULL JOIN F ON X.model = F.model AND X.strategy = F.strategy AND X.task = F.task WHERE F.n IS NULL OR X.model IS NULL OR F.n > 1""")
def grid_completeness(spark, sf):
    found = T.rows(spark, sf).where("complexity_bucket IS NOT NULL").select(S.group_key("model_id").alias("model"), F.col("prompt_template").alias("strategy"), F.col("complexity_bucket").alias("task"))
    return J.completeness(found, MODELS, PROMPTS, found)


@query("""WITH V AS (SELECT s_nationkey AS k, CAST(s_suppkey AS INT) AS lo, CAST(s_suppkey + s_suppkey % 40 AS INT) AS hi FROM supplier)
    SELECT c_custkey, c_nationkey, V.lo, V.hi FROM customer JOIN V ON c_nationkey = V.k AND c_custkey BETWEEN V.lo AND V.hi""")
def lines_in_ranges(spark, sf):
    spans = T.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").cast("int").alias("lo"), (F.col("s_suppkey") + F.col("s_suppkey") % 40).cast("int").alias("hi"))
    return J.in_intervals(T.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), spans, "c_nationkey", "c_custkey", 16)


@query("""WITH G AS (SELECT construct, count(*) AS n FROM ITEMS GROUP BY construct), S AS (SELECT count(*) FILTER (subsumed) AS f, count(*) FILTER (construct = 'exception_behavior' AND NOT subsumed) AS v FROM ITEMS)
    SELECT construct, CAST(CASE WHEN construct = 'exception_behavior' AND f > 0 THEN v ELSE n END AS BIGINT) AS n FROM G, S""")
def exception_override(spark, sf):
    items = T.items(spark, sf)
    per_row = items.groupBy("row_id").agg(S.count_where("subsumed").alias("flag"), S.count_where((F.col("construct") == "exception_behavior") & ~F.col("subsumed")).alias("n"))
    return J.override_from_total(items.groupBy("construct").agg(F.count(F.lit(1)).alias("n")), per_row, "exception_behavior", "construct", "n", "flag")


@query("""SELECT row_id, item_id, CASE WHEN k <= 1 THEN 'direct' WHEN k <= 3 THEN 'weak' ELSE 'none' END AS evidence FROM (SELECT row_id, item_id, row_number() OVER (PARTITION BY row_id ORDER BY item_id) AS k FROM ITEMS)""")
def evidence_budget(spark, sf):
    return R.budget(T.items(spark, sf).select("row_id", "item_id"), ["row_id"], ["item_id"], F.lit(1), F.lit(2))


@query("""SELECT row_id, item_id, last_value(CASE WHEN covered THEN category END IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY item_id, parameter, line, covered, category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_case FROM ITEMS""")
def switch_carry_forward(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", "covered", "category", F.struct("item_id", "parameter", "line", "covered", "category").alias("at"))
    return R.carry_forward(items, ["row_id"], "at", F.when(F.col("covered"), F.col("category")), "current_case").select("row_id", "item_id", "current_case")


@query("SELECT row_id, item_id, coalesce(lead(item_id) OVER (PARTITION BY row_id ORDER BY item_id) - 1, 99) AS \"end\" FROM ITEMS")
def case_span_ends(spark, sf):
    return R.next_start(T.items(spark, sf).select("row_id", "item_id"), ["row_id"], "item_id", F.lit(99))


@query("SELECT row_id, item_id, CAST(coalesce(sum(CASE WHEN covered THEN 1 ELSE -1 END) OVER (PARTITION BY row_id ORDER BY item_id, parameter, line, covered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS depth FROM ITEMS")
def brace_depth(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", "covered", F.struct("item_id", "parameter", "line", "covered").alias("at"))
    return R.depth_before(items, ["row_id"], "at", F.when(F.col("covered"), 1).otherwise(-1)).select("row_id", "item_id", "depth")


@query("SELECT construct, outcome, n, round(n / sum(n) OVER (PARTITION BY construct), 6) AS share FROM (SELECT construct, outcome, count(*) AS n FROM ITEMS GROUP BY ALL)")
def outcome_shares(spark, sf):
    return six(R.share_of_group(T.items(spark, sf).groupBy("construct", "outcome").agg(F.count(F.lit(1)).alias("n")), ["construct"]))


@query("""WITH U AS (SELECT row_id, coalesce(execution_passed, false) AS done FROM ROWS), K AS (SELECT row_id FROM U WHERE NOT done ORDER BY row_id LIMIT 100)
    SELECT row_id, done, NOT done AND row_id IN (SELECT row_id FROM K) AS process FROM U""")
def process_limit(spark, sf):
    rows = T.rows(spark, sf).select("row_id", S.truthy("execution_passed").alias("done"))
    return R.unprocessed_limit(rows, F.col("done"), ["row_id"], 100)


@query("SELECT row_id, construct, min(item_id) AS item_id FROM ITEMS GROUP BY row_id, construct")
def first_of_key(spark, sf):
    return R.keep_first(T.items(spark, sf).select("row_id", "construct", "item_id"), ["row_id", "construct"], "item_id")


@query("""SELECT k, 'left' AS side FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders) UNION ALL
    SELECT k, 'right' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""")
def key_set_difference(spark, sf):
    return R.set_difference(T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), T.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_property_counts(spark, sf):
    return T.table(spark, sf, "events").select("event_type", (F.from_json("props", "k bigint")["k"] % 5).alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT construct, measure, CAST(sum(n) AS BIGINT) AS n FROM (SELECT construct, unnest(['total', 'covered']) AS measure, unnest([1, CASE WHEN covered THEN 1 ELSE 0 END]) AS n FROM ITEMS) GROUP BY ALL")
def merged_counters(spark, sf):
    items = T.items(spark, sf).select("construct", F.create_map(F.lit("total"), F.lit(1), F.lit("covered"), F.col("covered").cast("int")).alias("counter"))
    return R.merge_counters(items, ["construct"], "counter")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, 'licen[sc]ed? under', 'i') THEN 'license' WHEN regexp_matches(text, '@[a-z0-9.]+[.](com|org|net)', 'i') THEN 'address' WHEN regexp_matches(text, '[0-9]{12,}', 'i') THEN 'number' ELSE 'other' END AS class FROM documents""")
def first_match_class(spark, sf):
    rules = (("license", r"licen[sc]ed? under"), ("address", r"@[a-z0-9.]+[.](com|org|net)"), ("number", r"[0-9]{12,}"))
    return T.table(spark, sf, "documents").select("doc_id", C.first_match(F.col("text"), rules, "other").alias("class"))


@query("""WITH O AS (SELECT coalesce(model_id, 'unknown-model') AS model, prompt_template AS pipeline, CASE WHEN coalesce(execution_passed, false) THEN 'passed' WHEN coalesce(nullif(failure_category, ''), 'unknown') = 'timeout_or_hang' THEN 'timeout_or_hang'
        WHEN failure_family = 'compile_failure' THEN 'compile_failure' WHEN failure_family = 'execution_failure' THEN 'execution_failure' ELSE 'unknown_failure' END AS outcome FROM ROWS)
    SELECT model, pipeline, count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'compile_failure') AS compile_failure, count(*) FILTER (outcome = 'execution_failure') AS execution_failure,
        count(*) FILTER (outcome = 'timeout_or_hang') AS timeout_or_hang, count(*) FILTER (outcome = 'unknown_failure') AS unknown_failure FROM O GROUP BY ALL""")
def run_outcomes(spark, sf):
    rows = T.rows(spark, sf)
    o = C.run_outcome(F.col("execution_passed"), F.col("failure_family"), F.col("failure_category"))["outcome"]
    named = rows.select(C.short_model(F.col("model_id")).alias("model"), F.col("prompt_template").alias("pipeline"), o.alias("outcome"))
    names = ["passed", "compile_failure", "execution_failure", "timeout_or_hang", "unknown_failure"]
    return named.groupBy("model", "pipeline").agg(F.count(F.lit(1)).alias("total"), *[S.count_where(F.col("outcome") == n).alias(n) for n in names])


@query("""SELECT row_id, CASE WHEN NOT coalesce(compile_passed, false) THEN 'test_failed' WHEN NOT coalesce(execution_passed, false) THEN 'not_collected' WHEN coalesce(assertion_mutation_raw_status, 'missing') IN ('', 'missing') THEN 'evidence_unavailable'
    WHEN total_items = 0 THEN 'not_applicable' WHEN scorable_items = 0 THEN 'not_scorable' ELSE 'scored' END AS status FROM ROWS""")
def public_metric_status(spark, sf):
    status = C.metric_status(F.col("compile_passed"), F.col("execution_passed"), A.has_artifact(), F.col("total_items"), F.col("scorable_items"))
    return T.rows(spark, sf).select("row_id", status.alias("status"))


@query("""SELECT coalesce(model_id, 'None') AS model, count(row_score) AS n, CASE WHEN count(row_score) < 10 THEN 'suppressed' WHEN avg(row_score) IS NULL THEN 'N/A' ELSE printf('%.3f', round(avg(row_score), 6)) END AS shown
    FROM ROWS WHERE complexity_bucket = 'low' GROUP BY ALL""")
def suppressed_rates(spark, sf):
    g = T.rows(spark, sf).where("complexity_bucket = 'low'").groupBy(S.group_key("model_id").alias("model")).agg(F.count("row_score").alias("n"), F.round(F.avg(F.col("row_score").cast("double")), 6).alias("m"))
    return g.select("model", "n", S.fmt_least(F.col("m"), "n").alias("shown"))


@query("""SELECT row_id, coalesce(complexity_bucket, 'unknown') AS bucket FROM ROWS WHERE coalesce(run_id, '') <> 'java-v2-mixed-gemma-panta-control-full' AND prompt_template IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    AND prompt_template <> '2-HIGH' AND coalesce(complexity_bucket, 'unknown') IN ('low', 'unknown')""")
def row_filter(spark, sf):
    rows = T.rows(spark, sf).withColumn("bucket", S.bucket_of(F.col("complexity_bucket")))
    keep = S.not_in("run_id", S.EXCLUDED_RUNS) & F.col("prompt_template").isin("1-URGENT", "2-HIGH", "3-MEDIUM") & S.not_in("prompt_template", ["2-HIGH"]) & F.col("bucket").isin("low", "unknown")
    return rows.where(keep).select("row_id", "bucket")


@query("""WITH L AS (SELECT row_id, list(line ORDER BY line) FILTER (covered) AS c FROM (SELECT DISTINCT row_id, line, covered FROM ITEMS) GROUP BY row_id)
    SELECT i.row_id, i.item_id, CASE WHEN c IS NULL THEN 'unknown' WHEN list_contains(c, i.line) THEN 'reached' ELSE 'not_reached' END AS reach FROM ITEMS i JOIN L ON L.row_id = i.row_id""")
def item_reach(spark, sf):
    items = T.items(spark, sf).select("row_id", "item_id", "line", "covered")
    cover = items.groupBy("row_id").agg(F.collect_set(F.when(F.col("covered"), F.col("line"))).alias("c")).withColumn("c", F.when(F.size("c") > 0, F.col("c")))
    return items.join(cover, "row_id").select("row_id", "item_id", J.reach_status("line", "c").alias("reach"))


@query("""SELECT construct, round(avg(CASE outcome WHEN 'killed_by_oracle' THEN 1.0 WHEN 'survived' THEN 0.0 END), 6) AS excluded, round(avg(CASE outcome WHEN 'killed_by_oracle' THEN 1.0 WHEN 'survived' THEN 0.0 WHEN 'killed_incidentally' THEN 0.0 END), 6) AS zeroed FROM ITEMS GROUP BY construct""")
def incidental_policy(spark, sf):
    return six(T.items(spark, sf).groupBy("construct").agg(F.avg(C.variant_score(F.col("outcome"), "exclude")).alias("excluded"), F.avg(C.variant_score(F.col("outcome"))).alias("zeroed")))


@query("""WITH N AS (SELECT row_id, source, concat('(n < ', CAST(bound AS STRING), ')') AS c FROM JAVA)
    SELECT row_id, 3 AS line, 'if' AS construct, 'condition_true' AS variant, replace(source, c, '(true)') AS mutated FROM N UNION ALL SELECT row_id, 3, 'if', 'condition_false', replace(source, c, '(false)') FROM N
    UNION ALL SELECT row_id, 8, 'catch', 'catch_body_noop', replace(source, concat('{', chr(10), '   h();', chr(10), '  }'), '{}') FROM N
    UNION ALL SELECT row_id, 11, 'exception_path', 'throw_removed', replace(source, 'throw new E();', ';') FROM N UNION ALL SELECT row_id, 4, 'return_behavior', 'return_value_changed', replace(source, 'return 0;', 'return 1;') FROM N""")
def mutant_sources(spark, sf):
    return O.mutants(T.java(spark, sf), "row_id")


@query("""SELECT complexity_bucket, CASE WHEN reached_items IS NULL THEN 'not_applicable' WHEN reached_items = 0 THEN 'no_visible_oracle' WHEN reached_items = 1 THEN 'weak_visible_oracle' ELSE 'direct_obligation_oracle' END AS label, count(*) AS n FROM ROWS GROUP BY ALL""")
def strength_labels(spark, sf):
    return T.rows(spark, sf).groupBy("complexity_bucket", C.strength_label(F.col("reached_items")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT construct, CAST(coalesce(nullif(list_position(['if', 'else_if', 'case', 'default', 'catch', 'exception_path', 'ternary', 'other'], construct), 0), 1073741824) AS BIGINT) AS place, count(*) AS n FROM MUTANTS GROUP BY ALL""")
def display_order(spark, sf):
    return T.mutants(spark, sf).groupBy("construct").agg(F.count(F.lit(1)).alias("n")).select("construct", S.fixed_order(F.col("construct"), C.CONTROL_FLOW_DISPLAY).cast("long").alias("place"), "n")


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, left(html, 4000) AS preview FROM pages")
def file_previews(spark, sf):
    from ..sources.readers import preview

    return T.table(spark, sf, "pages").select("page_id", preview(F.col("html")).alias("p")).select("page_id", "p.*")


@query("""WITH L AS (SELECT row_id, list_sort(list_distinct(list(line) FILTER (covered))) AS a, list_sort(list_distinct(list(line) FILTER (construct = 'return_behavior'))) AS b FROM ITEMS GROUP BY row_id),
    M AS (SELECT row_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM L)
    SELECT row_id, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), ',') AS changed, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset, list_has_any(a, b) AS overlap FROM M""")
def coverage_changes(spark, sf):
    g = T.items(spark, sf).groupBy("row_id").agg(F.collect_set(F.when(F.col("covered"), F.col("line"))).alias("a"), F.collect_set(F.when(F.col("construct") == "return_behavior", F.col("line"))).alias("b"))
    return g.select("row_id", F.array_join(J.changed_lines("a", "b"), ",").alias("changed"), (F.size(F.array_except("a", "b")) == 0).alias("subset"), F.arrays_overlap("a", "b").alias("overlap"))


@query("SELECT DISTINCT model_id, prompt_template, complexity_bucket FROM ROWS WHERE coalesce(execution_passed, false)")
def completed_keys(spark, sf):
    return T.rows(spark, sf).where(S.truthy("execution_passed")).select("model_id", "prompt_template", "complexity_bucket").distinct()


@query("""SELECT * FROM (SELECT category, construct, row_id, item_id, row_number() OVER (PARTITION BY category, construct ORDER BY row_id, item_id, line, parameter) AS k FROM ITEMS WHERE outcome = 'survived') WHERE k <= 3""")
def first_examples(spark, sf):
    rows = T.items(spark, sf).where("outcome = 'survived'").select("category", "construct", "row_id", "item_id", "line", "parameter")
    best = S.top_n(rows, ["category", "construct"], ["row_id", "item_id", "line", "parameter"], 3)
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("category", "construct").orderBy("row_id", "item_id", "line", "parameter"))
    return best.select("category", "construct", "row_id", "item_id", k.cast("long").alias("k"))


@query("""SELECT prompt_template AS prompt, count(*) FILTER (total_items > 0) AS rows_with_items, CAST(sum(total_items) AS BIGINT) AS obligations, CAST(coalesce(sum(checked_items) FILTER (total_items > 0), 0) AS BIGINT) AS checked FROM ROWS GROUP BY ALL""")
def exception_detail_by_prompt(spark, sf):
    some = F.col("total_items") > 0
    return T.rows(spark, sf).groupBy(F.col("prompt_template").alias("prompt")).agg(S.count_where(some).alias("rows_with_items"), S.total("total_items").cast("long").alias("obligations"), S.total(F.when(some, F.col("checked_items"))).cast("long").alias("checked"))


@query("""SELECT row_id, construct, category, list_sort(list_distinct(list(outcome) FILTER (outcome IS NOT NULL)))[1] AS best, count(*) AS n FROM ITEMS GROUP BY row_id, construct, category""")
def item_groups(spark, sf):
    return T.items(spark, sf).groupBy("row_id", "construct", "category").agg(F.min("outcome").alias("best"), F.count(F.lit(1)).alias("n"))


@query("""WITH M AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'NegateConditionalsMutator' WHEN 1 THEN 'NullReturnValsMutator' WHEN 2 THEN 'MathMutator' WHEN 3 THEN 'NonVoidMethodCallMutator' ELSE 'VoidMutator' END AS m FROM part),
    L AS (SELECT *, lower(m) AS l FROM M) SELECT p_partkey, CASE WHEN l LIKE '%conditional%' THEN 'branch_condition' WHEN l LIKE '%null%' THEN 'null_handling' WHEN l LIKE '%return%' THEN 'weak_oracle_return' WHEN l LIKE '%math%' THEN 'numeric_boundary' ELSE 'other' END AS class,
    CASE WHEN l LIKE '%conditional%' THEN 'branch_condition' WHEN l LIKE '%return%' THEN 'boundary_value,weak_oracle' WHEN l LIKE '%math%' THEN 'boundary_value' WHEN l LIKE '%nonvoid%' THEN 'interaction_dependency' ELSE '' END AS categories FROM L""")
def mutator_classes(spark, sf):
    names = F.array(*map(F.lit, ["NegateConditionalsMutator", "NullReturnValsMutator", "MathMutator", "NonVoidMethodCallMutator", "VoidMutator"]))
    m = T.table(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_size") % 5).cast("int")).alias("m"))
    return m.select("p_partkey", C.mutant_class(F.col("m")).alias("class"), F.array_join(C.mutator_categories(F.col("m"), F.lit("")), ",").alias("categories"))


@query("SELECT row_id, 'return_behavior' AS signal, 4 AS line, 'return 0;' AS snippet FROM JAVA UNION ALL SELECT row_id, 'exception_behavior', 11, 'throw new E();' FROM JAVA")
def oracle_obligations(spark, sf):
    return O.oracle_obligations(T.java(spark, sf), "row_id")
from . import registry_rows, registry_text  # noqa: E402, F401  register the queries of row profiles, tables and texts
