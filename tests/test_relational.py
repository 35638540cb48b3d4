"""Worked answers of the relational operators."""

import pytest
from pyspark.sql import functions as F

from veridia.functions import classify as C
from veridia.functions import semantics as S
from veridia.operators import aggregates as A
from veridia.operators import joins as J
from veridia.operators import ranking as R


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_comparison_partial_credit_and_exclusions(spark):
    keys = ["metric", "construct"]
    t = spark.createDataFrame([("CFA", "ternary", 1.5, 2), ("BVA", "zero", 1.0, 1), ("BVA", "negative", 0.0, 1)], "metric string, construct string, numerator double, denominator long")
    c = spark.createDataFrame([("BVA", "zero", 0.0, 2), ("CFA", "if", 0.0, 0)], "metric string, construct string, numerator double, denominator long")
    got = {(r["metric"], r["construct"]): r for r in J.compare_cohorts(t, c, keys).collect()}
    assert got["CFA", "ternary"]["treatment_score"] == 0.75 and got["CFA", "ternary"]["control_score"] is None and got["CFA", "ternary"]["treatment_minus_control"] is None
    assert got["BVA", "zero"]["treatment_minus_control"] == 1.0 and got["CFA", "if"]["control_denominator"] == 0 and got["CFA", "if"]["control_score"] is None


def test_execution_funnel(spark):
    rows = spark.createDataFrame([(False, False), (True, False), (True, True)], "compile_passed boolean, execution_passed boolean")
    assert one(A.execution_funnel(rows)) == {"total": 3, "compiled": 2, "executed": 1, "non_executable": 2}


def test_assertion_funnel(spark):
    schema = "execution_passed boolean, target_is_private boolean, assertion_mutation_raw_status string, assertion_mutation_status string, total_items long, reached_items long, represented_items long, scorable_items long, checked_items long"
    rows = spark.createDataFrame([(False, None, "passed", "passed", 1, 1, 1, 1, 1), (True, True, "passed", "passed", 1, 1, 1, 1, 1), (True, None, "passed", "passed", 2, 2, 1, None, 1)], schema)
    got = one(A.assertion_funnel(rows))
    assert [got[k] for k in ("rows", "executed", "executed_public", "passed_evidence", "non_executable", "executed_private", "obligations", "scorable")] == [3, 2, 1, 1, 1, 1, 2, 0]


def test_control_flow_funnel_is_nested(spark):
    schema = "execution_passed boolean, target_is_private boolean, extreme_status string, total_items long, represented_items long, scorable_items long, checked_items long"
    rows = spark.createDataFrame([(True, False, "passed", 5, 4, 3, 2), (False, False, "passed", 5, 4, 3, 2), (True, True, "passed", 5, 4, 3, 2), (True, False, "failed", 5, 4, 3, 2), (True, False, None, 5, 4, 3, 2)], schema)
    assert list(one(A.control_flow_funnel(rows)).values()) == [5, 4, 3, 2, 1, 5, 4, 3, 2]


VARIANTS = "item int, outcome string, status string, represented boolean, sensitivity_only boolean"


def test_variant_mean_and_policies(spark):
    rows = spark.createDataFrame([(1, o, None, o != "coverage_unverified", False) for o in ("killed_by_oracle", "killed_incidentally", "survived", "coverage_unverified")], VARIANTS)
    got = one(A.variants_to_items(rows, ["item"]))
    assert got["score"] == pytest.approx(1 / 3) and got["scored_variants"] == 3 and got["outcome"] == "killed_by_oracle"
    alone = rows.where("outcome = 'killed_incidentally'")
    assert one(A.variants_to_items(alone, ["item"]))["score"] == 0.0
    left_out = one(A.variants_to_items(alone, ["item"], incidental="exclude"))
    assert left_out["score"] is None and left_out["scored_variants"] == 0


def test_path_change_and_sensitivity_only(spark):
    rows = spark.createDataFrame([(1, "survived_path_changed", None, True, False), (2, "killed_by_oracle", None, True, True), (3, None, "timeout", False, None), (3, None, "coverage_unverified", False, None)], VARIANTS)
    got = {r["item"]: r for r in A.variants_to_items(rows, ["item"]).collect()}
    assert (got[1]["represented_variants"], got[1]["scored_variants"], got[1]["score"]) == (1, 0, None)
    assert got[2]["score"] is None and got[2]["outcome"] == "killed_by_oracle"
    assert got[3]["outcome"] == "coverage_unverified" and not got[3]["represented"]


ITEMS = "row int, construct string, status string, outcome string, represented boolean, score double, subsumed boolean"


def test_primary_scope_and_broad_originals(spark):
    rows = spark.createDataFrame([(1, "return_behavior", None, "killed_by_oracle", True, 1.0, None), (1, "exception_behavior", None, "survived", True, 0.0, None), (1, "side_effect_or_dependency", None, "killed_by_oracle", True, 1.0, None)], ITEMS)
    got = one(A.scope_summary(rows, ["row"]))
    assert (got["score"], got["scorable_items"], got["checked_items"]) == (0.5, 2, 1)
    rows = spark.createDataFrame([(1, "exception_behavior", None, "survived", True, 0.0, True), (1, "exception_behavior", None, "killed_by_oracle", True, 1.0, False)], ITEMS)
    got = one(A.scope_summary(rows, ["row"]))
    assert (got["score"], got["unmeasurable_items"], got["scorable_items"], got["total_items"], got["non_representable_items"]) == (1.0, 1, 1, 2, 1)


def test_control_flow_ratios(spark):
    v = spark.createDataFrame([(1, "if", "killed"), (1, "if", "survived"), (2, "if", "killed"), (2, "if", "compile_error")], "item int, construct string, status string")
    items = A.control_flow_items(v, ["item", "construct"])
    assert {r["item"]: r["score"] for r in items.collect()} == {1: 0.5, 2: None}
    got = one(A.control_flow_summary(items, ["construct"]))
    assert (got["total"], got["scorable"], got["score_sum"], got["score"], got["pessimistic"]) == (2, 1, 0.5, 0.5, 0.5)


def test_row_score_is_mean_of_ratios(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "a", False), (1, "b", True)], "row_id int, parameter string, covered boolean")
    assert one(A.row_boundary_score(rows))["score"] == 0.75


def test_failure_classes(spark):
    cases = [
        ("error: incompatible types: int", "compile", "compile_failure", "type_mismatch"), ("cannot find symbol and incompatible types", "compile", "compile_failure", "unresolved_symbol_or_api_misuse"),
        ("', ; expected'", "compile", "compile_failure", "syntax_or_other_compile_error"), ("anything", "compile_timeout", "execution_failure", "timeout_or_hang"), ("java.lang.NullPointerException", "execute", "execution_failure", "uncaught_runtime_exception"),
        ("AssertionError expected:<1> but was:<2>", "execute", "execution_failure", "wrong_oracle"), (None, "execute", "execution_failure", "other_execution_failure"), ("x", "model_error_429", "unknown", "unknown"), ("x", None, "unknown", "unknown"),
    ]
    rows = spark.createDataFrame(cases, "log string, stage string, family string, category string")
    assert rows.where(C.failure_class(F.col("log"), F.col("stage")) != F.struct("family", "category")).count() == 0


def test_metric_status_gates(spark):
    rows = spark.createDataFrame([(False, True, True, 1, 1, "test_failed"), (True, None, True, 1, 1, "not_collected"), (True, True, False, 1, 1, "evidence_unavailable"), (True, True, True, None, 1, "not_applicable"), (True, True, True, 2, 0, "not_scorable"), (True, True, True, 2, 1, "scored")], "a boolean, b boolean, c boolean, d int, e int, want string")
    assert rows.where(C.metric_status(*[F.col(x) for x in "abcde"]) != F.col("want")).count() == 0


def test_null_rules(spark):
    rows = spark.createDataFrame([(None, None, ""), ("x", 0, "y"), ("java-v2-mixed-gemma-panta-control-full", 3, None)], "run string, n int, t string")
    got = rows.select(S.not_in("run", S.EXCLUDED_RUNS), S.first_nonzero(F.col("n"), F.lit(9)), S.group_key("run"), S.known_or("t")).collect()
    assert [tuple(r) for r in got] == [(True, 9, "None", "unknown"), (True, 9, "x", "y"), (False, 3, "java-v2-mixed-gemma-panta-control-full", "unknown")]
    assert one(spark.range(1).select(S.fmt(F.lit(0.5)).alias("a"), S.fmt(F.lit(None)).alias("b"), S.fmt_least(F.lit(0.5), F.lit(9)).alias("c"))) == {"a": "0.500", "b": "N/A", "c": "suppressed"}


def test_last_wins_resume_and_null_safe_match(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 5, "c")], "k int, o int, v string")
    assert sorted((str(r["k"]), r["v"]) for r in S.last_wins(rows, ["k"], ["o"]).collect()) == [("1", "b"), ("None", "c")]
    done = spark.createDataFrame([(1, "v8"), (2, "old")], "k int, collector_version string")
    assert {r["k"] for r in J.resume(spark.createDataFrame([(1,), (2,), (3,)], "k int"), done, ["k"], "v8").collect()} == {2, 3}
    items = spark.createDataFrame([(0, None), (0, "x"), (1, None)], "p int, bound string")
    hit = spark.createDataFrame([(0, None)], "p int, bound string")
    assert [r["covered"] for r in J.mark_covered(items, hit, ["p", "bound"]).orderBy("p", "bound").collect()] == [True, False, False]


def test_completeness_and_intervals(spark):
    found = spark.createDataFrame([("m", "s", "t1"), ("m", "s", "t1"), ("z", "s", "t1")], "model string, strategy string, task string")
    tasks = spark.createDataFrame([("t1",), ("t2",)], "task string")
    assert sorted((r["problem"], r["model"], r["task"], r["n"]) for r in J.completeness(found, ["m"], ["s"], tasks).collect()) == [("duplicate", "m", "t1", 2), ("missing", "m", "t2", 0), ("unexpected", "z", "t1", 1)]
    points = spark.createDataFrame([(1, p) for p in range(40)], "k int, p int")
    spans = spark.createDataFrame([(1, 3, 25), (1, 24, 24), (2, 0, 99)], "k int, lo int, hi int")
    got = sorted((r["p"], r["lo"]) for r in J.in_intervals(points, spans, "k", "p", 10).collect())
    assert got == sorted([(p, 3) for p in range(3, 26)] + [(24, 24)])


def test_line_matching(spark):
    items = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [3]), (1, 3, [9]), (1, 4, [4])], "row int, item_id int, lines array<int>")
    mutants = spark.createDataFrame([(1, 1, "KILLED"), (1, 2, "SURVIVED"), (1, 3, "NO_COVERAGE"), (1, 4, "TIMED_OUT")], "row int, line int, status string")
    assert {r["item_id"]: r["match"] for r in J.match_lines(items, mutants, ["row"]).collect()} == {1: "covered", 2: "missed", 3: "unmutated", 4: "other"}


def test_budget_carry_forward_and_limits(spark):
    rows = spark.createDataFrame([(1, i, "c" if i == 2 else None) for i in range(1, 6)], "k int, i int, v string")
    assert [r["evidence"] for r in R.budget(rows, ["k"], ["i"], F.lit(1), F.lit(2)).orderBy("i").collect()] == ["direct", "weak", "weak", "none", "none"]
    assert [r["c"] for r in R.carry_forward(rows, ["k"], "i", F.col("v"), "c").orderBy("i").collect()] == [None, "c", "c", "c", "c"]
    assert [r["end"] for r in R.next_start(rows, ["k"], "i", F.lit(9)).orderBy("i").collect()] == [1, 2, 3, 4, 9]
    assert [r["process"] for r in R.unprocessed_limit(rows, F.col("i") == 2, ["i"], 2).orderBy("i").collect()] == [True, False, True, False, False]
    assert [r["depth"] for r in R.depth_before(rows, ["k"], "i", F.lit(1)).orderBy("i").collect()] == [0, 1, 2, 3, 4]


def test_sources_and_sinks(spark, tmp_path):
    from veridia.sources import readers, writers

    rows = spark.createDataFrame([("a", 1, [1, 2]), ("b", 2, None)], "k string, n long, xs array<int>")
    plain, packed = f"file://{tmp_path}/plain", f"file://{tmp_path}/gz"
    writers.write_json_lines(rows, plain)
    files = writers.package_profiles(rows, packed, ["k", "n"])
    assert files.count() >= 1 and spark.read.schema("k string, n long").json(packed).exceptAll(spark.read.schema("k string, n long").json(plain)).count() == 0
    assert writers.append_new(rows, f"file://{tmp_path}/log", ["k"]) == 2 and writers.append_new(rows, f"file://{tmp_path}/log", ["k"]) == 0
    writers.write_csv(rows, f"file://{tmp_path}/csv")
    with pytest.raises(Exception):
        writers.write_csv(rows, f"file://{tmp_path}/csv")
    (tmp_path / "ids").write_text("# all\nt1 first\n\n t2 # no\n")
    assert {r["task_id"] for r in readers.read_ids(spark, f"file://{tmp_path}/ids").collect()} == {"t1", "t2"}
    (tmp_path / "jacoco.xml").write_text('<report><package name="p"><sourcefile name="Subject.java"><line nr="3" mi="0" ci="2" mb="0" cb="0"/><line nr="4" mi="1" ci="0" mb="0" cb="0"/><counter type="LINE" missed="1" covered="3"/><counter type="BRANCH" missed="0" covered="0"/></sourcefile></package></report>')
    got = one(readers.read_jacoco(spark, f"file://{tmp_path}/jacoco.xml"))
    assert (got["line_rate"], got["branch_rate"], got["covered_lines"]) == (0.75, None, [3])
    (tmp_path / "mutations.xml").write_text('<mutations><mutation detected="true" status="KILLED" numberOfTestsRun="1"><lineNumber>7</lineNumber><mutator>M</mutator></mutation><mutation detected="false" status="SURVIVED"><lineNumber>8</lineNumber></mutation></mutations>')
    m = readers.read_pit(spark, f"file://{tmp_path}/mutations.xml")
    assert one(A.mutant_status_counts(m, []))["score"] == 0.5 and {r["line"] for r in m.collect()} == {7, 8}
    (tmp_path / "TEST-a.xml").write_text('<testsuite tests="5" failures="1" errors="0" skipped="2"><testcase name="x"/></testsuite>')
    assert one(readers.read_surefire(spark, f"file://{tmp_path}/TEST-a.xml"))["executed"] == 3
    assert "| k |" in writers.markdown(rows.select("k"))


def test_entry_has_every_query_with_sql():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) >= 150 and "pipeline" in names or "op1_ann" not in names


def test_flagship_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
