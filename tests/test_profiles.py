"""Worked answers of row profiles and report tables."""

from pyspark.sql import functions as F

from veridia.functions import classify as C
from veridia.operators import joins as J
from veridia.operators import profiles as P
from veridia.operators import ranking as R
from veridia.operators import tables as B


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_report_view_hides_constructs_at_any_depth(spark):
    rows = spark.createDataFrame(
        [(1, 2, [("if", 1), ("interaction_dependency", 2), (None, 3)], {"return_behavior": 1, "side_effect_x": 2}, (5, [("external_side_effect",), ("zero",)]), ["a", "side_effect_or_dependency"])],
        "k int, side_effect_score int, items array<struct<construct:string,n:int>>, by map<string,int>, deep struct<interaction_dependency_n:int,held:array<struct<category:string>>>, names array<string>",
    )
    out = P.report_view(rows)
    r = out.first()
    assert out.columns == ["k", "items", "by", "deep", "names"] and [i["construct"] for i in r["items"]] == ["if", None] and r["by"] == {"return_behavior": 1}
    assert r["deep"].asDict(True) == {"held": [{"category": "zero"}]} and r["names"] == ["a"]


def test_representability_and_conditions(spark):
    items = spark.createDataFrame([(1, 1, "if", [3]), (1, 2, "ternary", [3]), (1, 3, "else_if", [4, 5]), (1, 4, "if", [9]), (1, 5, "if", [])], "row_id int, item_id int, construct string, lines array<int>")
    mutants = spark.createDataFrame([(1, 3, "KILLED", "NegateConditionalsMutator", ""), (1, 3, "SURVIVED", "x", ""), (1, 4, "NO_COVERAGE", None, None), (1, 5, "TIMED_OUT", None, None), (1, 9, "TIMED_OUT", "y", None)], "row_id int, line int, status string, mutator string, description string")
    found = P.item_mutants(items, mutants, ["row_id"])
    shown = lambda custom: rows_of(P.represented_items(found, custom), "item_id", "representability")
    assert shown(False) == [(1, "killed"), (2, "custom_extreme_missing"), (3, "survived_or_no_coverage"), (4, "other_status"), (5, "unmutated")] and shown(True)[1] == (2, "killed")
    profile = P.representability_profile(P.represented_items(found), ["row_id"]).first()
    assert (profile["total"], profile["reached"], profile["unmutated"], profile["mutation_coverage_rate"]) == (5, 1, 2, 0.4)
    conditions = P.checked_conditions(found.withColumns({"reached_true": F.lit(True), "reached_false": F.col("item_id") == 1, "executed": F.lit(True)}))
    assert rows_of(conditions, "item_id", "killed", "represented", "score") == [(1, True, True, 1.0), (3, False, True, 0.0), (4, False, False, 0.0), (5, False, False, 0.0)]
    assert rows_of(P.match_with_fallback(found, F.lit(True)), "item_id", "covered") == [(1, True), (2, True), (3, True), (4, True), (5, True)]
    only = P.item_mutants(items.where("item_id = 3"), mutants.where("status = 'NO_COVERAGE'"), ["row_id"])
    assert P.match_with_fallback(only, F.lit(True)).first()["covered"] is False


def test_profiles_of_rows_that_did_not_run(spark):
    rows = spark.createDataFrame([(1, True, False, "passed", 4, 3), (2, False, False, "passed", 4, 3), (3, True, True, "passed", 4, 3), (4, True, None, None, None, None)], "row_id int, execution_passed boolean, target_is_private boolean, assertion_mutation_raw_status string, total int, covered int")
    assert rows_of(P.category_profile(rows), "row_id", "missed") == [(1, 1), (2, 4), (3, 1), (4, 0)]
    items = spark.createDataFrame([(i, "return_behavior", "represented", "killed_by_oracle", True, 1.0, False) for i in (1, 2, 3)], "row_id int, construct string, status string, outcome string, represented boolean, score double, subsumed boolean")
    out = P.assertion_profile(rows, items, "row_id")
    assert rows_of(out, "row_id", "assertion_mutation_status", "assertion_strength", "assertion_strength_total_items") == [
        (1, "passed", "applicable", 1), (2, "skipped_original_not_executed", "not_applicable", 0), (3, "skipped_private_target_method", "not_applicable", 0), (4, None, "not_applicable", 0)
    ]
    branch = P.branch_strength(rows.select("row_id", "execution_passed", "total", F.lit(9).alias("reached"), F.lit(1).alias("unreached"), F.lit(0).alias("other_status"), F.lit(0).alias("unmutated"), F.lit(2).alias("mutation_covered")))
    assert rows_of(branch, "row_id", "branch_reached", "branch_unmutated", "branch_score") == [(1, 4, 0, 1.0), (2, 0, 4, 0.0), (3, 4, 0, 1.0), (4, 0, 0, None)]


def test_evidence_counters_of_zero_come_from_items(spark):
    schema = "k int, status string, total_conditions int, scorable_conditions int, score_sum double, checked_items int, fully_checked_items int, represented_items int, items array<struct<score:double,represented:boolean>>"
    rows = spark.createDataFrame([(1, "passed", 0, None, 0.0, 0, 0, None, [(1.0, True), (0.5, True), (None, False)]), (2, "passed", 9, 8, 4.0, 5, 2, 7, None), (3, "failed", 1, 1, 1.0, 1, 1, 1, None)], schema)
    assert rows_of(P.evidence_profile(rows), "k", "total", "scorable", "score_sum", "checked_items", "partially_checked", "represented") == [(1, 3, 2, 1.5, 2, 1, 2), (2, 9, 8, 4.0, 5, 3, 7)]


def test_interaction_setups_and_pooled_strength(spark):
    items = spark.createDataFrame([(1, "net", "exception"), (1, "net", "positive_normal"), (1, "file", "positive_normal")], "k int, kind string, case string")
    setups = spark.createDataFrame([(1, "net", "void_or_side_effect"), (1, "net", "void_or_side_effect")], "k int, kind string, case string")
    assert rows_of(P.interaction_profile(items, setups, "k"), "kind", "case", "achieved") == [("file", "positive_normal", False), ("net", "exception", False), ("net", "positive_normal", True)]
    one = P.side_effect_strength(spark.createDataFrame([(2, 1, None, None), (0, 0, 0, 0)], "state_obligations int, state_checked int, interaction_obligations int, interaction_checked int"))
    assert rows_of(one, "side_effect_strength", "side_effect_score") == [("applicable", 0.5), ("not_applicable", None)]


def test_flatten_compact_null_merge_and_errors(spark):
    one = "struct<total:int,missed:int,pit_total:int,pit_missed:int,evidence:array<string>>"
    flat = P.flatten_profile(spark.createDataFrame([(1, ((3, 1, 2, 0, ["b", "c"]),))], f"k int, profile struct<a:{one}>"), "profile", ["a"]).first().asDict()
    assert flat == {"k": 1, "a_total": 3, "a_missed": 1, "a_pit_total": 2, "a_pit_missed": 0, "a_evidence": "b,c"}
    small = P.compact(spark.createDataFrame([(1, [("zero", 4)], {"if": 1, "case": 2}, 9)], "k int, items array<struct<category:string,line:int>>, m map<string,int>, x int"), ["k", "items", "m"])
    assert small.first().asDict(True) == {"k": 1, "items": [{"category": "zero"}], "m": {"if": 1}}
    assert rows_of(P.null_unrequested(spark.createDataFrame([(1, True, 0.5), (2, None, 0.5)], "k int, r boolean, s double"), "r", ["s"]), "k", "s") == [(1, 0.5), (2, None)]
    old = spark.createDataFrame([("if", 1), ("case", 1), (None, 1)], "construct string, n int")
    assert sorted(rows_of(P.merge_constructs(old, old.withColumn("n", F.lit(2)), ["case"]), "n")) == [(1,), (1,), (2,)] and P.scoped_items(old, []).count() == 3
    assert P.error_rows(old, {"score": "double"}).first()["score"] is None


def test_row_profile_of_stub_tests(spark):
    rows = spark.createDataFrame(
        [(1, "", True, True, False, "", "error", 100, "void testPlaceHolder() {}", "passed"), (2, "low", True, True, None, None, None, 9000, "testPlaceHolder", "passed"), (3, None, True, False, None, "compile", "incompatible types", None, None, None)],
        "row_id int, complexity_bucket string, compile_passed boolean, execution_passed boolean, target_is_private boolean, error_stage string, log string, test_bytes int, test_preview string, assertion_mutation_raw_status string",
    )
    empty = lambda schema: spark.createDataFrame([], schema)
    boundary = spark.createDataFrame([(2, 0, True), (2, 1, False), (2, 1, True)], "row_id int, parameter int, covered boolean")
    branches = empty("row_id int, construct string, representability string")
    conditions = empty("row_id int, score double, represented boolean, outcomes int, killed boolean")
    assertions = empty("row_id int, construct string, status string, outcome string, represented boolean, score double, subsumed boolean")
    out = P.row_profile(rows, boundary, branches, conditions, assertions)
    assert rows_of(out, "row_id", "complexity_bucket", "execution_passed", "failure_family", "failure_category", "boundary_applicable_count") == [
        (1, "unknown", False, "generation_failure", "panta_placeholder_stub", 0), (2, "low", True, "passed", "passed", 3), (3, "unknown", False, "compile_failure", "type_mismatch", 0)
    ]
    assert {r["row_id"]: r["boundary_strength_score"] for r in out.collect()} == {1: None, 2: 0.75, 3: None}


def test_tables_with_fallbacks_and_overrides(spark):
    stats = spark.createDataFrame([("case", 4, 0, 3, 2, 1.0, None, None), ("case", 2, 2, 2, 1, 1.0, 4, 0), ("odd", 0, 0, 0, 0, 0.0, 0, 0)], "construct string, total int, scorable int, represented int, checked int, score_sum double, total_variants int, represented_variants int")
    pit = spark.createDataFrame([("case", 4, 1)], "construct string, pit_total int, pit_covered int")
    r = B.control_flow_detail(stats, pit).collect()
    assert len(r) == 1 and (r[0]["place"], r[0]["scorable"], r[0]["variants"], r[0]["represented_variants"], r[0]["pit_representability"]) == (3, 5, 8, 5, 0.25)
    measured = spark.createDataFrame([("exception_behavior", *range(10, 25), 4.0), ("return_behavior", *range(10, 25), 4.0)], "construct string, " + ", ".join(f"{c} int" for c in B.OUTCOMES) + ", score_sum double")
    narrow = spark.createDataFrame([tuple([1] * len(B.OVERRIDDEN)) + (0.5,)], ", ".join(f"{c} int" for c in B.OVERRIDDEN) + ", score_sum double")
    hidden = lambda n: {r["construct"]: (r["scorable"], r["score"], r["unmeasurable"]) for r in B.oracle_strength_detail(measured, narrow, spark.createDataFrame([(n,)], "n int")).collect()}
    assert hidden(2) == {"exception_behavior": (1, 0.5, 2), "return_behavior": (12, 1 / 3, 0)} and hidden(0)["exception_behavior"] == (12, 1 / 3, 0)


def test_provenance_exclusions_orders_and_unions(spark):
    tasks = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "t string, f int")
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("b", 3), ("c", None), ("x", 1)], "t string, f int")
    assert rows_of(J.provenance_mismatches(rows, tasks, "t", ["f"]), "t", "problem") == [("b", "repeated"), ("d", "missing"), ("x", "unknown")]
    assert rows_of(J.exclusion_problems(rows, tasks, "t", "f"), "t", "problem") == [("b", "duplicate"), ("x", "unknown")]
    assert J.not_excluded(rows.union(spark.createDataFrame([(None, 1)], "t string, f int")), tasks.where("t <> 'b'"), "t").count() == 4
    assert rows_of(R.disjoint_union(tasks, rows.where("t in ('a', 'x')"), "t").where("problem is not null"), "t") == [("a",), ("a",)]
    assert spark.range(1).select(R.longest_first(F.array(*map(F.lit, ("b", "abc", "a", "ab")))).alias("x")).first()["x"] == ["abc", "ab", "a", "b"]
    deltas = spark.createDataFrame([(1, i, d) for i, d in enumerate((1, -1, -1, 1, 1))], "k int, at int, d int")
    assert rows_of(R.clamped_depth(deltas, ["k"], "at", F.col("d")), "at", "depth") == [(0, 1), (1, 0), (2, 0), (3, 1), (4, 2)]


def test_outcomes_of_models_and_tools(spark):
    raw = spark.createDataFrame([(True, True, "", "", None, None), (True, True, "model_error_429", "", None, None), (False, True, "", "", "Limit", 429), (False, False, "", "", None, 0), (False, None, "odd", "", None, None), (False, True, "compile", "cannot find symbol", None, None)], "p boolean, c boolean, s string, l string, e string, k int")
    got = [tuple(r["o"]) for r in raw.select(C.raw_outcome(*map(F.col, "pcslek")).alias("o")).collect()]
    assert got == [("passed", "generated test compiled and executed"), ("model_generation_failure", "model_error 429"), ("model_generation_failure", "Limit 429"), ("compile_failure", "compile_passed is false"), ("unknown_failure", "error_stage=odd"), ("compile_failure", "unresolved_symbol_or_api_misuse")]
    names = spark.createDataFrame([("gpt-5.4",), ("a/b",), ("",), (None,)], "m string").select(C.short_model(F.col("m")).alias("m"))
    assert [r["m"] for r in names.collect()] == ["GPT-5.4", "b", "unknown-model", "unknown-model"]
