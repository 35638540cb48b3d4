"""Profiles from JSON Lines to comparison, report and release files."""

import gzip
import json

import pytest

from veridia.plans import reports
from veridia.sources import readers, writers

FLOW = {"case": {"total": 6, "scorable": 4, "score_sum": 3.0, "checked": 3, "total_variants": 8, "represented_variants": 6}, "catch": {"total": 1, "represented": 1, "score_sum": 0.0, "checked": 0}}
ORACLE = {"return_behavior": {"total": 12, "not_reached_items": 2, "scorable": 10, "represented": 10, "checked": 7, "score_sum": 6.5, "killed_by_oracle_items": 6}, "exception_behavior": {"total": 3, "scorable": 3, "represented": 3, "checked": 3, "score_sum": 3.0}}


def profile(task, **more):
    own = {"run_id": "first", "task_id": task, "model_id": "lab/a", "prompt_template": "short", "compile_passed": True, "execution_passed": True, "target_is_private": False}
    own |= {"extreme_condition_mutation_status": "passed", "assertion_mutation_status": "passed", "assertion_mutation_raw_status": "passed", "boundary_applicable_items": None, "boundary_matched_items": None, "if_else_if_condition_by_construct": None}
    return own | more


ITEMS = lambda *names: [{"category": n, "parameter": 0} for n in names]
ROWS = [
    profile("t1", boundary_applicable_items=ITEMS("null", "empty", "empty"), boundary_matched_items=ITEMS("empty"), if_else_if_condition_by_construct=FLOW, if_else_if_condition_total=7, if_else_if_condition_scorable=5),
    profile("t2", model_id=None, assertion_strength_by_construct=ORACLE, assertion_strength_total_items=15, assertion_strength_checked_items=10, assertion_strength_unmeasurable_by_type_substitution_items=1,
            exception_behavior_excluding_broad_original_scope={"scorable_items": 2, "checked_items": 1, "represented_items": 2, "score_sum": 1.0}, assertion_strength_return_subcategories={"string": {"total": 12, "reached": 10, "represented": 10, "scorable": 10, "checked": 7, "score_sum": 6.5}}),
    profile("t3", compile_passed=False, execution_passed=False, error_stage="compile", failure_family="compile_failure", failure_category="type_mismatch", boundary_applicable_items=ITEMS("null")),
    profile("t4", run_id="java-v2-mixed-gemma-panta-control-full", boundary_applicable_items=ITEMS("null")),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("profiles")
    text = "\n\n".join(map(json.dumps, ROWS)) + "\n"
    (d / "a.jsonl").write_text(text)
    (d / "one.json").write_text(json.dumps(ROWS, indent=1))
    (d / "raw.jsonl").write_text(json.dumps({"run_id": "r", "task_id": "t"}) + "\n")
    for name in ("plain", "packed"):
        (d / name).mkdir()
    (d / "plain" / "blindspot_profiles.jsonl").write_text(text)
    for name in ("plain", "packed"):
        with gzip.open(d / name / "blindspot_profiles.jsonl.gz", "wt") as f:
            f.write(text if name == "packed" else "{}\n")
    return f"file://{d}"


@pytest.mark.parametrize("name", ["a.jsonl", "one.json", "plain", "packed"])
def test_profiles_of_every_form(spark, folder, name):
    got = readers.read_profiles(spark, f"{folder}/{name}")
    assert sorted(r["task_id"] for r in got.collect()) == ["t1", "t2", "t3", "t4"]
    assert got.where("task_id = 't1'").first()["if_else_if_condition_by_construct"]["case"]["score_sum"] == 3.0
    assert got.where("task_id = 't2'").first()["if_else_if_condition_by_construct"] is None


def test_raw_rows_are_refused(spark, folder):
    with pytest.raises(Exception, match="profiles are expected"):
        readers.read_profiles(spark, f"{folder}/raw.jsonl").collect()


def test_comparison_counts_items_and_sums_scores(spark, folder, tmp_path):
    p = readers.read_profiles(spark, f"{folder}/a.jsonl")
    table = reports.compare_profiles(p, p.where("task_id = 't2'"))
    got = {(r["metric"], r["construct"]): (r["treatment_numerator"], r["treatment_denominator"], r["control_score"], r["treatment_minus_control"]) for r in table.collect()}
    assert got == {("BVA", "null"): (0.0, 1, None, None), ("BVA", "empty"): (1.0, 2, None, None), ("CFA", "case"): (3.0, 4, None, None), ("CFA", "catch"): (0.0, 1, None, None)}
    path = f"file://{tmp_path}/comparison"
    writers.write_comparison(table, path)
    files = list((tmp_path / "comparison").glob("part-*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0].split(",") == list(writers.COMPARISON)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_comparison(table, path)
    with pytest.raises(ValueError):
        writers.write_comparison(table.drop("model"), path + "2")


def test_report_has_its_sections(spark, folder):
    text = reports.summary(readers.read_profiles(spark, f"{folder}/a.jsonl"))
    titles = [line[3:] for line in text.splitlines() if line.startswith("## ")]
    assert titles == ["Execution Funnel", "Failure Classification", "Boundary-Value Adequacy Details", "Control-Flow Mutation Funnel", "Control-Flow Adequacy Details", "Assertion Mutation Funnel", "Oracle Strength Details"]
    assert "| 4 | 3 | 3 | 1 |" in text and "| compile_failure | type_mismatch | 1 |" in text and "short 1/2" in text
    assert "| case | 6 | 4 | 3 | 0.750 | 0.500 |" in text  # variants 8 and 6
    # the exceptions' counters without what a broad catch hides
    assert "| exception_behavior | 3 | 3 | 2 | 0.667 | 1 |" in text and "| string | 12 | 10 | 10 | 10 | 7 | 0.650 | 1.000 |" in text and "| boolean | 0 | 0 | 0 | 0 | 0 | suppressed | suppressed |" in text


def test_documents_charts_and_rows(spark, folder, tmp_path):
    p = readers.read_profiles(spark, f"{folder}/a.jsonl")
    (tmp_path / "x.txt").write_text("abc")
    told = json.loads(writers.inventory_document(p, f"file://{tmp_path}"))
    assert told["rows"] == 4 and told["configurations"] == [{"model": "?", "strategy": "short", "rows": 1}, {"model": "lab/a", "strategy": "short", "rows": 3}]
    assert told["files"][0]["bytes"] == 3 and len(told["files"][0]["sha256"]) == 64
    metrics = spark.createDataFrame([("BVA", "scored", 0.5), ("OS", "not_collected", None)], "metric string, status string, score double")
    assert json.loads(writers.metrics_document(metrics, {"test": "00"}, {"engine": "1"}))["metrics"]["OS"] == {"score": None, "status": "not_collected"}
    bars = spark.createDataFrame([("a<b", 3, 4), ("c", 0, 9)], "name string, passed int, failed int")
    svg = writers.stacked_bars(bars, "name", ["passed", "failed"], ["#1a1", "#a11"])
    assert svg.count("<rect") == 3 and "a&lt;b" in svg and svg.endswith("</svg>")
    assert writers.latex_rows(bars, ["name", "failed"]) == "a<b & 4 \\\\\nc & 9 \\\\"
    for most, last in ((0, 1), (3, 3), (9, 10), (47, 50), (101, 150), (23456, 25000)):
        ticks = writers.count_ticks(most)
        assert ticks[0] == 0 and most <= ticks[-1] <= max(2, 1.6 * most) and len(ticks) <= 7, (most, last, ticks)


def test_appending_and_checkpoints(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame(list(v), "k long, v string")
    path = f"file://{tmp_path}/log"
    assert writers.append_new(rows((1, "a"), (2, "b"), (2, "c")), path, ["k"]) == 2
    assert writers.append_new(rows((2, "d"), (3, "e")), path, ["k"]) == 1 and spark.read.json(path).count() == 3
    path = f"file://{tmp_path}/checkpoint"
    writers.append_checkpoint(rows((1, "a"), (2, "b")), path, 1)
    writers.append_checkpoint(rows((2, "again")), path, 2)
    assert sorted(tuple(r) for r in writers.read_checkpoint(spark, path, "k long, v string", ["k"]).collect()) == [(1, "a"), (2, "again")]


def test_strict_reading(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_json_lines(spark, f"file://{tmp_path}/in", "a long")
    (tmp_path / "in" / "b.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    with gzip.open(tmp_path / "in" / "c.jsonl.gz", "wt") as f:
        f.write('{"a": 3}\n')
    (tmp_path / "in" / "d.jsonl.bak").write_text('{"a": 9}\n')
    assert sorted(r["a"] for r in readers.read_json_lines(spark, f"file://{tmp_path}/in", "a long").collect()) == [1, 2, 3]
    assert sorted(r["a"] for r in readers.read_evidence(spark, f"file://{tmp_path}/in", "a long").collect()) == [1, 2]
    (tmp_path / "in" / "e.jsonl").write_text('{"a": \n')
    with pytest.raises(Exception, match="bad JSON in .*e.jsonl"):
        readers.read_json_lines(spark, f"file://{tmp_path}/in", "a long").collect()
    rows = readers.read_json_lines(spark, f"file://{tmp_path}/in/b.jsonl", "a long, run_id string")
    assert rows.count() == 2


def test_tasks_ids_sources_and_reports(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# none\n t1 extra\n\nt2 # why\n")
    ids = readers.read_ids(spark, f"file://{tmp_path}/ids.txt", ["t9", "t1"])
    assert sorted(r["task_id"] for r in ids.collect()) == ["t1", "t2", "t9"]
    tasks = spark.createDataFrame([("t1", 2), ("t2", 1), ("t3", 3)], "task_id string, place int")
    assert [r["task_id"] for r in readers.select_tasks(tasks, ids.where("task_id <> 't9'"), "place").collect()] == ["t2", "t1"]
    with pytest.raises(Exception, match="not in the manifest: t9"):
        readers.select_tasks(tasks, ids, "place").collect()
    files = spark.createDataFrame([("/t/src/main/java/benchmark/Subject.java", "T"), ("/w/src/main/java/benchmark/Subject.java", "W")], "path string, content string")
    rows = spark.createDataFrame([(1, "/t/", "/w"), (2, "/none", "/w"), (3, None, None)], "k int, task_dir string, workdir string")
    assert sorted((r["k"], r["source"], r["source_path"][:2]) for r in readers.locate_source(rows, files).collect()) == [(1, "T", "/t"), (2, "W", "/w"), (3, None, "")]
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a.xml").write_text('<?xml version="1.0"?><testsuite tests="5" failures="1" errors="0" skipped="2"><testcase/></testsuite>')
    (tmp_path / "xml" / "b.xml").write_text('<testsuite tests="7"')
    got = readers.read_surefire(spark, f"file://{tmp_path}/xml").first()
    assert (got["tests"], got["failures"], got["executed"]) == (5, 1, 3)
    details = "array<struct<status:string,line:int,mutator:string,description:string>>"
    rows = spark.createDataFrame([(1, [("KILLED", 3, "m", "d")]), (2, []), (3, None)], f"k int, mutation_details {details}")
    found = spark.createDataFrame([(1, "SURVIVED", 9, "x", "y"), (2, "NO_COVERAGE", 4, "x", "y")], "k int, status string, line int, mutator string, description string")
    assert sorted((r["k"], r["status"]) for r in readers.pit_items(rows, found, ["k"]).collect()) == [(1, "KILLED"), (2, "NO_COVERAGE")]
