"""Scans with explicit schemas: JSON Lines, XML reports, text and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.semantics import EXCLUDED_RUNS, not_in, ratio

#: statistics kept per construct in a profile
CONSTRUCT_STATS = "struct<total:bigint,scorable:bigint,score_sum:double,checked:bigint,represented:bigint,total_variants:bigint,represented_variants:bigint>"
#: counters kept per construct and per return subcategory of assertion mutants
_COUNTS = (
    "total represented scorable checked not_reached_items not_generated_items out_of_scope_items compile_error_items timeout_items killed_by_oracle_items killed_incidentally_items survived_items survived_path_changed_items "
    "coverage_unverified_items non_representable_items applicable reached degenerate_null degenerate_null_items unobservable_return_state"
)
ASSERTION_STATS = "struct<" + ",".join(f"{n}:bigint" for n in _COUNTS.split()) + ",score_sum:double>"
SCOPE_STATS = "struct<" + ",".join(f"{n}:bigint" for n in "total_items reached_items scorable_items checked_items represented_items oracle_killed_items incidentally_killed_items survived_items survived_path_changed_items coverage_unverified_items".split()) + ",score_sum:double>"
PROFILE_SCHEMA = (
    "run_id string, task_id string, model_id string, prompt_template string, complexity_bucket string, target_is_private boolean, compile_passed boolean, execution_passed boolean, "
    "error_stage string, failure_family string, failure_category string, mutation_score double, coverage_line_rate double, coverage_branch_rate double, boundary_strength_score double, "
    "boundary_applicable_count bigint, boundary_covered_count bigint, boundary_applicable_items array<struct<category:string>>, boundary_matched_items array<struct<category:string>>, "
    f"extreme_condition_mutation_status string, if_else_if_condition_total bigint, if_else_if_condition_scorable bigint, if_else_if_condition_by_construct map<string,{CONSTRUCT_STATS}>, "
    "assertion_mutation_status string, assertion_mutation_raw_status string, assertion_strength_score double, assertion_strength_total_items bigint, assertion_strength_reached_items bigint, "
    f"assertion_strength_represented_items bigint, assertion_strength_scorable_items bigint, assertion_strength_checked_items bigint, assertion_strength_by_construct map<string,{ASSERTION_STATS}>, "
    f"assertion_strength_return_subcategories map<string,{ASSERTION_STATS}>, exception_behavior_excluding_broad_original_scope {SCOPE_STATS}, assertion_strength_unmeasurable_by_type_substitution_items bigint, "
    "if_else_if_condition_pit_covered_by_construct map<string,bigint>, if_else_if_condition_pit_total_by_construct map<string,bigint>"
)


def _paths(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Sorted files of a folder that match a pattern, or the file itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or fs.getFileStatus(where).isFile():
        return [path]
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}"))
    return sorted(str(f.getPath()) for f in found or [] if f.isFile())


def read_json_lines(spark: SparkSession, path, schema: str, strict: bool = True, pattern: str = "{*.jsonl,*.jsonl.gz}") -> DataFrame:
    """JSON Lines, plain or gzip, of a file, list or folder; blank lines are skipped.

    Strict reading fails on bad JSON, naming file and text, and on a folder
    without files.
    """
    files = [f for p in ([path] if isinstance(path, str) else path) for f in _paths(spark, p, pattern)]
    if not files:
        if strict:
            raise FileNotFoundError(f"no files {pattern} in {path}")
        return spark.createDataFrame([], schema)
    if not strict:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(files)
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(files)
    told = F.concat(F.lit("bad JSON in "), F.input_file_name(), F.lit(": "), F.left("_bad", F.lit(120)))
    names = [c for c in rows.columns if c != "_bad"]
    first = F.when(F.col("_bad").isNull(), F.col(names[0])).otherwise(F.raise_error(told).cast(rows.schema[names[0]].dataType))
    return rows.select(first.alias(names[0]), *names[1:])


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Collected evidence: the plain JSON Lines files of a folder, sorted; other files there do not count."""
    return read_json_lines(spark, path, schema, pattern="*.jsonl")


def read_rows_without(spark: SparkSession, path, schema: str, excluded=EXCLUDED_RUNS) -> DataFrame:
    """JSON Lines without the rows of excluded runs; rows without a run stay."""
    return read_json_lines(spark, path, schema).where(not_in("run_id", excluded))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a file (JSON Lines, or one JSON document) or of a folder's blindspot_profiles file, plain before gzip.

    Fails where the rows are raw results instead: the keys of profiles must be
    there, their values may be null.
    """
    found = [f for name in ("blindspot_profiles.jsonl", "blindspot_profiles.jsonl.gz") for f in _paths(spark, path, name) if f != path]
    target = found[0] if found else path
    lines = not target.endswith(".json")
    if not lines:
        return spark.read.schema(PROFILE_SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(target)
    keys = F.json_object_keys("value")
    needed = F.array(F.lit("boundary_applicable_items"), F.lit("if_else_if_condition_by_construct"))
    good = F.size(F.array_except(needed, F.coalesce(keys, F.array().cast("array<string>")))) == 0
    blank = F.trim("value") == ""
    refused = F.raise_error(F.lit("profiles are expected, not raw result rows")).cast(StructType.fromDDL(PROFILE_SCHEMA))
    row = F.when(good, F.from_json("value", PROFILE_SCHEMA, {"mode": "FAILFAST"})).when(~blank, refused)  # blank lines are null, in whatever order filters run
    return spark.read.text(target).where(~blank).select(row.alias("r")).select("r.*")


def read_ids(spark: SparkSession, path=None, ids=()) -> DataFrame:
    """Id list: the first word of each line that is neither blank nor a comment, and ids given by hand."""
    own = spark.createDataFrame([(i,) for i in ids], "task_id string")
    if path is None:
        return own.distinct()
    text = F.trim(F.regexp_replace("value", r"#.*$", ""))
    return spark.read.text(path).select(F.split(text, r"\s+")[0].alias("task_id")).where(F.col("task_id") != "").union(own).distinct()


def locate_source(rows: DataFrame, files: DataFrame, suffix: str = "src/main/java/benchmark/Subject.java") -> DataFrame:
    """Rows with source_path and source: the task folder's file, else the work folder's, among ``files`` (path, content)."""
    at = lambda c: F.concat(F.regexp_replace(F.col(c), "/+$", ""), F.lit("/" + suffix))
    out = rows.withColumns({"_t": at("task_dir"), "_w": at("workdir")})
    for name in ("_t", "_w"):
        out = out.join(files.select(F.col("path").alias(name), F.col("content").alias(f"{name}c")), name, "left")
    path = F.when(F.col("_tc").isNotNull(), F.col("_t")).when(F.col("_wc").isNotNull(), F.col("_w"))
    return out.withColumns({"source_path": F.coalesce(path, F.lit("")), "source": F.coalesce("_tc", "_wc")}).drop("_t", "_w", "_tc", "_wc")


def read_whole_text(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_jacoco(spark: SparkSession, path, source: str = "Subject.java") -> DataFrame:
    """file, line and branch counts and rates of one source file per coverage report."""
    schema = "_name string, counter array<struct<_type:string,_missed:bigint,_covered:bigint>>, line array<struct<_nr:int,_ci:int,_cb:int>>"
    rows = spark.read.format("xml").option("rowTag", "sourcefile").schema(schema).load(path).withColumn("file", F.input_file_name()).where(F.col("_name") == source)
    pick = lambda kind, f: F.element_at(F.filter("counter", lambda c: c["_type"] == kind), 1)[f]
    rows = rows.select("file", *[pick(k.upper(), f"_{f}").alias(f"{k}s_{f}") for k in ("line", "branch") for f in ("covered", "missed")], F.array_sort(F.transform(F.filter("line", lambda x: (x["_ci"] > 0) | (x["_cb"] > 0)), lambda x: x["_nr"])).alias("covered_lines"))
    return rows.select("*", *[ratio(f"{k}s_covered", F.col(f"{k}s_covered") + F.col(f"{k}s_missed")).alias(f"{k}_rate") for k in ("line", "branch")])


def read_pit(spark: SparkSession, path) -> DataFrame:
    """One row per mutation of mutation-test reports."""
    schema = "_status string, _detected string, _numberOfTestsRun string, sourceFile string, mutatedClass string, mutatedMethod string, methodDescription string, lineNumber int, mutator string, killingTest string, description string"
    rows = spark.read.format("xml").option("rowTag", "mutation").schema(schema).load(path).withColumn("file", F.input_file_name())
    return rows.withColumnsRenamed({"_status": "status", "_detected": "detected", "_numberOfTestsRun": "number_of_tests_run", "lineNumber": "line"})


def pit_items(rows: DataFrame, reports: DataFrame, keys: list[str], details: str = "mutation_details") -> DataFrame:
    """Mutants of rows: the stored details where there are any, else those of the row's report (keys, status, line, mutator, description)."""
    fields = ("status", "line", "mutator", "description")
    own = rows.where(F.size(F.coalesce(details, F.array().cast(rows.schema[details].dataType))) > 0)
    stored = own.select(*keys, F.explode(details).alias("m")).select(*keys, *[F.col(f"m.{f}").alias(f) for f in fields])
    return stored.unionByName(reports.select(*keys, *fields).join(own.select(*keys).distinct(), keys, "left_anti"))


def read_surefire(spark: SparkSession, path) -> DataFrame:
    """Totals of test reports per folder read: tests, failures, errors, skipped, executed; reports that cannot be parsed are skipped."""
    schema = "_tests string, _failures string, _errors string, _skipped string, _corrupt_record string"
    rows = spark.read.format("xml").option("rowTag", "testsuite").option("mode", "PERMISSIVE").schema(schema).load(path).where(F.col("_corrupt_record").isNull() & F.col("_tests").isNotNull())
    sums = [F.coalesce(F.sum(F.col(f"_{c}").try_cast("bigint")), F.lit(0)).alias(c) for c in ("tests", "failures", "errors", "skipped")]
    return rows.agg(*sums).withColumn("executed", F.col("tests") - F.col("skipped"))


def pit_summary(log) -> F.Column:
    """line_coverage, mutation_coverage and test_strength as a mutation log words them; null without such a line."""
    one = lambda name: F.nullif(F.trim(F.regexp_extract(log, rf"{name}\s*:\s*([^\n\r]+)", 1)), F.lit(""))
    return F.struct(one("Line Coverage").alias("line_coverage"), one("Mutation Coverage").alias("mutation_coverage"), one("Test strength").alias("test_strength"))


def select_tasks(tasks: DataFrame, wanted: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Wanted tasks in manifest order; reading fails where one is not in the manifest."""
    asked = wanted.select("task_id").distinct().withColumn("_w", F.lit(True))
    both = asked.join(tasks.withColumn("_t", F.lit(True)), "task_id", "left")
    told = F.raise_error(F.concat(F.lit("task not in the manifest: "), F.col("task_id"))).cast("string")
    out = both.withColumn("task_id", F.when(F.col("_t"), F.col("task_id")).otherwise(told)).select(*tasks.columns)
    return out.orderBy(order).limit(limit) if limit else out


def preview(content, n: int = 4000) -> F.Column:
    """struct(bytes, preview) of a file's text."""
    return F.struct(F.octet_length(content).cast("long").alias("bytes"), F.left(content, F.lit(n)).alias("preview"))


def log_bundle(*logs, n: int = 12000) -> F.Column:
    """The ends of several logs, joined by blank lines; nulls are left out."""
    return F.concat_ws("\n\n", *[F.right(log, F.lit(n)) for log in logs])
