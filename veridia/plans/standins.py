"""Evaluation records derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS = """
SELECT o.o_orderkey AS row_id, CAST(o.o_orderkey AS STRING) AS task_id,
       CASE WHEN o.o_orderkey % 50 = 0 THEN NULL WHEN o.o_orderkey % 17 = 0 THEN 'java-v2-mixed-gemma-panta-control-full'
            ELSE concat('run-', CAST(o.o_orderkey % 4 AS STRING)) END AS run_id,
       CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE c.c_mktsegment END AS model_id, o.o_orderpriority AS prompt_template,
       CASE WHEN o.o_totalprice < 100000 THEN 'low' WHEN o.o_totalprice < 250000 THEN 'medium' WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 'high' END AS complexity_bucket,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_orderstatus <> 'P' END AS compile_passed,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE o.o_orderstatus = 'F' END AS execution_passed,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderkey % 7 = 0 END AS target_is_private,
       CASE WHEN o.o_orderstatus = 'F' THEN NULL WHEN o.o_orderstatus = 'P' THEN 'compile' WHEN o.o_orderkey % 5 = 0 THEN 'execute_timeout' ELSE 'execute' END AS error_stage,
       CASE WHEN o.o_orderkey % 19 = 0 THEN '' WHEN o.o_orderstatus = 'P' THEN 'compile_failure' WHEN o.o_orderstatus = 'O' THEN 'execution_failure' ELSE 'passed' END AS failure_family,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL WHEN o.o_orderkey % 3 = 0 THEN 'type_mismatch' WHEN o.o_orderkey % 5 = 0 THEN 'timeout_or_hang' ELSE 'wrong_oracle' END AS failure_category,
       CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE o.o_orderkey % 101 / 100.0 END AS mutation_score,
       CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE (o.o_orderkey % 11) / 10.0 END AS row_score,
       CASE WHEN o.o_orderkey % 9 = 0 THEN 'missing' WHEN o.o_orderkey % 10 = 0 THEN NULL WHEN o.o_orderkey % 8 = 0 THEN 'failed' ELSE 'passed' END AS assertion_mutation_raw_status,
       CASE WHEN o.o_orderkey % 8 = 0 THEN 'failed' ELSE 'passed' END AS assertion_mutation_status,
       CASE WHEN o.o_orderkey % 12 = 0 THEN '' WHEN o.o_orderkey % 14 = 0 THEN 'failed' ELSE 'passed' END AS extreme_status,
       o.o_orderkey % 9 AS total_items, CASE WHEN o.o_orderkey % 15 = 0 THEN NULL ELSE least(o.o_orderkey % 9, o.o_orderkey % 7) END AS reached_items,
       least(o.o_orderkey % 9, o.o_orderkey % 5) AS represented_items, least(o.o_orderkey % 9, o.o_orderkey % 4) AS scorable_items, least(o.o_orderkey % 9, o.o_orderkey % 3) AS checked_items
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
"""

ITEMS = """
SELECT l_orderkey AS row_id, l_linenumber AS item_id, l_partkey % 60 AS line, l_suppkey AS parameter,
       CASE l_returnflag WHEN 'R' THEN 'return_behavior' WHEN 'A' THEN 'exception_behavior' ELSE 'side_effect_or_dependency' END AS construct,
       CASE l_partkey % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'numeric' WHEN 2 THEN 'string' WHEN 3 THEN 'collection' WHEN 4 THEN 'enum_or_class' ELSE 'object' END AS subcategory,
       CASE l_suppkey % 12 WHEN 0 THEN 'null' WHEN 1 THEN 'empty' WHEN 2 THEN 'zero' WHEN 3 THEN 'negative' WHEN 4 THEN 'true_value' ELSE 'at_inferred_bound' END AS category,
       CASE WHEN l_partkey % 10 = 0 THEN 'not_reached' WHEN l_partkey % 10 = 1 THEN 'not_generated' WHEN l_partkey % 10 = 2 THEN 'out_of_scope' WHEN l_partkey % 10 = 3 THEN 'coverage_unverified' WHEN l_partkey % 10 = 4 THEN NULL ELSE 'represented' END AS status,
       CASE WHEN l_partkey % 10 < 5 THEN NULL WHEN l_linestatus = 'F' THEN 'killed_by_oracle' WHEN l_partkey % 10 = 5 THEN 'killed_incidentally' WHEN l_partkey % 10 = 6 THEN 'survived_path_changed' ELSE 'survived' END AS outcome,
       l_partkey % 10 >= 5 AS represented,
       CASE WHEN l_partkey % 10 < 5 OR l_partkey % 10 = 6 AND l_linestatus <> 'F' THEN NULL WHEN l_linestatus = 'F' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score,
       l_returnflag = 'A' AND l_suppkey % 4 = 0 AS subsumed, l_suppkey % 9 = 0 AS sensitivity_only,
       l_linestatus = 'F' AS covered, l_suppkey % 5 AS oracle_level
FROM lineitem
"""

MUTANTS = """
SELECT l_orderkey AS row_id, l_linenumber AS mutant, l_partkey % 60 AS line,
       CASE l_suppkey % 7 WHEN 0 THEN 'SURVIVED' WHEN 1 THEN 'NO_COVERAGE' WHEN 2 THEN 'TIMED_OUT' ELSE 'KILLED' END AS status,
       CASE l_partkey % 4 WHEN 0 THEN 'compile_error' WHEN 1 THEN 'survived' ELSE 'killed' END AS flow_status,
       CASE l_returnflag WHEN 'R' THEN 'if' WHEN 'A' THEN 'ternary' ELSE 'case' END AS construct
FROM lineitem
"""

#: Java methods and tests made from parts; '~' stands for a line end
JAVA = """
SELECT p_partkey AS row_id, p_size AS bound, p_partkey % 60 - 5 AS arg, p_brand AS brand,
       replace(concat('class S {~ int f(int n, String s) {~  if (n < ', CAST(p_size AS STRING), ') {~   return 0;~  }~  try {~   g(s.equals("', p_brand, '"));~  } catch (E e) {~   h();~  }~  throw new E();~ }~}'), '~', chr(10)) AS source,
       'int f(int n, String s)' AS signature,
       concat('f(', CAST(p_partkey % 60 - 5 AS STRING), ', ', CASE p_partkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN concat('"', p_brand, '"') ELSE '"other"' END, ');') AS test_code
FROM part
"""


#: Java methods of six shapes with tabs, comments, switches, conditional expressions, loops, nested classes and calls of the outside;
#: '~' stands for a line end, '^' for a tab
METHODS = """
SELECT row_id, shape, bound, arg, brand, sarg, kind, signature, replace(replace(source, '~', chr(10)), '^', chr(9)) AS source, replace(test_code, '~', chr(10)) AS test_code FROM (
SELECT p_partkey AS row_id, p_partkey % 6 AS shape, p_size AS bound, p_partkey % 60 - 5 AS arg, p_brand AS brand,
       CASE p_size % 4 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN concat('"', p_brand, '"') ELSE '"other"' END AS sarg,
       CASE WHEN p_partkey % 6 = 4 THEN 'void' WHEN p_size % 3 = 0 THEN 'String' WHEN p_size % 3 = 1 THEN 'boolean' ELSE 'int' END AS kind,
       concat('public ', CASE WHEN p_partkey % 6 = 4 THEN 'void' WHEN p_size % 3 = 0 THEN 'String' WHEN p_size % 3 = 1 THEN 'boolean' ELSE 'int' END, ' f(int n, String s)') AS signature,
       CASE p_partkey % 6
       WHEN 0 THEN concat('package a.b;~import java.util.*;~class Subject {~^// if (x) throw new E();~^int f(int n, String s) {~^^if (n < ', CAST(p_size AS STRING), ') {~^^^return 0;~^^} else if (n > ', CAST(p_size AS STRING), ') {~^^^return n;~^^}~^^/* throw it */~^^throw new IllegalStateException("low ', p_brand, '");~^}~}')
       WHEN 1 THEN concat('class Subject {~ int f(int n, String s) {~  switch (n) {~   case 1:~   case 2:~    return 7;~   case ', CAST(p_size + 2 AS STRING), ':~    g(s);~    break;~   default:~    return s.equals("', p_brand, '") ? 1 : 2;~  }~  return 3;~ }~}')
       WHEN 2 THEN concat('class Subject {~ Map<String, ? extends List<Integer>> m = null;~ public int g(int a) { return a > 0 ? 1 : 2; }~ int f(int n, String s) {~  int k = n >= ', CAST(p_size AS STRING), '~    ? 4~    : 5;~  return k > 4 ? k : n;~ }~}')
       WHEN 3 THEN concat('class Subject {~ static final int MAX = ', CAST(p_size AS STRING), ';~ static int count;~ int f(int n, String s) {~  count += n;~  Other.last = s;~  for (int i = 0; i < n; i++) {~   h(i);~  }~  for (String t : all(s)) { h(t); }~  while (n == ', CAST(p_size AS STRING), ') n--;~  return n;~ }~}')
       WHEN 4 THEN concat('class Subject {~ void f(int n, String s) {~  try {~   Files.write(path, s);~   int code = conn.getResponseCode();~   client.send(s);~   task.execute(s);~  } catch (IOException e) {~   throw new RuntimeException(e);~  }~  if (', CAST(p_size AS STRING), ' <= n) { return; }~ }~}')
       ELSE concat('class Subject {~ private static class Inner {~  int z(int n) {~   if (n > 99) { return 1; }~   return 2;~  }~ }~ int f(int n, String s) {~  Runnable r = new Runnable() {~   public int run(int q) {~    return 8;~   }~  };~  if (n != ', CAST(p_size AS STRING), ' && s == null) return 6;~  return 9;~ }~}') END AS source,
       concat('@Test~void t() {~  // assertTrue(false);~  int got = Subject.f(', CAST(p_partkey % 60 - 5 AS STRING), ', ', CASE p_size % 4 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN concat('"', p_brand, '"') ELSE '"other"' END, ');~',
           CASE p_partkey % 5 WHEN 0 THEN '  assertEquals(3, got);~' WHEN 1 THEN '  assertNotNull(got);~' WHEN 2 THEN '  assertThrows(IllegalStateException.class, () -> Subject.f(1, "x fail(y)"));~' WHEN 3 THEN '  try { Subject.f(0, s); fail("no"); } catch (RuntimeException e) { }~' ELSE '  new Thing<String>();~' END, '}') AS test_code
FROM part) t
"""

#: signatures made from the parts that reading them has to give back
SIGNATURES = """
SELECT row_id, name, t1, t2, returns, is_private, thrown, arg,
       concat(CASE row_id % 3 WHEN 0 THEN '@Override ' WHEN 1 THEN '@SuppressWarnings("unchecked") ' ELSE '' END, CASE WHEN is_private THEN 'private ' ELSE 'public static ' END, CASE row_id % 4 WHEN 0 THEN '<T> ' ELSE '' END, returns, ' ', name,
              '(', CASE row_id % 5 WHEN 0 THEN 'final ' WHEN 1 THEN '@Nullable ' ELSE '' END, t1, ' first,  ', t2, ' second)', CASE WHEN thrown <> '' THEN concat(' throws ', thrown) ELSE '' END) AS signature
FROM (SELECT p_partkey AS row_id, concat('do', CAST(p_size AS STRING)) AS name, p_partkey % 7 = 0 AS is_private,
       CASE p_partkey % 11 WHEN 0 THEN 'int' WHEN 1 THEN 'Integer' WHEN 2 THEN 'java.math.BigDecimal' WHEN 3 THEN 'boolean' WHEN 4 THEN 'java.lang.Boolean' WHEN 5 THEN 'String' WHEN 6 THEN 'Map<String, List<Integer>>' WHEN 7 THEN 'char' WHEN 8 THEN 'int[]' WHEN 9 THEN 'Class<? extends Node>' ELSE 'Node' END AS t1,
       CASE p_size % 7 WHEN 0 THEN 'long' WHEN 1 THEN 'CharSequence' WHEN 2 THEN 'Optional<Set<String>>' WHEN 3 THEN 'Object' WHEN 4 THEN 'double' WHEN 5 THEN 'Boolean' ELSE 'java.util.List<String>' END AS t2,
       CASE p_size % 6 WHEN 0 THEN 'void' WHEN 1 THEN 'int' WHEN 2 THEN 'List<String>' WHEN 3 THEN 'java.lang.String' WHEN 4 THEN 'Node[]' ELSE 'Map<String, Integer>' END AS returns,
       CASE p_partkey % 4 WHEN 0 THEN 'java.io.IOException' WHEN 1 THEN 'IOException, ParseException' ELSE '' END AS thrown,
       CASE p_size % 12 WHEN 0 THEN 'null' WHEN 1 THEN '0' WHEN 2 THEN '-3L' WHEN 3 THEN 'false' WHEN 4 THEN 'Boolean.TRUE' WHEN 5 THEN '""' WHEN 6 THEN 'new ArrayList<>()' WHEN 7 THEN 'Map.of()' WHEN 8 THEN 'Integer.MIN_VALUE' WHEN 9 THEN 'Long.valueOf( -1 )' WHEN 10 THEN 'List.of()' ELSE 'new BitSet()' END AS arg
      FROM part) p
"""

#: counters per row and construct, of any vintage: some counters are null or 0
STATS = """
SELECT l_orderkey AS row_id, CASE l_partkey % 5 WHEN 0 THEN 'if' WHEN 1 THEN 'else_if' WHEN 2 THEN 'case' WHEN 3 THEN 'ternary' ELSE 'catch' END AS flow,
       CASE l_returnflag WHEN 'R' THEN 'return_behavior' WHEN 'A' THEN 'exception_behavior' ELSE 'side_effect_or_dependency' END AS construct,
       CASE l_partkey % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'numeric' WHEN 2 THEN 'string' WHEN 3 THEN 'collection' WHEN 4 THEN 'object' ELSE 'odd' END AS subcategory,
       l_partkey % 7 AS total, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_partkey % 7 END AS applicable, CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE l_partkey % 5 END AS scorable, l_partkey % 5 AS represented, l_suppkey % 3 AS checked,
       CAST(l_suppkey % 9 AS DOUBLE) / 4 AS score_sum, CASE WHEN l_suppkey % 6 = 0 THEN 0 ELSE l_partkey % 11 END AS total_variants, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey % 4 END AS represented_variants,
       l_partkey % 2 AS not_reached_items, CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE l_suppkey % 4 END AS reached, l_suppkey % 2 AS degenerate_null, l_suppkey % 3 AS degenerate_null_items,
       l_linenumber % 2 AS killed_by_oracle_items, l_linenumber % 3 AS killed_incidentally_items, l_linenumber % 4 AS survived_items, l_linenumber % 5 AS survived_path_changed_items, l_suppkey % 2 AS coverage_unverified_items,
       l_partkey % 3 AS not_generated_items, l_suppkey % 5 AS out_of_scope_items, l_partkey % 4 AS compile_error_items, l_suppkey % 3 AS timeout_items, l_partkey % 6 AS non_representable_items,
       l_orderkey % 2 AS unmeasurable, l_partkey % 8 AS pit_total, l_partkey % 8 % 3 AS pit_covered
FROM lineitem
"""

#: raw rows with logs, of models and of a tool
RUNS = """
SELECT o_orderkey AS row_id, o_orderpriority AS prompt_template,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'gpt-5.4' WHEN o_orderkey % 5 = 1 THEN 'lab/small' WHEN o_orderkey % 5 = 2 THEN '' ELSE 'RedHatAI/gemma-4-31B-it-FP8-Dynamic' END AS model_id,
       CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'compile' WHEN 2 THEN 'execute' WHEN 3 THEN 'compile_timeout' WHEN 4 THEN 'execute_timeout' WHEN 5 THEN 'model_error_429' WHEN 6 THEN 'test' ELSE '' END AS error_stage,
       CASE WHEN o_orderkey % 41 = 0 THEN 'RateLimit' END AS model_error_type, CASE WHEN o_orderkey % 43 = 0 THEN 500 END AS model_error_status_code,
       o_orderkey % 9 = 0 AND o_orderkey % 4 <> 0 AS execution_passed, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 8 <> 0 END AS compile_passed,
       concat('[INFO] build', chr(10), CASE o_custkey % 6 WHEN 0 THEN '[ERROR] Subject.java: cannot find symbol' WHEN 1 THEN 'error: incompatible types: int cannot be converted' WHEN 2 THEN '   unreported exception X must be caught or declared' WHEN 3 THEN 'f() has private access in Subject' WHEN 4 THEN 'error: ; expected' ELSE '' END, chr(10),
              CASE o_custkey % 7 WHEN 0 THEN 'org.opentest4j.AssertionFailedError: expected: <1> but was: <2>' WHEN 1 THEN 'java.lang.NullPointerException: x' WHEN 2 THEN 'Caused by: java.io.IOException: y' WHEN 3 THEN '# SIGSEGV (0xb) at pc' WHEN 4 THEN 'Process Exit Code: 137' WHEN 5 THEN 'java.lang.reflect.InvocationTargetException' ELSE 'done' END, chr(10),
              '>> Line Coverage (for mutated classes only): ', CAST(o_custkey % 100 AS STRING), '%', chr(10), CASE WHEN o_custkey % 3 = 0 THEN concat('>> Line Coverage : 7/', CAST(o_custkey % 50 AS STRING), '  ', chr(10), 'Mutation Coverage: ', CAST(o_custkey % 90 AS STRING), '%', chr(10), 'Test strength :  x') ELSE '' END) AS log,
       CASE o_orderkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'no_mutants' WHEN 2 THEN 'failed' ELSE NULL END AS mutation_status, CASE WHEN o_orderkey % 6 = 0 THEN 'panta_generation' END AS mutation_error_stage,
       CASE WHEN o_orderkey % 7 = 0 THEN 'panta_no_tests' WHEN o_orderkey % 11 = 0 THEN 'other' END AS skip_reason, CASE o_orderkey % 3 WHEN 0 THEN 'passed' WHEN 1 THEN '' ELSE 'skipped' END AS extreme_status,
       o_orderkey % 500 AS test_bytes, CASE WHEN o_orderkey % 3 = 0 THEN 'class T { void testPlaceHolder() {} }' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'class T { }' END AS test_preview,
       CASE o_orderkey % 8 WHEN 0 THEN 'replacement_constructor_incompatible' WHEN 1 THEN 'def_use_out_of_scope' WHEN 2 THEN 'redirect_catch_hazard' WHEN 3 THEN 'redirect_declared_type_not_assignable' WHEN 4 THEN 'replacement_not_assignable_to_declared_type' WHEN 5 THEN 'result_flows_to_computation_or_branch' WHEN 6 THEN 'call_not_found' ELSE NULL END AS operator_rule
FROM orders
"""


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders", "customer")
    return spark.sql(ROWS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(ITEMS)


def mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(MUTANTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def java(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    return spark.sql(JAVA)


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    return spark.sql(METHODS)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    return spark.sql(SIGNATURES)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    return spark.sql(STATS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(RUNS)
