"""Queries over Java text, signatures and logs, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import javasql as Q
from ..functions import semantics as S
from ..operators import obligations as O
from ..sources import readers as IN
from . import standins as T
from .base import query, six

#: lines of a text column as (row_id, line, raw, t): numbered, trimmed, without blank, import, package and comment lines
LINES = r"""L0 AS (SELECT row_id, string_split({c}, chr(10)) AS ls FROM {t}), L1 AS (SELECT row_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS raw FROM L0),
    L AS (SELECT row_id, CAST(line AS INT) AS line, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS t FROM L1), V AS (SELECT * FROM L WHERE t <> '' AND NOT regexp_matches(t, '^(?:import |package |//|/\*|\*)'))"""
METHOD_LINES = LINES.format(c="source", t="METHODS")
INSIDE = r"((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)"


@query(rf"""WITH D AS (SELECT doc_id AS row_id, regexp_replace(text, '\r\n|[\n\r\x{{0B}}\x{{0C}}\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g') AS text FROM documents), {LINES.format(c="text", t="D")}
    SELECT row_id AS doc_id, line, left(t, 240) AS snippet FROM V WHERE regexp_matches(raw, '[0-9]{{6,}}|Licensed')""")
def pattern_lines(spark, sf):
    return O.pattern_lines(T.table(spark, sf, "documents"), "doc_id", "text", "[0-9]{6,}|Licensed")


@query(rf"""WITH {METHOD_LINES},
    S AS (SELECT *, CASE WHEN regexp_matches(t, '\belse\s+if\s*\(') THEN 'else_if' WHEN regexp_matches(t, '\bif\s*\(') THEN 'if' WHEN regexp_matches(t, '\bswitch\s*\(') THEN 'switch' WHEN regexp_matches(t, '\bcase\s+[^:]+\s*:') THEN 'case' WHEN regexp_matches(t, '\bdefault\s*:') THEN 'default' END AS stop,
        regexp_matches(t, '\bfor\s*\([^;:]+:\s*[^)]+\)') AS each_for, CASE WHEN regexp_matches(t, '<[^>]*\?[^>]*>') THEN regexp_replace(t, '<[^>]*\?[^>]*>', '<>', 'g') WHEN regexp_matches(t, '\b(?:class|interface|enum|public|private|protected)\b[^{{;]*\([^)]*\)') THEN '' ELSE t END AS q FROM V),
    W AS (SELECT *, last_value(CASE WHEN stop = 'switch' THEN line END IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY line) AS sw FROM S),
    K AS (SELECT d.row_id, d.line, string_agg(DISTINCT trim(regexp_extract(c.t, '\bcase\s+([^:]+)\s*:', 1)), '|' ORDER BY trim(regexp_extract(c.t, '\bcase\s+([^:]+)\s*:', 1))) AS vals FROM W d JOIN W c ON c.row_id = d.row_id AND c.sw = d.sw AND c.line < d.line AND c.stop = 'case' WHERE d.stop = 'default' GROUP BY ALL),
    I AS (SELECT *, CASE stop WHEN 'if' THEN 'if_condition' WHEN 'else_if' THEN 'else_if_condition' ELSE stop END AS signal, stop AS construct FROM W WHERE stop IN ('if', 'else_if', 'case', 'default')
        UNION ALL SELECT *, 'enhanced_for_iteration', 'enhanced_for_iteration' FROM W WHERE stop IS NULL AND each_for
        UNION ALL SELECT W.*, 'loop_condition_' || o, 'loop_condition' FROM W, (VALUES ('true'), ('false')) v(o) WHERE stop IS NULL AND NOT each_for AND regexp_matches(t, '\b(?:for|while)\s*\(')
        UNION ALL SELECT *, 'try_normal', 'try' FROM W WHERE stop IS NULL AND regexp_matches(t, '\btry\s*\{{') UNION ALL SELECT *, 'catch_exception', 'catch' FROM W WHERE stop IS NULL AND regexp_matches(t, '\bcatch\s*\(')
        UNION ALL SELECT *, 'exception_path', 'exception_path' FROM W WHERE stop IS NULL AND regexp_matches(t, '\bthrow\b') UNION ALL SELECT W.*, 'ternary_' || o, 'ternary' FROM W, (VALUES ('true'), ('false')) v(o) WHERE stop IS NULL AND contains(q, '?') AND contains(q, ':'))
    SELECT I.row_id, I.line, signal, construct, CASE WHEN construct IN ('if', 'else_if') THEN trim(regexp_extract(I.t, '\bif\s*\({INSIDE}\)', 1)) WHEN construct = 'loop_condition' THEN trim(coalesce(nullif(regexp_extract(I.t, '\bfor\s*\({INSIDE}\)', 1), ''), regexp_extract(I.t, '\bwhile\s*\({INSIDE}\)', 1))) END AS condition,
        CASE WHEN construct = 'case' THEN trim(regexp_extract(I.t, '\bcase\s+([^:]+)\s*:', 1)) END AS case_value, CASE WHEN construct = 'default' AND I.sw IS NOT NULL THEN coalesce(vals, '') END AS case_values,
        CASE WHEN construct IN ('case', 'default') THEN trim(regexp_extract(s.t, '\bswitch\s*\({INSIDE}\)', 1)) END AS switch_condition, left(I.t, 240) AS snippet FROM I LEFT JOIN K ON K.row_id = I.row_id AND K.line = I.line LEFT JOIN L s ON s.row_id = I.row_id AND s.line = I.sw""")
def control_flow_obligations(spark, sf):
    return O.control_flow_obligations(T.methods(spark, sf), "row_id", "source").withColumn("case_values", F.array_join("case_values", "|"))


@query()
def control_flow_items(spark, sf):
    return O.control_flow_items(T.methods(spark, sf), "row_id").drop("case_values")


_N = "regexp_extract(m, '(<=|>=|==|!=|<|>)', 1)"


@query(rf"""WITH B AS (SELECT *, regexp_extract(regexp_replace(source, '/\*.*?\*/|//[^\n]*', '', 'gs'), '(?s)\bf\(int n.*$', 0) AS body, row_id % 5 AS k,
        list_concat([arg], CASE row_id % 5 WHEN 2 THEN [1] WHEN 3 THEN [0] ELSE [] END) AS ns FROM METHODS),
    M AS (SELECT *, unnest(list_distinct(list_concat(regexp_extract_all(body, '\bn\s*(?:<=|>=|==|!=|<|>)\s*\d+'), regexp_extract_all(body, '\d+\s*(?:<=|>=|==|!=|<|>)\s*n\b')))) AS m FROM B),
    N AS (SELECT *, CAST(regexp_extract(m, '(\d+)', 1) AS BIGINT) AS v, concat('number:', {_N}, ':', regexp_extract(m, '(\d+)', 1), '.0:', m) AS b FROM M),
    S AS (SELECT *, contains(body, concat('s.equals("', brand, '")')) AS has FROM B)
    SELECT row_id, 0 AS parameter, 'zero' AS category, NULL AS bound, list_contains(ns, 0) AS covered FROM B UNION ALL SELECT row_id, 0, 'negative', NULL, list_min(ns) < 0 FROM B
    UNION ALL SELECT row_id, 1, 'null', NULL, sarg = 'null' FROM B UNION ALL SELECT row_id, 1, 'empty', NULL, sarg = '""' FROM B
    UNION ALL SELECT row_id, 0, 'below_inferred_bound', b, list_min(ns) < v FROM N UNION ALL SELECT row_id, 0, 'at_inferred_bound', b, list_contains(ns, v) FROM N UNION ALL SELECT row_id, 0, 'above_inferred_bound', b, list_max(ns) > v FROM N
    UNION ALL SELECT row_id, 1, 'same_inferred_bound', concat('string:equals:', brand, ':s.equals("', brand, '")'), sarg = concat('"', brand, '"') FROM S WHERE has
    UNION ALL SELECT row_id, 1, 'different_inferred_bound', concat('string_literals_all:', substr(sha1(concat('["', brand, '"]')), 1, 12)), sarg IN ('""', '"other"') OR k = 2 FROM S WHERE has""")
def boundary_evidence(spark, sf):
    return O.boundary_evidence(T.methods(spark, sf), "row_id")


@query()
def boundary_row_scores(spark, sf):
    return six(O.boundary_row_scores(T.methods(spark, sf), "row_id"))


@query(rf"""WITH {METHOD_LINES}, A AS (SELECT row_id, min(line) AS a FROM L WHERE regexp_matches(raw, '\bf\(int n') GROUP BY row_id)
    SELECT V.row_id, line, left(t, 240) AS snippet FROM V JOIN A ON A.row_id = V.row_id AND line >= a JOIN METHODS m ON m.row_id = V.row_id WHERE kind <> 'void' AND regexp_matches(t, '\breturn\s+[^;]+;') AND NOT (shape = 5 AND t = 'return 8;')""")
def return_obligations(spark, sf):
    return O.return_obligations(T.methods(spark, sf), "row_id")


@query(rf"""WITH {METHOD_LINES} SELECT row_id, line, left(t, 240) AS snippet FROM V WHERE regexp_matches(raw, '\bthrow\b')""")
def exception_obligations(spark, sf):
    return O.exception_obligations(T.methods(spark, sf), "row_id", "source")


@query()
def dependency_obligations(spark, sf):
    return O.dependency_obligations(T.methods(spark, sf), "row_id")


@query()
def assertion_mutation_items(spark, sf):
    return O.assertion_mutation_items(T.methods(spark, sf), "row_id")


@query()
def obligation_totals(spark, sf):
    return O.obligation_totals(T.methods(spark, sf), "row_id")


@query("""SELECT row_id, 5 AS line, 'count += n;' AS snippet, 'count' AS target, 'static_field' AS scope, unnest(['zero', 'negative', 'positive_normal']) AS "case" FROM METHODS WHERE contains(source, 'count += n')
    UNION ALL SELECT row_id, 6, 'Other.last = s;', 'Other.last', 'static_class_property', 'positive_normal' FROM METHODS WHERE contains(source, 'Other.last = s')""")
def state_obligations(spark, sf):
    return O.state_obligations(T.methods(spark, sf), "row_id")


@query()
def state_evidence(spark, sf):
    return O.state_evidence(T.methods(spark, sf), "row_id")


@query()
def case_and_fallback_mutants(spark, sf):
    return O.case_and_fallback_mutants(T.methods(spark, sf), "row_id")


@query(r"""WITH L0 AS (SELECT row_id, kind, string_split(source, chr(10)) AS ls FROM METHODS), L AS (SELECT row_id, kind, generate_subscripts(ls, 1) AS line, unnest(ls) AS raw FROM L0),
    R AS (SELECT row_id, kind, CAST(line AS INT) AS line, trim(regexp_extract(raw, '\breturn\s+([^;]+);', 1)) AS v FROM L WHERE regexp_matches(raw, '\breturn\s+[^;]+;')),
    N AS (SELECT *, regexp_matches(v, '^-?[0-9]+$') AS num FROM R)
    SELECT row_id, line, CASE kind WHEN 'boolean' THEN 'boolean_negate' WHEN 'String' THEN 'string_expression_concatenated_noop_safe' WHEN 'int' THEN CASE WHEN num THEN 'numeric_zero_or_one_literal_only' ELSE 'integral_expression_plus_one_noop_safe' END ELSE 'opaque_object_degenerate_null' END AS operator_rule,
        true AS generated, CASE kind WHEN 'boolean' THEN 'boolean' WHEN 'String' THEN 'string' WHEN 'int' THEN 'numeric' ELSE 'object' END AS subcategory FROM N WHERE v <> '' AND kind <> 'void'""")
def return_rules(spark, sf):
    return O.return_rules(T.methods(spark, sf).where("kind <> 'void'"), "row_id")


@query("""SELECT row_id, 'Inner' AS name, CAST(NULL AS STRING) AS signal, shape = 5 AS makeable FROM METHODS UNION ALL SELECT row_id, 'Subject', CASE WHEN shape IN (3) THEN NULL END, true FROM METHODS""")
def class_observability(spark, sf):
    return O.class_observability(T.methods(spark, sf).withColumn("names", F.array(F.lit("Inner"), F.lit("Subject"))), "row_id", "names")


@query()
def oracle_mutants(spark, sf):
    return O.oracle_mutants(T.methods(spark, sf), "row_id")


@query()
def condition_outcomes(spark, sf):
    return O.condition_outcomes(T.methods(spark, sf), "row_id")


@query()
def case_outcomes(spark, sf):
    return O.case_outcomes(T.methods(spark, sf), "row_id")


@query()
def test_evidence(spark, sf):
    return O.test_evidence(T.methods(spark, sf), "row_id").withColumn("helpers", F.array_join("helpers", ","))


@query()
def oracle_matches(spark, sf):
    return O.oracle_matches(T.methods(spark, sf), "row_id")


@query()
def exception_strength(spark, sf):
    thrown = O.exception_obligations(T.methods(spark, sf), "row_id", "source").groupBy("row_id").agg(F.count(F.lit(1)).alias("exception_obligations"))
    return six(O.exception_strength(O.test_evidence(T.methods(spark, sf), "row_id").drop("helpers").join(thrown, "row_id")))


@query()
def observable_contract(spark, sf):
    return O.observable_contract(T.methods(spark, sf), "row_id")


@query()
def unresolved_arguments(spark, sf):
    return six(O.unresolved_arguments(T.methods(spark, sf), "row_id").withColumn("examples", F.array_join("examples", ";")))


@query(r"""SELECT row_id, 1 AS parameter, 's' AS name FROM METHODS WHERE regexp_matches(source, '\bs\s*[!=]=\s*null')""")
def nullable_parameters(spark, sf):
    return O.nullable_parameters(T.methods(spark, sf), "row_id")


@query()
def source_signals(spark, sf):
    return O.source_signals(T.methods(spark, sf), "row_id").select("row_id", F.array_join("signals", ",").alias("signals"), F.array_join("mentions", ",").alias("mentions"))


@query(r"""WITH N AS (SELECT row_id, list_concat(regexp_extract_all(source, '(?:<=|<|>=|>|==|!=)\s*(-?\d+)', 1), regexp_extract_all(source, '(-?\d+)\s*(?:<=|<|>=|>|==|!=)', 1)) AS n FROM METHODS)
    SELECT row_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(n, lambda x: CAST(x AS BIGINT)))), lambda x: concat(CAST(x AS STRING), '.0')), ',') AS numeric_bounds, '' AS lengths FROM N""")
def boundary_constraints(spark, sf):
    out = O.boundary_constraints(T.methods(spark, sf), "row_id")
    return out.select("row_id", F.array_join(F.transform("numeric_bounds", lambda x: x.cast("string")), ",").alias("numeric_bounds"), F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",").alias("lengths"))


@query(rf"""WITH {METHOD_LINES}, K AS (SELECT row_id, line, left(t, 160) AS snippet, unnest(list_filter([CASE WHEN regexp_matches(t, '\b(?:if|while|switch)\s*\(') THEN 'condition' END, CASE WHEN regexp_matches(t, '\bfor\s*\(') THEN 'loop' END,
        CASE WHEN regexp_matches(t, '\bthrow\b|\bcatch\s*\(') THEN 'exception' END, CASE WHEN regexp_matches(t, '\breturn\b') THEN 'return' END], lambda x: x IS NOT NULL)) AS kind FROM V)
    SELECT row_id, kind, place, snippet FROM (SELECT *, CAST(row_number() OVER (PARTITION BY row_id, kind ORDER BY line) AS INT) AS place FROM K) WHERE place <= 2""")
def prompt_context(spark, sf):
    return O.prompt_context(T.methods(spark, sf), "row_id", 2)


_BARE = r"""regexp_replace(regexp_replace(test_code, '"[^"]*"', '""', 'g'), '//[^\n]*', ' ', 'g')"""
_FEATURES = ("assertions", "equals", "throws", "nulls", "fails", "tests", "object_creation_count", "catch_clause_count", "method_invocation_count", "target_calls")


@query(rf"""WITH B AS (SELECT row_id, {_BARE} AS b FROM METHODS) SELECT row_id, {', '.join(f"len(regexp_extract_all(b, '{O.FEATURES[n]}'))::INT AS {n}" for n in _FEATURES)},
    regexp_matches(b, 'getDeclared|setAccessible\s*\(') AS uses_reflection, regexp_matches(b, 'throw\s+new\s+AssertionError\b') AS uses_manual_assertion_error FROM B""")
def assertion_features(spark, sf):
    return O.assertion_features(T.methods(spark, sf), "row_id", "test_code").select("row_id", *_FEATURES, "uses_reflection", "uses_manual_assertion_error")


# --- signatures and types


@query("SELECT row_id, name, t1, t2, 'first,second' AS names, returns, is_private, replace(thrown, ', ', ',') AS thrown FROM SIGNATURES")
def signature_parts(spark, sf):
    s = F.col("s")
    out = T.signatures(spark, sf).select("row_id", Q.signature("signature").alias("s"))
    return out.select("row_id", s["name"].alias("name"), F.get(s["types"], F.lit(0)).alias("t1"), F.get(s["types"], F.lit(1)).alias("t2"), F.array_join(s["names"], ",").alias("names"), s["returns"].alias("returns"), s["private"].alias("is_private"), F.array_join(s["throws"], ",").alias("thrown"))


_NUMERIC = "('int', 'Integer', 'java.math.BigDecimal', 'long', 'double')"
_BOOLEAN = "('boolean', 'java.lang.Boolean', 'Boolean')"
_HELD = "('Map<String, List<Integer>>', 'int[]', 'Optional<Set<String>>', 'java.util.List<String>')"
_TEXT = "('String', 'CharSequence')"


@query(f"""WITH U AS (SELECT row_id, 0 AS parameter, t1 AS t FROM SIGNATURES UNION ALL SELECT row_id, 1, t2 FROM SIGNATURES)
    SELECT row_id, parameter, array_to_string(list_filter([CASE WHEN t IN {_TEXT} OR t IN {_HELD} THEN 'empty' END, CASE WHEN t IN {_BOOLEAN} THEN 'false_value' END, CASE WHEN t IN {_NUMERIC} THEN 'negative' END,
        CASE WHEN t NOT IN ('int', 'long', 'double', 'boolean', 'char') THEN 'null' END, CASE WHEN t IN {_BOOLEAN} THEN 'true_value' END, CASE WHEN t IN {_NUMERIC} THEN 'zero' END], lambda x: x IS NOT NULL), ',') AS categories FROM U""")
def type_categories(spark, sf):
    out = T.signatures(spark, sf).select("row_id", F.posexplode(Q.signature("signature")["types"]).alias("parameter", "t"))
    return out.select("row_id", "parameter", F.array_join(Q.type_categories(F.col("t")), ",").alias("categories"))


@query(f"""WITH U AS (SELECT row_id, arg, t1 AS t, 0 AS parameter FROM SIGNATURES UNION ALL SELECT row_id, arg, t2, 1 FROM SIGNATURES)
    SELECT row_id, parameter, CASE WHEN arg = 'null' THEN 'null' WHEN t IN {_NUMERIC} THEN CASE WHEN arg = '0' THEN 'zero' WHEN regexp_matches(arg, '^-|MIN_VALUE|\\( -') THEN 'negative' ELSE '' END
        WHEN t IN {_BOOLEAN} THEN CASE WHEN lower(arg) LIKE '%false' THEN 'false_value' WHEN lower(arg) LIKE '%true' THEN 'true_value' ELSE '' END WHEN t IN {_TEXT} AND arg = '""' OR t IN {_HELD} AND arg IN ('new ArrayList<>()', 'List.of()') THEN 'empty' ELSE '' END AS categories FROM U""")
def argument_categories(spark, sf):
    out = T.signatures(spark, sf).select("row_id", "arg", F.posexplode(Q.signature("signature")["types"]).alias("parameter", "t"))
    return out.select("row_id", "parameter", F.array_join(Q.argument_categories(F.col("arg"), F.col("t")), ",").alias("categories"))


@query(r"""SELECT row_id, CASE WHEN returns = 'int' THEN 'numeric' WHEN returns LIKE '%[]' THEN 'array' WHEN returns LIKE 'List<%' OR returns LIKE 'Map<%' THEN 'collection' WHEN returns LIKE '%String' THEN 'string' ELSE 'domain_object' END AS category,
    regexp_replace(returns, '<.*>', '') AS erased, regexp_extract(regexp_replace(t1, '<.*>', ''), '([^.]*)$', 1) AS simple, CASE WHEN t1 LIKE 'Class<%' THEN 'Node' END AS class_bound, regexp_extract(t1, '<(.*)>', 1) AS generics FROM SIGNATURES""")
def return_type_categories(spark, sf):
    r, t = F.col("s.returns"), F.get(F.col("s.types"), F.lit(0))
    out = T.signatures(spark, sf).select("row_id", Q.signature("signature").alias("s"))
    return out.select("row_id", C.return_type_category(r).alias("category"), Q.erased(r).alias("erased"), Q.simple_name(t).alias("simple"), Q.class_bound(t).alias("class_bound"), F.array_join(Q.generic_arguments(t), ", ").alias("generics"))


@query("""WITH U AS (SELECT row_id, unnest(string_split(thrown, ', ')) AS e FROM SIGNATURES WHERE thrown <> '') SELECT row_id, regexp_extract(e, '([^.]*)$', 1) AS name, true AS checked, false AS broad FROM U""")
def thrown_types(spark, sf):
    out = T.signatures(spark, sf).select("row_id", F.explode(Q.signature("signature")["throws"]).alias("e"))
    return out.select("row_id", Q.simple_name(F.col("e")).alias("name"), Q.is_checked_exception(F.col("e")).alias("checked"), Q.is_broad_exception(F.col("e")).alias("broad"))


# --- snippets


_KINDS = r"""CASE WHEN regexp_matches(t, '\bset[A-Z]\w*\s*\(|\.set\s*\(') THEN 'setter_or_set_call' WHEN regexp_matches(t, '\.(?:add|put|remove|clear)\s*\(') THEN 'collection_mutation' WHEN regexp_matches(t, '\+\+|--|\+=|-=') THEN 'increment_or_compound_update'
    WHEN regexp_matches(t, '\w+\s*=') THEN 'field_assignment' ELSE 'other_state_write' END"""


@query(rf"""WITH {METHOD_LINES} SELECT row_id, line, {_KINDS} AS state, CASE WHEN regexp_matches(t, '\b(?:Files|Reader|Writer)\b') THEN 'filesystem_or_stream' WHEN regexp_matches(t, '\.(?:connect|getResponseCode)\s*\(|\b\w+\.(?:send|execute)\s*\(') THEN 'network_or_http' ELSE 'other_dependency' END AS dependency,
    CASE WHEN regexp_matches(t, '\bthrow\s+new\b|\bthrows\s+\w+') THEN 'exception_path' WHEN regexp_matches(t, '\btry\s*\{{') THEN 'try' WHEN regexp_matches(t, '\bcatch\s*\(') THEN 'catch' WHEN regexp_matches(t, '\bcase\s+') THEN 'case' WHEN regexp_matches(t, '\bdefault\s*:') THEN 'default' WHEN regexp_matches(t, '\belse\s+if\s*\(') THEN 'else_if'
        WHEN regexp_matches(t, '\belse\b') THEN 'else' WHEN regexp_matches(t, '\bif\s*\(') THEN 'if' WHEN regexp_matches(t, '\bfor\s*\([^;:]+:') THEN 'enhanced_for_iteration' WHEN regexp_matches(t, '\bfor\s*\(|\bwhile\s*\(') THEN 'loop_condition' WHEN contains(t, '?') THEN 'ternary' ELSE 'other' END AS branch FROM V""")
def snippet_kinds(spark, sf):
    t = F.col("text")
    return O.source_lines(T.methods(spark, sf), "row_id", "source").select("row_id", "line", C.state_kind(t).alias("state"), C.dependency_kind(t).alias("dependency"), C.branch_kind(t).alias("branch"))


@query(rf"""WITH {METHOD_LINES}, P AS (SELECT row_id, 1 + row_id % 20 AS n FROM METHODS) SELECT P.row_id, left(t, 500) AS text, coalesce(contains(t, '?') OR len(regexp_extract_all(t, '\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\(')) > 1, false) AS imprecise FROM P LEFT JOIN L ON L.row_id = P.row_id AND L.line = P.n""")
def mutated_lines(spark, sf):
    text = Q.mutated_line(F.col("source"), (1 + F.col("row_id") % 20).cast("int"))
    return T.methods(spark, sf).select("row_id", text.alias("text")).withColumn("imprecise", Q.imprecise_line(F.col("text")))


@query(r"""SELECT row_id, CASE WHEN shape < 3 THEN regexp_replace(source, '^\s+|\s+$', '', 'g') ELSE concat('no code for ', brand) END AS code, CASE WHEN shape = 1 THEN concat('{"a": ', CAST(bound AS STRING), '}') WHEN shape < 3 THEN regexp_extract(source, '(?s)(\{.*\})', 1) END AS object FROM METHODS WHERE shape <> 1
    UNION ALL SELECT row_id, concat('{"a": ', CAST(bound AS STRING), '}'), concat('{"a": ', CAST(bound AS STRING), '}') FROM METHODS WHERE shape = 1""")
def reply_code(spark, sf):
    reply = F.when(F.col("shape") == 1, F.concat(F.lit("Sure:\n```\n{\"a\": "), F.col("bound").cast("string"), F.lit("}\n```"))).when(F.col("shape") < 3, F.concat(F.lit("Here:\n```java\n"), "source", F.lit("\n```\nDone ```x```"))).otherwise(F.concat(F.lit("no code for "), "brand"))
    return T.methods(spark, sf).select("row_id", Q.fenced_code(reply).alias("code"), Q.json_object(reply).alias("object"))


@query(r"""SELECT row_id, len(list_filter(regexp_split_to_array(test_code, ';|\n\s*\n'), lambda x: regexp_matches(x, '\S'))) AS windows, regexp_replace(brand, '[^A-Za-z0-9_.-]+', '_', 'g') AS label, concat(replace(concat('a.b.', brand), '.', '/'), '.java') AS path,
    (regexp_matches(test_code, '\bgot\b')) AS has_got, len(regexp_extract_all(source, '\breturn\b')) + len(regexp_extract_all(source, '\bint\b')) AS hits FROM METHODS""")
def text_counts(spark, sf):
    return T.methods(spark, sf).select(
        "row_id", F.size(Q.statement_windows(F.col("test_code"))).cast("long").alias("windows"), Q.safe_label(F.col("brand")).alias("label"), Q.class_path(F.concat(F.lit("a.b."), "brand")).alias("path"),
        F.col("test_code").rlike(r"\bgot\b").alias("has_got"), Q.pattern_count(F.col("source"), [r"\breturn\b", r"\bint\b"]).alias("hits"),
    )


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\bth[a-z]+')) AS hits, regexp_matches(text, '[^\x00-\x7F]|[\x00-\x08\x0B\x0C\x0E-\x1F]') AS unicode FROM documents""")
def pattern_counts(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", Q.pattern_count(F.col("text"), [r"\bth[a-z]+"]).alias("hits"), Q.has_unicode_boundary(F.col("text")).alias("unicode"))


@query(r"""SELECT row_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_extract(test_code, 'Subject\.f\(([^;]*)\);', 1), '"[^"]*"', '""', 'g'), '-?\d+'), lambda x: concat(x, '.0')), ',') AS numbers FROM METHODS""")
def numeric_literals(spark, sf):
    call = F.regexp_extract("test_code", r"Subject\.f\(([^;]*)\);", 1)
    return T.methods(spark, sf).select("row_id", F.array_join(F.transform(Q.all_numbers(call), lambda x: x.cast("string")), ",").alias("numbers"))


@query("""SELECT row_id, coalesce(CASE row_id % 3 WHEN 0 THEN 'own.Test' END, CASE WHEN shape = 0 THEN 'a.b.Subject' ELSE 'Subject' END) AS test_class, CASE WHEN shape = 0 THEN 'a.b' END AS package FROM METHODS""")
def test_classes(spark, sf):
    explicit = F.when(F.col("row_id") % 3 == 0, "own.Test").otherwise("")
    return T.methods(spark, sf).select("row_id", Q.test_class(explicit, F.col("source"), "benchmark.SubjectTest").alias("test_class"), Q.package_name(F.col("source")).alias("package"))


# --- logs and outcomes


_COMPILE = r"""CASE WHEN regexp_matches(log, 'cannot find symbol|symbol:\s+(?:class|method|variable)|no suitable method|constructor .* cannot be applied', 'i') THEN 'unresolved_symbol_or_api_misuse' WHEN regexp_matches(log, 'incompatible types|bad operand types|cannot be converted|unexpected type', 'i') THEN 'type_mismatch'
    WHEN regexp_matches(log, 'unreported exception .* must be caught or declared', 'i') THEN 'checked_exception_not_handled' WHEN regexp_matches(log, 'has private access|setAccessible|IllegalAccessException', 'i') THEN 'private_or_reflection_access' ELSE 'syntax_or_other_compile_error' END"""
_EXECUTE = r"""CASE WHEN regexp_matches(log, 'AssertionError|expected[=<:]|Expected .* but|Expected .*exception|expected message|but was', 'i') THEN 'wrong_oracle' WHEN regexp_matches(log, 'Exception while executing|NullPointerException|IndexOutOfBounds|IllegalArgumentException|NumberFormatException', 'i') THEN 'uncaught_runtime_exception' ELSE 'other_execution_failure' END"""
_FAILURE = f"""CASE WHEN error_stage IN ('execute_timeout', 'compile_timeout') THEN 'execution_failure/timeout_or_hang' WHEN error_stage = 'compile' THEN 'compile_failure/' || {_COMPILE} WHEN error_stage = 'execute' THEN 'execution_failure/' || {_EXECUTE} ELSE 'unknown/unknown' END"""


@query(f"""SELECT row_id, CASE WHEN coalesce(execution_passed, false) THEN 'passed/passed' WHEN coalesce(test_bytes <= 300 AND contains(test_preview, 'testPlaceHolder'), false) THEN 'generation_failure/panta_placeholder_stub' ELSE {_FAILURE} END AS failure FROM RUNS""")
def failure_classes(spark, sf):
    stub = C.is_placeholder(F.col("test_bytes"), F.col("test_preview"))
    return T.runs(spark, sf).select("row_id", C.row_failure(F.col("execution_passed"), stub, F.col("log"), F.coalesce("error_stage", F.lit(""))).alias("f")).select("row_id", F.concat_ws("/", "f.family", "f.category").alias("failure"))


_MODEL = """CASE coalesce(nullif(model_id, ''), 'unknown-model') WHEN 'RedHatAI/gemma-4-31B-it-FP8-Dynamic' THEN 'Gemma-4-31B' WHEN 'gpt-5.4' THEN 'GPT-5.4' WHEN 'lab/small' THEN 'small' ELSE 'unknown-model' END"""


@query(f"""WITH E AS (SELECT *, coalesce(error_stage, '') AS st, coalesce(model_error_type, '') AS et, coalesce(CAST(model_error_status_code AS STRING), '') AS ec FROM RUNS)
    SELECT row_id, {_MODEL} AS model, CASE WHEN st LIKE 'model\\_error%' ESCAPE '\\' OR et <> '' OR ec <> '' THEN 'model_generation_failure' WHEN coalesce(execution_passed, false) THEN 'passed' WHEN st LIKE '%timeout' THEN 'timeout_or_hang' WHEN st IN ('compile', 'execute') THEN split_part({_FAILURE}, '/', 1) WHEN compile_passed = false THEN 'compile_failure' ELSE 'unknown_failure' END AS outcome,
        CASE WHEN st LIKE 'model\\_error%' ESCAPE '\\' OR et <> '' OR ec <> '' THEN trim(concat(CASE WHEN et = '' THEN 'model_error' ELSE et END, ' ', CASE WHEN ec <> '' THEN ec ELSE replace(st, 'model_error_', '') END)) WHEN coalesce(execution_passed, false) THEN 'generated test compiled and executed' WHEN st LIKE '%timeout' THEN st
            WHEN st IN ('compile', 'execute') THEN split_part({_FAILURE}, '/', 2) WHEN compile_passed = false THEN 'compile_passed is false' ELSE concat('error_stage=', st) END AS detail FROM E""")
def raw_outcomes(spark, sf):
    o = C.raw_outcome(F.col("execution_passed"), F.col("compile_passed"), F.col("error_stage"), F.col("log"), F.col("model_error_type"), F.col("model_error_status_code"))
    return T.runs(spark, sf).select("row_id", C.short_model(F.col("model_id")).alias("model"), o.alias("o")).select("row_id", "model", "o.*")


@query("""WITH E AS (SELECT row_id, coalesce(mutation_status, '') AS m, coalesce(mutation_error_stage, '') AS g, coalesce(skip_reason, '') AS k, extreme_status AS x FROM RUNS)
    SELECT row_id, CASE WHEN m IN ('passed', 'no_mutants') AND x IN ('', 'passed') THEN 'passed' WHEN g = 'panta_generation' OR starts_with(k, 'panta_') THEN 'panta_generation_failure' WHEN m = 'failed' OR x NOT IN ('', 'passed') THEN 'passed' ELSE 'unknown_failure' END AS outcome,
        CASE WHEN m IN ('passed', 'no_mutants') AND x IN ('', 'passed') THEN 'Panta generation and mutation evidence available' WHEN g = 'panta_generation' OR starts_with(k, 'panta_') THEN coalesce(nullif(k, ''), g) WHEN m = 'failed' OR x NOT IN ('', 'passed') THEN 'Panta generated a test; later mutation evidence failed or was skipped'
            ELSE concat('mutation_status=', m, ', panta_skip_reason=', k) END AS detail FROM E""")
def tool_outcomes(spark, sf):
    o = C.tool_outcome(*(F.col(c) for c in ("mutation_status", "mutation_error_stage", "skip_reason", "extreme_status")))
    return T.runs(spark, sf).select("row_id", o.alias("o")).select("row_id", "o.*")


@query(r"""SELECT row_id, nullif(trim(regexp_extract(log, 'Line Coverage\s*:\s*([^\n\r]+)', 1)), '') AS line_coverage, nullif(trim(regexp_extract(log, 'Mutation Coverage\s*:\s*([^\n\r]+)', 1)), '') AS mutation_coverage, nullif(trim(regexp_extract(log, 'Test strength\s*:\s*([^\n\r]+)', 1)), '') AS test_strength FROM RUNS""")
def pit_log_summary(spark, sf):
    return T.runs(spark, sf).select("row_id", IN.pit_summary(F.col("log")).alias("p")).select("row_id", "p.*")


@query(r"""SELECT row_id, array_to_string(list_transform(list_slice(list_filter(string_split(log, chr(10)), lambda x: contains(x, '[ERROR]') OR contains(x, 'Exception') OR contains(x, 'AssertionError') OR contains(x, 'error:')), 1, 4), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' / ') AS evidence, right(log, 40) AS bundle FROM RUNS""")
def first_errors(spark, sf):
    return T.runs(spark, sf).select("row_id", C.first_error_lines(F.col("log")).alias("evidence"), IN.log_bundle(F.col("log"), F.lit(None).cast("string"), n=40).alias("bundle"))


@query(r"""SELECT row_id, CASE WHEN contains(log, 'AssertionFailedError') THEN 'killed_by_oracle' WHEN regexp_matches(log, 'SIGSEGV|Exit Code: 137|NullPointerException|IOException') THEN 'killed_incidentally' ELSE 'coverage_unverified' END AS outcome,
    CASE WHEN contains(log, 'AssertionFailedError') THEN 'assertion_failure:org.opentest4j.AssertionFailedError' WHEN contains(log, 'SIGSEGV') THEN 'jvm_crash' WHEN contains(log, 'Exit Code: 137') THEN 'process_terminated:137' WHEN contains(log, 'NullPointerException') THEN 'unhandled_exception:java.lang.NullPointerException'
        WHEN contains(log, 'IOException') THEN 'unhandled_exception:java.io.IOException' ELSE 'failure_type_unverified' END AS reason FROM RUNS""")
def kill_classes(spark, sf):
    return T.runs(spark, sf).select("row_id", C.kill_class(F.col("log")).alias("k")).select("row_id", "k.*")


@query("""SELECT row_id, CASE WHEN operator_rule LIKE 'replacement%' THEN 'not_generated' WHEN regexp_matches(coalesce(operator_rule, ''), 'out_of_scope|flows_to|hazard|not_assignable') THEN 'out_of_scope' ELSE 'not_generated' END AS status,
    array_to_string(list_filter([CASE WHEN test_bytes % 2 = 0 THEN 'degenerate_null' END, CASE WHEN test_bytes % 3 = 0 THEN 'subsumed_by_broad_original' END, CASE WHEN mutation_status = 'failed' THEN 'coverage_unverified' WHEN mutation_status = 'passed' THEN 'path_coverage_changed' END], lambda x: x IS NOT NULL), ',') AS tags FROM RUNS""")
def unwritten_mutants(spark, sf):
    status = F.when(F.col("mutation_status") == "failed", "coverage_unverified").when(F.col("mutation_status") == "passed", "survived_path_changed")
    tags = C.mutant_tags({"degenerate_null": F.col("test_bytes") % 2 == 0, "subsumed_by_broad_original": F.col("test_bytes") % 3 == 0}, status)
    return T.runs(spark, sf).select("row_id", C.unwritten_status(F.col("operator_rule")).alias("status"), F.array_join(tags, ",").alias("tags"))


@query("""SELECT row_id, CASE WHEN NOT coalesce(execution_passed, false) THEN 'original_generated_test_not_executed' WHEN model_id IS NULL THEN 'missing_subject_java' WHEN coalesce(target_is_private, false) THEN 'private_target_method' END AS reason FROM ROWS""")
def skipped_evidence(spark, sf):
    return T.rows(spark, sf).select("row_id", C.skipped_evidence(F.col("execution_passed"), F.col("target_is_private"), F.col("model_id"))["reason"].alias("reason"))


@query("""SELECT row_id, coalesce(nullif(prompt_template, ''), 'x') AS bucket, CASE WHEN test_bytes = 0 THEN '' ELSE printf('%.3f', row_id % 7 / test_bytes) END AS shown,
    concat(CAST(row_id AS STRING), '/', coalesce(model_id, '')) AS k FROM RUNS""")
def row_keys(spark, sf):
    rows = T.runs(spark, sf).withColumn("task", F.struct(F.col("prompt_template").alias("dataset"), F.lit("").alias("v2_primary_split"))).withColumn("complexity_bucket", F.lit(None).cast("string"))
    key = S.row_keys(rows, "row_id", "model_id")
    return rows.select("row_id", S.bucket_chain(rows).alias("bucket"), S.percent(F.col("row_id") % 7, "test_bytes").alias("shown"), F.concat_ws("/", key["row_id"], key["model_id"]).alias("k"))


@query(r"""WITH X AS (SELECT row_id, 1 + row_id % 12 AS n, source FROM METHODS), Y AS (SELECT row_id, string_split(source, chr(10)) AS ls, n FROM X), Z AS (SELECT row_id, CASE WHEN n <= len(ls) THEN array_to_string(list_slice(ls, greatest(1, n - 2), n + 2), chr(10)) ELSE '' END AS c FROM Y)
    SELECT row_id, array_to_string(list_filter([CASE WHEN regexp_matches(c, '\bif\s*\(|\belse\b|\bswitch\s*\(|\bcase\s+|\bdefault\s*:|\bfor\s*\(|\bwhile\s*\(|\btry\s*\{|\bcatch\s*\(|\bthrow\b|\bthrows\b|\?') THEN 'branch_condition' END,
        CASE WHEN regexp_matches(c, '\bthrow\b|\bthrows\b|\bcatch\s*\(|\b(?:Exception|Error|Throwable)\b') THEN 'exception_path' END, 'weak_oracle'], lambda x: x IS NOT NULL), ',') AS categories FROM Z""")
def mutator_context(spark, sf):
    near = C.context_lines(F.col("source"), (1 + F.col("row_id") % 12).cast("int"))
    return T.methods(spark, sf).select("row_id", F.array_join(C.mutator_categories(F.lit("ReturnValsMutator"), F.lit(""), near), ",").alias("categories"))
