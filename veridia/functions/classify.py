"""Ordered classification rules: the first that matches names the class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import first_nonempty, truthy

# --- fixed values: classes in order of precedence, with their patterns
COMPILE_RULES = (
    ("unresolved_symbol_or_api_misuse", r"cannot find symbol|symbol:\s+class|symbol:\s+method|symbol:\s+variable|no suitable method|constructor .* cannot be applied"),
    ("type_mismatch", r"incompatible types|bad operand types|cannot be converted|unexpected type"),
    ("checked_exception_not_handled", r"unreported exception .* must be caught or declared"),
    ("private_or_reflection_access", r"has private access|setAccessible|IllegalAccessException|InaccessibleObjectException"),
)
EXECUTION_RULES = (
    ("wrong_oracle", r"AssertionError|expected[=<:]|Expected .* but|Expected .*exception|expected message|Expected message|but was"),
    ("uncaught_runtime_exception", r"Exception while executing|An exception occurred while executing|NullPointerException|IndexOutOfBoundsException|IllegalArgumentException|NumberFormatException"),
)
BOUNDARY_CATEGORIES = ("null", "empty", "false_value", "true_value", "zero", "negative", "below_inferred_bound", "at_inferred_bound", "above_inferred_bound", "same_inferred_bound", "different_inferred_bound")
PROFILE_CATEGORIES = ("boundary_value", "weak_oracle", "branch_condition", "state_transition", "interaction_dependency")
CONTROL_FLOW_DISPLAY = ("if", "else_if", "case", "default", "catch", "exception_path", "ternary", "other")
RUN_OUTCOMES = ("passed", "model_generation_failure", "compile_failure", "execution_failure", "timeout_or_hang", "panta_generation_failure", "unknown_failure")
STRATEGIES = ("zero-shot", "p3-intention-planning", "p5-mutation-feedback", "panta")
RETURN_SUBCATEGORIES = ("boolean", "numeric", "string", "collection", "enum_or_class", "object")
PRIMARY_CONSTRUCTS = ("return_behavior", "exception_behavior")
NOT_REPRESENTED = ("coverage_unverified", "out_of_scope", "compile_error", "timeout", "command_missing", "not_generated")
NON_REPRESENTABLE = ("not_generated", "out_of_scope", "compile_error", "timeout", "coverage_unverified")


def first_match(text: Column, rules, default: str) -> Column:
    """Name of the first (name, pattern) rule found in ``text``, letters of either case."""
    out = None
    for name, pattern in rules:
        hit = F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def all_matches(text: Column, rules) -> Column:
    """Names of all rules found in ``text``, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text.rlike("(?i)" + p), F.lit(False)), n) for n, p in rules]))


def failure_class(log: Column, stage: Column) -> Column:
    """struct(family, category) of a failed run from its log and stage."""
    timeout = stage.isin("execute_timeout", "compile_timeout")
    family = F.when(timeout | (stage == "execute"), "execution_failure").when(stage == "compile", "compile_failure").otherwise("unknown")
    category = (
        F.when(timeout, "timeout_or_hang")
        .when(stage == "compile", first_match(log, COMPILE_RULES, "syntax_or_other_compile_error"))
        .when(stage == "execute", first_match(log, EXECUTION_RULES, "other_execution_failure"))
        .otherwise("unknown")
    )
    return F.struct(family.alias("family"), category.alias("category"))


def row_failure(execution_passed: Column, placeholder: Column, log: Column, stage: Column) -> Column:
    """struct(family, category) of any row: passed runs and placeholder stubs come first."""
    fixed = lambda f, c: F.struct(F.lit(f).alias("family"), F.lit(c).alias("category"))
    return F.when(truthy(execution_passed), fixed("passed", "passed")).when(truthy(placeholder), fixed("generation_failure", "panta_placeholder_stub")).otherwise(failure_class(log, stage))


def run_outcome(passed: Column, family: Column, category: Column, stage: Column | None = None) -> Column:
    """struct(outcome, detail) for the failure analysis from a profile row's failure class."""
    family, detail = (F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in (family, category))
    late = detail == "timeout_or_hang"
    if stage is not None:
        late = late | F.coalesce(stage.isin("compile_timeout", "execute_timeout"), F.lit(False))
    generation = F.when(detail.startswith("panta_"), "panta_generation_failure").otherwise("model_generation_failure")
    outcome = F.when(truthy(passed), "passed").when(late, "timeout_or_hang").when(family == "generation_failure", generation).when(family.isin("compile_failure", "execution_failure"), family).otherwise("unknown_failure")
    return F.struct(outcome.alias("outcome"), F.when(truthy(passed), "passed").otherwise(detail).alias("detail"))


def pair(outcome, detail) -> Column:
    """struct(outcome, detail) of texts or columns."""
    return F.struct((F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def raw_outcome(passed: Column, compiled: Column, stage: Column, log: Column, error_type: Column, error_code: Column) -> Column:
    """struct(outcome, detail) of a raw row of the model pipelines: an error of the model comes first, then its stage decides."""
    stage, error_type, code = (F.coalesce(c, F.lit("")) for c in (stage, error_type, error_code.cast("string")))
    kind = failure_class(log, stage)
    told = F.when(code.isin("", "0"), F.replace(stage, F.lit("model_error_"), F.lit(""))).otherwise(code)
    model = F.trim(F.concat_ws(" ", F.when(error_type == "", "model_error").otherwise(error_type), told))
    return (
        F.when(stage.rlike("^model_error(?:_|$)") | (error_type != "") | ~code.isin("", "0"), pair("model_generation_failure", model)).when(truthy(passed), pair("passed", "generated test compiled and executed"))
        .when(stage.isin("compile_timeout", "execute_timeout"), pair("timeout_or_hang", stage)).when(stage.isin("compile", "execute"), pair(kind["family"], kind["category"]))
        .when(F.coalesce(~compiled, F.lit(False)), pair("compile_failure", "compile_passed is false")).otherwise(pair("unknown_failure", F.concat(F.lit("error_stage="), stage)))
    )


def tool_outcome(mutation_status: Column, mutation_stage: Column, skip_reason: Column, extreme_status: Column) -> Column:
    """struct(outcome, detail) of a row of the test-generation tool, which reports by its mutation evidence."""
    status, stage, skip, extreme = (F.coalesce(c, F.lit("")) for c in (mutation_status, mutation_stage, skip_reason, extreme_status))
    return (
        F.when(status.isin("passed", "no_mutants") & extreme.isin("", "passed"), pair("passed", "Panta generation and mutation evidence available"))
        .when((stage == "panta_generation") | skip.startswith("panta_"), pair("panta_generation_failure", F.when(skip == "", stage).otherwise(skip)))
        .when((status == "failed") | ~extreme.isin("", "passed"), pair("passed", "Panta generated a test; later mutation evidence failed or was skipped"))
        .otherwise(pair("unknown_failure", F.concat(F.lit("mutation_status="), status, F.lit(", panta_skip_reason="), skip)))
    )


def is_placeholder(size: Column, preview: Column) -> Column:
    """Whether a generated test is the tool's stub: at most 300 bytes with its marker."""
    return F.coalesce((size <= 300) & preview.contains("testPlaceHolder"), F.lit(False))


# --- fixed values: kinds of state writes and of dependencies in order of precedence
STATE_RULES = (
    ("setter_or_set_call", r"\bset[A-Z]\w*\s*\(|\.set\s*\("), ("collection_mutation", r"\.(?:add|put|remove|clear)\s*\("), ("increment_or_compound_update", r"\+\+|--|\+=|-="),
    ("field_assignment", r"\b(?:this\.|[A-Z][A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\.)?\w+\s*="),
)
DEPENDENCY_RULES = (
    ("filesystem_or_stream", r"\b(?:Files|FileInputStream|FileOutputStream|InputStreamReader|OutputStreamWriter|FileReader|FileWriter|BufferedReader|BufferedWriter|InputStream|OutputStream|Reader|Writer)\b"),
    ("network_or_http", r"\b(?:URL|URI|Socket|HttpClient|RestTemplate|WebClient|URLConnection|HttpURLConnection)\b|\.(?:connect|getInputStream|getOutputStream|getResponseCode)\s*\(|\b\w+\.(?:send|execute)\s*\("),
)


def state_kind(snippet: Column) -> Column:
    return ordered_class(snippet, STATE_RULES, "other_state_write")


def dependency_kind(snippet: Column) -> Column:
    return ordered_class(snippet, DEPENDENCY_RULES, "other_dependency")


def unwritten_status(rule: Column) -> Column:
    """Status of a mutant that was not written, by the rule that refused it."""
    rule = F.coalesce(rule, F.lit(""))
    never = rule.isin("replacement_constructor_incompatible", "replacement_not_assignable_to_declared_type")
    return F.when(never, "not_generated").when(rule.rlike("out_of_scope|flows_to_computation_or_branch|hazard|not_assignable"), "out_of_scope").otherwise("not_generated")


def mutant_tags(flags: dict[str, Column], status: Column) -> Column:
    """Tags of a mutant: its flags in a fixed order, then what its status tells."""
    named = [F.when(truthy(flags[n]), n) for n in ("degenerate_null", "unobservable_return_state", "subsumed_by_broad_original", "downstream_flow_risk") if n in flags]
    return F.array_compact(F.array(*named, F.when(status == "survived_path_changed", "path_coverage_changed"), F.when(status == "coverage_unverified", "coverage_unverified")))


def skipped_evidence(executed: Column, private: Column, source: Column) -> Column:
    """struct(status, reason) of rows whose evidence is not collected; null for those where it is."""
    two = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(~truthy(executed), two("skipped", "original_generated_test_not_executed")).when(source.isNull(), two("skipped", "missing_subject_java"))
        .when(truthy(private), two("skipped", "private_target_method"))
    )


#: display names of models (fixed values)
MODEL_NAMES = {"RedHatAI/gemma-4-31B-it-FP8-Dynamic": "Gemma-4-31B", "gpt-5.4": "GPT-5.4"}


def short_model(model: Column) -> Column:
    """Display name, else the last part of a model's path-like name; 'unknown-model' where there is none."""
    model = F.coalesce(F.nullif(model, F.lit("")), F.lit("unknown-model"))
    last = F.element_at(F.split(model, "/"), -1)
    out = None
    for long, short in MODEL_NAMES.items():
        out = F.when(model == long, short) if out is None else out.when(model == long, short)
    return out.otherwise(last)


def metric_status(test_passed: Column, collected: Column, evidence: Column, applicable: Column, scorable: Column) -> Column:
    """Public status of a metric: the first gate that fails names it."""
    return (
        F.when(~truthy(test_passed), "test_failed")
        .when(~truthy(collected), "not_collected")
        .when(~truthy(evidence), "evidence_unavailable")
        .when(F.coalesce(applicable, F.lit(0)) == 0, "not_applicable")
        .when(F.coalesce(scorable, F.lit(0)) == 0, "not_scorable")
        .otherwise("scored")
    )


def variant_score(outcome: Column, incidental: str = "zero") -> Column:
    """Score of a mutant variant; incidental kills count 0, or are left out."""
    out = F.when(outcome == "killed_by_oracle", 1.0).when(outcome == "survived", 0.0)
    return out.when(outcome == "killed_incidentally", 0.0) if incidental == "zero" else out


#: represented outcomes of an item's variants, the strongest first (fixed values)
ITEM_OUTCOMES = ("killed_by_oracle", "killed_incidentally", "survived_path_changed", "survived")


#: labels of the oracle scores 0, 1 and 2 (fixed values)
STRENGTH = ("no_visible_oracle", "weak_visible_oracle", "direct_obligation_oracle")


def strength_label(score: Column) -> Column:
    """Label of an oracle score, clamped to 0..2; 'not_applicable' without one."""
    at = F.greatest(F.lit(0), F.least(F.lit(2), score.cast("int")))
    return F.when(score.isNull(), "not_applicable").otherwise(F.get(F.array(*map(F.lit, STRENGTH)), at))


def ratio_label(score: Column) -> Column:
    return F.when(score.isNull(), "not_applicable").otherwise("applicable")


def control_flow_reason(represented: Column, score: Column) -> Column:
    """Why a control-flow item scores as it does."""
    return F.when(~truthy(represented), "cannot_be_mutated_or_non_viable_custom_mutant").when(score == 1, "all_custom_mutants_killed").when(score == 0.5, "half_custom_mutants_killed").otherwise("no_custom_mutant_killed")


# --- fixed values: Java return types by category
RETURN_TYPES = {
    "boolean": ("boolean", "Boolean"), "numeric": ("byte", "short", "int", "long", "float", "double", "Byte", "Short", "Integer", "Long", "Float", "Double"), "char": ("char", "Character"),
    "string": ("String", "java.lang.String"), "class": ("Class", "java.lang.Class"),
    "collection": ("List", "Set", "Map", "Collection", "Iterable", "java.util.List", "java.util.Set", "java.util.Map", "java.util.Collection", "java.lang.Iterable"),
}


def return_type_category(kind: Column) -> Column:
    """Category of a Java return type without its generics."""
    erased = F.trim(F.regexp_replace(F.coalesce(kind, F.lit("")), "<.*>", ""))
    out = F.when(erased == "", "unknown").when(erased.endswith("[]"), "array")
    for category, names in RETURN_TYPES.items():
        out = out.when(erased.isin(*names), category)
    return out.otherwise("domain_object")


def failure_log_path(workdir: Column, prompt: Column, stage: Column) -> Column:
    """Path of a failed row's log; null without workdir or prompt."""
    name = F.when(stage.isin("execute", "execute_timeout"), "execute-").otherwise("mvn-test-")
    return F.concat(F.nullif(workdir, F.lit("")), F.lit("/"), name, F.nullif(prompt, F.lit("")), F.lit(".log"))


def first_error_lines(log: Column, n: int = 4) -> Column:
    """First lines that tell of an error, trimmed and joined by ' / '."""
    told = F.filter(F.split(log, r"\r?\n"), lambda x: x.contains("[ERROR]") | x.contains("Exception") | x.contains("AssertionError") | x.contains("error:"))
    return F.array_join(F.transform(F.slice(told, 1, n), F.trim), " / ")


# --- fixed values: what an execution log shows of a killed mutant
FAILURE_LINE = r'(?m)^\s*(?:\[ERROR\]\s*)?(?:(?:Exception in thread "[^"]+"\s+|Caused by:\s*))?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?::|\s*$)'
ORACLE_TYPE = (
    r"(?:^|\.)(?:AssertionError|AssertionFailedError|ComparisonFailure|ArrayComparisonFailure|MultipleFailuresError|MockitoAssertionError)$|"
    r"^org\.mockito\.exceptions\.verification\.(?:(?:junit|opentest4j)\.)?(?:WantedButNotInvoked|NeverWantedButInvoked|TooManyActualInvocations|TooFewActualInvocations|NoInteractionsWanted|VerificationInOrderFailure|ArgumentsAreDifferent)$"
)
JVM_CRASH = r"(?m)^\s*#\s*(?:A fatal error has been detected by the Java Runtime Environment|SIGSEGV|SIGBUS|SIGILL|SIGFPE)|^\s*(?:Segmentation fault|Aborted)(?:\s|$)"
WRAPPER_TYPE = r"^org\.apache\.maven\.|^org\.codehaus\.mojo\.|^java\.lang\.reflect\.InvocationTargetException$|^java\.util\.concurrent\.ExecutionException$"
RUNTIME_TYPE = r"(?:Exception|Error|Throwable)$|^org\.mockito\.exceptions\.misusing\.PotentialStubbingProblem$"
CRASH_CODES = (132, 134, 135, 136, 137, 138, 139)


def kill_class(log: Column, returncode: Column | None = None) -> Column:
    """struct(outcome, reason) of a failed mutant run: an assertion, else a crash, else the last real exception."""
    types = F.coalesce(F.regexp_extract_all(log, F.lit(FAILURE_LINE), F.lit(1)), F.array().cast("array<string>"))
    oracle = F.get(F.filter(types, lambda t: t.rlike(ORACLE_TYPE)), F.lit(0))
    last = F.get(F.reverse(F.filter(types, lambda t: ~t.rlike(WRAPPER_TYPE) & t.rlike(RUNTIME_TYPE))), F.lit(0))
    told = F.nullif(F.regexp_extract(log, r"Process Exit Code:\s*(-?\d+)", 1), F.lit("")).cast("int")
    code = F.coalesce(told, returncode) if returncode is not None else told
    pair = lambda o, r: F.struct(F.lit(o).alias("outcome"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    return (
        F.when(oracle.isNotNull(), pair("killed_by_oracle", F.concat(F.lit("assertion_failure:"), oracle))).when(log.rlike(JVM_CRASH), pair("killed_incidentally", "jvm_crash"))
        .when((code < 0) | code.isin(*CRASH_CODES), pair("killed_incidentally", F.concat(F.lit("process_terminated:"), code.cast("string"))))
        .when(last.isNotNull(), pair("killed_incidentally", F.concat(F.lit("unhandled_exception:"), last))).when(log.isNull(), pair("coverage_unverified", "execute_log_unavailable"))
        .otherwise(pair("coverage_unverified", "failure_type_unverified"))
    )


# --- fixed values: what source lines around a mutant tell
BRANCH_CONTEXT = r"\bif\s*\(|\belse\b|\bswitch\s*\(|\bcase\s+|\bdefault\s*:|\bfor\s*\(|\bwhile\s*\(|\btry\s*\{|\bcatch\s*\(|\bthrow\b|\bthrows\b|\?"
EXCEPTION_CONTEXT = r"\bthrow\b|\bthrows\b|\bcatch\s*\(|\b(?:Exception|Error|Throwable)\b"


def context_lines(source: Column, line: Column, radius: int = 2) -> Column:
    """A line of a source with those around it; empty outside it."""
    lines = F.split(source, r"\r?\n")
    first = F.greatest(F.lit(1), line - radius)
    inside = (line >= 1) & (line <= F.size(lines))
    return F.when(inside, F.array_join(F.slice(lines, first, F.greatest(F.lit(0), line + radius - first + 1)), "\n")).otherwise(F.lit(""))


def mutator_categories(mutator: Column, description: Column, context: Column | None = None, outside: str = "", boundary: str = "") -> Column:
    """Categories of a mutation operator by its name and description, and by the lines around it, in name order.

    ``outside`` and ``boundary`` are the patterns of dependencies and of boundary
    signals in those lines.
    """
    m, d = F.lower(F.coalesce(mutator, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    has = lambda col, *words: col.rlike("|".join(words))
    near = lambda p: F.coalesce(context.rlike("(?m)" + p), F.lit(False)) if context is not None and p else F.lit(False)
    returns = has(m, "return") | has(d, "return")
    edge = returns & (has(m, "null", "empty") | has(d, "null", "empty")) | has(m, "mathmutator", "increments") | has(d, "replaced integer", "changed increment")
    return F.array_compact(F.array(
        F.when(edge | near(boundary), "boundary_value"), F.when(has(m, "negateconditionals", "conditionalsboundary") | has(d, "conditional") | near(BRANCH_CONTEXT), "branch_condition"),
        F.when(near(EXCEPTION_CONTEXT), "exception_path"), F.when(has(m, "constructorcall", "nonvoidmethodcall") | near(outside), "interaction_dependency"), F.when(returns, "weak_oracle"),
    ))


# --- fixed values: classes in order of precedence
MUTANT_RULES = (
    ("boundary_value", "conditionalsboundary|changed conditional boundary"), ("branch_condition", "negateconditionals|conditional|switch"), ("null_handling", "null"), ("weak_oracle_return", "return"),
    ("interaction_or_state", "void method call|removed call"), ("numeric_boundary", "increments|math|arithmetic"), ("construction", "constructor"),
)
BRANCH_RULES = (
    ("exception_path", r"\bthrow\s+new\b|\bthrows\s+\w+"), ("try", r"\btry\s*\{"), ("catch", r"\bcatch\s*\("), ("case", r"\bcase\s+"), ("default", r"\bdefault\s*:"), ("else_if", r"\belse\s+if\s*\("), ("else", r"\belse\b"), ("if", r"\bif\s*\("),
    ("enhanced_for_iteration", r"\bfor\s*\([^;:]+:\s*[^)]+\)"), ("loop_condition", r"\bfor\s*\(|\bwhile\s*\("), ("ternary", r"\?"),
)
RULE_SUBCATEGORIES = {
    "boolean": ("boolean_negate",),
    "numeric": ("numeric_zero_or_one_literal_only", "floating_zero_or_one_literal_only", "integral_expression_plus_one_noop_safe", "integral_expression_increment_noop_safe", "boxed_integral_literal_only"),
    "string": ("string_empty_or_mutated_literal_only", "string_expression_concatenated_noop_safe"), "collection": ("collection_map_array_empty_or_singleton",),
    "enum_or_class": ("enum_next_declared_constant", "return_null_type_compatible_replacement_class_type_changed"),
    "object": ("domain_object_default_constructor", "domain_object_concrete_constructor_defaults", "domain_object_record_canonical_defaults", "domain_object_single_value_perturbed", "opaque_object_degenerate_null", "return_null_type_compatible_replacement", "unobservable_return_state"),
}


def ordered_class(text: Column, rules, default: str | None = "other") -> Column:
    """Name of the first rule found in ``text``, letters as they are."""
    out = None
    for name, pattern in rules:
        hit = F.coalesce(text.rlike(pattern), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default))


def mutant_class(*texts: Column) -> Column:
    return ordered_class(F.lower(F.concat_ws(" ", *texts)), MUTANT_RULES)


def branch_kind(snippet: Column) -> Column:
    return ordered_class(snippet, BRANCH_RULES)


def rule_subcategory(rule: Column) -> Column:
    """Return subcategory of a mutation rule; null for none."""
    out = F.when(rule.startswith("class_"), "enum_or_class")
    for name, rules in RULE_SUBCATEGORIES.items():
        out = out.when(rule.isin(*rules), name)
    return out


def test_code(extracted: Column, preview: Column, content: Column) -> Column:
    """Generated test: extracted code, else the preview, else the file."""
    return F.coalesce(first_nonempty(extracted, preview, content), F.lit(""))
