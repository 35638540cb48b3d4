"""Java text as column functions: what needs no bracket matching stays in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .javatext import COLLECTIONS, EMPTY_TYPES, NUMERIC, PRIMITIVES

#: a bracketed expression with brackets nested twice
INSIDE = r"((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)"
#: an unsigned or signed numeric literal
NUMBER = r"-?\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[lLfFdD]?"
STRING = r'"(?:\\.|[^"\\])*"'
NO_TEXTS = "CAST(array() AS array<string>)"


def text_of(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_comments(c: Column, literals: bool = False) -> Column:
    """Source text without comments, and unless ``literals`` with empty string and character literals."""
    # literals are matched first, so that comment signs inside them stay
    out = F.regexp_replace(c, r"""(?s)("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|/\*.*?\*/|//[^\n]*""", "$1 ")
    return out if literals else F.regexp_replace(F.regexp_replace(out, STRING, '""'), r"'(?:\\.|[^'\\])*'", "''")


def pattern_count(c: Column, patterns) -> Column:
    """Hits of several patterns, lines matched one by one."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text_of(c), F.lit("(?m)" + p))
    return total.cast("long")


def has_unicode_boundary(c: Column) -> Column:
    """Whether a text holds characters beyond ASCII, or control characters."""
    return F.coalesce(c.rlike(r"[^\x00-\x7F]|[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit(False))


def to_number(c: Column) -> Column:
    """Value of a numeric literal with separators and suffix; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[_\s]", ""), "[lLfFdD]$", "")
    return F.when(c.rlike(r"^\s*[+-]?\s*\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[lLfFdD]?\s*$"), bare.try_cast("double"))


def all_numbers(c: Column) -> Column:
    """Values of all numeric literals of an expression outside string literals."""
    plain = F.regexp_replace(c, STRING, '""')
    return F.transform(F.regexp_extract_all(plain, F.lit(rf"(?<![\w.])({NUMBER})(?![\w.])"), F.lit(1)), to_number)


def all_texts(c: Column) -> Column:
    """Contents of all string literals, escapes of quotes and backslashes undone."""
    raw = F.regexp_extract_all(c, F.lit(r'"((?:\\.|[^"\\])*)"'), F.lit(1))
    return F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\n", "\n"), r"\\t", "\t"), r'\\(["\\\'])', "$1"))


def split_top(c: Column) -> Column:
    """Parts between the commas outside generics, trimmed; empty ones are left out."""
    depth = lambda x: F.regexp_count(x, F.lit("<")) - F.regexp_count(x, F.lit(">"))
    start = F.struct(F.expr(NO_TEXTS).alias("parts"), F.lit(0).alias("depth"))

    def step(acc, x):
        parts = F.when(acc["depth"] > 0, F.concat(F.slice(acc["parts"], 1, F.size(acc["parts"]) - 1), F.array(F.concat(F.element_at(acc["parts"], -1), F.lit(","), x)))).otherwise(F.concat(acc["parts"], F.array(x)))
        return F.struct(parts.alias("parts"), (acc["depth"] + depth(x)).alias("depth"))

    parts = F.aggregate(F.split(c, ","), start, step, lambda acc: acc["parts"])
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


MODIFIERS = r"\b(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\b"


def signature(c) -> Column:
    """struct(name, types, names, returns, private, throws) of a method signature."""
    clean = F.regexp_replace(without_comments(text_of(c), True), r"@\w+(?:\s*\([^)]*\))?", " ")
    name = F.regexp_extract(clean, r"([A-Za-z_$][\w$]*)\s*\(", 1)
    head = F.regexp_extract(clean, r"(?s)^(.*?)[A-Za-z_$][\w$]*\s*\(", 1)
    parts = F.transform(split_top(F.regexp_extract(clean, r"(?s)\(([^()]*)\)", 1)), lambda p: stripped(F.regexp_replace(p, r"\bfinal\s+", "")))
    shape = r"(?s)^(.+?)\s*([A-Za-z_$][\w$]*)((?:\s*\[\s*\])*)$"
    parts = F.filter(parts, lambda p: p.rlike(shape))

    def kind(p):
        t = F.regexp_replace(stripped(F.regexp_extract(p, shape, 1)), r"\s+", " ")
        t = F.concat(t, F.regexp_replace(F.regexp_extract(p, shape, 3), r"\s", ""))
        return F.regexp_replace(t, r"\s*\.\.\.$", "[]")

    returns = F.regexp_replace(F.regexp_replace(head, MODIFIERS, " "), r"\s+", " ")
    returns = stripped(F.regexp_replace(stripped(returns), r"^<[^>]*>", ""))
    thrown = F.regexp_extract(clean, r"(?s)\)\s*throws\s+([^{;]+)", 1)
    return F.struct(
        name.alias("name"), F.transform(parts, kind).alias("types"), F.transform(parts, lambda p: F.regexp_extract(p, shape, 2)).alias("names"), returns.alias("returns"),
        head.rlike(r"\bprivate\b").alias("private"), split_top(thrown).alias("throws"),
    )


def one_of(names) -> str:
    return "(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")"


def squeezed(kind: Column) -> Column:
    return F.regexp_replace(text_of(kind), r"\s+", "")


def is_collection(kind: Column) -> Column:
    k = F.lower(text_of(kind))
    return k.contains("[]") | k.rlike(rf"(?:^|[.<\s,]){one_of(COLLECTIONS)}(?:$|[<>\s,])")


def is_numeric(kind: Column) -> Column:
    return ~is_collection(kind) & F.regexp_replace(squeezed(kind), "<.*>$", "").rlike(rf"^(?:[\w$]+\.)*{one_of(NUMERIC)}$")


def is_boolean(kind: Column) -> Column:
    return stripped(text_of(kind)).isin("boolean", "Boolean", "java.lang.Boolean")


def is_string(kind: Column) -> Column:
    return squeezed(kind).rlike(r"^(?:java\.lang\.)?(?:String|CharSequence)$")


def is_class(kind: Column) -> Column:
    return squeezed(kind).rlike(r"^(?:java\.lang\.)?Class(?:<.*>)?$")


def is_primitive(kind: Column) -> Column:
    return squeezed(kind).isin(*sorted(PRIMITIVES))


def is_general_object(kind: Column) -> Column:
    return (text_of(kind) != "") & ~(is_primitive(kind) | is_numeric(kind) | is_boolean(kind) | is_string(kind) | is_collection(kind))


def erased(kind: Column) -> Column:
    """A type without generics."""
    return stripped(F.regexp_replace(text_of(kind), "<.*>", ""))


def simple_name(kind: Column) -> Column:
    return F.element_at(F.split(erased(kind), r"\."), -1)


def generic_arguments(kind: Column) -> Column:
    return split_top(F.regexp_extract(text_of(kind), r"(?s)<(.*)>", 1))


def class_bound(kind: Column) -> Column:
    """Upper bound of Class<? extends X>, or its argument; null without one."""
    return F.nullif(F.regexp_extract(text_of(kind), r"Class\s*<\s*(?:\?\s*extends\s+)?([\w$.]+)", 1), F.lit(""))


def package_name(source: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(source), r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.lit(""))


def type_categories(kind: Column) -> Column:
    """Boundary categories that a parameter of a type has, in name order."""
    numeric, boolean = is_numeric(kind), is_boolean(kind)
    return F.array_compact(F.array(
        F.when(is_string(kind) | is_collection(kind), "empty"), F.when(boolean, "false_value"), F.when(numeric, "negative"),
        F.when(~is_primitive(kind), "null"), F.when(boolean, "true_value"), F.when(numeric, "zero"),
    ))


EMPTY_COLLECTION = (
    r"^(?:java\.util\.)?(?:Collections\.(?:<[^>]+>)?empty\w*\s*\(\s*\)|List\.(?:<[^>]+>)?of\s*\(\s*\)|Arrays\.asList\s*\(\s*\))$"
    rf"|^new\s+(?:java\.util\.)?{one_of(EMPTY_TYPES)}(?:\s*<[^>]*>)?\s*\(\s*\)$|^new\s+\w+\s*\[\s*0\s*\]$|^new\s+\w+\s*\[\s*\]\s*\{{\s*\}}$"
)
BOXES = r"(?:Integer|Long|Short|Byte|Double|Float|BigInteger|BigDecimal)"


def argument_categories(argument: Column, kind: Column) -> Column:
    """Boundary categories that an argument of a parameter type hits."""
    arg = stripped(text_of(argument))
    inner = F.regexp_extract(arg, rf"(?s)^{BOXES}\.valueOf\s*\((.*)\)$", 1)
    v = to_number(F.when(inner != "", stripped(inner)).otherwise(arg))
    none = F.expr(NO_TEXTS)
    one = lambda name: F.array(F.lit(name))
    number = F.when(arg.rlike(r"^(?:Integer|Long|Short|Byte)\.MIN_VALUE$") | (v < 0), one("negative")).when(v == 0, one("zero")).otherwise(none)
    truth = F.when(arg.isin("false", "Boolean.FALSE"), one("false_value")).when(arg.isin("true", "Boolean.TRUE"), one("true_value")).otherwise(none)
    empty = is_string(kind) & arg.rlike(r'^(?:""|String\.valueOf\s*\(\s*""\s*\))$') | is_collection(kind) & arg.rlike(EMPTY_COLLECTION)
    return F.when(arg == "null", one("null")).when(is_numeric(kind), number).when(is_boolean(kind), truth).when(empty, one("empty")).otherwise(none)


def has_ternary(line: Column) -> Column:
    """Whether a line holds a conditional expression: no wildcard of generics, no method head."""
    wild = r"<[^>\n]*\?[^>\n]*>"
    both = lambda c: c.contains("?") & c.contains(":")
    head = line.rlike(r"\b(?:class|interface|enum|public|private|protected)\b[^{;]*\([^)]*\)")
    return both(line) & F.when(line.rlike(wild), both(F.regexp_replace(line, wild, "<>"))).otherwise(~head)


def condition_of(line: Column, keyword: str) -> Column:
    """The condition in brackets behind a keyword; null if it does not end on the line."""
    found = rf"\b{keyword}\s*\({INSIDE}\)"
    return F.when(line.rlike(found), stripped(F.regexp_extract(line, found, 1)))


def fenced_code(reply: Column) -> Column:
    """The first fenced block of a model's reply, else the whole reply."""
    block = r"(?is)```(?:java)?\s*(.*?)```"
    return F.when(reply.rlike(block), stripped(F.regexp_extract(reply, block, 1))).otherwise(stripped(reply))


def json_object(reply: Column) -> Column:
    """The text from the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(fenced_code(reply), r"(?s)(\{.*\})", 1), F.lit(""))


def statement_windows(code: Column) -> Column:
    """Statements of test code: parts between semicolons and blank lines."""
    return F.filter(F.transform(F.split(text_of(code), r";|\n\s*\n"), stripped), lambda x: x != "")


def safe_label(name: Column) -> Column:
    """A name that can stand in a path."""
    return F.regexp_replace(text_of(name), r"[^A-Za-z0-9_.-]+", "_")


def class_path(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.", "/"), F.lit(".java"))


def mutated_line(source: Column, line: Column, most: int = 500) -> Column:
    """Trimmed text of a line of a source; null outside it."""
    lines = F.split(source, r"\r?\n")
    return F.when((line >= 1) & (line <= F.size(lines)), F.left(stripped(F.try_element_at(lines, line)), F.lit(most)))


def imprecise_line(text: Column) -> Column:
    """Whether coverage of a line cannot tell its parts apart: a conditional expression, or several calls."""
    return F.coalesce(text.contains("?") | (F.regexp_count(text, F.lit(r"\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\(")) > 1), F.lit(False))


#: checked from the name alone, as no class path is at hand (fixed values)
UNCHECKED = ("RuntimeException", "IllegalStateException", "IllegalArgumentException", "UnsupportedOperationException", "NullPointerException", "IndexOutOfBoundsException", "ArithmeticException", "NumberFormatException")


def is_checked_exception(kind: Column) -> Column:
    name = simple_name(kind)
    return name.endswith("Exception") & ~name.isin(*UNCHECKED)


def is_broad_exception(kind: Column) -> Column:
    return simple_name(kind).isin("Exception", "RuntimeException", "Throwable", "Error")


def test_class(explicit: Column, code: Column, default: str) -> Column:
    """Qualified name of a test class: the explicit one, else the file's package and class, else a default."""
    name = F.nullif(F.regexp_extract(text_of(code), r"\bclass\s+([A-Za-z_$][\w$]*)", 1), F.lit(""))
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(name.isNotNull(), F.concat_ws(".", package_name(code), name)), F.lit(default))


def source_path(task_file: Column, work_file: Column) -> Column:
    """The first of two files that exists (null: it does not)."""
    return F.coalesce(task_file, work_file)
