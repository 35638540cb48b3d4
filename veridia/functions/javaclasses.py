"""What Java source tells of its classes, and values that differ from a returned expression.

A class is read once into its members by walking the tokens of its body at
depth 0; questions about it (can it be made, can its state be seen) are asked of
the members.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .javatext import LITERAL, PAIRS, Token, closing, line_of, number, parse_signature, scan, split_arguments, statement_end, tokens

MODIFIERS = frozenset("public protected private static final abstract synchronized native strictfp transient volatile default sealed".split())


@dataclass
class Member:
    access: str  # public, protected, private or package
    kind: str  # type of a field or method; empty for constructors
    name: str
    parameters: list[str] | None = None  # None: a field
    body: str = ""
    modifiers: frozenset = frozenset()


@dataclass
class Shape:
    form: str  # class, record, enum or interface
    parent: str | None
    members: list[Member] = field(default_factory=list)
    components: list[str] = field(default_factory=list)
    constants: list[str] = field(default_factory=list)

    def constructors(self, name: str) -> list[Member]:
        return [m for m in self.members if m.parameters is not None and m.name == name and not m.kind]


def simple(kind: str | None) -> str:
    """A type's last name without generics; arrays keep their brackets."""
    return re.sub(r"<.*>", "", kind or "").strip().split(".")[-1]


def shape_of(source: str, name: str) -> Shape | None:
    """The class, record, enum or interface of a name that the source declares."""
    m = re.search(rf"\b(class|record|enum|interface)\s+{re.escape(name)}\b([^{{;]*)\{{", source) if re.fullmatch(r"[\w$]+", name or "") else None
    if not m:
        return None
    end = closing(source, scan(source), m.end() - 1)
    body = source[m.end() : end if end >= 0 else len(source)]
    parent = re.search(r"\bextends\s+([\w$.]+)", m[2])
    out = Shape(m[1], simple(parent[1]) if parent else None)
    held = re.match(r"\s*(?:<[^(]*>)?\s*\((.*)\)", m[2], re.S)
    if m[1] == "record" and held:
        out.components = split_arguments(held[1])
    ts, at = tokens(body), 0
    if m[1] == "enum":
        while at < len(ts) and ts[at].text != ";":
            if ts[at].kind == "name":
                out.constants.append(ts[at].text)
            at = behind(ts, at + 1, (",", ";"))
            at += at < len(ts) and ts[at].text == ","
        at += 1
    while at < len(ts):
        at = member(body, ts, at, out)
    return out


def behind(ts: list[Token], at: int, ends) -> int:
    """Place of the next token of ``ends`` outside brackets."""
    depth = 0
    while at < len(ts):
        t = ts[at].text
        if not depth and t in ends:
            return at
        depth += (t in PAIRS) - (t in PAIRS.values())
        at += 1
    return at


def member(body: str, ts: list[Token], at: int, out: Shape) -> int:
    """Read the member that begins at a token into ``out``; the place behind it."""
    start, access, generic = at, "package", 0
    while at < len(ts):
        t = ts[at].text
        generic += (t == "<") - (t == ">")
        if t == "@" and at + 1 < len(ts):  # an annotation, with its arguments
            at += 2
            if at < len(ts) and ts[at].text == "(":
                at = behind(ts, at + 1, (")",)) + 1
            start = at  # annotations stand in front of types
            continue
        if t in ("public", "protected", "private"):
            access = t
        if t == "(" and not generic:
            words, told = [x for x in ts[start:at] if x.text not in MODIFIERS], frozenset(x.text for x in ts[start:at]) & MODIFIERS
            end = behind(ts, at + 1, (")",))
            stop = behind(ts, end + 1, ("{", ";"))
            name = words[-1].text if words else ""
            kind = body[words[0].start : words[-1].start].strip() if len(words) > 1 else ""
            inner = behind(ts, stop + 1, ("}",)) if stop < len(ts) and ts[stop].text == "{" else stop
            text = body[ts[stop].end : ts[inner].start] if inner < len(ts) and inner != stop else ""
            close = ts[end].start if end < len(ts) else len(body)
            out.members.append(Member(access, re.sub(r"^<[^>]*>\s*", "", kind), name, split_arguments(body[ts[at].end : close]), text, told))
            return inner + 1
        if t in ("class", "record", "enum", "interface") and not generic:
            opens = behind(ts, at + 1, ("{", ";"))
            return behind(ts, opens + 1, ("}",)) + 1
        if t in ("=", ";") and not generic:
            words = [x for x in ts[start:at] if x.text not in MODIFIERS]
            if len(words) > 1:
                told = frozenset(x.text for x in ts[start:at]) & MODIFIERS
                out.members.append(Member(access, body[words[0].start : words[-1].start].strip(), words[-1].text, modifiers=told))
            return (at if t == ";" else behind(ts, at + 1, (";",))) + 1
        if t == "{":
            return behind(ts, at + 1, ("}",)) + 1
        at += 1
    return at


def visible(access: str, same_package: bool) -> bool:
    return access in ("public", "protected") or access == "package" and same_package


def no_argument_constructor(source: str, name: str, same_package: bool = False) -> bool:
    """Whether a test can make an object of a class of the source without arguments."""
    shape = shape_of(source, name)
    if shape is None or shape.form not in ("class", "record"):
        return False
    made = shape.constructors(name)
    return not made or any(not m.parameters and visible(m.access, same_package) for m in made)


#: methods whose results say little of an object's state (fixed values)
PLAIN_METHODS = ("hashCode", "toString", "clone", "iterator", "stream")


def observability(source: str, name: str, same_package: bool = False, seen: frozenset = frozenset()) -> str | None:
    """What lets a test see an object's state: a field, a getter, another accessor, equals, or what its parent has."""
    shape = None if name in seen else shape_of(source, name)
    if shape is None:
        return None
    told = lambda m, what: f"{m.access}_{what}" + ("" if m.access == "public" else "_same_package")
    open_ = [m for m in shape.members if visible(m.access, same_package)]
    silent = [m for m in open_ if m.parameters == [] and m.kind not in ("", "void")]
    for m in open_:
        if m.parameters is None:
            return told(m, "field")
    for m in silent:
        if re.match(r"(?:get|is)[A-Z]", m.name):
            return told(m, "getter")
    for m in silent:
        if m.name[:1].islower() and m.name not in PLAIN_METHODS:
            return told(m, "bare_accessor")
    for m in silent:
        if m.name not in PLAIN_METHODS[:3] and len(m.body) <= 500 and re.search(r"\breturn\s+(?:this\.)?[\w$]+\s*;", m.body):
            return told(m, "fluent_accessor")
    if any(m.name == "equals" and m.kind == "boolean" and m.parameters and m.parameters[0].startswith("Object") for m in shape.members):
        return "overridden_equals"
    above = observability(source, shape.parent, same_package, seen | {name}) if shape.parent else None
    return above and f"inherited_{above}"


# --- fixed values: what stands for a value of a type
SAMPLES = {
    **dict.fromkeys(("boolean", "Boolean"), "true"), **dict.fromkeys(("byte", "short", "int", "long", "Byte", "Short", "Integer", "Long"), "1"),
    **dict.fromkeys(("float", "double", "Float", "Double"), "1.0"), **dict.fromkeys(("char", "Character"), "'x'"), "String": '"MUTATED1"',
}
CLASS_CANDIDATES = {
    "Number": ("Integer", "Long", "Double"), "CharSequence": ("String", "StringBuilder"), "Object": ("String", "Object"), "Throwable": ("RuntimeException", "Exception"),
    "Exception": ("RuntimeException", "java.io.IOException"), "RuntimeException": ("IllegalArgumentException", "IllegalStateException"),
}


def sample(kind: str | None) -> str:
    """An expression of a type, made from nothing."""
    name = simple(kind)
    return SAMPLES.get(name) or (f"new {name}()" if re.fullmatch(r"[A-Za-z_$][\w$]*", name) else "new Object()")


def is_number(value: str) -> bool:
    return bool(re.fullmatch(r"-?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?[fFdDlL]?", value))


def bracketed(value: str) -> str:
    """An expression that can be an operand."""
    return value if re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*|\d+[lL]?|'(?:\\.|[^'\\])'", value) else f"({value})"


def known_empty(value: str) -> bool:
    words = "".join(t.text if t.kind != "name" or t.text != "new" else "new " for t in tokens(re.sub(r"<[^<>]*>", "", value)))
    words = words.removeprefix("java.util.")
    return words in ('""', "null") or words in ("Collections.emptyList()", "Collections.emptySet()", "Collections.emptyMap()", "List.of()", "Set.of()", "Map.of()") or bool(re.fullmatch(r"new [\w$.]+\[0\]", words))


def other_collection(kind: str, value: str) -> str | None:
    """An empty array or collection, or one with an element where the value is empty."""
    bare, empty = re.sub(r"<.*>", "", kind).strip(), known_empty(value)
    if bare.endswith("[]"):
        of = bare[:-2].strip()
        one = {"boolean": "true", "char": "'x'"}.get(of, "1" if of in ("byte", "short", "int", "long", "float", "double") else sample(of))
        return f"new {of}[] {{ {one} }}" if empty else f"new {of}[0]"
    held = re.search(r"<(.*)>", kind, re.S)
    parts = split_arguments(held[1]) if held else []
    first = sample(parts[0] if parts else "Object")
    made = {"List": "ArrayList", "Collection": "ArrayList", "Iterable": "ArrayList", "Set": "LinkedHashSet"}.get(simple(kind))
    if made:
        return f"new java.util.{made}<>(java.util.Arrays.asList({first}))" if empty else f"new java.util.{made}<>()"
    if simple(kind) == "Map":
        return f'new java.util.HashMap<>(java.util.Collections.singletonMap("MUTATED1", {sample(parts[1] if len(parts) > 1 else "Object")}))' if empty else "new java.util.HashMap<>()"
    return None


def other_class(kind: str, value: str) -> tuple[str | None, str]:
    token = re.fullmatch(r"(?:[\w$]+\.)*([\w$]+)\.class", value)
    if not token:
        return None, "class_original_not_class_token"
    bound = re.search(r"Class\s*<\s*\?\s+extends\s+([\w$.]+)\s*>", kind)
    if not bound:
        return ("String.class" if token[1] == "Object" else "Object.class"), "class_type_changed"
    new = next((c for c in CLASS_CANDIDATES.get(simple(bound[1]), ()) if c.split(".")[0] != token[1]), None)
    return (f"{new}.class", "class_type_changed_with_declared_bound") if new else (None, "class_bound_no_safe_replacement")


def new_expression(value: str) -> tuple[str, list[str]] | None:
    """Type and arguments of an expression that is a plain construction."""
    m = re.match(r"new\s+((?:[\w$]+\.)*[\w$]+)\s*\(", value)
    return (m[1], split_arguments(value[m.end() : -1])) if m and closing(value, scan(value), m.end() - 1) == len(value) - 1 else None


def with_defaults(source: str, value: str, record: bool) -> str | None:
    """A construction with sample values for its arguments, where the source declares matching parameters."""
    made = new_expression(value)
    if not made or "." in made[0] and not made[0].startswith("Subject."):
        return None
    name = simple(made[0])
    shape = shape_of(source, name)
    if shape is None or record != (shape.form == "record"):
        return None
    choices = [shape.components] if record else [m.parameters for m in shape.constructors(name)]
    if not choices:
        return f"new {name}()"
    for parameters in choices:
        if len(parameters) == len(made[1]):
            defaults = [SAMPLES.get(simple(" ".join(p.split()[:-1]))) for p in parameters]
            return f"new {name}({', '.join(defaults)})" if all(defaults) else None
    return None


def other_single_value(kind: str, value: str) -> str | None:
    """A construction of one literal with another literal."""
    made = new_expression(value)
    if not made or simple(made[0]) != simple(kind) or len(made[1]) != 1:
        return None
    arg = made[1][0]
    if re.fullmatch(r"-?\d+[lL]?", arg):
        new = f"{int(arg.rstrip('lL')) + 1}{'L' if arg[-1] in 'lL' else ''}"
    elif LITERAL.fullmatch(arg):
        new = arg[:-1] + 'MUTATED1"'
    else:
        new = {"true": "false", "false": "true"}.get(arg)
    return new and f"new {simple(kind)}({new})"


def replacement(source: str, kind: str, value: str, same_package: bool = False) -> tuple[str | None, str]:
    """(expression, rule): a value other than the returned one, by the first rule of the type that applies; None where none is safe."""
    bare, null = re.sub(r"<.*>", "", kind or "").strip(), "return_null_type_compatible_replacement"
    flip = {"true": "false", "false": "true"}
    zero = is_number(value) and number(value) == 0
    if bare == "boolean":
        return flip.get(value) or (f"!({value})" if value else "false"), "boolean_negate"
    if bare == "Boolean":
        return ("false", null) if value == "null" else (flip[value], "boolean_negate") if value in flip else (None, "boxed_boolean_expression_not_generated_unboxing_guard")
    if bare in ("byte", "short", "int", "long", "char", "Byte", "Short", "Integer", "Long", "Character"):
        if value == "null":
            return "0", null
        if is_number(value):
            return ("1" if zero else "0"), "numeric_zero_or_one_literal_only"
        if bare[0].isupper():
            return None, "boxed_integral_expression_not_generated_unboxing_guard"
        plus = f"{bracketed(value)} + 1"
        return (f"({bare}) ({plus})" if bare in ("byte", "short", "char") else plus), "integral_expression_plus_one_noop_safe"
    if bare in ("float", "double", "Float", "Double"):
        if value == "null":
            return "0.0", null
        return (("1.0" if zero else "0.0"), "floating_zero_or_one_literal_only") if is_number(value) else (None, "floating_expression_not_generated_noop_guard")
    if bare in ("String", "java.lang.String"):
        if value == "null":
            return '""', null
        if not (value.startswith('"') and value.endswith('"') and len(value) > 1):
            return f'{bracketed(value)} + "MUTATED1"', "string_expression_concatenated_noop_safe"
        return ('"MUTATED1"' if value == '""' else '""'), "string_empty_or_mutated_literal_only"
    if new := other_collection(kind, value):
        return new, "collection_map_array_empty_or_singleton"
    name = simple(kind)
    shape = shape_of(source, name)
    constants = shape.constants if shape else []
    if constants:
        now = value.split(".")[-1].strip()
        if len(constants) == 1 and now == constants[0]:
            return None, "enum_single_constant_not_generated"
        new = constants[(constants.index(now) + 1) % len(constants)] if now in constants else constants[0]
        return (f"{name}.{new}" if "." in value else new), "enum_next_declared_constant"
    if bare in ("Class", "java.lang.Class"):
        new, rule = other_class(kind, "String.class" if value == "null" else value)
        return (new or "String.class", f"{null}_{rule}") if value == "null" else (new, rule)
    for rule, new in (("domain_object_record_canonical_defaults", with_defaults(source, value, True)), ("domain_object_concrete_constructor_defaults", with_defaults(source, value, False))):
        if new:
            return new, rule
    makes = no_argument_constructor(source, name, same_package)
    if makes and observability(source, name, same_package):
        return f"new {name}()", "domain_object_default_constructor"
    if new := other_single_value(kind, value):
        return new, "domain_object_single_value_perturbed"
    if value != "null" and bare:
        return (None, "unobservable_return_state") if makes else ("null", "opaque_object_degenerate_null")
    return ("new Object()", null) if bare in ("Object", "java.lang.Object") else (None, "not_generated")


def return_mutants(source: str, signature: str, same_package: bool = False) -> list[tuple[int, str, str, str | None, str]]:
    """(line, construct, variant, mutated, rule) of every return statement with a value; None where no rule gives one."""
    kind, kinds, out = parse_signature(signature).returns, scan(source), []
    for m in re.finditer(r"\breturn\b", source):
        end = statement_end(source, kinds, m.start()) if kinds[m.start()] == "c" else -1
        value = source[m.end() : end - 1].strip() if end >= 0 else ""
        if value:
            new, rule = replacement(source, kind, value, same_package)
            out.append((line_of(source, m.start()), "return_behavior", "return_value_changed", None if new is None else f"{source[: m.start()]}return {new};{source[end:]}", rule))
    return out
