"""State that outlives a call: static fields a method writes, and what a test sets up and checks of them.

These obligations are in no reported total; they are here for research reports.
"""

from __future__ import annotations

import re

from .javaclasses import shape_of, simple
from .javatext import LITERAL, NUMBER, closing, is_collection, is_empty_collection, line_of, line_text, number, parse_signature, placed_calls, scan, target_span, tokens

#: methods that change a collection or a holder (fixed values)
CHANGERS = frozenset("add put remove clear set".split())
PLAIN_TYPES = frozenset("byte short int long float double boolean char String Byte Short Integer Long Float Double Boolean Character".split())


def accessors(name: str) -> set[str]:
    big = name[:1].upper() + name[1:]
    return {f"get{big}", f"is{big}", f"has{big}", name}


def state_fields(source: str) -> dict[str, str]:
    """Name and type of the static fields of the source's first class whose change can be seen from outside; constants are none."""
    m = re.search(r"\b(?:class|record|enum)\s+([\w$]+)", source)
    shape = shape_of(source, m[1]) if m else None
    if shape is None:
        return {}
    methods = {x.name for x in shape.members if x.parameters is not None}
    return {
        x.name: x.kind for x in shape.members
        if x.parameters is None and "static" in x.modifiers and not ("final" in x.modifiers and simple(x.kind) in PLAIN_TYPES) and (x.access != "private" or accessors(x.name) & methods)
    }


def initial_cases(kind: str) -> list[str]:
    """States of a field of a type before a call that are worth a test."""
    if simple(kind).lower() == "boolean":
        return ["false_value", "true_value"]
    if is_collection(kind):
        return ["empty", "positive_normal", "duplicate"]
    if re.search(r"int|long|short|byte|float|double|bigdecimal", kind.lower()):
        return ["zero", "negative", "positive_normal"]
    return ["empty", "positive_normal", "overflow_or_long"] if simple(kind) in ("String", "CharSequence") else ["positive_normal"]


def writes(text: str) -> list[tuple[int, str, str]]:
    """(place, qualifier, name) of every write to a variable or through a changing method; declarations are none."""
    ts, out = tokens(text), []
    word = lambda i: ts[i].text if 0 <= i < len(ts) else ""
    for i, t in enumerate(ts):
        if t.kind != "name":
            continue
        changed = word(i + 1) == "=" or word(i + 1) in ("+", "-") and word(i + 2) == "=" or word(i + 1) in ("++", "--") or word(i + 1) == "." and word(i + 2) in CHANGERS and word(i + 3) == "("
        declared = i and (ts[i - 1].kind == "name" and ts[i - 1].text not in ("return", "else", "do") or ts[i - 1].text in (">", "]"))
        if changed and not declared:
            first = i
            while first > 1 and word(first - 1) == "." and ts[first - 2].kind == "name":
                first -= 2
            out.append((t.start, text[ts[first].start : ts[i].start].rstrip(". ") if first < i else "", t.text))
    return out


def state_obligations(source: str, signature: str) -> list[tuple[int, str, str, str, str]]:
    """(line, snippet, target, scope, case) of the first write to visible state on each line of the target."""
    span = target_span(source, parse_signature(signature).name) or (0, len(source))
    fields, seen, out = state_fields(source), set(), []
    for at, owner, name in writes(source[span[0] : span[1]]):
        at += span[0]
        line = line_of(source, at)
        if line in seen:
            continue
        if name in fields:
            found = [(name, "static_field", c) for c in initial_cases(fields[name])]
        elif owner[:1].isupper():
            found = [(f"{owner}.{name}", "static_class_property", "positive_normal")]
        else:
            continue
        seen.add(line)
        out += [(line, line_text(source, at)[:240], *f) for f in found]
    return out


def value_cases(value: str) -> set[str]:
    """Boundary cases that a value of any type stands for."""
    if value == "null":
        return {"null"}
    if value == '""' or is_empty_collection(value):
        return {"empty"}
    v = number(value) if re.fullmatch(NUMBER, value) else None
    return {"zero"} if v == 0 else {"negative"} if v is not None and v < 0 else set()


def state_setups(test: str, name: str, target: str) -> set[str]:
    """Cases that a test sets a piece of state to before it first calls the target."""
    first = min((at for at, _ in placed_calls(test, name)), default=len(test))
    kinds, short, out = scan(test), target.split(".")[-1], set()
    for at, _, written in writes(test[:first]):
        if written != short:
            continue
        rest = test[at + len(short) :]
        m = re.match(r"\s*=\s*([^;]+);", rest)
        if m:
            out |= value_cases(m[1].strip())
        m = re.match(r"\s*\.(\w+)\s*\(", rest)
        if m:
            end = closing(test, kinds, at + len(short) + m.end() - 1)
            out |= value_cases(test[at + len(short) + m.end() : end].strip()) | ({"empty"} if m[1] == "clear" else {"positive_normal"} if m[1] in ("add", "put", "set") else set())
    for m in re.finditer(rf'getDeclaredField\s*\(\s*"{re.escape(short)}"\s*\)', test[:first]):
        held = re.search(r"\.set(?:Int|Long|Boolean|Double|Float|Object)?\s*\([^,]+,\s*([^)]+)\)", test[m.end() : first])
        out |= value_cases(held[1].strip()) if held else set()
    return out


def state_checked(test: str, name: str, target: str) -> bool:
    """Whether an assertion behind the first target call reads the state, by name or accessor."""
    first, short = min((at for at, _ in placed_calls(test, name)), default=len(test)), target.split(".")[-1]
    kinds = scan(test)
    for m in re.finditer(r"\bassert\w*\s*\(", test[first:]):
        at = first + m.end() - 1
        end = closing(test, kinds, at) if kinds[at] == "c" else -1
        names = {t.text for t in tokens(test[at : end + 1])} if end >= 0 else set()
        if names & accessors(short) or any(LITERAL.fullmatch(n) and n[1:-1] == short for n in names):
            return True
    return False


def sequence_score(test: str, name: str) -> float:
    """1 where the target is called again and the test's words tell of an order, a half where it is only called again."""
    again = len(placed_calls(test, name)) > 1
    told = re.search(r"\b(?:before|after|initial|final|again|second|third|then|sequence|previous|next|repeated|twice|idempotent|accumulat|reset|transition|order)\b", test, re.I)
    return 0.0 if not again else 1.0 if told else 0.5
