"""Filter trees to columns.

A filter is ``[field, op, value]``, ``["And", [filters]]``, ``["Or", [filters]]`` or ``["Not", filter]``. Values have two
storage classes, numeric (numbers, booleans as 1 and 0) below text (strings, arrays and objects as JSON);
nothing is converted between them. Predicates are three-valued: on a missing or null field they are
unknown, so ``Not`` of them does not match either, while ``NotEq``, ``NotIn`` and ``NotGlob`` match.
``id`` names the key column; predicates on it compare plain text and reach the Parquet scan.

A filter becomes the text of one SQL expression: making it of columns, call by call, took longer than running it on some thousand rows.
Values go into that text as casts of hexadecimal or decimal digits, and names are checked, so no value is read as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError, refuse
from ..functions import attributes as A

# Fixed values of the filter grammar: field names, nesting, list length, operators.
FIELD = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}")
MAX_DEPTH = 16
MAX_LIST = 10_000
COMPARISONS = ("Lt", "Lte", "Gt", "Gte")
LISTS = ("In", "NotIn", "ContainsAny")
OPS = ("Eq", "NotEq", *COMPARISONS, "In", "NotIn", "Glob", "NotGlob", "Contains", "ContainsAny")


@dataclass(frozen=True)
class Condition:
    """A checked condition: one value, a list of values, or a pattern; numbers and booleans are floats."""

    field: str
    op: str
    value: str | float | list | None


@dataclass(frozen=True)
class Junction:
    """All (``every``) or any of some filters."""

    every: bool
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Negation:
    part: Node


Node = Condition | Junction | Negation


def _scalar(value: object) -> str | float | None:
    match value:
        case None | str():
            return value
        case bool() | int() | float() if value == value:
            return float(value)
    refuse(f"cannot compare with {value!r}: only text, numbers, booleans and null can be compared with")


def _operand(op: str, value: object) -> str | float | list | None:
    if op in ("Glob", "NotGlob"):
        return value if isinstance(value, str) else refuse(f"the pattern of {op} must be text, not {value!r}")
    if op not in LISTS:
        return _scalar(value)
    if isinstance(value, str) or not isinstance(value, Sequence):
        refuse(f"{op} takes a list, not {value!r}")
    return [_scalar(v) for v in value] if 1 <= len(value) <= MAX_LIST else refuse(f"the list of {op} holds {len(value)} values; 1 to {MAX_LIST} are possible")


def read_filter(tree: object, *, level: int = 0, one_to_negate: bool = False) -> Node:
    """The checked form of a filter; bad ones are refused with status 400. With ``one_to_negate``, a ``Not`` of several filters is bad too."""
    below = {"level": level + 1, "one_to_negate": one_to_negate}
    if level > MAX_DEPTH:
        refuse(f"filters nest {MAX_DEPTH} levels at most")
    match tree:
        case ["And" | "Or" as word, [_, *_] as parts, *_]:
            return Junction(word == "And", tuple(read_filter(part, **below) for part in parts))
        case ["And" | "Or" as word, *_]:
            refuse(f"{word} is followed by a list of one filter or more")
        case ["Not", _, _, *_] if one_to_negate:
            refuse("Not is followed by a single filter")
        case ["Not", part, *_]:
            return Negation(read_filter(part, **below))
        case [str() as field, op, value]:
            if not FIELD.fullmatch(field):
                refuse(f"{field!r} cannot be the name of a field")
            if op not in OPS:
                refuse(f"there is no operator {op!r}; there are {', '.join(OPS)}")
            if field == "id" and op in ("Contains", "ContainsAny"):
                refuse(f"an id is not a list, so {op} does not apply to it")
            return Condition(field, op, _operand(op, value))
    refuse("expected [field, operator, value], [And or Or, list of filters] or [Not, filter]")


def glob_to_regex(pattern: str) -> str:
    """Java regular expression of a GLOB pattern: ``*``, ``?``, ``[set]`` and ``[^set]``; there is no escape character."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(r"[\s\S]*")
        elif c == "?":
            out.append(r"[\s\S]")
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            begin = i + negated
            close = pattern.find("]", begin + 1)
            if close < 0:
                return r"(?!)"  # an open set matches nothing
            chosen = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[begin:close])
            out.append(f"[{'^' if negated else ''}{chosen}]")
            i = close + 1
        else:
            out.append(re.sub(r"[^A-Za-z0-9_]", lambda m: "\\" + m[0] if ord(m[0]) < 128 else m[0], c))
    return r"\A" + "".join(out) + r"\z"


def literal(v: str | float) -> str:
    """A constant whatever it holds; the optimiser folds it."""
    return f"cast(X'{v.encode('utf-8', 'replace').hex()}' as string)" if isinstance(v, str) else f"cast('{v!r}' as double)"


def _either(*tests: str) -> str:
    return "(" + " or ".join(tests) + ")"


class _Names:
    """Names for lambda variables, each used once."""

    def __init__(self) -> None:
        self.used = 0

    def new(self) -> str:
        self.used += 1
        return f"__x{self.used}"

    def let(self, value: str, body: Callable[[str], str]) -> str:
        """``body`` of a value that is computed once a row. Filters do not share common subexpressions, and without this
        the JSON text would be parsed again for each mention of a field."""
        x = self.new()
        return f"transform(array({value}), {x} -> {body(x)})[0]"

    def operand(self, value: str, test: Callable[[_Operand], str]) -> str:
        """``test`` of a variant's storage classes."""
        return self.let(value, lambda v: self.let(f"named_struct('value', {v}, 'number', {A.number_sql(v)}, 'text', {A.text_sql(v)})", lambda x: test(_Operand(x))))


class _Operand:
    """A field's value in its two storage classes: the name of a struct of value, number and text. Tests are never null but where they say so."""

    def __init__(self, name: str):
        self.value, self.number, self.text = (f"{name}.{k}" for k in ("value", "number", "text"))
        self.missing = f"({self.number} is null and {self.text} is null)"

    def known(self, test: str) -> str:
        """Three-valued: unknown where the field is missing, else whether the test holds."""
        return f"if({self.missing}, {UNKNOWN}, {test})"

    def among(self, values: list) -> str:
        numbers, texts = ([literal(v) for v in values if isinstance(v, kind)] for kind in (float, str))
        hits = [f"coalesce({own} in ({', '.join(wanted)}), false)" for own, wanted in ((self.number, numbers), (self.text, texts)) if wanted]
        return _either(*hits) if hits else "false"

    def compares(self, op: str, v: str | float) -> str:
        own, other = (self.text, self.number) if isinstance(v, str) else (self.number, self.text)
        hits = [f"coalesce({own} {SIGNS[op]} {literal(v)}, false)"]
        # Every number is below every text.
        if isinstance(v, str) == (op in ("Lt", "Lte")):
            hits.append(f"{other} is not null")
        return _either(*hits)

    def like(self, pattern: str) -> str:
        return f"coalesce(rlike({A.as_text_sql(self.value)}, {literal(glob_to_regex(pattern))}), false)"


UNKNOWN = "cast(null as boolean)"
SIGNS = {"Eq": "=", "NotEq": "<>", "Lt": "<", "Lte": "<=", "Gt": ">", "Gte": ">="}


def _id_text(v: str | float | None) -> str | None:
    """A number against an id compares by its JSON text."""
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
    return v


def _on_id(op: str, value: str | float | list | None) -> str:
    if op in ("In", "NotIn"):
        values = [_id_text(v) for v in value]
        wanted = [literal(v) for v in values if v is not None]
        hit = f"id in ({', '.join(wanted)})" if wanted else "false"
        hit = f"if({hit}, true, {UNKNOWN})" if None in values else hit
        return f"({hit})" if op == "In" else f"(not ({hit}))"
    if op in ("Glob", "NotGlob"):
        hit = f"rlike(id, {literal(glob_to_regex(value))})"
        return hit if op == "Glob" else f"(not {hit})"
    v = _id_text(value)
    if v is None:  # ids are never null
        return UNKNOWN if op in COMPARISONS else "true" if op == "NotEq" else "false"
    return f"(id {SIGNS[op]} {literal(v)})"


def _test(names: _Names, op: str, v: str | float | list | None) -> Callable[[_Operand], str]:
    """The predicate of one condition on an attribute."""
    if op in ("Eq", "NotEq"):
        if v is None:
            return lambda x: x.missing if op == "Eq" else f"(not {x.missing})"
        if op == "Eq":
            return lambda x: x.known(x.among([v]))
        return lambda x: _either(x.missing, f"not {x.among([v])}")
    if op in COMPARISONS:
        return lambda x: UNKNOWN if v is None else x.known(x.compares(op, v))
    if op in ("In", "NotIn"):
        rest = UNKNOWN if None in v else "false"
        known = lambda x: f"case when {x.missing} then {UNKNOWN} when {x.among(v)} then true else {rest} end"
        return known if op == "In" else lambda x: _either(x.missing, f"not {known(x)}")
    if op == "Glob":
        return lambda x: x.known(x.like(v))
    if op == "NotGlob":
        return lambda x: _either(x.missing, f"not {x.like(v)}")
    values = [v] if op == "Contains" else v
    element = names.new()
    return lambda x: f"coalesce(exists({A.elements_sql(x.value)}, {element} -> {names.operand(element, lambda e: e.among(values))}), false)"


def filter_sql(tree: object, attrs: str = "attrs") -> str:
    """The text of ``compile_filter``."""
    names = _Names()

    def built(node: Node, attributes: str | None) -> str:
        match node:
            case Condition(field="id"):
                return _on_id(node.op, node.value)
            case Condition():
                return names.operand(A.field_sql(attributes, node.field), _test(names, node.op, node.value))
            case Negation(part=part):
                return f"(not {built(part, attributes)})"
            case Junction(every=every, parts=parts):
                return "(" + (" and " if every else " or ").join(built(p, attributes) for p in parts) + ")"

    def whole(node: Node) -> str:
        if isinstance(node, Junction) and node.every:
            on_id, rest = (tuple(p for p in node.parts if uses_attributes(p) is x) for x in (False, True))
            if on_id and rest:
                return f"{built(Junction(True, on_id), None)} and {whole(Junction(True, rest))}"
        if not uses_attributes(node):
            return built(node, None)
        return names.let(f"try_parse_json(`{attrs}`)", lambda attributes: built(node, attributes))

    return whole(read_filter(tree))


def compile_filter(tree: object, attrs: str = "attrs") -> Column:
    """Boolean column of a filter over columns ``id`` and ``attrs`` (JSON text); bad filters are refused with status 400.

    The attributes are parsed once a row. Conditions on ``id`` that must hold on their own stay outside, where they
    reach the scan.
    """
    return F.expr(filter_sql(tree, attrs))


def uses_attributes(node: Node) -> bool:
    """Whether any condition is about something else than ``id``."""
    match node:
        case Condition(field=field):
            return field != "id"
        case Junction(parts=parts):
            return any(map(uses_attributes, parts))
        case Negation(part=part):
            return uses_attributes(part)


def check_shape(tree: object) -> str | None:
    """What is wrong with a filter, or None; ``Not`` takes exactly one filter here."""
    try:
        read_filter(tree, one_to_negate=True)
    except EngineError as e:
        return str(e)
    return None


def condition(name: str, op: str, text: str) -> list:
    """A condition from form input: list operators split at commas and drop empty parts, other values are inferred."""
    from ..functions.jsontext import infer_value

    if op in LISTS:
        return [name, op, [infer_value(p.strip()) for p in text.split(",") if p.strip()]]
    return [name, op, text if op in ("Glob", "NotGlob") else infer_value(text)]


def form(test: Sequence) -> tuple[str, str, str]:
    """Form input (field, operator, text) that ``condition`` reads back as the condition; lists whose texts hold commas, blanks
    at their ends, or are empty, are refused, as the text of a list is split at commas."""
    from ..functions.jsontext import value_to_field

    name, op, value = test
    text = ", ".join(map(value_to_field, value)) if op in LISTS else value if op in ("Glob", "NotGlob") else value_to_field(value)
    return (name, op, text) if condition(name, op, text) == [name, op, value] else refuse(f"{value!r} cannot be written as a list of form input")
