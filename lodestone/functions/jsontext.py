"""JSON text helpers: strict lint with positions, descriptions, value inference, attribute diffs."""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass
class Lint:
    ok: bool
    value: object = None
    message: str = ""
    line: int = 0
    column: int = 0
    offset: int = 0


def _reject(name: str):
    raise ValueError(f"{name} is not JSON")


def lint(text: str) -> Lint:
    """Parse strict JSON; on failure say where."""
    try:
        return Lint(True, json.loads(text, parse_constant=_reject))
    except json.JSONDecodeError as e:
        return Lint(False, None, e.msg, e.lineno, e.colno, e.pos)
    except ValueError as e:
        at = next((i for i in (text.find(n) for n in ("NaN", "Infinity")) if i >= 0), 0)
        return Lint(False, None, str(e), text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), at)


#: Names of JSON types, most specific first (a bool is an int).
KINDS = ((bool, "truth value"), ((int, float), "number"), (str, "text"), (dict, "object"), (list, "list"), (type(None), "null"))


def describe(value: object) -> str:
    """Kind of a JSON value; of lists and objects also the size, as in ``list (3)``."""
    name = next(name for kind, name in KINDS if isinstance(value, kind))
    return f"{name} ({len(value)})" if isinstance(value, (dict, list)) else name


def infer_value(text: str) -> object:
    """Numbers, booleans, null, arrays, objects and quoted strings as JSON; blank text as "", any other text as it is."""
    found = lint(text.strip())
    return found.value if found.ok else text if text.strip() else ""


def value_to_field(value: object) -> str:
    """Text that ``infer_value`` reads back as the value: text as it is where that works, else JSON."""
    if isinstance(value, str) and infer_value(value) == value:
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def attribute_patch(current: dict | None, edited: dict) -> dict:
    """The patch that turns ``current`` into ``edited``: edited keys, and null for removed ones."""
    return {**edited, **{k: None for k in current or {} if k not in edited}}
