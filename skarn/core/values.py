"""JSON values as Python objects: dict (in order), list, str, bool, None, int, float, and Decimal where numbers are
exact.  Python's own == is never used on them, as True == 1 there."""

from __future__ import annotations

import re
from decimal import Decimal

KINDS = ("object", "array", "number", "string", "boolean", "null")


def kind(v: object) -> str:
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    if isinstance(v, str):
        return "string"
    if isinstance(v, bool):
        return "boolean"
    return "null" if v is None else "number"


def equals(a: object, b: object, strict: bool = False) -> bool:
    """Deep equality; objects regardless of order.  strict: 5 and 5.0 differ."""
    k = kind(a)
    if k != kind(b):
        return False
    if k == "number":
        return a == b and (not strict or isinstance(a, int) == isinstance(b, int))
    if k == "object":
        return len(a) == len(b) and all(x in b and equals(v, b[x], strict) for x, v in a.items())
    if k == "array":
        return len(a) == len(b) and all(equals(x, y, strict) for x, y in zip(a, b))
    return a == b


def compare(a: object, b: object, strict: bool = False) -> int | None:
    """-1, 0, 1; None where there is no order.  Numbers by value, strings by code point, the rest only when equal."""
    k = kind(a)
    if k != kind(b):
        return None
    if k in ("number", "string"):
        return (a > b) - (a < b)
    return 0 if equals(a, b, strict) else None


_SPECIAL = re.compile(r'[\x00-\x1f"\\]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(s: str) -> str:
    """A string as JSON text: short escapes, else \\u00xx; everything else as it is."""
    return '"' + _SPECIAL.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def number_text(v: int | float | Decimal) -> str:
    """Digits without an exponent; a whole float prints without a point."""
    if isinstance(v, int):
        return str(v)
    s = format(v if isinstance(v, Decimal) else Decimal(repr(v)), "f")
    return s.rstrip("0").rstrip(".") if "." in s and not isinstance(v, Decimal) else s


def compact(v: object) -> str:
    """JSON text without blanks, members in their order."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{quoted(k)}:{compact(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(compact, v)) + "]"
    return _scalar(v)


def _scalar(v: object) -> str:
    if isinstance(v, str):
        return quoted(v)
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return number_text(v)


def pretty(v: object, depth: int = 0) -> str:
    """JSON text over lines, indented by four."""
    if isinstance(v, (dict, list)) and v:
        rows = [f"{quoted(k)}: {pretty(x, depth + 1)}" for k, x in v.items()] if isinstance(v, dict) else [pretty(x, depth + 1) for x in v]
        pad, (a, b) = "    " * (depth + 1), "{}" if isinstance(v, dict) else "[]"
        return a + "\n" + ",\n".join(pad + r for r in rows) + "\n" + pad[4:] + b
    return {dict: "{}", list: "[]"}.get(type(v)) or _scalar(v)


def canonical(v: object, strict: bool = False) -> str:
    """Equal values, equal text: sorted members, numbers by value (strict: and by kind)."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{quoted(k)}:{canonical(v[k], strict)}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(canonical(x, strict) for x in v) + "]"
    if kind(v) == "number":
        if v == 0:
            text = "0"
        elif isinstance(v, Decimal):  # normalize() would round it
            text = format(v, "f")
            text = text.rstrip("0").rstrip(".") if "." in text else text
        elif v == v.__floor__():
            text = str(int(v))
        else:
            text = format(Decimal(repr(v)).normalize(), "f")
        return text + (".0" if strict and not isinstance(v, int) and "." not in text else "")
    return _scalar(v)


def copy(v: object) -> object:
    if isinstance(v, dict):
        return {k: copy(x) for k, x in v.items()}
    return [copy(x) for x in v] if isinstance(v, list) else v
