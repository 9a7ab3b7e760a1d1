"""JSON Pointer (RFC 6901); the pointer's text is the body of a JSON string, so its escapes are decoded."""

from __future__ import annotations

import re
from functools import lru_cache

from .errors import ParseError, PointerError
from .limits import STRING_BYTES
from .parse import decode_at

MISSING = object()


@lru_cache(4096)
def tokens(pointer: str) -> tuple[tuple[str, int], ...]:
    """The reference tokens with their byte positions; none for the whole document."""
    data = pointer.encode("utf-8", "surrogatepass")
    if not data:
        return ()
    out, text, start, at, first = [], [], 0, 0, True

    def one(at: int) -> tuple[str, int]:
        try:
            return decode_at(data, at)
        except ParseError as e:
            raise PointerError(e.kind, e.pos, e.detail) from None

    def close() -> None:
        token = "".join(text)
        if len(token.encode()) > STRING_BYTES:
            raise PointerError("StringLengthLimitExceeded", start, STRING_BYTES)
        out.append((token, start))

    while at < len(data):
        c, after = one(at)
        if first and c != "/":
            raise PointerError("InvalidPointerSyntax", at)
        if c == "/":
            if first or after - at == 1:  # an escaped slash stands for itself inside a token
                if not first:
                    close()
                text, start, first = [], after, False
                at = after
                continue
        if c == "~":
            if after >= len(data):
                raise PointerError("StringUnexpectedEof", len(data) - 1)
            digit, behind = one(after)
            if digit not in "01":
                raise PointerError("UnknownEscapedCharacter", after, chr(data[after]))
            c, after = "~/"[int(digit)], behind
        text.append(c)
        at = after
    close()
    return tuple(out)


_INDEX = re.compile(r"0|[1-9][0-9]*")


def index(token: str, pos: int, strict: bool = False) -> int | None:
    """The array index that a token is; None for what merely finds nothing.  strict: that is an error as well."""
    if _INDEX.fullmatch(token):
        return int(token)
    if not token or token == "-":
        if strict:
            raise PointerError("InvalidIndex", pos, "invalid array index" if token else "empty value as index")
        return None
    if token[0] in "+-" and token[1:2].isdigit() and token[1:2].isascii():
        raise PointerError("InvalidIndex", pos, "index can not be prefixed with a sign")
    if token[0] == "0" and token[1:2].isdigit() and token[1:2].isascii():
        raise PointerError("InvalidIndex", pos, "leading zeros are not allowed")
    if token[0] not in "0123456789" or strict:
        raise PointerError("InvalidIndex", pos, "invalid array index")
    return None


def resolve(value: object, pointer: str) -> object:
    """What the pointer leads to, or MISSING.  A scalar document has no places at all, not even the whole."""
    if not isinstance(value, (dict, list)):
        return MISSING
    for token, pos in tokens(pointer):
        if isinstance(value, dict):
            if token not in value:
                return MISSING
            value = value[token]
        elif isinstance(value, list):
            i = index(token, pos)
            if i is None or i >= len(value):
                return MISSING
            value = value[i]
        else:
            return MISSING
    return value


#: A normalized path's step: a quoted name, with the escapes that such paths use, or an index.
_STEP = re.compile(r"\['((?:[^\x00-\x1f'\\]|\\(?:['\\bfnrt]|u00(?:0[0-7be]|0[f]|1[0-9a-f])))*)'\]|\[(0|[1-9][0-9]*)\]")


def from_npath(npath: str) -> str | None:
    """The pointer of a normalized path; None if it is not one."""
    if npath[:1] != "$":
        return None
    at, out = 1, []
    while at < len(npath):
        m = _STEP.match(npath, at)
        if not m:
            return None
        # names keep their JSON escapes, which a pointer's text may have too; only the quote loses its own
        name = re.sub(r"\\(.)", lambda e: "'" if e[1] == "'" else e[0], m[1]).replace("~", "~0").replace("/", "~1") if m[1] is not None else m[2]
        out.append("/" + name)
        at = m.end()
    return "".join(out)
