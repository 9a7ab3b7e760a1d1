"""Strict JSON: RFC 8259 with I-JSON numbers, unique names and limits.

`parse` reads with the standard library's C scanner, whose hooks check what it lets pass; whatever fails there, and texts
that could hide what the hooks can't see, are read again by `_Strict`, which finds the kind and place of an error.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from .errors import ParseError
from .limits import DEPTH, INPUT_BYTES, INT_MAX, STRING_BYTES

_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_BLANK = re.compile(rb"[ \t\r\n]*")
_PLAIN = re.compile(rb'[^\x00-\x1f\x7f"\\\x80-\xff]*')
_ESCAPES = {"\\": "\\", '"': '"', "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_HEX = re.compile(rb"[0-9a-fA-F]{4}")
#: Bytes that a well-formed sequence of each first byte may have second, and its length (RFC 3629).
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class _Doubt(Exception):
    """The fast reader can't vouch for the text."""


def _pairs(items: list[tuple[str, object]]) -> dict:
    out = dict(items)
    if len(out) != len(items):
        raise _Doubt
    return out


def _int(s: str) -> int:
    if len(s) > 17 or abs(v := int(s)) > INT_MAX:
        raise _Doubt
    return v


def _float(s: str) -> float:
    v = float(s)
    if v in (float("inf"), float("-inf")):
        raise _Doubt
    return v


def _never(s: str) -> None:
    raise _Doubt


#: Digits up to which Python makes an int from text; more are kept as a Decimal, which is as exact and takes linear time.
_INT_DIGITS = 4000


def _whole(s: str) -> int | Decimal:
    return int(s) if len(s) <= _INT_DIGITS else Decimal(s)


_scan = json.JSONDecoder(object_pairs_hook=_pairs, parse_int=_int, parse_float=_float, parse_constant=_never).decode
_exact = json.JSONDecoder(object_pairs_hook=_pairs, parse_int=_whole, parse_float=Decimal, parse_constant=_never).decode


def parse(text: str | bytes, exact: bool = False) -> object:
    """The value of a JSON text; ParseError with kind and byte position.  exact: numbers of any size, as int or Decimal."""
    if isinstance(text, str):
        plain = text
        size = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
    else:
        size = len(text)
        try:
            plain = text.decode()
        except UnicodeDecodeError:
            return _Strict(bytes(text), exact).whole()
    doubt = size > INPUT_BYTES or not plain or "\x7f" in plain or "\\ud" in plain or "\\uD" in plain or plain[0] == "\ufeff"
    doubt = doubt or size > STRING_BYTES or plain.count("[") + plain.count("{") > DEPTH
    if not doubt:
        try:
            return (_exact if exact else _scan)(plain)
        except (_Doubt, ValueError, RecursionError):
            pass
    elif size <= INPUT_BYTES and plain and "\x7f" not in plain and "\\ud" not in plain and "\\uD" not in plain:
        try:
            value = (_exact if exact else _scan)(plain.removeprefix("\ufeff"))
            if _within(value):
                return value
        except (_Doubt, ValueError, RecursionError):
            pass
    return _Strict(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text), exact).whole()


def _within(value: object) -> bool:
    """Whether depth and string lengths keep the limits."""
    todo = [(value, 0)]
    while todo:
        v, depth = todo.pop()
        if isinstance(v, str):
            if 4 * len(v) > STRING_BYTES and len(v.encode()) > STRING_BYTES:
                return False
        elif isinstance(v, (dict, list)):
            if depth >= DEPTH:
                return False
            todo += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v)]
            if isinstance(v, dict):
                todo += [(k, 0) for k in v]
    return True


class _Strict:
    """A recursive reader over bytes."""

    def __init__(self, data: bytes, exact: bool = False):
        self.data, self.exact, self.at, self.depth = data, exact, 0, 0

    def fail(self, kind: str, pos: int, detail: object = None) -> ParseError:
        return ParseError(kind, pos, detail)

    def end(self) -> ParseError:
        return self.fail("UnexpectedEof", len(self.data) - 1)

    def whole(self) -> object:
        if not self.data:
            raise self.fail("UnexpectedEof", 0)
        if len(self.data) > INPUT_BYTES:
            raise self.fail("InputBufferLimitExceeded", 0, INPUT_BYTES)
        if self.data.startswith(b"\xef\xbb\xbf"):
            self.at = 3
        value = self.value()
        if self.peek() is not None:
            raise self.fail("UnexpectedToken", self.at)
        return value

    def peek(self) -> int | None:
        """The first byte of the next token; the token itself is checked where it could not begin a value."""
        self.at = _BLANK.match(self.data, self.at).end()
        if self.at >= len(self.data):
            return None
        c = self.data[self.at]
        if chr(c) not in '{}[]:,"-+0123456789tfn':
            raise self.fail("UnexpectedCharacter", self.at, chr(c))
        return c

    def token(self) -> int | None:
        """As peek, but a scalar is read through, so that what is wrong inside it comes before its place."""
        c = self.peek()
        if c is not None and chr(c) not in "{}[]:,":
            here = self.at
            self.scalar(c)
            self.at = here
        return c

    def value(self) -> object:
        c = self.peek()
        if c is None:
            raise self.end()
        if c in b"{[":
            return self.container(c == 0x7B)
        if c in b"}]:,":
            raise self.fail("UnexpectedToken", self.at, "json value")
        return self.scalar(c)

    def scalar(self, c: int) -> object:
        if c == 0x22:
            return self.string()
        if c in b"tfn":
            return self.keyword({0x74: (b"true", True), 0x66: (b"false", False), 0x6E: (b"null", None)}[c])
        return self.number()

    def container(self, is_object: bool) -> object:
        self.at += 1
        if self.depth >= DEPTH:
            raise self.fail("NestingDepthLimitExceeded", self.at, DEPTH)
        self.depth += 1
        out: object = {} if is_object else []
        close, wanted = (0x7D, "string key") if is_object else (0x5D, "json value")
        c = self.token()
        if c is None:
            raise self.end()
        while c != close:
            if is_object:
                c, start = self.token(), self.at
                if c is None:
                    raise self.end()
                if c != 0x22:
                    raise self.fail("UnexpectedToken", start, "object name")
                name = self.string()
                if name in out:
                    raise self.fail("DuplicateName", start, name)
                c = self.token()
                if c != 0x3A:
                    raise self.end() if c is None else self.fail("UnexpectedToken", self.at, "colon ':'")
                self.at += 1
                out[name] = self.value()
            else:
                out.append(self.value())
            c = self.token()
            if c is None:
                raise self.end()
            if c == 0x2C:
                self.at += 1
                if self.token() == close:
                    raise self.fail("UnexpectedToken", self.at, wanted)
            elif c != close:
                raise self.fail("UnexpectedToken", self.at, "',' or closing bracket")
        self.at += 1
        self.depth -= 1
        return out

    def keyword(self, known: tuple[bytes, object]) -> object:
        word, value = known
        for i, c in enumerate(word):
            if self.at + i >= len(self.data):
                raise self.end()
            if self.data[self.at + i] != c:
                raise self.fail("UnexpectedCharacter", self.at + i, chr(self.data[self.at + i]))
        self.at += len(word)
        return value

    def number(self) -> object:
        data, start = self.data, self.at
        found = _NUMBER.match(data, start)
        end = found.end() if found else start
        after = data[end : end + 1]
        if not found or after and after in b"0123456789.eE+-":
            raise self.not_a_number(start, end)
        self.at = end
        text = found[0].decode()
        if found[1] or found[2]:
            if self.exact:
                return Decimal(text)
            v = float(text)
            if v in (float("inf"), float("-inf")):
                raise self.fail("OutOfRange", start, "-1.7976931348623157e308" if text[0] == "-" else "1.7976931348623157e308")
            return v
        digits = text.lstrip("-")
        if not self.exact and (len(digits) > 16 or int(digits) > INT_MAX):
            raise self.fail("OutOfRange", start, -INT_MAX if text[0] == "-" else INT_MAX)
        return _whole(text)

    def not_a_number(self, start: int, end: int) -> ParseError:
        """What is wrong with digits that are no number; end is where they stop to be one."""
        data = self.data
        digit = lambda i: data[i : i + 1].isdigit()
        if data[start] == 0x2B:
            if digit(start + 1):
                return self.fail("InvalidSign", start, "json specification prohibits numbers from being prefixed with a plus sign")
            return self.fail("UnexpectedCharacter", start, "+")
        if data[start] == 0x2D and not digit(start + 1):
            if start + 1 >= len(data):
                return self.fail("UnexpectedEof", start)
            return self.fail("InvalidSign", start, "a valid numeric value requires a digit (0-9) after the minus sign")
        if digit(end):  # only a zero can be followed by a digit that is not its own
            return self.fail("LeadingZeros", start)
        c, seen = chr(data[end]), data[start:end].lower()
        if c == ".":
            if b"." in seen:
                return self.fail("InvalidDecimal", end, "double decimal point found")
            if not digit(end + 1):
                return self.fail("InvalidDecimal", end, "decimal point must be followed by a digit")
            return self.fail("InvalidDecimal", end, "decimal point is not allowed after exponential notation")
        if c in "eE":
            if b"e" in seen:
                return self.fail("InvalidScientific", end, "double exponential notation('e' or 'E') found")
            if data[end + 1 : end + 2] in (b"+", b"-"):
                return self.fail("InvalidScientific", end + 1, "exponential notation must be followed by a digit")
            return self.fail("InvalidScientific", end, "exponential notation must be followed by a digit or a sign")
        return self.fail("InvalidScientific", end, "sign ('+' or '-') is only allowed as part of exponential notation")

    def string(self) -> str:
        data, start = self.data, self.at
        self.at += 1
        out: list[str] = []
        while True:
            m = _PLAIN.match(data, self.at)
            out.append(m[0].decode())
            self.at = m.end()
            if self.at >= len(data):
                raise self.fail("StringUnexpectedEof", len(data) - 1)
            c = data[self.at]
            if c == 0x22:
                break
            if c == 0x5C:
                out.append(self.escape())
            elif c >= 0x80:
                n = self.sequence()
                out.append(data[self.at : self.at + n].decode())
                self.at += n
            else:
                raise self.fail("InvalidControlCharacter", self.at, c)
        self.at += 1
        text = "".join(out)
        if len(text.encode()) > STRING_BYTES:
            raise self.fail("StringLengthLimitExceeded", start, STRING_BYTES)
        return text

    def sequence(self) -> int:
        """The length of the UTF-8 sequence here."""
        data, at, c = self.data, self.at, self.data[self.at]
        n = 2 if 0xC2 <= c <= 0xDF else 3 if 0xE0 <= c <= 0xEF else 4 if 0xF0 <= c <= 0xF4 else 0
        low, high = _SECOND.get(c, (0x80, 0xBF))
        rest = data[at + 1 : at + n] if n else b""
        if not n or len(rest) < n - 1 or not low <= rest[0] <= high or any(not 0x80 <= x <= 0xBF for x in rest[1:]):
            raise self.fail("InvalidByteSequence", at, max(n, 1))
        return n

    def escape(self) -> str:
        """The character of the escape here; moves behind it."""
        data, at = self.data, self.at
        if at + 1 >= len(data):
            raise self.fail("StringUnexpectedEof", at)
        c = chr(data[at + 1])
        if c in _ESCAPES:
            self.at += 2
            return _ESCAPES[c]
        if c != "u":
            raise self.fail("UnknownEscapedCharacter", at + 1, c)
        high = self.hex(at + 2)
        self.at = at + 6
        if not 0xD800 <= high <= 0xDFFF:
            return chr(high)
        if high >= 0xDC00 or data[at + 6 : at + 8] != b"\\u":
            if high < 0xDC00 and at + 11 >= len(data):
                raise self.fail("StringUnexpectedEof", len(data) - 1)
            raise self.fail("InvalidSurrogate", at)
        low = self.hex(at + 8)
        if not 0xDC00 <= low <= 0xDFFF:
            raise self.fail("InvalidSurrogate", at)
        self.at = at + 12
        return chr(0x10000 + (high - 0xD800) * 0x400 + low - 0xDC00)

    def hex(self, at: int) -> int:
        if at + 4 > len(self.data):
            raise self.fail("StringUnexpectedEof", len(self.data) - 1)
        m = _HEX.match(self.data, at)
        if not m:
            bad = next(i for i in range(at, at + 4) if chr(self.data[i]) not in "0123456789abcdefABCDEF")
            raise self.fail("InvalidUnicodeSequence", bad, chr(self.data[bad]))
        return int(m[0], 16)


def decode_at(data: bytes, at: int) -> tuple[str, int]:
    """The character that a JSON string body has at a place, and where the next one starts; ParseError if malformed."""
    reader = _Strict(data)
    reader.at = at
    c = data[at]
    if c == 0x5C:
        return reader.escape(), reader.at
    if c >= 0x80:
        n = reader.sequence()
        return data[at : at + n].decode(), at + n
    if c < 0x20 or c == 0x7F:
        raise ParseError("InvalidControlCharacter", at, c)
    return chr(c), at + 1
