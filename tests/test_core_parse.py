"""The strict parser, numbers, printing and comparison."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.core import values
from skarn.core.errors import ParseError
from skarn.core.parse import parse

BAD = [
    (b"", "UnexpectedEof", 0),
    (b"  ", "UnexpectedEof", 1),
    (b"[", "UnexpectedEof", 0),
    (b'{"a": 1,', "UnexpectedEof", 7),
    (b'{"a": 1', "UnexpectedEof", 6),
    (b'{"a"', "UnexpectedEof", 3),
    (b"[ true : 1]", "UnexpectedToken", 7),
    (b"{ true : 1 }", "UnexpectedToken", 2),
    (b'{"a": 1,}', "UnexpectedToken", 8),
    (b'{"a": 1 true', "UnexpectedToken", 8),
    (b'{"a" 1', "UnexpectedToken", 5),
    (b"[1,]", "UnexpectedToken", 3),
    (b"[1] 2", "UnexpectedToken", 4),
    (b'{"k": 1, "k": 2}', "DuplicateName", 9),
    (b'{"k": 1, "\\u006b": 2}', "DuplicateName", 9),
    (b"tru", "UnexpectedEof", 2),
    (b"nulx", "UnexpectedCharacter", 3),
    (b"?", "UnexpectedCharacter", 0),
    (b"NaN", "UnexpectedCharacter", 0),
    (b"+7", "InvalidSign", 0),
    (b"-x", "InvalidSign", 0),
    (b"-", "UnexpectedEof", 0),
    (b"07", "LeadingZeros", 0),
    (b"-01", "LeadingZeros", 0),
    (b"1.2.3", "InvalidDecimal", 3),
    (b"1.", "InvalidDecimal", 1),
    (b"1.x", "InvalidDecimal", 1),
    (b"2e3.4", "InvalidDecimal", 3),
    (b"2e3e4", "InvalidScientific", 3),
    (b"2e", "InvalidScientific", 1),
    (b"2ex", "InvalidScientific", 1),
    (b"22+1", "InvalidScientific", 2),
    (b"2e+", "InvalidScientific", 2),
    (b"2e-y", "InvalidScientific", 2),
    (b"1e999", "OutOfRange", 0),
    (b"[9007199254740992]", "OutOfRange", 1),
    (b"-9007199254740992", "OutOfRange", 0),
    (b'"abc', "StringUnexpectedEof", 3),
    (b'"a\nb"', "InvalidControlCharacter", 2),
    (b'"a\x7fb"', "InvalidControlCharacter", 2),
    (b'"\\x"', "UnknownEscapedCharacter", 2),
    (b'"\\u12g4"', "InvalidUnicodeSequence", 5),
    (b'"\\ud800"', "StringUnexpectedEof", 7),
    (b'"\\udc00\\ud800"', "InvalidSurrogate", 1),
    (b'"\\ud83dabcdef"', "InvalidSurrogate", 1),
    (b'"\xff"', "InvalidByteSequence", 1),
    (b'"\xc0\xaf"', "InvalidByteSequence", 1),
    (b'"\xed\xa0\x80"', "InvalidByteSequence", 1),
    (b'"\xf4\x90\x80\x80"', "InvalidByteSequence", 1),
    (b'"\xe2\x82"', "InvalidByteSequence", 1),
]


@pytest.mark.parametrize(("text", "kind", "pos"), BAD)
def test_errors(text, kind, pos):
    with pytest.raises(ParseError) as e:
        parse(text)
    assert (e.value.kind, e.value.pos) == (kind, pos)


def test_limits():
    assert parse("[" * 128 + "]" * 128)
    with pytest.raises(ParseError, match="NestingDepthLimitExceeded"):
        parse("[" * 129 + "]" * 129)
    assert parse('"' + "x" * 8192 + '"')
    assert parse('"' + "\\n" * 8192 + '"') == "\n" * 8192
    with pytest.raises(ParseError, match="StringLengthLimitExceeded"):
        parse('"' + "é" * 4097 + '"')
    with pytest.raises(ParseError, match="InputBufferLimitExceeded"):
        parse(" " * (5 * 1024 * 1024 + 1))


def test_values():
    text = '\ufeff {"z": [1, -0, 1.0, 1e2, "\\ud83d\\ude00\\/"], "a": {"": null, "t": true}} '
    assert parse(text) == {"z": [1, 0, 1.0, 100.0, "😀/"], "a": {"": None, "t": True}}
    assert list(parse('{"b":1,"a":2}')) == ["b", "a"]
    assert isinstance(parse("1.0"), float) and isinstance(parse("1"), int)
    assert parse("9007199254740991") == 2**53 - 1
    assert parse("123456789012345678901234567890", exact=True) == 123456789012345678901234567890
    assert parse("1e400", exact=True) == Decimal("1e400")


def test_printing():
    v = parse('{"s": "a\\"\\n\\u0007é", "f": 1.50, "w": 2.0, "e": 1e21, "t": 1e-7, "l": [], "o": {}, "x": [null, {"k": false}]}')
    assert values.compact(v) == '{"s":"a\\"\\n\\u0007é","f":1.5,"w":2,"e":1000000000000000000000,"t":0.0000001,"l":[],"o":{},"x":[null,{"k":false}]}'
    assert values.pretty(parse('{"a":[1,{"b":[]}]}')) == '{\n    "a": [\n        1,\n        {\n            "b": []\n        }\n    ]\n}'


def test_comparison():
    order = lambda a, b: values.compare(parse(a), parse(b))
    assert order("1", "1.5") == -1 and order("2.0", "2") == 0 and order('"b"', '"a"') == 1
    assert order("1", '"1"') is None and order("true", "1") is None and order("false", "true") is None
    assert order("[1,2]", "[1,3]") is None and order('{"a":1,"b":2}', '{"b":2,"a":1}') == 0
    assert not values.equals(True, 1) and values.equals(5, 5.0) and not values.equals(5, 5.0, strict=True)
    assert values.canonical(parse('{"b":1.0,"a":-0.0}')) == values.canonical(parse('{"a":0,"b":1}'))
    assert values.canonical(5.0, True) != values.canonical(5, True)


JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(-(2.0**53) + 1, 2.0**53 - 1) | st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x7f")),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x7f"), max_size=4), x, max_size=4),
    max_leaves=12,
)


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_round_trip(v):
    again = parse(values.compact(v))
    assert values.equals(again, v) and values.canonical(again) == values.canonical(v)
    assert values.equals(parse(values.pretty(v)), v)
