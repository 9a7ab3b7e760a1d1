"""JSON Pointer, normalized paths as pointers, JSON Patch."""

import pytest

from skarn.core import patch, pointer
from skarn.core.errors import PatchError, PointerError
from skarn.core.parse import parse

DOC = parse('{"a": [10, null, {"b": "x"}], "": {"": 1}, "s/t": 2, "m~n": 3, "é": 4, "0": 5, "\\"q": 6}')

FOUND = [
    ("/a/0", 10), ("/a/1", None), ("/a/2/b", "x"), ("//", 1), ("/s~1t", 2), ("/m~0n", 3), ("/é", 4), ("/\\u00e9", 4),
    ("/0", 5), ("/m~\\u0030n", 3), ("/m\\u007e0n", 3), ("\\u002fa/0", 10), ('/\\"q', 6),
]
MISSED = ["/a/3", "/a/-", "/a/", "/x", "/a/0/0", "/a/1e0", "/a/99999999999999999999"]
WRONG = [
    ("a", "InvalidPointerSyntax", 0), ("\\u0061", "InvalidPointerSyntax", 0), ("/a~", "StringUnexpectedEof", 2),
    ("/a~2", "UnknownEscapedCharacter", 3), ("/a~\\u0062", "UnknownEscapedCharacter", 3), ("/\\u007e", "StringUnexpectedEof", 6),
    ("/a/+1", "InvalidIndex", 3), ("/a/01", "InvalidIndex", 3), ("/a/+", "InvalidIndex", 3), ("/a/x", "InvalidIndex", 3),
    ("/a\tb", "InvalidControlCharacter", 2), ("/\\q", "UnknownEscapedCharacter", 2),
]


@pytest.mark.parametrize(("text", "value"), FOUND)
def test_found(text, value):
    assert pointer.resolve(DOC, text) == value


def test_whole_and_scalars():
    assert pointer.resolve(DOC, "") is DOC
    assert pointer.resolve(5, "") is pointer.MISSING and pointer.resolve("s", "no pointer") is pointer.MISSING


@pytest.mark.parametrize("text", MISSED)
def test_missed(text):
    assert pointer.resolve(DOC, text) is pointer.MISSING


@pytest.mark.parametrize(("text", "kind", "pos"), WRONG)
def test_wrong(text, kind, pos):
    with pytest.raises(PointerError) as e:
        pointer.resolve(DOC, text)
    assert (e.value.kind, e.value.pos) == (kind, pos)


NPATHS = [
    ("$", ""), ("$['x'][3]['y z']", "/x/3/y z"), ("$['o\\'k']", "/o'k"), ("$['~/'][0]['/~']", "/~0~1/0/~1~0"), ("$['tab\\t']", "/tab\\t"), ("$['\\u0001\\u001e']", "/\\u0001\\u001e"), ("$['']['']", "//"),
    ("$['x'][", None), ("$[x]", None), ("$['x'] ", None), ("$[-1]", None), ("$['x\\']", None), ("$['\\v']", None), ("$['\\u000A']", None), ("$['\\u0009']", None),
    ("$['\\u00e9']", None), ("$[01]", None), ("x", None), ("", None), ("$.x", None),
]


@pytest.mark.parametrize(("npath", "text"), NPATHS)
def test_npath(npath, text):
    assert pointer.from_npath(npath) == text


def applied(doc, *ops):
    return patch.modify(parse(doc), patch.read([parse(o) for o in ops]))


OPS = [
    ('{"a": {"b": 1}}', '{"op": "add", "path": "/a/b", "value": [2]}', {"a": {"b": [2]}}),
    ('{"a": {}}', '{"op": "add", "path": "/a/c", "value": null}', {"a": {"c": None}}),
    ("{}", '{"op": "add", "path": "", "value": 7}', 7),
    ("[1, 3]", '{"op": "add", "path": "/1", "value": 2}', [1, 2, 3]),
    ("[1]", '{"op": "add", "path": "/1", "value": 2}', [1, 2]),
    ("[1]", '{"op": "add", "path": "/-", "value": 2}', [1, 2]),
    ('{"a": 1, "b": 2}', '{"op": "remove", "path": "/a"}', {"b": 2}),
    ("[[1, 2]]", '{"op": "remove", "path": "/0/0"}', [[2]]),
    ('{"a": 1}', '{"op": "replace", "path": "/a", "value": {}}', {"a": {}}),
    ("[1]", '{"op": "replace", "path": "", "value": "r"}', "r"),
    ("[1, 2]", '{"op": "replace", "path": "/1", "value": 9}', [1, 9]),
    ('{"a": [1], "b": [2]}', '{"op": "copy", "from": "/a", "path": "/b/0"}', {"a": [1], "b": [[1], 2]}),
    ('{"a": 1}', '{"op": "copy", "from": "", "path": "/b"}', {"a": 1, "b": {"a": 1}}),
    ('{"a": 1, "b": {}}', '{"op": "move", "from": "/a", "path": "/b/c"}', {"b": {"c": 1}}),
    ("[1, 2, 3]", '{"op": "move", "from": "/0", "path": "/2"}', [2, 3, 1]),
    ('{"a": 1}', '{"op": "move", "from": "/a", "path": "/a"}', {"a": 1}),
    ('{"a": [1.0]}', '{"op": "test", "path": "/a", "value": [1], "more": 0}', {"a": [1.0]}),
    ('{"": 1}', '{"op": "replace", "path": "/", "value": 2}', {"": 2}),
]


@pytest.mark.parametrize(("doc", "op", "result"), OPS)
def test_operations(doc, op, result):
    value, error = applied(doc, op)
    assert error is None and value == result


FAILS = [
    ('{"a": {}}', '{"op": "remove", "path": "/a/b/c"}', "PathNotFound", ("/a/b/c", 1)),
    ('{"a": {"b": {}}}', '{"op": "remove", "path": "/a/b/c"}', "PathNotFound", ("/a/b/c", 3)),
    ("5", '{"op": "remove", "path": "/a/b"}', "PathNotFound", ("/a/b", 0)),
    ('{"a": [1]}', '{"op": "add", "path": "/a/4/b", "value": 1}', "IndexOutOfBounds", ("/a/4/b", 1, 4, 1)),
    ('{"a": [1]}', '{"op": "replace", "path": "/a/1", "value": 1}', "IndexOutOfBounds", ("/a/1", 2, 1, 1)),
    ('{"a": [1]}', '{"op": "add", "path": "/a/2", "value": 1}', "IndexOutOfBounds", ("/a/2", 2, 2, 1)),
    ("{}", '{"op": "remove", "path": ""}', "InvalidRootOp", "remove"),
    ("{}", '{"op": "move", "from": "", "path": "/a"}', "InvalidRootOp", "move"),
    ('{"a": {"b": 1}}', '{"op": "move", "from": "/a", "path": "/a/b"}', "InvalidMove", ("/a", "/a/b")),
    ("[1]", '{"op": "test", "path": "/0", "value": "1"}', "NotEqual", None),
    ("[1]", '{"op": "remove", "path": "/-"}', "Pointer", None),
]


@pytest.mark.parametrize(("doc", "op", "kind", "detail"), FAILS)
def test_failures(doc, op, kind, detail):
    root = parse(doc)
    value, error = patch.modify(root, patch.read([parse(op)]))
    assert error.kind == kind and error.index == 0 and (detail is None or error.detail == detail)
    assert value == parse(doc)


BAD = [
    ("5", "UnexpectedValue", None, "Array"), ("[1]", "UnexpectedValue", 0, "Object"), ("[{}]", "MissingMember", 0, "op"),
    ('[{"op": "grow"}]', "UnexpectedField", 0, "op: valid op"), ('[{"op": "add"}]', "MissingMember", 0, "path"),
    ('[{"op": "add", "path": 1}]', "UnexpectedField", 0, "path: string"), ('[{"op": "add", "path": ""}]', "MissingMember", 0, "value"),
    ('[{"op": "copy", "path": ""}]', "MissingMember", 0, "from"), ("[", "ParseError", None, None),
]


@pytest.mark.parametrize(("text", "kind", "index", "detail"), BAD)
def test_bad_patches(text, kind, index, detail):
    with pytest.raises(PatchError) as e:
        patch.read(text)
    assert (e.value.kind, e.value.index) == (kind, index) and (detail is None or e.value.detail == detail)


def test_partial_and_atomic():
    ops = '[{"op": "add", "path": "/n", "value": 1}, {"op": "remove", "path": "/gone"}, {"op": "add", "path": "/m", "value": 2}]'
    value, error = patch.modify({"a": 0}, ops)
    assert value == {"a": 0, "n": 1} and (error.kind, error.index) == ("PathNotFound", 1)
    root = {"a": 0}
    value, error = patch.try_modify(root, ops)
    assert value == {"a": 0} == root and error.index == 1
    assert patch.modify({"a": 0}, '[{"op": "add", "path": "/b", "value": 0}, {"op": "no"}]')[0] == {"a": 0}
