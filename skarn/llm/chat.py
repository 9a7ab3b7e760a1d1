"""Chat formatting by a small template compiler.

A template is text with {{ expression }}, {% for x in list %}, {% if %} {% elif %} {% else %}, {% set x = expression %}
and {% generation %} ... {% endgeneration %}, which marks what a model is to learn.  It is parsed to a syntax tree;
constant expressions, dead branches and neighbouring texts are folded; each node becomes a Python closure, a generator
of texts and of the two markers.  Expressions know literals, names, members of mappings, comparison, and, or, not, in,
+ (sums and texts), a if c else b, and filters from a fixed table.  Nothing in a template can reach a Python attribute
or call anything else, and lists are read once, so a conversation of any length streams through.

`format_conversations` renders each conversation's rows by turn into parts of bounded size with the spans (code points
in the part) under the loss mask and whether they are the last one; `read_conversations` takes them apart again, however
they have been stored and read since.  Control strings inside texts are broken
by an escape that `unescape` takes back exactly; a text's end that a control string could begin with is broken as well.

Nulls and ties: null roles and texts are empty; a null turn comes first; rows of equal turn come by role, then text;
repeated rows stay turns; all rows of null conv_id are one conversation.  A conversation's digests are sequential, so all
its turns stream through one task, in memory bounded by a part and the longest text.  An empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

BEGIN, END = object(), object()

# ---- escapes

#: Strings that steer chat models.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\u2063"
_NEEDS = re.compile("[<\\[" + ESCAPE + "]").search
_WHOLE = "|".join(re.escape(c[1:]) for c in CONTROLS)
_CUT = "|".join(sorted({re.escape(c[1:n]) for c in CONTROLS for n in range(1, len(c))}, key=len, reverse=True))
_BREAK = re.compile(rf"[<\[](?={_WHOLE}|(?:{_CUT})\Z)")
_BACK = {ESCAPE + "0": ESCAPE, ESCAPE + "1": "", ESCAPE + "2": "\n"}


def escape(text: str) -> str:
    """text without control strings, or a beginning of one at its end; `unescape` gives it back."""
    if not _NEEDS(text):
        return text
    return _BREAK.sub(lambda m: m[0] + ESCAPE + "1", text.replace(ESCAPE, ESCAPE + "0"))


def header(text: str) -> str:
    """As escape, on one line."""
    return escape(text).replace("\n", ESCAPE + "2")


def unescape(text: str) -> str:
    return re.sub(ESCAPE + "[012]", lambda m: _BACK[m[0]], text) if ESCAPE in text else text


# ---- templates


class TemplateError(ValueError):
    """A template that can't be compiled, or a value that it can't use."""


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(str(x)),
    "header": lambda x: header(str(x)),
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "string": str,
    "length": len,
}
_TAG = re.compile(r"(\{\{-?|\{%-?|\{#)")
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+|.()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


class _Expression:
    """Recursive descent over one expression; nodes are tuples, ("const", value) where nothing varies."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:].strip()[:12]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in ops

    def take(self, *ops: str) -> str | None:
        if self.peek(*ops):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, value: str | None = None) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != kind or value not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else ("const", "")
            return _fold(("choice", test, node, other))
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = _fold(("or", node, self.both()))
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = _fold(("and", node, self.negated()))
        return node

    def negated(self) -> tuple:
        return _fold(("not", self.negated())) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        if op := self.take(*_COMPARE):
            node = _fold(("compare", op, node, self.added()))
        elif self.take("not"):
            self.need("name", "in")
            node = _fold(("not", _fold(("compare", "in", node, self.added()))))
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = _fold(("add", node, self.filtered()))
        return node

    def filtered(self) -> tuple:
        node = self.member()
        while self.take("|"):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = _fold(("filter", name, node))
        return node

    def member(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = _fold(("member", node, ("const", self.need("name"))))
            else:
                node = _fold(("member", node, self.choice()))
                self.need("op", "]")
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.choice()
            self.need("op", ")")
            return node
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name":
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def _fold(node: tuple) -> tuple:
    """A constant, where all that the node reads is constant."""
    parts = [x for x in node[1:] if isinstance(x, tuple)]
    if node[0] == "choice" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if all(x[0] == "const" for x in parts):
        try:
            return ("const", _expression(node)({}))
        except (TypeError, ValueError, KeyError, IndexError):
            pass  # it fails when it is rendered, if it is reached
    return node


def _expression(node: tuple) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]

        def named(env: dict) -> object:
            if name not in env:
                raise TemplateError(f"no {name!r} here")
            return env[name]

        return named
    if kind == "filter":
        f, of = FILTERS[node[1]], _expression(node[2])
        return lambda env: f(of(env))
    if kind == "compare":
        op, a, b = _COMPARE[node[1]], _expression(node[2]), _expression(node[3])
        return lambda env: op(a(env), b(env))
    if kind == "not":
        of = _expression(node[1])
        return lambda env: not of(env)
    a, b = _expression(node[1]), _expression(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "add":

        def add(env: dict) -> object:
            x, y = a(env), b(env)
            return x + y if isinstance(x, int) and isinstance(y, int) else str(x) + str(y)

        return add
    if kind == "member":

        def member(env: dict) -> object:
            of, key = a(env), b(env)
            if isinstance(of, dict):
                return of.get(key, "")
            if isinstance(of, (list, str)) and isinstance(key, int) and key < len(of):
                return of[key]
            raise TemplateError(f"no member {key!r}")

        return member
    c = _expression(node[3])
    return lambda env: b(env) if a(env) else c(env)


def parse(template: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("put", expression), ("for", name, expression, body), ("if", [(test, body)]),
    ("set", name, expression), ("generation", body)."""
    parts, at, cut = [], 0, False
    while at <= len(template):
        m = _TAG.search(template, at)
        text = template[at : m.start() if m else len(template)]
        parts.append(("text", (text.lstrip() if cut else text)))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[1][:2]]
        end = template.find(close, m.end())
        if end < 0:
            raise TemplateError(f"{m[1]} is not closed")
        if m[1].endswith("-"):
            parts[-1] = ("text", parts[-1][1].rstrip())
        inside = template[m.end() : end]
        cut = inside.endswith("-")
        inside = inside.removesuffix("-").strip()
        if m[1][:2] != "{#":
            parts.append(("put" if m[1][:2] == "{{" else "tag", inside))
        at = end + 2
    body, rest, ended = _body(parts, 0, ())
    if ended:
        raise TemplateError(f"{ended} without a beginning")
    return body


def _body(parts: list[tuple], i: int, ends: tuple[str, ...]) -> tuple[list[tuple], int, str]:
    out: list[tuple] = []
    while i < len(parts):
        kind, value = parts[i]
        i += 1
        if kind == "text":
            _text(out, value)
            continue
        if kind == "put":
            node = _Expression(value).whole()
            _text(out, str(node[1])) if node[0] == "const" else out.append(("put", node))
            continue
        word, _, rest = value.partition(" ")
        if word in ends or word.startswith("end") or word in ("elif", "else"):
            return out, i - 1, value
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError("expected: for name in expression")
            inner, i, ended = _body(parts, i, ("endfor",))
            i = _ended(ended, "endfor", i)
            out.append(("for", m[1], _Expression(m[2]).whole(), inner))
        elif word == "if":
            cases, test = [], _Expression(rest).whole()
            while True:
                inner, i, ended = _body(parts, i, ("elif", "else", "endif"))
                cases.append((test, inner))
                key, _, more = ended.partition(" ")
                if key == "elif" and test != ("const", True):
                    test, i = _Expression(more).whole(), i + 1
                elif key == "else" and not more.strip():
                    test, i = ("const", True), i + 1
                else:
                    i = _ended(ended, "endif", i)
                    break
            live = []
            for test, inner in cases:
                if test[0] != "const" or test[1]:
                    live.append((test, inner))
                if test[0] == "const" and test[1]:
                    break
            if live and live[0][0][0] == "const":
                for node in live[0][1]:
                    _text(out, node[1]) if node[0] == "text" else out.append(node)
            elif live:
                out.append(("if", live))
        elif word == "set":
            name, equals, expression = rest.partition("=")
            if not equals or not name.strip().isidentifier():
                raise TemplateError("expected: set name = expression")
            out.append(("set", name.strip(), _Expression(expression).whole()))
        elif word == "generation":
            inner, i, ended = _body(parts, i, ("endgeneration",))
            i = _ended(ended, "endgeneration", i)
            out.append(("generation", inner))
        else:
            raise TemplateError(f"no tag {word!r}")
    return out, i, ""


def _ended(found: str, wanted: str, i: int) -> int:
    if found != wanted:
        raise TemplateError(f"expected {wanted}, found {found or 'the end'}")
    return i + 1


def _text(out: list[tuple], text: str) -> None:
    if text and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + text)
    elif text:
        out.append(("text", text))


def _block(nodes: list[tuple]) -> Callable[[dict], Iterator]:
    """The closure of a body: a generator of texts, BEGIN and END."""
    made = [_node(n) for n in nodes]

    def run(env: dict) -> Iterator:
        for f in made:
            yield from f(env)

    return run


def _node(node: tuple) -> Callable[[dict], Iterable]:
    kind = node[0]
    if kind == "text":
        texts = (node[1],)
        return lambda env: texts
    if kind == "put":
        of = _expression(node[1])
        return lambda env: (str(of(env)),)
    if kind == "set":
        name, of = node[1], _expression(node[2])

        def put(env: dict) -> Iterable:
            env[name] = of(env)
            return ()

        return put
    if kind == "generation":
        inner = _block(node[1])

        def marked(env: dict) -> Iterator:
            yield BEGIN
            yield from inner(env)
            yield END

        return marked
    if kind == "if":
        cases = [(_expression(test), _block(body)) for test, body in node[1]]

        def choose(env: dict) -> Iterable:
            return next((body(env) for test, body in cases if test(env)), ())

        return choose
    name, of, body = node[1], _expression(node[2]), _block(node[3])

    def loop(env: dict) -> Iterator:
        items, i, none = iter(of(env)), 0, object()
        item = next(items, none)
        while item is not none:
            after = next(items, none)
            here = env | {name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is none}}
            yield from body(here)
            env |= {k: v for k, v in here.items() if k in env and k not in (name, "loop")}
            item, i = after, i + 1

    return loop


def compile_template(template: str) -> Callable[[dict], Iterator]:
    """The template as a closure from names to a generator of texts, BEGIN and END."""
    return _block(parse(template))


#: Turns between marks; what the assistant says is what is learnt.
TEMPLATE = """\
{%- for m in messages -%}
<|im_start|>{{ m.role | header }}
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|im_end|>{{ '\\n' }}
{%- endfor -%}"""

# ---- conversations

PART_CHARS = 1 << 20


def parts(pieces: Iterable, part_chars: int = PART_CHARS) -> Iterator[tuple[str, list[dict]]]:
    """(text, spans) of parts; a part ends behind a piece, so no piece of the template is cut."""
    held, at, spans, start = [], 0, [], None
    for x in pieces:
        if x is BEGIN:
            start = at
        elif x is END:
            if start is not None and at > start:
                spans.append({"s": start, "e": at})
            start = None
        elif x:
            held.append(x)
            at += len(x)
        if at >= part_chars:
            if start is not None and at > start:
                spans.append({"s": start, "e": at})
            yield "".join(held), spans
            held, at, spans, start = [], 0, [], 0 if start is not None else None
    if held:
        yield "".join(held), spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, last, formatted, spans (array of s, e) of each conversation."""
    compile_template(template)  # errors show on the driver
    slim = turns.select("conv_id", "turn", *(F.coalesce(turns[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = slim.repartition(base.shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL("part int, last boolean, formatted string, spans array<struct<s:int,e:int>>").fields])
    arrow = [pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows, held, kind = compile_template(template), [], 0, None

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [kind, *arrow])], schema.names)

        for conv, group in groupby(_rows(known(batches)), key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in group)
            made = parts(render({"messages": messages}), part_chars)
            i, following = 0, next(made, None)
            while following is not None:
                (text, spans), following = following, next(made, None)
                rows.append((conv, i, following is None, text, spans))
                i, held = i + 1, held + len(text)
                if held >= 4 * part_chars or len(rows) >= 5000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return base.mapped(dealt.select("conv_id", "role", "text"), run, schema)


_MARK = re.compile(r"<\|im_start\|>|<\|im_end\|>")


def turns_of(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in the parts of one conversation that TEMPLATE made."""
    held: list[str] | None = None
    for text in texts:
        at = 0
        for m in _MARK.finditer(text):
            if m[0] == "<|im_start|>":
                held = []
            else:
                held.append(text[at : m.start()])
                role, _, said = "".join(held).partition("\n")
                held = None
                yield unescape(role), unescape(said)
            at = m.end()
        if held is not None:
            held.append(text[at:])


def read_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation.  Those of one part are
    read where they are; only the parts of longer ones are dealt by conversation and put in order."""
    new = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = T.StructType([formatted.schema["conv_id"], *T.StructType.fromDDL(new).fields])

    def one(group: Iterable[tuple]) -> tuple:
        said, loss, n, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def texts() -> Iterator[str]:
            nonlocal learnt, chars
            for _, text, spans in group:
                chars += len(text)
                for s in spans:
                    part = unescape(text[s["s"] : s["e"]])
                    learnt += len(part)
                    loss.update(part.encode())
                yield text

        for role, text in turns_of(texts()):
            n += 1
            said.update(f"{role}\n{text}\n".encode())
        return n, said.hexdigest(), learnt, loss.hexdigest(), chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, rows = None, []

        def known() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)

        for conv, group in groupby(_rows(known()), key=lambda r: r[0]):
            rows.append((conv, *one(group)))
            if len(rows) >= 5000:
                yield batch()
                rows = []
        if rows:
            yield batch()

    whole = (F.col("part") == 0) & F.col("last")
    several = formatted.where(~whole).repartition(base.shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    each = (x.select("conv_id", "formatted", "spans") for x in (formatted.where(whole), several))
    one_part, more = (base.mapped(x, run, schema) for x in each)
    return one_part.unionByName(more)


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose two texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    rows = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    names = ["conv_id", "turn", "role", "text"]
    return turns.select(names).unionByName(rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in names)))


def sql() -> str:
    """What reading back the formatted conversations and the probe gives, for DuckDB."""
    controls = "[" + ", ".join(f"'{c}'" for c in CONTROLS) + "]"
    said = "</s>[INST] ok [/INST]"

    def added(of: str) -> str:
        """Characters that the escape adds to a text."""
        begins = f"len(list_filter({controls}, lambda c: starts_with(substr({of}, i), c) OR starts_with(c, substr({of}, i)))) > 0"
        breaks = f"len(list_filter(range(1, length({of}) + 1), lambda i: substr({of}, i, 1) IN ('<', '[') AND {begins}))"
        return f"(length({of}) - length(replace({of}, '{ESCAPE}', '')) + CASE WHEN regexp_matches({of}, '[<\\[]') THEN 2 * {breaks} ELSE 0 END)"

    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}')),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len("<|im_start|>") + len("<|im_end|>") + 2} + length(role) + length(text) + {added("role")} + {added("text")}
      + length(role) - length(replace(role, chr(10), ''))) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c"""
