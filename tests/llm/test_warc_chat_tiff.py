"""WARC, chat formatting and TIFF: exact round trips and odd rows."""

import base64
import hashlib
import io
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import base, chat, tiff, warc

# ---- WARC

PAGES = [
    (5, "http://a/1", "<html>é one</html>", "x"), (3, "http://a/2", "<html>é one</html>", "x"), (9, "http://a/\r\n3", "<html>é one</html>", "x"), (7, None, None, "x"), (8, "u", "", "x"),
    (None, "n", "<html>é one</html>", "x"), (None, "m", "only here", "x"), (4, "t", "tie", "x"), (4, "t", "tie", "x"), (4, "s", "tie", "x"), (10, "long", "y" * 300_000, "x"), (11, "crlf", "a\r\n\r\nWARC/1.1\r\n", "x"),
]


def expected(pages, least=0):
    first = {}
    for i, _, html, _ in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", 1 << 62), i)
    done, out = set(), []
    for i, url, html, _ in sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        data = (html or "").encode()
        copies = sum((p[2] or "") == (html or "") for p in pages)
        f = first.get(html or "")
        response = copies == 1 or len(data) < least or f == i and (html or "") not in done
        if response:
            done.add(html or "")
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else f))
    return sorted(map(repr, out))


@pytest.mark.parametrize("least", [0, 5])
def test_warc(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, sha string")
    got = warc.round_trip(pages, least)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(PAGES, least)


def test_warc_files(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, sha string")
    folders = [base.work_path(spark, "t") for _ in range(2)]
    made = [warc.write(p, f, roll_bytes=400) for p, f in zip((pages, pages.repartition(7)), folders)]
    names = [sorted((r.name, r.records, r.bytes) for r in m.collect()) for m in made]
    assert names[0] == names[1] and len(names[0]) > 4 and sum(r[1] for r in names[0]) == len(PAGES)
    data = [[base.Files(f).open(n).read() for n, _, _ in names[0]] for f in folders]
    assert data[0] == data[1]
    heads = [h for d in data[0] for h, _ in warc.records(io.BytesIO(d), chunk=7)]
    assert len(heads) == len(PAGES) and len({h["WARC-Record-ID"] for h in heads}) == len(PAGES) - 1
    for d in data[0]:
        for head, block in warc.records(io.BytesIO(d)):
            assert head["WARC-Block-Digest"] == "sha1:" + warc.digest(block) and int(head["Content-Length"]) == len(block)
    html = {r.page_id: r.html for r in warc.read(made[0], folders[0]).where("record_type = 'response'").collect()}
    assert html[10] == "y" * 300_000 and html[11] == PAGES[-1][2]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_damage():
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(io.BytesIO(warc.member(warc.record("response", 1, "u", b"x", None))[:-9])))


# ---- chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, *(c[:n] for c in chat.CONTROLS for n in (1, 2, 4)), chat.ESCAPE, "0", "1", "a", "\n", "é"]), max_size=8).map("".join))
def test_escape(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)
    for after in ("<|im_end|>\n", "</s>", "[/INST]"):
        assert min(i for i in ((safe + after).find(c) for c in chat.CONTROLS) if i >= 0) == len(safe)
    assert chat.unescape(chat.header(text)) == text and "\n" not in chat.header(text)


CASES = [
    ("plain", {}, "plain"), ("{{ 1 + 2 }}{{ 'a' + 1 }}", {}, "3a1"), ("{# no #}x", {}, "x"), ("{{ a.b['c'] }}", {"a": {"b": {"c": 5}}}, "5"), ("{{ a.z }}", {"a": {}}, ""),
    ("{% for x in l %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"l": iter("ab")}, "1a,2b"), ("{% if a == 'x' and b > 1 or false %}y{% else %}n{% endif %}", {"a": "x", "b": 2}, "y"),
    ("{% if 1 > 2 %}dead{{ nowhere }}{% elif true %}live{% else %}dead{% endif %}", {}, "live"), ("{{ 'a' if b else 'c' }}", {"b": 0}, "c"), ("{{ '  x ' | trim | upper }}", {}, "X"), ("a {%- if true -%} b {%- endif -%} c", {}, "abc"),
    ("{% set n = 4 %}{{ n + 1 }}", {}, "5"), ("{% set s = 0 %}{% for x in l %}{% set s = s + x %}{% endfor %}{{ s }}", {"l": [1, 2, 3]}, "6"), ("{{ 'a' in 'cat' }}{{ 'z' not in 'cat' }}", {}, "TrueTrue"), ("{{ \"q\\n\" }}", {}, "q\n"),
]


@pytest.mark.parametrize(("template", "names", "text"), CASES)
def test_templates(template, names, text):
    assert "".join(x for x in chat.compile_template(template)(dict(names)) if isinstance(x, str)) == text


def test_folding():
    assert chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% endif %}e") == [("text", "abCde")]
    assert chat.parse("{% if false %}x{% endif %}") == []


@pytest.mark.parametrize("bad", ["{{ x", "{% for x %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ a | system }}", "{{ a() }}", "{% import os %}", "{{ 1 + }}", "{% generation %}{% endfor %}", "{{ @ }}", "{% else %}"])
def test_template_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_sandbox():
    for t in ("{{ a.__class__ }}", "{{ a['__class__'] }}"):
        with pytest.raises(chat.TemplateError):
            list(chat.compile_template(t)({"a": object()}))
        assert list(chat.compile_template(t)({"a": {}})) == [""]


TURNS = [
    (1, 0, "system", "be <|im_end|> kind"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "user", "hi\n[INST"), (2, 0, "assistant", None), (2, 1, None, "who?"), (2, 1, None, "who?"),
    (3, None, "assistant", "first" + chat.ESCAPE), (3, 0, "assistant", "x" * 5000), (4, 0, "a\nb<s>", "odd role"), (None, 0, "user", "null"), (None, 1, "assistant", "conv <"), (5, 0, "assistant", ""),
]


@pytest.mark.parametrize("part_chars", [1, 50, 1 << 20])
def test_conversations(spark, part_chars):
    turns = chat.with_probe(spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, part string"))
    made = chat.format_conversations(turns, part_chars=part_chars).cache()
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_conversations(made).collect()}
    said = "</s>[INST] ok [/INST]"
    rows = [(c, t, r or "", x or "") for c, t, r, x in [*TURNS, (-1, 0, "user", said), (-1, 1, "assistant", said)]]
    key = lambda x: (x[0] is not None, x[0] or 0)
    for conv, group in itertools.groupby(sorted(rows, key=lambda x: (*key(x), x[1] is not None, x[1] or 0, x[2], x[3])), key=lambda x: x[0]):
        group = list(group)
        loss = "".join(x for _, _, r, x in group if r == "assistant")
        whole = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in group).encode()).hexdigest()
        assert got.pop(conv)[:4] == (len(group), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got and chat.read_conversations(chat.format_conversations(turns.limit(0))).count() == 0


# ---- TIFF


@pytest.mark.parametrize("n", [0, 1, 2, 200, 9000])
@pytest.mark.parametrize("values", [1, 3, 256])
def test_codecs(n, values):
    data = bytes(random.Random(n + values).choices(range(values), k=n))
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data and tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_known_codes():
    assert tiff.packbits_decode(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80])) == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4)
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_images(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 256, (33, 50, 3)).astype(np.uint8), rng.integers(0, 6000, (20, 7, 1)).astype(np.uint16), np.zeros((1, 1, 1), np.uint8)]
    back = list(tiff.decode(tiff.encode(arrays, compression, predictor, rows=10, tile=tile, order=order)))
    assert len(back) == 3 and all((a == b).all() for a, b in zip(arrays, back))


def test_pages(spark):
    two = tiff.encode([np.arange(12, dtype=np.uint8).reshape(3, 4)] * 2)
    circle = bytearray(tiff.encode([np.zeros((2, 2), np.uint8)]))
    circle[-4:] = circle[4:8]
    rows = spark.createDataFrame([(1, bytearray(two)), (2, None), (3, bytearray(b"no")), (4, bytearray(two[:40])), (5, circle)], "id long, file binary")
    got = sorted((r.id, r.page, r.height, r.width, r.error is None) for r in tiff.pages(rows, "file", ("id",)).collect())
    assert got[:2] == [(1, 0, 3, 4, True), (1, 1, 3, 4, True)] and [g[:2] for g in got if not g[-1]] == [(3, -1), (4, -1), (5, -1)]


def test_texts(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "long " * 60_000, "a"]
    docs = spark.createDataFrame([(i if i != 2 else None, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in tiff.digests(tiff.text_images(docs)).collect()}
    assert len(rows) == 7 and rows[0][2:] == rows[1][2:] and rows[None][2:] == rows[6][2:]
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
        r = rows[None if i == 2 else i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tiff.digests(tiff.text_images(docs.limit(0))).count() == 0


def test_every_way_to_store(spark):
    """Each codec, predictor, layout and byte order is used, over one page and several, and equal texts give equal files."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc é\n", k=rng.choice([0, 10, 200, 3000]))) for _ in range(900)] + ["x" * (64 * tiff.PAGE_ROWS + 5)]
    files = [tiff.text_image(t) for t in texts]
    ways, counts = set(), set()
    for t, f in zip(texts, files):
        tags = list(tiff.directories(f))
        ways.add((f[:2], tags[0][tiff.COMPRESSION][0], tags[0][tiff.PREDICTOR][0], tiff.TILE_AT in tags[0]))
        counts.add(len(tags))
        assert b"".join(p.tobytes() for p in tiff.decode(f)) == tiff.text_payload(t)
    assert len(ways) == 2 * 5 * 2 * 2 and counts >= {1, 2} and files[0] == tiff.text_image(texts[0])


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS])
def test_packed_samples(bits, compression):
    """Samples of less than a byte, rows at whole bytes."""
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << bits, (9, 13)).astype(np.uint8)
    rows = np.packbits((values[:, :, None] >> np.arange(bits)[::-1] & 1).reshape(9, -1), axis=1)
    made = bytearray(tiff.encode([rows], compression, rows=4))
    at = int.from_bytes(made[4:8], "little")
    for i in range(int.from_bytes(made[at : at + 2], "little")):
        tag = int.from_bytes(made[at + 2 + 12 * i : at + 4 + 12 * i], "little")
        if tag in (tiff.WIDTH, tiff.BITS):
            made[at + 10 + 12 * i : at + 12 + 12 * i] = (13 if tag == tiff.WIDTH else bits).to_bytes(2, "little")
    (back,) = tiff.decode(bytes(made))
    assert (back[:, :, 0] == values).all()


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 3), st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 255)), min_size=1, max_size=4))
def test_damaged_headers(way, changes):
    """Whatever the bytes say, a file gives rows, some with an error, and never raises."""
    arrays = [np.arange(300, dtype=np.uint8).reshape(20, 15), np.ones((5, 5), np.uint8)]
    data = bytearray(tiff.encode(arrays, (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)[way], 1 + way % 2, 8, (16, 16) if way > 1 else None, "<>"[way % 2]))
    for at, value in changes:
        data[at % len(data)] = value
    for number, page, error in tiff._pages(bytes(data)):
        assert (page is None) == (error is not None) and number >= -1


def test_pages_behind_a_bad_one(spark):
    arrays = [np.full((4, 4), i, np.uint8) for i in range(3)]
    data = bytearray(tiff.encode(arrays))
    first = int.from_bytes(data[4:8], "little")
    for field in (tiff.WIDTH, tiff.ROWS, tiff.COMPRESSION):
        bad = bytearray(data)
        for i in range(int.from_bytes(data[first : first + 2], "little")):
            if int.from_bytes(data[first + 2 + 12 * i : first + 4 + 12 * i], "little") == field:
                bad[first + 10 + 12 * i : first + 14 + 12 * i] = bytes(4)
        rows = spark.createDataFrame([(1, 5, bad)], "id long, page int, file binary")
        got = sorted((r.k_page, r.page, r.error is None) for r in tiff.pages(rows, "file", ("id", "page")).collect())
        assert got == [(5, 0, False), (5, 1, True), (5, 2, True)]


def test_revisits_can_be_resolved(spark):
    """A revisit names the record, URI and date of its response."""
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, sha string")
    folder = base.work_path(spark, "t")
    names = [r.name for r in warc.write(pages, folder).collect()]
    heads = [h for n in names for h, _ in warc.records(io.BytesIO(base.Files(folder).open(n).read()))]
    by = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 6
    for h in revisits:
        at = by[h["WARC-Refers-To"]]
        assert (at["WARC-Target-URI"], at["WARC-Date"], at["WARC-Payload-Digest"], at["X-Page-ID"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["WARC-Payload-Digest"], h["X-Refers-To-Page"])


def test_common_payload(spark):
    """A payload that most pages share is looked up by broadcast, to the same result."""
    pages = spark.createDataFrame([(i, f"u{i}", "" if i % 3 else f"<p>{i % 50}", "x") for i in range(4000)], "page_id long, url string, html string, sha string")
    got = warc.round_trip(pages)
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected([tuple(r) for r in pages.collect()])


def test_conversations_stored_in_any_order(spark):
    """The parts of a conversation may be stored, mixed and read again."""
    turns = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"{c} says {t} " * 20) for c in range(20) for t in range(c)], "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(turns, part_chars=300)
    wanted = sorted(map(tuple, chat.read_conversations(chat.format_conversations(turns)).collect()))
    mixed = base.written(made.repartition(7), "mixed").repartition(3)
    assert sorted(map(tuple, chat.read_conversations(mixed).collect())) == wanted and len(wanted) == 19


def test_files_elsewhere(tmp_path):
    """A file system that doesn't replace files keeps what an earlier attempt has put there."""
    from pyarrow import fs

    class Kept(fs.LocalFileSystem):
        def move(self, old, new):
            if self.get_file_info(new).is_file:
                raise FileExistsError(new)
            super().move(old, new)

    files = base.Files(f"file://{tmp_path}")
    files.fs, files.root = Kept(), str(tmp_path)
    for data in (b"one", b"one"):
        with files.create(".t.tmp") as out:
            out.write(data)
        files.move(".t.tmp", "whole")
    assert files.open("whole").read() == b"one" and not (tmp_path / ".t.tmp").exists()
    files.drop("absent")


def test_shared_folder(spark, tmp_path):
    """Work folders go at the end of their scope, but for what outlives it."""
    import os

    here = lambda df: df.inputFiles()[0].removeprefix("file://")
    with base.scope(spark):
        with base.scope(spark):
            one, two = base.written(spark.range(3), "one"), base.written(spark.range(4), "two", outlives=True)
            paths = here(one), here(two)
        assert not os.path.exists(paths[0]) and two.count() == 4
    assert not os.path.exists(paths[1])
    odd = spark.createDataFrame([(1,)], "__I int")
    assert base.unused(odd, "__i", "__i", "x") == ["__i_", "__i__", "x"]
