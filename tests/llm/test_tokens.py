"""Token ids, Simple-8b shards and length histograms against the library on whole texts."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import lengths, simple8b, tokenids, tokens

public = pytest.importorskip("public_tokenizers")
ODD = [
    "", "Hello, world. It's 3.50 EUR!", "a.b,c. d, e", 'He said "no." Then, ...', "İstanbul ΣΑΣ. ΟΔΟΣ naïve É́ é", "x<|endoftext|>y <|ENDOFTEXT|> <| z", "tab\tnew\nline\r\nnbsp\xa0x\x1cy z",
    "日本語 テスト. 12,5", "don't we'll I'm", " lead", "trail. ", ". , . ,", "ß.ẞ. Ä, ö. ſ.", "word " * 3000, "x" * 5000, "😀. 😀,", "a\u0000b. c\u007f",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(tokens.VOCABULARY))


def whole(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(library):
    e = tokens.Encoder()
    assert e.direct
    for texts in (ODD, ODD[::-1], [t.upper() for t in ODD]):
        got = list(e.encode(pa.array(texts)))
        assert [x.tolist() for x in got] == [whole(library, t) for t in texts]
        assert e.lengths(pa.array(texts)).tolist() == [len(x) for x in got]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aZé.,'s -<|>\n\t\"1Σİ́\x85")), max_size=30))
def test_pieces_of_any_text(text):
    e = tokens.encoder()
    assert next(e.encode(pa.array([text]))).tolist() == whole(e.library, text)


def test_forgetting(monkeypatch, library):
    monkeypatch.setattr(tokens, "_KEPT", 3)
    monkeypatch.setattr(tokens, "_GROUP", 40)
    e = tokens.Encoder()
    texts = [f"alpha beta {i} gamma. delta" for i in range(30)]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == [whole(library, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1), st.just(0)), max_size=300))
def test_simple8b(ids):
    a = np.array(ids, np.uint64)
    words, raw = simple8b.pack(a)
    assert simple8b.unpack(words, raw, len(a)).tolist() == ids
    assert len(words) <= len(a) and len(raw) == sum(x >= 1 << 60 for x in ids)


def test_simple8b_sizes():
    assert len(simple8b.pack(np.zeros(480, np.uint64))[0]) == 2
    assert len(simple8b.pack(np.full(400, 30_000, np.uint64))[0]) == 100
    assert len(simple8b.pack(np.full(300, 60_000, np.uint64))[0]) == 100


def test_shard():
    rng = random.Random(2)
    docs = [(None if i == 3 else i * 7 - 5, np.array([rng.randrange(49_408) for _ in range(rng.choice([0, 1, 10, 70_000]))], "<u4")) for i in range(12)]
    out = io.BytesIO()
    w = simple8b.Writer(out)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    before = np.cumsum([0] + [len(x) for _, x in docs])
    assert list(simple8b.read(out, w.bytes)) == [(d, int(b), len(x), zlib.crc32(x.tobytes())) for (d, x), b in zip(docs, before)]


def test_documents(spark, library, monkeypatch):
    texts = [*ODD, None, ODD[1], ODD[1]]
    ids = [*range(50, 50 - len(ODD), -1), None, 7, 7]
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(ids)), ["x"] * len(ids))), "doc_id long, text string, ids long, start string").repartition(3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenids.token_ids(docs).collect())
    at, wanted = 0, []
    for d, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        x = [*whole(library, t or ""), 2]
        wanted.append((at, d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == wanted
    folder = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/rolled"
    rolled = tokenids.write_shards(docs, folder, roll_bytes=200)
    assert rolled.count() >= 4 and sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenids.read_shards(rolled, folder).collect()) == wanted
    assert tokenids.token_ids(docs.limit(0)).count() == 0


def test_histogram(spark, library, monkeypatch):
    monkeypatch.setattr(lengths, "RUN", 4)
    texts = [*ODD, None, "one two three", "one two three"]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    n = sorted(len(whole(library, t or "")) + 1 for t in texts)
    h = lengths.length_histogram(lengths.encoded_lengths(docs, extra=1)).cache()
    for r in h.collect():
        x = r.n_tokens
        assert (r.documents, r.documents_at_least, r.tokens_at_least) == (n.count(x), sum(y >= x for y in n), sum(y for y in n if y >= x))
        assert (r.tokens_kept, r.documents_at_most, r.total_documents, r.total_tokens) == (sum(min(x, y) for y in n), sum(y <= x for y in n), len(n), sum(n))
    assert h.count() == len(set(n))
    for limit in (0, 1, 7, 10**6):
        assert tuple(lengths.kept_at(h, limit).first()) == (sum(min(x, limit) for x in n), sum(x > limit for x in n))
    for r in lengths.quantiles(h, [0.0, 0.3, 0.5, 1.0]).collect():
        assert r.n_tokens == next(x for x in n if sum(y <= x for y in n) >= r.share * len(n))
    empty = lengths.length_histogram(lengths.encoded_lengths(docs.limit(0)))
    assert empty.count() == 0 and lengths.kept_at(empty, 5).first() == (0, 0)
