"""The pipeline's stages on a small folder of tables, each against what it must keep and drop."""

import collections
import random

import pytest

import corpus_pipeline
from skarn.llm import base, catalog, mixing, toxicity

ITEM = "Which of these four rivers is the longest one that flows through more than three countries and into the Black Sea"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(6), tmp_path_factory.mktemp("tables")
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(1500)]
    docs, labels = [], []
    for i in range(400):
        text = rng.choices(words, k=rng.randint(60, 150))
        if i % 5 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grubl", "snarff"]) + rng.choice(["", "en", "ish"]))
        docs.append((i, " ".join(text), "en", f"src{i % 3}", 1))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + i, docs[i][1], "en", "src1", 1) for i in (1, 1, 2, 3, 4)]
    docs += [(2000 + i, docs[i][1] + " tail", "en", "src2", 1) for i in (6, 7, 8)]
    docs += [(3000, f"{docs[9][1]} {ITEM} {docs[11][1]}", "en", "src0", 1), (3001, None, None, None, None), (3002, "", "en", "src0", 0), (None, "a text without an id but of its own", "en", "src0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs


def test_stages(spark, folder):
    path, rows = folder
    docs = base.table(spark, path, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, base.written(stage(spark, docs, path), name)
        seen[name] = (before, docs)
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = seen["toxicity"]
    bad = {r.doc_id for r in toxicity.toxicity(before, base.table(spark, path, "labels")).where("predicted = 1").collect()}
    assert len(bad & set(range(0, 400, 5))) >= 72 and not {i for i in bad if i < 400 and i % 5}
    assert sorted(map(str, (r.doc_id for r in after.collect()))) == sorted(str(r[0]) for r in rows if r[0] not in bad)

    before, after = seen["near_duplicates"]
    kept = [r.doc_id for r in after.collect()]
    assert len(kept) == len(set(kept))
    gone = {r.doc_id for r in before.collect()} - set(kept)
    assert gone == {1001, 1002, 1003, 1004, 2006, 2007, 2008, 3002}

    before, after = seen["decontamination"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {3000}

    before, after = seen["mixing"]
    wanted = collections.Counter(r.doc_id for r in mixing.replicate(before, catalog.WEIGHTS).collect())
    assert collections.Counter(r.doc_id for r in after.collect()) == wanted

    before, after = seen["token_ids"]
    out = after.orderBy("start").collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in before.collect())
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]


def test_run(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_odd_tables(spark, tmp_path):
    """Empty tables, repeated rows and clashing columns pass through all stages."""
    names = "doc_id long, text string, lang string, source string, n_chars long, __i int, __h int, __r int, __n int, __text string, __predicted int, `MIX KEY` int"
    rows = [(i % 4, ["a b c d e f g", None, "", "other words stand here now"][i % 4], "en", None, 1, i % 2, 2, 3, 4, "t", 6, 7) for i in range(40)]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (base.table(spark, str(tmp_path), "documents"), base.table(spark, str(tmp_path), "documents").limit(0)):
        first, columns = docs, docs.columns
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = base.written(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == columns
            if name == "near_duplicates":
                assert sorted(r.doc_id for r in docs.collect()) == ([0, 1, 3] if first.count() else [])
                assert {(r["__h"], r["__r"], r["__n"], r["__predicted"]) for r in docs.collect()} <= {(2, 3, 4, 6)}


def test_run_leaves_no_stages(spark, folder):
    """What run() has made on its way is gone when it returns."""
    import os

    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    top = base.shared_dir(spark).removeprefix("file://") + f"/skarn/{spark.sparkContext.applicationId}"
    assert out.count() > 100 and not [d for d in os.listdir(top) if d.startswith("stage-") and not d.startswith("stage-token_ids")]
