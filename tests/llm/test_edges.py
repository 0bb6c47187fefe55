"""Every query over nulls in any column, odd texts, repeated rows and columns whose names clash with its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import queries
from quillstream.llm.decontamination import Items, edits_allowed, search

WORDS = [f"w{i}" for i in range(400)]
CLASH = ["members", "size", "copies", "source_size", "target", "score", "predicted", "held_out", "label", "component_id", "n_shingles", "a", "b", "h", "n", "cls", "stay", "start", "c0", "__m", "d", "th", "spans", "tail", "key", "count", "a.b", "item_id"]


def some(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables: documents 0 and 1 hold the benchmark item, 7 and 8 are near copies, 8 repeats."""
    rng = np.random.default_rng(4)
    p, q = some(rng, 60), some(rng, 200)
    rows = [(0, p, "en", "s"), (1, p, None, None), (3, "", "en", "s"), (4, None, "en", "s"), (None, some(rng, 30), "en", "r"), (None, None, None, None)]
    rows += [(7, q + " y", "fr", "r"), (8, q, "fr", "r"), (8, q, "fr", "r"), (9, "k" * 100_000, "en", "s"), (10, some(rng, 20_000), "en", "s"), (11, "a\x00b é中 \u2028 x", "en", "é"), (12, " \t\n", "en", "s"), (13, "tie one", "en", "z"), (14, "tie two", "en", "z")]
    rows += [(100 + i, some(rng, int(rng.integers(1, 80))), "en", str(rng.choice(list("rsz")))) for i in range(30)]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    known = [(i, 1, i % 3 // 2) for i in range(100, 130)] + [(None, 1, 1), (101, None, None), (99_999, 1, 1)]
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame(known, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("score", F.lit(1)),
        "benchmark": spark.createDataFrame([(0, p), (0, p), (2, ""), (3, None), (None, some(rng, 40))], "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("distance", F.lit(1)),
        "pages": spark.createDataFrame([(0, None), (None, "http://a.com/en/1"), (1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (2, ""), (3, "x://" + "a." * 9000 + "com/en/" + "z" * 9000)], "page_id long, url string").withColumn("host", F.lit("h")).withColumn("rule", F.lit("r")),
    }
    out = {}
    for kind in ("full", "empty"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, df in tables.items():
            (df if kind == "full" else df.limit(0)).coalesce(2).write.parquet(f"{out[kind]}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    key, table = ("page_id", "pages") if name.startswith("op3") else ("doc_id", "documents")
    got = sorted(str(r[key]) for r in queries.QUERIES[name](spark, odd["full"]).collect())
    want = ["0", "0", "1", "1"] if name.startswith("op10") else sorted(str(r[0]) for r in spark.read.parquet(f"{odd['full']}/{table}.parquet").select(key).collect())
    assert got == want
    assert queries.QUERIES[name](spark, odd["empty"]).count() == 0


def test_odd_stages(spark, odd):
    docs = spark.read.parquet(f"{odd['full']}/documents.parquet")
    ids = lambda df: sorted(str(r[0]) for r in df.select("doc_id").collect())
    near = corpus_pipeline.near_duplicates(spark, docs, odd["full"])
    assert near.schema.names == docs.columns and ids(near) == sorted({*ids(docs), "None"} - {"1", "8"}) + ["None"]
    clean = corpus_pipeline.contamination(spark, docs, odd["full"])
    assert clean.columns == docs.columns and ids(clean) == [i for i in ids(docs) if i not in "01"]
    for stage in (corpus_pipeline.quality, corpus_pipeline.mixing):
        out = stage(spark, docs, odd["full"])
        assert out.columns == docs.columns and set(ids(out)) <= set(ids(docs))
        assert {r["stay"] for r in out.select("stay").distinct().collect()} <= {CLASH.index("stay")}
    assert corpus_pipeline.token_ids(spark, docs, odd["full"]).count() == docs.count()


def test_pipeline_of_empty_tables(spark, odd):
    assert corpus_pipeline.run(spark, odd["empty"]).count() == 0


@pytest.mark.parametrize("n", [5, 6, 11, 60, 5000])
def test_recall_at_the_edit_limit(n):
    rng = np.random.default_rng(n)
    vocabulary = rng.integers(1, 2**62, 3000).astype(np.uint64)
    seqs = [rng.choice(vocabulary, n) for _ in range(40 if n < 100 else 1)]
    held, hit = Items(list(range(len(seqs))), seqs), 0
    for i, s in enumerate(seqs):
        x = s.copy()
        x[rng.choice(n, int(edits_allowed(np.array([n]))[0]), replace=False)] = 7
        around = rng.choice(vocabulary, 30)
        doc = np.concatenate([around, x, around])
        hit += any(m[1] == i for m in search(held, doc, np.array([0, len(doc)])))
    assert hit >= 0.95 * len(seqs)
