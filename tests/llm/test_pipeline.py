import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from test_operators import WORDS, brute_components, brute_targets
from tokenizers import Tokenizer

import corpus_pipeline
from quillstream.llm.features import features
from quillstream.llm.jaccard import similar_components
from quillstream.llm.quality import fit_quality
from quillstream.llm.textkit import text_buffer
from quillstream.llm.tokens import default_vocabulary


def test_near_duplicates_keep_one_of_each(spark):
    a, b = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(5, a), (3, a + " more"), (9, b), (9, b), (7, ""), (8, ""), (None, "lone words"), (1, "q")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 7), (False, 8), (False, 9), (True, 0)]
    assert similar_components(spark, docs).count() == len(rows)


def test_near_duplicates_decide_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, "s"), (5, b, "s"), (6, a + " more", "s"), (None, c, "s"), (None, c, "s"), (None, c + " more", "s"), (None, b + " more", "s"), (7, "", "s"), (7, "", "s"), (8, "d e f g h i", "p"), (8, "d e f g h i", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [tuple(r) for k in (1, 5) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(k), "").collect()]
    first, again = kept[: len(kept) // 2], kept[len(kept) // 2 :]
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert sorted((str(i), t[0] if t else "") for i, t, _ in first) == [("5", "a"), ("5", "b"), ("7", ""), ("8", "d"), ("None", "c")]


def nearest_passage(item, doc):
    """Least word edit distance of the item and any passage of the document."""
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        last, row[0] = row[:], i
        for j, x in enumerate(doc, 1):
            row[j] = min(last[j - 1] + (w != x), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_run_against_a_plain_pipeline(spark, tmp_path):
    """All stages by plain Python; the fitted model and the mix's choice of documents within a source are taken from the engine."""
    rng = np.random.default_rng(12)
    some = lambda n: list(rng.choice(WORDS, int(n)))
    items = [some(n) for n in (4, 9, 40)]
    texts, good = [], []
    for i in range(260):
        bad = i % 4 == 0
        texts.append([str(rng.choice(WORDS))] * 50 if bad else some(rng.integers(30, 70)))
        good.append(int(not bad))
    for i in range(20):  # near copies, on both sides of the limit
        own = list(texts[4 * i + 1])
        for j in rng.choice(len(own), i % 6, replace=False):
            own[j] = "edit"
        texts.append(own)
    for i, item in enumerate(items):  # whole, edited and much edited items; one of them in a copied text
        near = list(item)
        for j in range(min(len(item) // 10, 3)):
            near[5 * j + 2] = "other"
        far = [w if j % 2 else "far" for j, w in enumerate(item)]
        texts += [[*some(30), *held, *some(30)] for held in (item, near, far)]
        texts[4 * i + 102] = [*texts[4 * i + 102], *item]
    texts += [[], None]
    sources = [str(s) if s != "-" else None for s in rng.choice(list("aab-"), len(texts))]
    rows = [(i, None if t is None else " ".join(t), s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good)], "doc_id long, quality int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"))):
        df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))

    model = fit_quality(docs, labels)
    text = {i: t or "" for i, t, _ in rows}
    left = [i for i in text if model.score(features(*text_buffer(pa.array([text[i]]))))[0] >= 0.3]
    assert {i for i, g in enumerate(good) if g} <= set(left) and len(left) < len(rows) - 40
    parts = brute_components([text[i] for i in left], 5, 80, 100)
    unique = [i for k, i in enumerate(left) if parts[k][1] == k]
    assert len(left) - 20 < len(unique) < len(left)
    allowed = lambda item: len(item) // 5 if len(item) >= 5 else 0
    clean = [i for i in unique if all(nearest_passage(x, text[i].split()) > allowed(x) for x in items)]
    assert len(unique) - len(clean) == 9
    words = {i: len(text[i].split()) for i in clean}
    copies = Counter(r[0] for r in got)
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    sizes = {s: sum(words[i] for i in clean if sources[i] == s) for s in {sources[i] for i in clean}}
    taken = {s: sum(copies[i] * words[i] for i in clean if sources[i] == s) for s in sizes}
    assert all(abs(taken[s] - want) <= max(words.values()) for s, want in brute_targets(sizes).items())
    tool, start = Tokenizer.from_file(default_vocabulary()), 0
    for doc_id, at, n, crc in got:
        ids = [*tool.encode(text[doc_id], add_special_tokens=False).ids, 2]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
