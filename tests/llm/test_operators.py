import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import queries
from quillstream.llm.decontamination import Items, contaminated, edits_allowed, search
from quillstream.llm.jaccard import similar_components
from quillstream.llm.language_model import score
from quillstream.llm.media import clips, decode_films, digests, encode_avi, payload_of, to_media
from quillstream.llm.mixing import min_cost_flow, water_fill
from quillstream.llm.quality import fit_quality, score_quality
from quillstream.llm.suffixes import dedup_substrings, suffix_array
from quillstream.llm.textkit import text_buffer
from quillstream.llm.tokens import WordEncoder, default_vocabulary, read_tokens, write_tokens
from quillstream.llm.toxicity import fit_toxicity, score_toxicity
from quillstream.llm.urls import rules_frame, url_verdicts
from quillstream.runtime import Scratch

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, score double"


def make(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(seed=1, n=40):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(WORDS, int(rng.integers(1, 90)))) for _ in range(n)]
    copies = [b + " end" for b in base[:10]] + base[:5]
    return [None, "", "  \n ", "one", "É two THREE", *base, *copies, " ".join(rng.choice(WORDS, 5000))]


def test_media_round_trip_and_odd_input(spark):
    texts = ["", "a", "x" * 64, "À\x00\x7f" * 700, "é" * 5000]
    buf, at = text_buffer(pa.array(texts))
    for t, f in zip(texts, decode_films(encode_avi(buf, at)), strict=True):
        raw = t.encode()
        assert payload_of(f) == raw + b"\0" * (-len(raw) % 64 if raw else 64)
    assert [bool(f.error) for f in decode_films([None, b"", b"RIFFxxxxAVI "])] == [True] * 3
    docs = make(spark, [None, "abc"])
    rows = {r["doc_id"]: r for r in digests(to_media(docs)).collect()}
    assert rows[0]["n_bytes"] == 0 and rows[0]["payload_sha256"] == hashlib.sha256(b"\0" * 64).hexdigest()
    assert clips(to_media(docs)).count() >= 2


def brute_components(texts, k, num, den):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = (t or "").translate(fold).split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return {i: (len(s), up[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, k, num):
    texts = corpus()
    rng = np.random.default_rng(7)
    base = rng.choice(WORDS, 120)
    for _ in range(30):  # near copies around the threshold
        own = base.copy()
        own[rng.integers(0, 120, int(rng.integers(1, 7)))] = "edit"
        texts.append(" ".join(own))
    got = {r[0]: (r[1], r[2]) for r in similar_components(spark, make(spark, texts), k, num, 100).collect()}
    assert got == brute_components(texts, k, num, 100)


def test_url_precedence(spark):
    rows = [(0, None), (1, "no scheme"), (2, "http://A.example.COM/en/71"), (3, "x://com/en/"), (4, "x://notcom/en/"), (5, "x://a.net?/de/"), (6, "x://example.net/de/8#f"), (6, "x://example.net/de/8#f")]
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules_frame(spark)).collect()}
    assert got == {(0, None, "allow"), (1, None, "allow"), (2, "example.com/en/7", "allow"), (3, "com/en/", "block"), (4, None, "allow"), (5, None, "allow"), (6, "example.net/de/8", "block")}


def test_url_rules_of_the_contract(spark):
    want = {
        "x://a.com/en/8": ("com/en/", "block"), "x://www.example.com/en/7": ("example.com/en/7", "allow"), "x://a.NET/de/1?q": ("net/de/", "allow"), "x://net/de/": ("net/de/", "allow"),
        "x://example.net/de/7": ("net/de/", "allow"), "x://a.example.net/de/8": ("example.net/de/8", "block"), "x://b.org/es/": ("org/es/", "block"), "x://b.org/e": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = {list(want)[r["page_id"]]: (r["rule"], r["verdict"]) for r in url_verdicts(pages, rules_frame(spark)).collect()}
    assert got == want
    other = {r["rule"]: r["verdict"] for r in url_verdicts(pages, rules_frame(spark), default="block").collect()}
    assert other == {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block", None: "block"}


def test_url_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_url_filters"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.QUERIES["op3_url_filters"](spark, sf).collect())


def test_language_model(spark):
    texts = corpus()
    docs, scratch = make(spark, texts), Scratch(spark, "t")
    rows = score(spark, docs, scratch).collect()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(t or "").translate(fold).split() + [None] for t in texts]
    c = Counter(w for i, ws in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["score"] < 0


def thue_morse(n=10):
    """Two words of 2**n letters that every polynomial hash modulo 2**64 takes for one, from n = 10 on."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_a_plain_polynomial(spark):
    a, b = (w + " " + " ".join(f"x{i}" for i in range(9)) for w in thue_morse())
    rows = similar_components(spark, make(spark, [a, b, a]), 4, 95, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("bad_hash", [False, True])
def test_encoder_compares_bytes(monkeypatch, bad_hash):
    import quillstream.llm.tokens as T

    if bad_hash:
        monkeypatch.setattr(T, "range_hashes", lambda buf, starts, ends, fold=True: (ends - starts).astype(np.uint64))
    tool = WordEncoder(default_vocabulary())
    a, b = thue_morse()
    for texts in ([a, b, "x " + b.upper(), "aa Bb aA cc", ""], ["bb aa", a, "don't"]):
        ids, at = tool.encode(*text_buffer(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*tool.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers

    tool = WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  spaces, UPPER", "", "é x\n"]
    ids, at = tool.encode(*text_buffer(pa.array(texts)))
    assert not tool.piecewise
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*tool.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_tokens_round_trip(spark):
    texts = [*corpus(), "don't <|endoftext|>x a<|b", "x中é5…!? ́", "K" * 300, *thue_morse()]
    docs, scratch = make(spark, texts), Scratch(spark, "t")
    write_tokens(spark, docs, default_vocabulary(), f"{scratch.base}/d", scratch)
    tool, at = WordEncoder(default_vocabulary()).tokenizer, 0
    got = {r["doc_id"]: r for r in read_tokens(spark, f"{scratch.base}/d", with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = [*tool.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["ids"], got[i]["ids_crc32"]) == (at, ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_suffix_array():
    rng = np.random.default_rng(5)
    for _ in range(500):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 30))).tolist()
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("group", [2, 256])
def test_substrings_against_brute_force(spark, monkeypatch, group):
    import quillstream.llm.suffixes as S

    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(3)
    passage = " ".join(rng.choice(WORDS, 45))
    texts = [*corpus(), "a" * 450, "ab" * 200, passage]
    texts += [f"{' '.join(rng.choice(WORDS, 20))} {passage[int(rng.integers(0, 30)):]} {rng.choice(WORDS)}" for _ in range(12)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in dedup_substrings(spark, make(spark, texts)).collect()}
    assert got == want


def test_flow_and_targets():
    assert water_fill(90, [3, 1, 2], [10, 100, 100]) == pytest.approx([10, 80 / 3, 160 / 3])
    flow = min_cost_flow([10, 10], [12, 6], [(0, 0), (1, 0), (1, 1)], 2)  # fresh tokens before repeats
    assert sum(flow.values()) == pytest.approx(18) and flow[(0, 0)] == pytest.approx(10)


def test_flow_against_all_routings():
    """Whole numbers of tokens, all ways to route them: the flow routes as many as any, at the least price."""
    from itertools import product

    rng = np.random.default_rng(7)
    for _ in range(40):
        supply, quota = rng.integers(1, 4, 3).tolist(), rng.integers(0, 5, 2).tolist()
        edges = [(p, s) for p in range(3) for s in range(2) if rng.random() < 0.7]
        price = lambda used: sum(sum((k // size) ** 2 for k in range(n)) for n, size in zip(used, supply, strict=True))
        best = (0, 0)
        for amounts in product(*[range(min(2 * supply[p], quota[s]) + 1) for p, s in edges]):
            used, got = [0] * 3, [0] * 2
            for (p, s), n in zip(edges, amounts, strict=True):
                used[p] += n
                got[s] += n
            if all(u <= 2 * c for u, c in zip(used, supply, strict=True)) and all(g <= q for g, q in zip(got, quota, strict=True)):
                best = max(best, (sum(amounts), -price(used)))
        flow = min_cost_flow(supply, quota, edges, 2)
        used = [sum(f for (p, _), f in flow.items() if p == i) for i in range(3)]
        assert sum(flow.values()) == pytest.approx(best[0])
        assert price([round(u) for u in used]) == -best[1]


def brute_targets(sizes):
    """Targets of sources by the words of the contract."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while len(out) < len(names):
        unit = left / sum(weight[s] for s in names if s not in out)
        over = [s for s in names if s not in out and unit * weight[s] > 2 * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in names if s not in out}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
    return out


def test_mixing_query_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    sources = [None, "a", "b", "é", "z", ""]
    rows = [(int(i), " ".join(rng.choice(WORDS, int(rng.integers(0, 40)))), sources[int(x)]) for i, x in enumerate(rng.choice(6, 400, p=[0.05, 0.5, 0.2, 0.1, 0.1, 0.05]))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: len(t.split()) for i, t, _ in rows}
    sizes = {s: sum(words[i] for i, _, x in rows if x == s) for s in sources}
    wanted = brute_targets(sizes)
    got, again = (sorted(map(tuple, queries.QUERIES["op8_mixing"](spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken").collect())) for _ in range(2))
    assert got == again and len(got) == len(rows)
    taken = dict.fromkeys(sources, 0)
    for (i, size, source_size, target, n), (_, _, s) in zip(got, rows, strict=True):
        assert (size, source_size) == (words[i], sizes[s]) and target == pytest.approx(wanted[s])
        assert n in (0, size, 2 * size)
        taken[s] += n
    longest = max(words.values())
    assert all(abs(taken[s] - wanted[s]) <= longest for s in sources)


@pytest.mark.parametrize("rules", [300])
def test_url_rules_of_any_shapes(spark, rules):
    rng = np.random.default_rng(6)
    labels = ["a", "b", "c", "co"]
    host = lambda n: ".".join(rng.choice(labels, n))
    path = lambda n: "/" + "".join(rng.choice(list("xy/"), n))
    listed = sorted({(str(rng.choice(["block", "allow"])), host(int(rng.integers(1, 6))) + path(int(rng.integers(0, 8)))) for _ in range(rules)})
    pages = [(i, f"http://{host(int(rng.integers(1, 7)))}{path(int(rng.integers(0, 12)))}") for i in range(400)]
    rows = url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), rules_frame(spark, listed)).collect()

    def best(url):
        rest = url.split("://")[1]
        h, p = rest[: rest.index("/")], rest[rest.index("/") :]
        hits = []
        for action, rule in listed:
            rh, rp = rule[: rule.index("/")], rule[rule.index("/") :]
            if (h == rh or h.endswith("." + rh)) and p.startswith(rp):
                hits.append((len(rule), len(rh), action == "block", rule, action))
        return max(hits)[3:] if hits else (None, "allow")

    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == {i: best(u) for i, u in pages}


def test_mixing_meets_targets(spark):
    rows = {}
    for r in queries.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.001").collect():
        s = rows.setdefault(r["source"], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert all(abs(t - want) <= most for t, want, most in rows.values())


def test_classifiers_learn(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(600):
        bad, toxic = i % 3 == 0, i % 4 == 0
        w = list(rng.choice(WORDS, 60)) if not bad else [str(rng.choice(WORDS))] * 60
        if toxic:
            w[5] = "awfulword"
        texts.append(" ".join(w))
        labels.append((i, int(not bad), int(toxic)))
    docs = make(spark, [*texts, None, ""])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for rows, column in ((score_quality(docs, fit_quality(docs, known)).collect(), 1), (score_toxicity(docs, fit_toxicity(docs, known)).collect(), 2)):
        held = [(r["predicted"], labels[r["doc_id"]][column]) for r in rows if r["held_out"] and r["doc_id"] < 600]
        assert len(rows) == 602 and np.mean([a == b for a, b in held]) > 0.95
    empty = known.limit(0)
    assert score_quality(docs, fit_quality(docs, empty)).count() == score_toxicity(docs, fit_toxicity(docs, empty)).count() == 602


def test_decontamination(spark):
    rng = np.random.default_rng(1)
    items = [list(rng.choice(WORDS, n)) for n in (6, 12, 30, 60)]
    texts = [None, ""]
    for item in items:
        edited = list(item)
        for _ in range(int(edits_allowed(np.array([len(item)]))[0])):
            edited[int(rng.integers(len(edited)))] = "changed"
        texts += [" ".join([*rng.choice(WORDS, 20), *edited, *rng.choice(WORDS, 20)]), " ".join(rng.choice(WORDS, 80)), " ".join(item).upper()]
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (9, ""), (10, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(make(spark, texts), bench).collect()}
    assert got == {(2 + 3 * i + j, i) for i in range(4) for j in (0, 2)}


def test_lsh_recall_at_the_limit():
    rng = np.random.default_rng(0)
    vocabulary = rng.integers(1, 2**62, 3000).astype(np.uint64)
    seqs = [rng.choice(vocabulary, 30) for _ in range(60)]
    held, hit = Items(list(range(60)), seqs), 0
    for i, s in enumerate(seqs):
        x = s.tolist()
        for _ in range(6):
            x[int(rng.integers(len(x)))] = int(rng.choice(vocabulary))
        doc = np.array(x, np.uint64)
        hit += any(m[1] == i for m in search(held, doc, np.array([0, len(doc)])))
    assert hit / 60 >= 0.95


def test_empty_table(spark):
    none = make(spark, [])
    scratch = Scratch(spark, "t")
    assert digests(to_media(none)).count() == 0
    assert similar_components(spark, none).count() == 0
    assert dedup_substrings(spark, none).count() == 0
    assert score(spark, none, scratch).count() == 0
    write_tokens(spark, none, default_vocabulary(), f"{scratch.base}/d", scratch)
    assert read_tokens(spark, f"{scratch.base}/d").count() == 0
