"""N-gram Jaccard join by a grouped prefix join.

A document's set holds its distinct word shingles; two documents link when the
Jaccard similarity of their sets reaches num/den. Result: connected components.

1. Equal sets collapse into one class. Classes with the same set size and the same
   prefix (the first n - ceil(t*n) + 1 shingles in a common order) collapse into one
   group; only groups are joined on prefix shingles.
2. The common order is by hash, but shingles that many documents have in their
   prefixes come last; they are known from an exact count, kept as a bitmap of
   fixed size (BITS). Any bitmap gives a valid order, so false hits cost nothing.
3. Stars first: every group is paired with one group (by a hash that changes each round,
   and after the first round with the shingle) of each prefix shingle it shares, and every
   class with one class of its group, if they are not yet in one component. Verified stars join copies of one text into
   components, in a number of pairs linear in the postings. Rounds go on while they
   find links in number.
4. Then the rest: pairs of groups that share a prefix shingle and are not yet in one
   component are filtered, each at their first shared one, by size, position and (where
   both have one class) parity, and only what is left is expanded into pairs of their
   classes. Shingles that the same groups share count as one, the first of them. The parity of the hashes in each of PARITY bits differs between two sets in
   at most as many bits as there are shingles in one set only. So no link between
   different components is lost, and no group is expanded into all its pairs.
5. Candidates are verified on the whole sets of their texts.

Prefix shingles travel packed (exchange.py) and meet in buckets of a bounded size; only
those that groups of fitting sizes share become rows.

Null or empty texts have an empty set and link with nothing (their component is their
own id). Documents without an id take part; a component of only such documents has a
null id. Repeated rows are equal sets and each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .exchange import blob, bucket_of, by_bucket, pack, rows_of, runs, unpack
from .graph import connected_components
from .textkit import _COMBINE, chunks, mix, shingle_hashes, text_buffer, trim, word_hashes

#: Bits of the bitmaps of frequent shingles and of wanted classes (2 MB each).
BITS = 24
#: Bytes of text in a piece, and of the text whose prefix shingles meet in one bucket, about.
PIECE, BUCKET = 4 << 20, 32 << 20
#: A shingle in this many prefixes is frequent; the count is raised until 1/8 of the bitmap holds them all.
FREQUENT = 4
#: Of a group's postings before one, so many are kept to know the first that a pair shares; more repeats are removed after the join.
BEFORE = 64
#: Bits of a set's parity sketch.
PARITY = 512
_SKETCH = [f"p{i}" for i in range(PARITY // 64)]
U64 = np.uint64


def text_sets(batch: pa.RecordBatch, k: int):
    """The sorted distinct shingle hashes of each text of a batch."""
    hashes, at = word_hashes(*text_buffer(batch.column("text")))
    sh, at = shingle_hashes(hashes, at, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        part = np.sort(sh[a:b])
        if b - a > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        yield part


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def _set_hash(part: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = (mix(part) * _COMBINE[0]).sum(dtype=U64) + U64(len(part)) * _COMBINE[1]
        return int(mix(np.array([total], U64)).view(np.int64)[0])


def _list_hash(part: np.ndarray, n: int) -> int:
    with np.errstate(over="ignore"):
        total = (mix(part + np.arange(1, len(part) + 1, dtype=U64)) * _COMBINE[2]).sum(dtype=U64) + U64(n) * _COMBINE[3]
        return int(mix(np.array([total], U64)).view(np.int64)[0])


def _parity(part: np.ndarray) -> np.ndarray:
    odd = np.bincount((part >> U64(64 - 9)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _near(num: int, den: int) -> Column:
    """Whether the parities of sets 1 and 2 leave room for the threshold."""
    apart = sum((F.bit_count(F.col(f"{p}1").bitwiseXOR(F.col(f"{p}2"))) for p in _SKETCH), F.lit(0))
    return F.lit(num + den) * apart <= F.lit(den - num) * (F.col("n1") + F.col("n2"))


def bitmap(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of 2**bits bits with the low bits of every key set; built by a bounded aggregation."""
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(U64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    low = hashes & U64(64 * len(bits) - 1)
    return (bits[(low >> U64(6)).astype(np.int64)] >> (low & U64(63))) & U64(1) > 0


def text_hash(text: Column) -> Column:
    """64 bits of a text as it is; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar_components(spark: SparkSession, docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id long, text)."""
    of = similar_rows(spark, docs, k, num, den, scratch)
    least_id = of.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = of.join(least_id, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _counted(k: int, num: int, den: int, buckets: int):
    """The shingles of the prefixes in plain hash order, packed by bucket with their counts."""

    def run(batches):
        for batch in chunks(batches, limit=PIECE):
            parts = [p[: prefix_length(len(p), num, den)] for p in text_sets(batch, k)]
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1)).tolist()
            some = [b for b in range(buckets) if edge[b + 1] > edge[b]]
            yield rows_of({"b": (some, pa.int32()), "body": ([pack(h[edge[b] : edge[b + 1]], n[edge[b] : edge[b + 1]]) for b in some], pa.binary())})
        trim()

    return run


def _frequent(batches):
    """Of rows sorted by b: the shingles that occur FREQUENT times or more."""
    for rows in runs(batches, "b"):
        parts = [unpack(blob(r)) for r in rows]
        h, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(which.reshape(-1), np.concatenate([p[1] for p in parts])).astype(np.int64)
        often = np.flatnonzero(n >= FREQUENT)
        for a in range(0, len(often), 100_000):
            part = often[a : a + 100_000]
            yield rows_of({"h": (h[part].view(np.int64), pa.int64()), "n": (n[part], pa.int64())})
    trim()


def _signed(k: int, num: int, den: int, buckets: int, frequent):
    """Rows of two kinds: each document's signature (b null), and the postings of its group packed by bucket."""

    def run(batches):
        for batch in chunks(batches, limit=PIECE):
            size, early, cls, group, prefix, parity = [], [], [], [], [], []
            for part in text_sets(batch, k):
                n = len(part)
                late = in_bitmap(frequent.value, part)
                ordered = np.concatenate([part[~late], part[late]])[: prefix_length(n, num, den)]
                size.append(n)
                early.append(len(part) - int(late.sum()))
                cls.append(_set_hash(part))
                group.append(_list_hash(ordered, n))
                prefix.append(ordered)
                parity.append(_parity(part))
            sketch = np.stack(parity, axis=1)
            none = {c: pa.nulls(batch.num_rows, t) for c, t in (("b", pa.int32()), ("body", pa.binary()))}
            own = {"n": pa.array(size, pa.int64()), "cls": pa.array(cls, pa.int64()), "grp": pa.array(group, pa.int64()), **dict(zip(_SKETCH, map(pa.array, sketch), strict=True))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), **own, **none})
            size, early, group = np.array(size), np.array(early), np.array(group, np.int64).view(U64)
            _, one = np.unique(group, return_index=True)
            one = one[size[one] > 0]
            if len(one) == 0:
                continue
            length = np.array([len(prefix[i]) for i in one])
            h, of = np.concatenate([prefix[i] for i in one]), np.repeat(np.arange(len(one)), length)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(length) - length, length)
            bucket = bucket_of(h, buckets)
            order = np.lexsort((of, bucket))
            h, of, pos = h[order], of[order], pos[order]
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            some, body = [], []
            for b in range(buckets):
                here = slice(edge[b], edge[b + 1])
                if edge[b + 1] > edge[b]:
                    used, times = np.unique(of[here], return_counts=True)
                    some.append(b)
                    body.append(pack(group[one[used]], size[one[used]], early[one[used]], times, h[here], pos[here]))
            m = len(some)
            empty = {c: pa.nulls(m, pa.int64()) for c in ("doc_id", "text_hash", *own)}
            yield pa.RecordBatch.from_pydict({**empty, "b": pa.array(some, pa.int32()), "body": pa.array(body, pa.binary())})
        trim()

    return run


def _postings(num: int, den: int):
    """Of rows sorted by b: (h, grp, n, pos, late) of shingles that several groups of fitting sizes share.

    A posting stays if the group next in size under its shingle is near enough in size; where
    there are just two, also if enough of both sets follows the shingle.
    """

    def run(batches):
        for rows in runs(batches, "b"):
            parts = [unpack(blob(r)) for r in rows]
            times = [p[3].astype(np.int64) for p in parts]
            grp, n, early = (np.concatenate([np.repeat(p[i], t) for p, t in zip(parts, times, strict=True)]) for i in range(3))
            h, pos = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
            n, pos, late = n.astype(np.int64), pos.astype(np.int64), pos >= early
            del parts, times, early
            order = np.lexsort((grp, n, h))
            h, grp, n, pos, late = (x[order] for x in (h, grp, n, pos, late))
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (grp[1:] != grp[:-1])  # a group that several pieces hold is one
            h, grp, n, pos, late = (x[keep] for x in (h, grp, n, pos, late))
            near = (h[1:] == h[:-1]) & (num * n[1:] <= den * n[:-1])
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            pair = first[np.diff(np.concatenate([first, [len(h)]])) == 2]
            need = -(-num * (n[pair] + n[pair + 1]) // (num + den))
            near[pair] &= np.minimum(n[pair] - pos[pair], n[pair + 1] - pos[pair + 1]) >= need
            stay = np.zeros(len(h), bool)
            stay[1:] |= near
            stay[:-1] |= near
            stay = np.flatnonzero(stay)
            for a in range(0, len(stay), 100_000):
                part = stay[a : a + 100_000]
                yield rows_of({"h": (h[part].view(np.int64), pa.int64()), "grp": (grp[part].view(np.int64), pa.int64()), "n": (n[part], pa.int64()), "pos": (pos[part], pa.int64()), "late": (late[part], pa.bool_())})
        trim()

    return run


def _apart(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """The postings by which groups that are not in one component meet, with the columns of their groups.

    Shingles that the same groups share (told by their number and two xors of 64-bit hashes) bring the same pairs
    together; the first of them in the common order stays, so each pair keeps its first shared one. `before` holds
    the last BEFORE of the group's postings before this one.
    """
    one_list = (F.count("*").alias("m"), F.bit_xor(F.xxhash64("grp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "grp")).alias("y"))
    open_ = posts.join(groups.select("grp", "lo", "hi"), "grp").groupBy("h", "late").agg(F.min("lo").alias("l"), F.max("hi").alias("r"), *one_list).filter("l < r")
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    first = open_.groupBy("m", "x", "y").agg(F.min(F.struct("late", unsigned.alias("u"), "h")).alias("first")).select("first.h")
    earlier = Window.partitionBy("grp").orderBy("pos").rowsBetween(-BEFORE, -1)
    held = posts.join(first, "h").select("h", "grp", "n", "pos", F.collect_list("h").over(earlier).alias("before"))
    return held.join(groups, "grp")


def _group_pairs(apart: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (grp1, grp2) of groups that fit in size, position and parity, each at its first shared shingle (and again beyond BEFORE)."""
    own = ("grp", "n", "pos", "before", "lo", "hi", "one", *_SKETCH)
    x, y = (apart.select("h", *[F.col(c).alias(f"{c}{i}") for c in own]) for i in (1, 2))
    need = F.ceil(F.lit(num) * (F.col("n1") + F.col("n2")) / F.lit(num + den))
    pairs = x.hint("merge").join(y, "h").filter(  # broadcast, one task would join all of a small table
        (F.col("grp1") < F.col("grp2")) & (F.least("lo1", "lo2") < F.greatest("hi1", "hi2")) & (F.lit(num) * F.greatest("n1", "n2") <= F.lit(den) * F.least("n1", "n2"))
        & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) >= need) & (F.col("one1").isNull() | F.col("one2").isNull() | _near(num, den))
        & ~F.arrays_overlap("before1", "before2")
    )
    return pairs.select("grp1", "grp2")


def similar_rows(spark: SparkSession, docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_hash, n, comp) of every row of docs: the number of its shingles, and what names its component where that is not 0."""
    scratch = scratch or Scratch(spark, "jaccard")
    docs = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    buckets = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET))
    counts = by_bucket(docs.select("text").mapInArrow(_counted(k, num, den, buckets), "b int, body binary"), buckets)
    counts = scratch.save("counts", counts.mapInArrow(_frequent, "h long, n long"))
    steps = [FREQUENT << i for i in range(40)]
    row = counts.agg(*[F.sum((F.col("n") >= t).cast("long")) for t in steps]).first()
    least = next((t for i, t in enumerate(steps) if (row[i] or 0) <= 1 << (BITS - 3)), steps[-1])
    frequent = spark.sparkContext.broadcast(bitmap(counts.filter(F.col("n") >= least), "h"))
    scratch.release()
    fields = "doc_id long, text_hash long, n long, cls long, grp long, " + ", ".join(f"{p} long" for p in _SKETCH) + ", b int, body binary"
    sig = scratch.save("signatures", docs.mapInArrow(_signed(k, num, den, buckets, frequent), fields))
    posts = by_bucket(sig.filter("b is not null").select("b", "body"), buckets)
    posts = scratch.save("postings", posts.mapInArrow(_postings(num, den), "h long, grp long, n long, pos long, late boolean"))
    sig = sig.filter("b is null")
    ids = scratch.save("ids", sig.select("doc_id", "text_hash", "n", "cls"))
    classes = sig.filter("n > 0").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("grp", "n", *_SKETCH)], F.min("text_hash").alias("text_hash"))
    classes = scratch.save("classes", classes)
    del sig, counts
    scratch.drop("counts", "signatures")
    scratch.release()
    fits = (F.lit(num) * F.greatest("n1", "n2") <= F.lit(den) * F.least("n1", "n2")) & _near(num, den)
    side = lambda d, i, name: d.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}{i}") for c in ("n", "comp", *_SKETCH)])
    named, links, joined, merged, step = classes.withColumn("comp", F.col("cls")), None, None, [], 0
    while True:
        # stars: each group with one of each shingle, each class with one of its group, if their components differ
        groups = named.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("cls", F.lit(step)), "cls")).alias("c"))
        groups = scratch.save(f"groups-{step}", groups.select("grp", "lo", "hi", F.col("c.cls").alias("rep")))
        held = posts.select("h", "grp").join(groups, "grp")
        seed = ["h"] if step else []  # first one centre for all shingles of a group of copies, then one of each shingle's own
        centre = held.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct(F.xxhash64("grp", F.lit(step), *seed), "rep")).alias("c"))
        centre = centre.filter("lo < hi").select("h", F.col("c.rep").alias("b"))
        stars = held.select("h", F.col("rep").alias("a")).join(centre, "h").filter("a != b").select("a", "b").distinct()
        inside = named.select("grp", F.col("cls").alias("a")).join(groups.filter("lo < hi").select("grp", F.col("rep").alias("b")), "grp").filter("a != b").select("a", "b")
        stars = stars.unionByName(inside).join(side(named, 1, "a"), "a").join(side(named, 2, "b"), "b").filter(fits & (F.col("comp1") != F.col("comp2")))
        stars = scratch.save(f"stars-{step}", stars.select("a", "b"))
        found = scratch.save(f"links-{step}", _verify(spark, docs, classes, stars, k, num, den, scratch, f"{step}"))
        merged.append(found.count())
        links = found if links is None else links.unionByName(found)
        if merged[-1]:
            joined = connected_components(links, scratch, f"star{step}")
            named = classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
            named = scratch.save(f"named-{step}", named)
            scratch.drop(*(f"named-{i}" for i in range(step)))
        scratch.drop(f"texts-{step}", f"stars-{step}", f"groups-{step}")
        scratch.release()
        step += 1
        if step > 1 and merged[-1] <= max(merged) // 10:  # another round would cost more than the pairs that it spares
            break
    # what stars left apart: pairs of groups that fit, then of their classes
    lone = F.when(F.count("*") == 1, F.first("cls")).alias("one")  # a group of one class is told apart by that class's parities
    groups = named.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), lone, *[F.first(c).alias(c) for c in _SKETCH])
    groups = scratch.save("groups", groups)
    apart = scratch.save("apart", _apart(posts, groups))
    pairs = scratch.save("pairs", _group_pairs(apart, num, den).distinct())
    scratch.drop("postings", "apart")
    mixed = groups.filter("lo < hi").select(F.col("grp").alias("grp1"), F.col("grp").alias("grp2"))
    of = lambda i, name: side(named, i, name).join(named.select(F.col("cls").alias(name), F.col("grp").alias(f"grp{i}")), name)
    rest = pairs.unionByName(mixed).join(of(1, "a"), "grp1").join(of(2, "b"), "grp2")
    rest = rest.filter(((F.col("grp1") != F.col("grp2")) | (F.col("a") < F.col("b"))) & (F.col("comp1") != F.col("comp2")) & fits)
    rest = scratch.save("rest", rest.select("a", "b"))
    del apart, posts
    scratch.release()
    if not rest.isEmpty():
        more = scratch.save("more", _verify(spark, docs, classes, rest, k, num, den, scratch, "rest"))
        joined = connected_components(links.unionByName(more), scratch, "all")
    out = ids.withColumn("component", F.lit(None).cast("long")) if joined is None else ids.join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    out = scratch.save("members", out.select("doc_id", "text_hash", "n", F.coalesce("component", "cls").alias("comp")))
    scratch.drop("ids", "classes", "groups", "pairs", "rest", "more", "texts-rest", *(f"{x}-{i}" for i in range(step) for x in ("named", "links")))
    return out


def _verify(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    asked = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    asked = scratch.save(f"asked-{name}", classes.select("cls", "text_hash").join(asked, "cls", "left_semi"))
    wanted = spark.sparkContext.broadcast(bitmap(asked, "text_hash"))

    def pick(batches):
        for batch in chunks(batches):
            hashes = batch.column("text_hash").to_numpy()
            rows = np.flatnonzero(in_bitmap(wanted.value, hashes.view(U64)))
            _, first = np.unique(hashes[rows], return_index=True)  # one text of each hash in this piece
            yield batch.take(pa.array(rows[np.sort(first)]))

    texts = docs.select("text_hash", "text").mapInArrow(pick, "text_hash long, text string").join(asked, "text_hash")
    texts = scratch.save(f"texts-{name}", texts.groupBy("cls").agg(F.min("text").alias("text")))
    scratch.drop(f"asked-{name}")

    def check(batches):
        for batch in batches:
            for part in _by_bytes(batch):
                a = list(text_sets(part.rename_columns(["a", "b", "text", "tb"]), k))
                b = list(text_sets(part.rename_columns(["a", "b", "ta", "text"]), k))
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64) - both
                yield part.select(["a", "b"]).filter(pa.array(den * both >= num * union))

    with_a = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _by_bytes(batch: pa.RecordBatch, limit: int = 4 << 20):
    size = np.cumsum(np.diff(text_buffer(batch.column("ta"))[1]) + np.diff(text_buffer(batch.column("tb"))[1]))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table, texts

    return similar_components(spark, texts(table(spark, sf_dir, "documents")))
