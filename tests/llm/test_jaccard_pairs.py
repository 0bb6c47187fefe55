"""The pair join of the Jaccard components: what it makes, not only what comes of it."""

import numpy as np

from quillstream.llm.jaccard import _group_pairs, similar_components
from quillstream.runtime import Scratch


class Kept(Scratch):
    """Scratch tables that stay."""

    def __init__(self, spark):
        super().__init__(spark, "kept")
        self.tables = {}

    def save(self, name, df, compression="zstd"):
        self.tables[name] = super().save(name, df, compression)
        return self.tables[name]

    def drop(self, *names):
        pass


def near_copies(spark, n):
    """Copies of one text with one to five words changed, so that many pairs are just below the threshold."""
    rng = np.random.default_rng(5)
    words, rows = np.array([f"w{i}" for i in range(5000)]), []
    base = rng.choice(words, 160)
    for i in range(n):
        own = base.copy()
        own[rng.integers(0, 160, int(rng.integers(1, 6)))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_each_pair_of_groups_is_made_once(spark):
    kept = Kept(spark)
    similar_components(spark, near_copies(spark, 100), 4, 85, 100, kept).collect()
    rows = _group_pairs(kept.tables["apart"], 85, 100)
    assert rows.count() == rows.distinct().count() > 0
    # each pair shares many shingles
    posts = kept.tables["postings"].select("h", "grp")
    shared = posts.join(posts.withColumnRenamed("grp", "grp2"), "h").filter("grp < grp2").groupBy("grp", "grp2").count()
    assert rows.join(shared.toDF("grp1", "grp2", "times"), ["grp1", "grp2"]).filter("times > 1").count() > 0


def test_stars_leave_few_pairs_of_near_copies(spark):
    kept = Kept(spark)
    similar_components(spark, near_copies(spark, 250), 4, 85, 100, kept).collect()
    assert kept.tables["pairs"].count() <= 2 * kept.tables["classes"].count()
