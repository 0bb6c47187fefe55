"""A training corpus in five stages: quality, near duplicates, contamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of `documents`, also extra ones under any name. Null texts are empty texts; a null
source is a source; rows that repeat are documents of their own but for near_duplicates;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.decontamination import drop_contaminated
from quillstream.llm.jaccard import similar_rows, text_hash
from quillstream.llm.mixing import mix, word_count
from quillstream.llm.quality import fit_quality, keep_quality
from quillstream.llm.tables import table, texts
from quillstream.llm.tokens import default_vocabulary, read_tokens, write_tokens
from quillstream.runtime import Scratch, ship

#: Near duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
SHINGLE, SIMILAR = 5, (80, 100)
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores QUALITY or more; it is fitted on the labelled ones."""
    ship(spark)
    model = fit_quality(texts(docs), table(spark, sf_dir, "labels"))
    return keep_quality(docs, model, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar documents: that of least id (none comes last), then least hash of the text.

    Of rows equal in id and text the one whose columns have the least hash stays. Empty texts are similar to
    nothing: they stay, but for rows that repeat an id and text.
    """
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with those added
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names).withColumns({"id": doc_id.cast("long"), "th": text_hash(text.cast("string"))})
    found = Scratch(spark, "near").save("found", similar_rows(spark, texts(docs), SHINGLE, *SIMILAR))
    found = found.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_th"), "n", "comp")
    full = found.filter("n > 0")
    first = F.min(F.struct(F.col("g_id").isNull().alias("no_id"), "g_id", "g_th")).alias("first")
    first = full.groupBy("comp").agg(first, F.count("*").alias("rows")).filter("rows > 1")
    # what goes, without repeats: often small enough for Spark to broadcast
    gone = full.join(first, "comp").filter(~(F.col("g_id").eqNullSafe(F.col("first.g_id")) & (F.col("g_th") == F.col("first.g_th")))).select("g_id", "g_th").distinct()
    same = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th"))
    kept = rows.join(gone, same, "left_anti")
    twice = found.filter("n > 0 or g_id is not null").groupBy("g_id", "g_th").count().filter("count > 1").select("g_id", "g_th")
    if not twice.isEmpty():
        order = Window.partitionBy("id", "th").orderBy(F.xxhash64(F.to_json(F.struct(*names))))
        one = kept.join(twice, same, "left_semi").withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
        kept = kept.join(twice, same, "left_anti").unionByName(one)
    return kept.select(*names).toDF(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with few edits."""
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0, 1 or 2)."""
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with the mix's
    doc_id, source, text = (names[docs.columns.index(c)] for c in ("doc_id", "source", "text"))
    out = mix(spark, docs.toDF(*names), F.array(F.col(source).cast("string")), word_count(F.col(text).cast("string")), key=(doc_id,))
    return out.filter("copies > 0").withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*names).toDF(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix as a token dataset, read back: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    scratch = Scratch(spark, "tokens")
    path = f"{scratch.base}/dataset"
    write_tokens(spark, texts(docs), default_vocabulary(), path, scratch)
    return read_tokens(spark, path)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("contamination", contamination), ("mixing", mixing), ("token_ids", token_ids)]

#: The first stage is a fitted model, so no SQL gives the rows; run() is tested against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(name, docs)
    return docs
