"""A corpus pipeline: each stage works on all that the stage before it kept, and the last deals the corpus into shards.

Documents keep their columns, whatever their names, up to the last stage, which returns doc_id, size, text_crc32, law, shard, slot and
grown_shard of every row (a document that the mix takes twice is there twice, in the same shard). Training order is the order in which
the mixing stage writes its rows; the last stage reads it back from the files, so slots of a shard are in training order.

Defined cases: rows with null or empty texts are neither toxic nor contaminated nor copies of each other, and take part in the mix
without words; rows with null ids are judged by their texts; of repeated rows one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import aliased, load, named, shared_dir
from lodeframe.llm.decontaminate import decontaminate
from lodeframe.llm.jaccard_join import join_near
from lodeframe.llm.mixing import mix_documents
from lodeframe.llm.sharding import as_rows, assign_shards
from lodeframe.llm.toxicity import drop_toxic as without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of the smallest id, nulls last, then the first row. Rows without a word stay.
    Rows are numbered where they are read, so docs has to be a table that every read gives in one order, as stored tables are."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    near = join_near(numbered, id_col=row).select(F.col("doc_id").alias("_row"), "component_id")
    ids = numbered.select(F.col(row).alias("_row"), F.struct(F.col("doc_id").isNull(), "doc_id", row).alias("_rank"))
    leaders = ids.join(near, "_row").groupBy("component_id").agg(F.min("_rank").alias("_rank"))
    kept = leaders.select(F.col("_rank")[row].alias(row))
    return numbered.join(kept, row, "left_semi").select(*map(named, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, in training order. Columns of docs that are named like those of the mix are kept in its place."""
    plain, known = aliased(docs)
    mixed = mix_documents(plain, source_col=known["source"], text_col=known["text"], id_col=known["doc_id"])
    return mixed.select(*plain.columns).toDF(*docs.columns)


#: Spark names the files of a table by the task that wrote them and, where a task starts a file after a number of rows, by the file's number
#: in the task.
WRITTEN = r"^part-(\d+)-.*-c(\d+)(?:\.|$)"


def training_order(docs: DataFrame) -> tuple[Column, int] | None:
    """The place of a row in the table that docs was read from (task, file of the task, row of the file), and how many bits of it tell rows
    of one bucket apart. None if docs doesn't come from files. Files with other names than Spark's hold no training order: they come
    after the others, by a hash of their name. Room for 2**20 tasks, 2**14 files of each and 2**28 rows in a file."""
    try:
        docs.select("_metadata.row_index", "_metadata.file_name")
    except AnalysisException:
        return None
    number = [F.regexp_extract("_metadata.file_name", WRITTEN, k).try_cast("long") for k in (1, 2)]
    place = F.shiftleft(number[0], 42) + F.shiftleft(number[1], 28) + F.col("_metadata.row_index")
    other = F.shiftleft(F.pmod(F.xxhash64("_metadata.file_name"), F.lit(1 << 20)) + (1 << 20), 42) + F.col("_metadata.row_index")
    return F.when(number[1].isNotNull(), place).otherwise(other), 11


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal texts into one shard, shards of nearly equal bytes, slots in training order."""
    return as_rows(assign_shards(docs, order=training_order(docs)))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: A learnt classifier decides in the first stage, which SQL can't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet into the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
