"""The logarithmic family of suffix arrays as tables in a folder: each new batch is compared with what is stored, and joins it.

A level is a sparse suffix array: one row for each sampled suffix (content-chosen anchors, see suffix_dedup) with the suffix's first
GRAM bytes as they are, a fingerprint of the text over which strings can share the anchor, and the place of the first document that has
it; rows are range-partitioned and sorted by the suffix, that is in the order of the text. A batch is worked through so:

1. Its texts are stored in order of (doc_id, text), each with a place after all places of earlier batches.
2. Its own suffix array is made, and merge-joined with the levels: equal bytes, not hashes. Stored documents with a common suffix are the
   only ones that can share 100 bytes with the batch.
3. Those documents, first, and the batch go through remove_repeats. What it says about the batch is the answer.
4. What the batch's array has and no level has becomes the newest level. While that is more than half as long as the level before it, both
   are merged, so there are never more than about log2(entries) levels, and an entry is rewritten as often at most.

A batch is visible once its state is written, as one small table that names the live levels: if a job fails before that, the index is as
it was. One batch is added at a time.

Defined cases: as in suffix_dedup; documents of an earlier batch are earlier, whatever their ids; an empty batch gives an empty result and
no level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.common import mix, named, release, text_chunks
from lodeframe.llm.suffix_dedup import GRAM, placed_anchors, remove_repeats

_ARRAY = pa.schema([("suffix", pa.binary()), ("segment", pa.int64()), ("place", pa.int64())])
_LEVEL = "suffix binary, segment long, place long"
_STATE = "number int, levels array<struct<name:string,entries:long>>"
_TEXTS = "place long, doc_id long, text string"
#: Places of a batch: its number above these bits.
BATCH_BITS = 52


def _array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sampled suffixes of the texts, each once for a run of texts."""
    for batch in batches:
        places = batch.column("place").to_numpy()
        for a, _, data, at in text_chunks(batch.column("text")):
            _, _, grams, segments, where = placed_anchors(data, at)
            keys = mix(grams * np.uint64(0x9FB21C651E98DF25) + segments)
            _, first = np.unique(keys, return_index=True)  # anchors stand in order of place
            suffixes = [data[k : k + GRAM].tobytes() for k in where[first]]
            own = places[a + np.searchsorted(at, where[first], "right") - 1]
            yield pa.RecordBatch.from_arrays([pa.array(suffixes, pa.binary()), pa.array(keys[first].view(np.int64)), pa.array(own)], schema=_ARRAY)
        del batch
        release()


class SuffixIndex:
    """folder: one that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _there(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def state(self) -> tuple[int, list[tuple[str, int]]]:
        """(number of batches, live levels with their entries, oldest first)."""
        if not self._there("states"):
            return 0, []
        last = self.spark.read.schema(f"{_STATE}, id string").parquet(f"{self.folder}/states").orderBy(F.col("number").desc()).first()
        return (0, []) if last is None else (last.number, [(x.name, x.entries) for x in last.levels])

    def texts(self, number: int) -> DataFrame:
        """The documents of the first `number` batches."""
        paths = [f"{self.folder}/texts-{k}" for k in range(number)]
        return self.spark.read.schema(_TEXTS).parquet(*paths) if paths else self.spark.createDataFrame([], _TEXTS)

    def level(self, *names: str) -> DataFrame:
        return self.spark.read.schema(_LEVEL).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], _LEVEL)

    def _write_level(self, rows: DataFrame) -> tuple[str, int]:
        name = f"level-{uuid.uuid4().hex}"
        rows.repartitionByRange("suffix", "segment").sortWithinPartitions("suffix", "segment").write.parquet(f"{self.folder}/{name}")
        return name, self.level(name).count()

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """For each row of the batch its doc_id, n_bytes, the runs [removed_from, removed_to) that stand in an earlier document or earlier
        in the batch, and the kept bytes. The batch is part of the index afterwards."""
        number, levels = self.state()
        rows = batch.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
        ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), "text")
        place = F.monotonically_increasing_id() + F.lit(number << BATCH_BITS)
        own = f"{self.folder}/texts-{number}"
        ordered.select(place.alias("place"), "doc_id", "text").write.mode("overwrite").parquet(own)
        new = self.spark.read.schema(_TEXTS).parquet(own)

        path = f"{self.folder}/array-{uuid.uuid4().hex}"
        suffixes = new.select("place", "text").mapInArrow(_array, _LEVEL)
        suffixes.groupBy("suffix", "segment").agg(F.min("place").alias("place")).write.parquet(path)
        array = self.spark.read.schema(_LEVEL).parquet(path)
        stored = self.level(*(n for n, _ in levels))
        met = stored.join(array.select("suffix").distinct(), "suffix", "left_semi").select("place").distinct()
        earlier = self.texts(number).join(met, "place", "left_semi")
        told = remove_repeats(earlier.unionByName(new).select("place", "text"), id_col="place")
        answer = f"{self.folder}/answers-{number}"
        found = told.where(F.col("doc_id") >= number << BATCH_BITS).withColumnRenamed("doc_id", "place")
        found.join(new.select("place", "doc_id"), "place").drop("place").write.mode("overwrite").parquet(answer)

        fresh = array.join(stored, ["suffix", "segment"], "left_anti")
        newest = self._write_level(fresh)
        levels = [*levels, newest] if newest[1] else levels
        gone = [] if newest[1] else [newest[0]]
        while len(levels) > 1 and levels[-1][1] * 2 > levels[-2][1]:
            (a, _), (b, _) = levels[-2:]
            levels = [*levels[:-2], self._write_level(self.level(a, b))]
            gone += [a, b]
        state = self.spark.createDataFrame([(number + 1, levels)], _STATE)
        state.coalesce(1).write.parquet(f"{self.folder}/states/id={number + 1}")
        for name in (*gone, path.rpartition("/")[2]):
            fs, old = self._fs(name)
            fs.delete(old, True)
        return self.spark.read.parquet(answer).select("doc_id", "n_bytes", "removed_from", "removed_to", "kept")
