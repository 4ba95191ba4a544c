"""Incremental ingest: new artifact files of a folder are parsed as they come, and become sessions like those of loadApk.

A stream of binary files feeds foreachBatch. A batch is safe to run twice: it writes the tables of its sessions (each session's partition is
replaced), then sessions, owners and dead letters in one change of the catalogue. A session that is registered is complete, and is left out
from then on; one that isn't is written again. Files that no parser can read are rows of the dead letters; they are tried again if they come
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeframe import schema
from lodeframe.operators.match import sized_broadcast
from lodeframe.operators.ranking import first_wins
from lodeframe.plans.index import Index
from lodeframe.sources import ingest
from lodeframe.tables import materialize

FILE = "path string, modificationTime timestamp, length long, content binary"
ERROR = "code string, message string, suggestion string"


def session_of(digest) -> F.Column:
    """Each file is a session of its own, named by its digest."""
    return F.concat(F.lit("ses_"), F.substring(digest, 1, 12))


def append_batch(index: Index, files: DataFrame, source: str = "app", owner: str = "stream") -> None:
    """files: path and content."""
    name = F.element_at(F.split("path", "/"), -1)
    # Contents are hashed where they are read; only names and digests are compared and shuffled.
    told = files.select("path", name.alias("name"), F.sha2("content", 256).alias("sha256")).withColumn("session_id", session_of(F.col("sha256")))
    new = first_wins(told, ["session_id"], ["name", "path"]).join(index.sessions().select("session_id"), "session_id", "left_anti")
    new = materialize(new, "stream-new")
    if new.isEmpty():
        return
    kept = files.join(sized_broadcast(new.select("path", "session_id", "name")), "path")
    parsed = materialize(ingest.parse_files(kept.select("session_id", F.lit(0).alias("file_ord"), "name", F.lit(source).alias("source"), "content")), "stream-parsed")
    errors = parsed.where("entity = 'error'").select("session_id", F.from_json("payload", ERROR).alias("e")).select("session_id", "e.*")
    tables = ingest.normalise(parsed.join(errors.select("session_id").distinct(), "session_id", "left_anti"))
    index.write(tables)
    now = F.current_timestamp()
    dead = errors.join(new, "session_id").select("path", "sha256", "code", "message", "suggestion", now.alias("seen_at"))
    good = new.join(errors.select("session_id"), "session_id", "left_anti").join(tables["manifest"], "session_id", "left")
    kind = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    rows = good.select("session_id", "sha256", kind.alias("kind"), F.col("name").alias("label"), F.col("package").alias("pkg"), "version_name", "version_code", now.alias("created_at"), F.lit(schema.SCHEMA_VERSION).alias("schema_version"), F.array("path").alias("sources"))
    owned = rows.select("session_id", F.lit(owner).alias("owner"), "created_at")
    index.append_rows({"sessions": rows, "owners": owned, "dead_letters": dead})


def watch(index: Index, folder: str, checkpoint: str, pattern: str = "*.apk", source: str = "app", owner: str = "stream") -> StreamingQuery:
    """A query that takes what is there and ends; start it again for what has come since."""
    stream = index.spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    query = stream.writeStream.foreachBatch(lambda batch, _: append_batch(index, batch, source, owner))
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts of a stream of events by type and window, with late events up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


