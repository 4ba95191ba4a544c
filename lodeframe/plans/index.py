"""The stored index: a folder of Parquet tables partitioned by session, beside a catalogue of sessions and owners."""

from __future__ import annotations

import os
import re
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe import schema
from lodeframe.errors import EngineError, bad_argument
from lodeframe.functions.text import combined_sha
from lodeframe.operators.ranking import first_wins
from lodeframe.plans.changes import Changes
from lodeframe.sources import ingest
from lodeframe.tables import materialize

SESSIONS = "session_id string, sha256 string, kind string, label string, pkg string, version_name string, version_code long, created_at timestamp, schema_version int, sources array<string>"
OWNERS = "session_id string, owner string, created_at timestamp"
DEAD_LETTERS = "path string, sha256 string, code string, message string, suggestion string, seen_at timestamp"
CATALOGUE = {"sessions": (SESSIONS, ["session_id"]), "owners": (OWNERS, ["session_id", "owner"]), "dead_letters": (DEAD_LETTERS, ["path", "sha256"])}
MOST_BYTES = 200 << 20
WRITERS = 6


class Index:
    """root, allowed folders and artifacts are paths of any file system that the cluster's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession, root: str, allowed: list[str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.allowed = [self._qualified(a) for a in allowed] if allowed else None
        self.log = Changes(spark, f"{self.root}/catalogue", CATALOGUE, self._hadoop)

    # -------------------------------------------------------------- files

    def _hadoop(self, path: str):
        """(file system, path) of a path."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _qualified(self, path: str) -> str:
        """The whole path with its scheme. Links of local files are followed."""
        fs, found = self._hadoop(path)
        full = fs.makeQualified(found).toString()
        return "file:" + os.path.realpath(full.removeprefix("file:")) if full.startswith("file:") else full

    def _list(self, path: str, recursive: bool) -> list[str]:
        fs, found = self._hadoop(path)
        files, out = fs.listFiles(found, recursive), []
        while files.hasNext():
            out.append(files.next().getPath().toString())
        return sorted(out)

    # -------------------------------------------------------------- tables

    def exists(self, name: str) -> bool:
        """Whether a folder of tables has a file. Folders of released sessions stay, empty."""
        fs, path = self._hadoop(f"{self.root}/{name}")
        return fs.exists(path) and fs.listFiles(path, True).hasNext()

    def delete(self, name: str) -> None:
        fs, path = self._hadoop(f"{self.root}/{name}")
        fs.delete(path, True)

    def size(self, session_id: str | None = None) -> int:
        """Bytes of all tables, or of those of one session."""
        part = "" if session_id is None else f"/session_id={session_id}"
        paths = [self._hadoop(f"{self.root}/{n}{part}") for n in schema.TABLES if self.exists(n + part)]
        return sum(fs.getContentSummary(path).getLength() for fs, path in paths)

    def unreadable(self, session_id: str) -> list[str]:
        """Tables of a session that can't be read to the end."""
        bad = []
        for name in schema.TABLES:
            if self.exists(f"{name}/session_id={session_id}"):
                try:
                    self.table(name, session_id).write.format("noop").mode("overwrite").save()
                except (Py4JJavaError, CapturedException):
                    bad.append(name)
        return bad

    def table(self, name: str, session_id: str | None = None) -> DataFrame:
        """A table, or its part for one session: Spark then lists and reads that partition alone."""
        kind = f"{schema.COLUMNS[name]}, session_id string" + (f", {schema.PARTED[name]} int" if name in schema.PARTED else "")
        df = self.spark.read.schema(kind).parquet(f"{self.root}/{name}") if self.exists(name) else self.spark.createDataFrame([], kind)
        return df if session_id is None else df.where(F.col("session_id") == session_id)

    def about(self, classes: dict[str, DataFrame]):
        """Where the members of these classes (descriptors by session) are read: the stored tables hold them by session."""
        return self

    def write(self, tables: dict[str, DataFrame], **options) -> None:
        """Write sessions' parts of tables, WRITERS at a time: most of the time of a small session is the start of jobs."""

        def one(name: str, df: DataFrame) -> None:
            columns = self.spark.createDataFrame([], schema.COLUMNS[name]).schema
            folders = ["session_id", *[schema.PARTED[n] for n in (name,) if n in schema.PARTED]]
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in columns], *folders)
            order = [*folders, *schema.TABLES[name]]
            # A large session is spread over its natural key; AQE puts small ones together again.
            dealt = df.repartitionByRange(*order) if name in schema.CLUSTERED else df.repartition(*(order if schema.TABLES[name] else folders))
            blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in schema.BLOOM.get(name, ())}
            writer = dealt.sortWithinPartitions(*order).write.mode("overwrite").options(partitionOverwriteMode="dynamic", **blooms, **options)
            writer.partitionBy(*folders).parquet(f"{self.root}/{name}")

        with ThreadPoolExecutor(WRITERS) as pool:
            for done in [pool.submit(one, name, df) for name, df in tables.items()]:
                done.result()

    # -------------------------------------------------------------- catalogue

    def dead_letters(self) -> DataFrame:
        """Files of a stream that no parser could read, each once, and why."""
        return self.log.table("dead_letters")

    def sessions(self) -> DataFrame:
        return self.log.table("sessions")

    def owners(self) -> DataFrame:
        return self.log.table("owners")

    def append_rows(self, tables: dict[str, DataFrame]) -> None:
        """Many rows of catalogue tables in one change. Rows replace those of their keys."""
        folders = {name: self.log.store(name, rows) for name, rows in tables.items()}
        self.log.commit(lambda _: {"folders": folders})

    def upsert(self, row: tuple, owner: str, since: int | None = None) -> bool:
        """row: as SESSIONS, with the time of now. A session that is there keeps its time. since: the change after which the session's
        tables were written; if it has been taken away after that, nothing is changed and the answer is no."""
        names = [f.split()[0] for f in SESSIONS.split(", ")]
        at = names.index("created_at")
        done = True

        def decide(number: int) -> dict | None:
            nonlocal done
            done = since is None or not self.log.released_since(since, row[0])
            if not done:
                return None
            old = self.log.table("sessions", number).where(F.col("session_id") == row[0]).first()
            kept = row if old is None else (*row[:at], old.created_at, *row[at + 1 :])
            rows = {}
            if old is None or tuple(old[n] for n in names) != kept:
                rows["sessions"] = [(*kept, False)]
            if self.log.table("owners", number).where((F.col("session_id") == row[0]) & (F.col("owner") == owner)).isEmpty():
                rows["owners"] = [(row[0], owner, row[at], False)]
            return {"rows": rows} if rows else None

        self.log.commit(decide)
        return done

    def release(self, session_id: str, owner: str, keep_files: bool = False) -> int:
        """Owners left. With the last one the session goes, and the files that its tables had before that change: those of a loader that
        comes after it have other names."""
        now, left, files = datetime.now(), 0, []

        def decide(number: int) -> dict:
            nonlocal left, files
            left = self.log.table("owners", number).where((F.col("session_id") == session_id) & (F.col("owner") != owner)).count()
            rows = {"owners": [(session_id, owner, now, True)]}
            if left:
                return {"rows": rows}
            parts = [f"{name}/session_id={session_id}" for name in schema.TABLES]
            files = [] if keep_files else [f for part in parts if self.exists(part) for f in self._list(f"{self.root}/{part}", True)]
            rows["sessions"] = [(session_id, *[None] * (len(SESSIONS.split(", ")) - 1), True)]
            return {"rows": rows, "released": [session_id]}

        self.log.commit(decide)
        if not left:
            for path in files:
                fs, found = self._hadoop(path)
                fs.delete(found, False)
        return left

    # -------------------------------------------------------------- loading

    def resolve(self, path: str) -> str:
        real = self._qualified(path)
        fs, found = self._hadoop(real)
        if not fs.exists(found):
            raise EngineError("INVALID_PATH", f"no file {path}", "give a path that the cluster can read")
        if self.allowed is not None and not any(real == a or real.startswith(a.rstrip("/") + "/") for a in self.allowed):
            raise EngineError("INVALID_PATH", f"{path} is outside the allowed folders", f"put it below one of {', '.join(self.allowed)}")
        return real

    def expand(self, path: str, splits: bool = True) -> list[str]:
        """A file, a folder, or a list with commas (for local files also colons); base packages first. A base.apk brings the splits beside
        it."""
        fs, found = self._hadoop(path) if "," not in path else (None, None)
        whole = fs is not None and ("://" in path or fs.exists(found))
        parts = [self.resolve(p) for p in ([path] if whole else [p for p in re.split(r",|:(?!//)", path) if p])]
        if not parts:
            raise EngineError("INVALID_PATH", f"no file in {path!r}", "give a path that the cluster can read")
        base = lambda p: p.rpartition("/")[2]
        is_split = lambda p: base(p).startswith(("split_", "config."))
        out: list[str] = []
        for p in parts:
            fs, found = self._hadoop(p)
            if fs.getFileStatus(found).isDirectory():
                out += [x for x in self._list(p, True) if x.endswith(".apk")]
            else:
                out.append(p)
                if splits and base(p) == "base.apk":
                    out += [x for x in self._list(p.rpartition("/")[0], False) if is_split(x) and x.endswith(".apk")]
        out = sorted(dict.fromkeys(out), key=lambda p: (is_split(p), p))
        if not splits:
            out = [p for p in out if not is_split(p)]
        if not out:
            raise EngineError("INVALID_PATH", f"no package in {path!r}", "give a folder with .apk files")
        return out

    def files(self, paths: list[str], source: str, most: int | None, force: bool) -> tuple[DataFrame, str, str]:
        """(files for the parser, session id, digest). most: None for the default, 0 for no limit."""
        most = MOST_BYTES if most is None else most
        size = sum(fs.getFileStatus(found).getLen() for fs, found in map(self._hadoop, paths))
        if most and not force and size > most:
            raise EngineError("APK_TOO_LARGE", f"{size} bytes, at most {most}", "raise maxApkBytes, or use force")
        plain = lambda p: re.sub("^file:/+", "file:/", p)
        order = self.spark.createDataFrame([(plain(p), k, p.rpartition("/")[2]) for k, p in enumerate(paths)], "path string, file_ord int, name string")
        raw = self.spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "content").join(F.broadcast(order), "path")
        told = raw.agg(combined_sha(F.collect_list(F.struct("name", F.sha2("content", 256).alias("sha")))).alias("digest")).first()
        session = "ses_" + told.digest[:12]
        return raw.select(F.lit(session).alias("session_id"), "file_ord", "name", F.lit(source).alias("source"), "content"), session, told.digest

    def load(self, paths: list[str], kind: str, owner: str, source: str = "app", into: str = "", parser: str = "", most: int | None = None, force: bool = False, form: str = "auto") -> tuple[str, bool]:
        """(session, whether it was there already). into: a session that the new rows are added to; what it has wins."""
        ingest.backend(parser)
        files, session, digest = self.files(paths, source, most, force)
        if into:
            files = files.withColumn("session_id", F.lit(into))
        elif not force:
            read = self.log.head()
            known = self.log.table("sessions", read).where(F.col("session_id") == session).first()
            if known is not None:
                if known.schema_version != schema.SCHEMA_VERSION:
                    raise EngineError("INDEX_STALE", f"{session} has schema {known.schema_version}", "load it again with force")
                if self.upsert(tuple(known), owner, since=read):
                    return session, True
        parsed = materialize(ingest.parse_files(files, parser, form), "parsed")
        error = parsed.where("entity = 'error'").select(F.from_json("payload", "code string, message string, suggestion string").alias("e")).select("e.*").first()
        if error is not None:
            raise EngineError(error.code, error.message, error.suggestion)
        tables = ingest.normalise(parsed)
        if into:
            # A class that the session has already keeps its own members: those of the new one go.
            had = materialize(self.table("classes", into).select(F.col("descriptor").alias("_class")), "classes")
            for name, owner_col in (("methods", "class_descriptor"), ("fields", "class_descriptor"), ("annotations", "class_descriptor"), ("string_refs", "method_key"), ("refs_by_string", "method_key"), ("xref_edges", "caller_key"), ("edges_by_callee", "caller_key")):
                tables[name] = tables[name].join(had, F.substring_index(owner_col, "->", 1) == F.col("_class"), "left_anti")
            self.write({name: self._added(name, into, df) for name, df in tables.items()})
            return into, False
        m = tables["manifest"].first()
        told = (m["package"], m["version_name"], m["version_code"]) if m else (None, None, None)
        row = (session, digest, kind, paths[0].rpartition("/")[2], *told, datetime.now(), schema.SCHEMA_VERSION, paths)
        while True:
            began = self.log.head()
            self.write(tables)
            for name in schema.TABLES:
                if force and tables[name].limit(1).count() == 0:
                    self.delete(f"{name}/session_id={session}")
            # An owner who gave the session up while it was written may have taken these files with it.
            if self.upsert(row, owner, since=began):
                return session, False

    def _added(self, name: str, session: str, new: DataFrame) -> DataFrame:
        """The session's rows and those new ones whose keys it does not have."""
        key = list(schema.TABLES[name])
        old = self.table(name, session)
        if name == "dex":
            shift = (old.agg(F.max("dex_idx")).first()[0] or 0) // ingest.DEX_PER_FILE + 1
            same = old.select("origin", F.col("name").alias("_name"))
            new = new.join(same, (new["origin"] == same["origin"]) & (new["name"] == same["_name"]), "left_anti").withColumn("dex_idx", F.col("dex_idx") + shift * ingest.DEX_PER_FILE)
            return materialize(old.unionByName(new), name)
        both = old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
        return materialize(first_wins(both, ["session_id", *key], ["_rank"]).drop("_rank"), name)

    # -------------------------------------------------------------- sessions by name

    def session(self, name: str, owner: str | None = None) -> str:
        """By id, else by package, else by the start of the digest. More than one is an error."""
        if not name:
            raise bad_argument("sessionId is missing", "list the sessions")
        found = [r.session_id for r in self.sessions().where((F.col("session_id") == name) | (F.col("pkg") == name) | F.col("sha256").startswith(name)).collect()]
        if name in found:
            return name
        if len(found) > 1:
            raise bad_argument(f"{name!r} fits {len(found)} sessions: {', '.join(sorted(found))}", "give a session id")
        if not found:
            raise EngineError("SESSION_NOT_FOUND", f"no session {name!r}", "load the artifact, or list the sessions")
        return found[0]
