"""Artifacts to tables: files are opened and their images parsed in Arrow batches on the executors, then exploded and de-duplicated in the JVM."""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe import schema
from lodeframe.errors import EngineError
from lodeframe.functions import descriptors as d
from lodeframe.operators import grams
from lodeframe.operators.ranking import first_wins
from lodeframe.sources import containers
from lodeframe.sources.classfile import ClassError, parse_class
from lodeframe.sources.dex import Dex, DexError
from lodeframe.sources.resources import ChunkError, parse_arsc, read_manifest
from lodeframe.tables import materialize

#: Numbers of dex images that belong to one file.
DEX_PER_FILE = 1 << 16
#: A row of the first step that the second parses.
IMAGE = "image"
_BROKEN = (ClassError, DexError, ChunkError, IndexError, KeyError, TypeError, ValueError, struct.error, zipfile.BadZipFile)


class _Out:
    """Rows of one file. Dex images are not parsed here: each is a row with its bytes, for a task of its own."""

    def __init__(self, file_ord: int, origin: str, source: str):
        self.rows: list[tuple] = []
        self.file_ord, self.origin, self.source, self.dex_idx = file_ord, origin, source, file_ord * DEX_PER_FILE
        self.notes: list[str] = []

    def add(self, entity: str, payload: dict, order: int = 0, source: str | None = None) -> None:
        self.rows.append((entity, self.file_ord, self.dex_idx, order, source or self.source, json.dumps(payload, ensure_ascii=False)))

    def dex(self, name: str, data: bytes) -> None:
        if self.dex_idx - self.file_ord * DEX_PER_FILE >= DEX_PER_FILE - 1:
            raise EngineError("UNSUPPORTED_FORMAT", f"{self.origin} holds more than {DEX_PER_FILE - 1} images", "load its parts one by one")
        self.rows.append((IMAGE, self.file_ord, self.dex_idx, 0, self.source, json.dumps({"name": name, "origin": self.origin}), data))
        self.dex_idx += 1

    def jar(self, name: str, archive: zipfile.ZipFile, source: str) -> None:
        entries = containers.class_entries(archive)
        if entries:
            self.add("dex", {"name": name, "origin": self.origin, "size": sum(archive.getinfo(n).file_size for n in entries), "version": "class", "sha": None, "counts": {"classes": len(entries)}}, source=source)
            for k, n in enumerate(entries):
                try:
                    self.add("class", parse_class(archive.read(n)), k, source)
                except _BROKEN as e:
                    self.notes.append(f"{n}: {e}")
            self.dex_idx += 1


def parse_image(file_ord: int, dex_idx: int, source: str, name: str, origin: str, data: bytes) -> list[tuple]:
    """All rows of one dex image."""
    image = Dex(data)
    row = lambda entity, payload, order=0: (entity, file_ord, dex_idx, order, source, json.dumps(payload, ensure_ascii=False))
    head = {"name": name, "origin": origin, "size": len(data), "version": image.version, "sha": hashlib.sha256(data).hexdigest(), "counts": image.counts()}
    rows = [row("dex", head), *(row("class", c, k) for k, c in enumerate(image.classes()))]
    return [*rows, row("notes", {"notes": image.notes})] if image.notes else rows


def builtin(file_ord: int, name: str, data: bytes, source: str, form: str = "auto") -> list[tuple]:
    """All rows of one file. form: what the caller says that it is; auto looks at its start, name and members."""
    out, facts = _Out(file_ord, name, source), {"origin": name}
    zipped = data[:4] == b"PK\x03\x04"
    kind = form if form != "auto" else containers.sniff(data[:16], name, set(containers.open_zip(data).namelist()) if zipped else set())
    if (kind in ("apk", "aar", "jar")) != zipped and kind != "unknown":
        raise EngineError("UNSUPPORTED_FORMAT", f"{name} is not of the format {kind}", "leave the format out")
    if kind in ("apk", "aar", "jar"):
        archive = containers.open_zip(data)
        names = archive.namelist()
        found = containers.zip_facts(archive)
        for lib in found.pop("libs"):
            out.add("lib", lib | {"origin": name})
        facts |= found
        if "AndroidManifest.xml" in names:
            try:
                out.add("manifest", read_manifest(archive.read("AndroidManifest.xml")))
            except (*_BROKEN, SyntaxError) as e:
                out.notes.append(f"manifest: {e}")
        if "resources.arsc" in names:
            entries, notes = parse_arsc(archive.read("resources.arsc"))
            facts["resource_table"] = bool(entries)
            out.notes += [f"resources.arsc: {n}" for n in notes]
            for k, e in enumerate(entries):
                out.add("resource", e, k)
        for n in containers.dex_members(names):
            out.dex(n, archive.read(n))
        if kind == "aar" or (kind == "jar" and not containers.dex_members(names)):
            if kind == "jar":
                out.jar(name, archive, "library" if source == "app" else source)
            for n in sorted(n for n in names if n == "classes.jar" or (n.startswith("libs/") and n.endswith(".jar"))):
                out.jar(n, containers.open_zip(archive.read(n)), "library")
            if "R.txt" in names:
                lines = [x for x in archive.read("R.txt").decode("utf-8", "replace").splitlines() if x.strip()]
                facts |= {"r_count": len(lines), "r_sample": lines[:5]}
            rules = [r for n in ("proguard.txt", "consumer-rules.pro") if n in names for r in containers.keep_rules(archive.read(n).decode("utf-8", "replace"))]
            facts |= {"keep": rules, "headers": sum(n.endswith((".h", ".hpp")) for n in names)}
    elif kind == "dex":
        out.dex(name, data)
    elif kind in ("odex", "vdex"):
        images = containers.carve(data)
        if not images:
            raise EngineError("UNSUPPORTED_FORMAT", f"{name} holds no whole dex image", "extract the dex files first and load those")
        for k, image in enumerate(images):
            out.dex(f"{name}#{k}", image)
    else:
        raise EngineError("UNSUPPORTED_FORMAT", f"{name} is none of apk, aar, jar, dex, odex, vdex", "check the file")
    facts["notes"] = out.notes
    out.add("facts", facts)
    return out.rows


#: Parsers by name: each gives the rows of one file.
BACKENDS: dict[str, Callable[[int, str, bytes, str, str], list[tuple]]] = {"builtin": builtin}


def register(name: str, parser: Callable[[int, str, bytes, str, str], list[tuple]]) -> None:
    """Another parser: from (file number, name, content, source, format) the rows (entity, file number, dex number, order, source, JSON)."""
    BACKENDS[name] = parser


def backend(name: str = "") -> Callable[[int, str, bytes, str, str], list[tuple]]:
    if (name or "builtin") not in BACKENDS:
        raise EngineError("BACKEND_UNAVAILABLE", f"no parser {name!r}", f"one of {', '.join(BACKENDS)}")
    return BACKENDS[name or "builtin"]


def parse_files(files: DataFrame, parser: str = "", form: str = "auto") -> DataFrame:
    """files: session_id, file_ord, name, source, content. A row (session_id, PARSED) for each thing found; a file, or an image in it, that
    can't be read is a row of entity error.

    Files are opened where they are read: archives are listed, odex and vdex files carved, and all but dex images is parsed. The images
    then go to tasks by their number, so those of one package are parsed side by side.
    """
    parse = backend(parser)
    columns = ["session_id", *[f.split()[0] for f in schema.PARSED.split(", ")]]

    def tried(name: str, order: int, dex_idx: int, source: str, rows: Callable[[], list[tuple]]) -> list[tuple]:
        try:
            return rows()
        except EngineError as e:
            told = {"code": e.code, "message": e.message, "suggestion": e.suggestion}
        except _BROKEN as e:
            told = {"code": "PARSE_FAILED", "message": f"{name}: {e}", "suggestion": "check that the file is whole"}
        return [("error", order, dex_idx, 0, source, json.dumps(told))]

    def frames(session: str, rows: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
        for a in range(0, len(rows), 2000):
            yield pd.DataFrame([(session, *r, *[None] * (len(names) - 1 - len(r))) for r in rows[a : a + 2000]], columns=names)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for session, order, name, source, content in batch[["session_id", "file_ord", "name", "source", "content"]].itertuples(index=False):
                rows = tried(name, int(order), 0, source, lambda o=int(order), n=name, c=content, s=source: parse(o, n, bytes(c), s, form))
                yield from frames(session, [r for r in rows if r[0] != IMAGE], [*columns, "content"])
                for r in rows:
                    if r[0] == IMAGE:
                        yield from frames(session, [r], [*columns, "content"])

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            image = batch["entity"] == IMAGE
            if not image.all():
                yield batch.loc[~image, columns]
            for session, order, k, source, payload, content in batch.loc[image, ["session_id", "file_ord", "dex_idx", "source", "payload", "content"]].itertuples(index=False):
                told = json.loads(payload)
                rows = tried(f"{told['origin']}: {told['name']}", int(order), int(k), source, lambda o=int(order), k=int(k), s=source, t=told, c=content: parse_image(o, k, s, t["name"], t["origin"], bytes(c)))
                yield from frames(session, rows, columns)

    kind = f"session_id string, {schema.PARSED}"
    found = files.mapInPandas(opened, f"{kind}, content binary")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.hash("session_id", "file_ord") % parts + F.col("dex_idx") % DEX_PER_FILE, F.lit(parts)).cast("int")
    return found.repartitionById(parts, place).mapInPandas(images, kind)


def normalise(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables of the parsed rows. The first class of a descriptor wins, with its members; members of losing classes go."""

    def of(entity: str) -> DataFrame:
        return parsed.where(F.col("entity") == entity).withColumn("p", F.from_json("payload", schema.PAYLOADS[entity]))

    base = ["session_id", "file_ord", "dex_idx", "ord", "source"]
    dex = of("dex").select(*base, "p.*")
    # A dex image that stands twice in a session counts once.
    dex = first_wins(dex, ["session_id", F.coalesce("sha", F.concat("origin", F.lit("/"), "name"))], ["dex_idx"])
    classes = of("class").select(*base, "p.*").join(dex.select("session_id", "dex_idx", F.col("origin").alias("origin_file")), ["session_id", "dex_idx"])
    classes = materialize(first_wins(classes, ["session_id", "descriptor"], ["dex_idx", "ord"]), "classes")
    own = classes.select("session_id", "dex_idx", F.col("descriptor").alias("class_descriptor"), "source", F.posexplode("methods").alias("ord", "m")).select("session_id", "dex_idx", "class_descriptor", "source", "ord", "m.*")
    key = d.smali_method(F.col("class_descriptor"), F.col("name"), F.col("params_descriptor"), F.col("return_descriptor"))
    own = materialize(first_wins(own.withColumn("method_key", key), ["session_id", "method_key"], ["ord"]), "own")
    methods = own.select(
        "session_id", "class_descriptor", "name", "params_descriptor", "return_descriptor", "method_key", "access_flags", F.col("access_flags").bitwiseAND(8).cast("boolean").alias("is_static"), (F.col("name") == "<init>").alias("is_constructor"),
        ((F.size("strings") > 0) | (F.size("refs") > 0)).alias("has_refs"), "partial", F.size(d.split_params(F.col("params_descriptor"))).alias("param_count"), "shorty", "regs", F.col("ins").alias("ins_size"), F.col("units").alias("unit_count"),
    )
    fields = classes.select("session_id", F.col("descriptor").alias("class_descriptor"), F.posexplode("fields").alias("ord", "f")).select("session_id", "class_descriptor", "ord", "f.*")
    string_refs = own.select("session_id", "method_key", F.explode("strings").alias("value")).distinct()
    edges = own.select("session_id", F.col("method_key").alias("caller_key"), F.explode("refs").alias("r"))
    part = lambda k: F.col("r")[k]
    edges = edges.select("session_id", "caller_key", part(0).cast("int").alias("kind"), F.concat(part(1), F.when(part(2) != "", F.concat(F.lit("->"), part(2), F.when(part(3) == "", F.lit(":")).otherwise(part(3)), part(4))).otherwise("")).alias("callee_descriptor"), part(1).alias("callee_owner"), part(2).alias("callee_name"), part(3).alias("callee_params"), part(4).alias("callee_ret"), part(5).cast("int").alias("hits"))
    notes = classes.select("session_id", F.col("descriptor").alias("class_descriptor"), F.explode("annotations").alias("a")).select("session_id", "class_descriptor", F.col("a.method").alias("method_key"), "a.descriptor", "a.visibility", "a.args").distinct()
    manifest = first_wins(of("manifest").select(*base, "p.*"), ["session_id"], ["file_ord"])
    tables = {
        "dex": dex.select("session_id", "dex_idx", "name", "origin", "size", "version", "source", "counts"),
        "classes": classes.select("session_id", "dex_idx", "descriptor", d.simple_name(F.col("descriptor")).alias("simple_name"), d.package_of(F.col("descriptor")).alias("package"), "access_flags", "super_descriptor", "interfaces", "source", "origin_file", d.class_kind(F.col("access_flags")).alias("kind"), "source_file"),
        "methods": methods,
        "fields": first_wins(fields, ["session_id", "class_descriptor", "name"], ["ord"]).drop("ord"),
        "string_refs": string_refs,
        "xref_edges": edges.groupBy(*[c for c in edges.columns if c != "hits"]).agg(F.sum("hits").alias("hits")),
        "annotations": notes,
        "manifest": manifest.drop("components", "file_ord", "dex_idx", "ord", "source"),
        "components": manifest.select("session_id", F.inline("components")),
        "native_libs": of("lib").select("session_id", "p.*").distinct(),
        "resource_entries": first_wins(of("resource").select(*base, "p.*"), ["session_id", "id"], ["file_ord", "ord"]).select("session_id", "pkg", "type", "name", "type_id", "entry_id", "id"),
        "facts": with_notes(of("facts").select("session_id", "file_ord", "p.*"), of("notes")),
    }
    return tables | probed(string_refs, tables["xref_edges"], classes.select("session_id", F.explode("constants").alias("value")))


def with_notes(facts: DataFrame, notes: DataFrame) -> DataFrame:
    """facts, with what the parsers of a file's images have noted after its own notes."""
    own = notes.groupBy("session_id", "file_ord").agg(F.flatten(F.sort_array(F.collect_list(F.struct("dex_idx", "p.notes")))["notes"]).alias("_more"))
    more = F.coalesce("_more", F.array().cast("array<string>"))
    return facts.join(own, ["session_id", "file_ord"], "left").withColumn("notes", F.concat("notes", more)).drop("file_ord", "_more")


def string_id(value: Column) -> Column:
    return F.xxhash64(value)


def probed(string_refs: DataFrame, edges: DataFrame, constants: DataFrame | None = None) -> dict[str, DataFrame]:
    """The pool of strings with its grams, and second copies of references and edges for probes from the other side. constants: strings that
    are in the pool though no code refers to them."""
    pool = string_refs.select("session_id", "value")
    pool = (pool if constants is None else pool.unionByName(constants)).distinct()
    strings = pool.select("session_id", string_id(F.col("value")).alias("id"), "value", F.lower("value").alias("lc"), F.length("value").alias("len"))
    refs = string_refs.select("session_id", string_id(F.col("value")).alias("id"), "value", "method_key")
    return {"strings": strings, "string_grams": grams.postings(strings, ["session_id"], "id", "lc"), "refs_by_string": refs, "edges_by_callee": edges}
