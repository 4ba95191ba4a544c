"""The 23 named queries over a stored index. Each checks its arguments, builds one plan and shows at most `limit` rows of it."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodeframe import schema
from lodeframe.errors import EngineError, bad_argument
from lodeframe.functions import descriptors as d
from lodeframe.functions.text import keywords
from lodeframe.operators import diff, filters, grams, graph, match, pairing, ranking
from lodeframe.plans import envelope, packers, snippets
from lodeframe.plans.index import Index
from lodeframe.sources import containers
from lodeframe.sources.dex import KINDS
from lodeframe.sources.ingest import string_id
from lodeframe.tables import materialize

INVOKES = tuple(range(1, 9))
FIELD_KINDS = (10, 11, 12, 13)
#: What makes a permission dangerous, and visibilities of annotations.
DANGEROUS = ("INTERNET", "LOCATION", "CAMERA", "RECORD_AUDIO", "STORAGE", "READ_PHONE", "SEND_SMS", "CALL_PHONE", "READ_CONTACTS", "WRITE_CONTACTS", "READ_SMS", "ACCESS_FINE", "ACCESS_COARSE")
VISIBILITY = {0: "build", 1: "runtime", 2: "system"}
COMPONENT_TYPES = ("activity", "service", "receiver", "provider")


def as_list(value) -> list[str]:
    if value is None:
        return []
    return [str(v).strip() for v in (value if isinstance(value, (list, tuple)) else re.split(r"[,;|]", str(value))) if str(v).strip()]


def as_texts(value) -> list[str]:
    """A list as it is (texts may hold commas), else the parts of a text."""
    return [str(s) for s in value] if isinstance(value, (list, tuple)) else as_list(value)


def callee(parsed: tuple) -> Column:
    """Edges to a member: (owner or None, name, and parameters, a type or None). A simple owner stands for a class of any package."""
    owner, name, rest = parsed
    out = F.col("callee_name") == name
    if owner:
        own = F.col("callee_owner") == owner
        out = out & (own if "/" in owner else own | F.col("callee_owner").endswith("/" + owner[1:]))
    if isinstance(rest, list):
        return out & (F.col("callee_params") == f"({''.join(rest)})")
    return out & (F.col("callee_ret") == rest) if rest else out


def pasted(code: str) -> dict:
    """Code to paste, and which of its brackets and quotes don't close."""
    return {"snippet": code, "snippetProblems": snippets.check_balance(code)}


def method_code(item: Row, strings: list[str]) -> dict:
    params = re.findall(r"\[*(?:[VZBCSIJFD]|L[^;]+;)", item.paramsDescriptor)
    return pasted(snippets.method_snippet(item.classDescriptor, item["name"], params, item.returnDescriptor, strings))


def checked(name: str, value, parameter: inspect.Parameter):
    """The value as the parameter's annotation wants it: text that stands for a number or a truth value is read as one."""
    kind = str(parameter.annotation)
    if value is None or kind == str(inspect.Parameter.empty):
        return value
    if kind.startswith("bool"):
        spelled = {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False}.get(str(value).strip().lower())
        if spelled is None:
            raise bad_argument(f"{name} must be true or false, not {value!r}")
        return spelled
    if kind.startswith(("int", "float")):
        number = float if kind.startswith("float") else int
        try:
            return number(value)
        except (TypeError, ValueError) as e:
            raise bad_argument(f"{name} must be a number, not {value!r}") from e
    if kind.startswith("str") and not isinstance(value, str):
        raise bad_argument(f"{name} must be a text, not {value!r}")
    return value


def rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


class Engine:
    def __init__(self, spark: SparkSession, root: str = "", allowed: list[str] | None = None, owner: str = "default", index=None):
        """index: anything with the table(), exists() and session() of an Index, instead of the one stored in root."""
        self.spark, self.index, self.owner = spark, index or Index(spark, root, allowed), owner
        self.tools = {"loadApk": self.load_apk, "loadAar": self.load_aar, "loadDex": self.load_dex, "sessionList": self.session_list, "unload": self.unload, "stats": self.stats, "checkPacker": self.check_packer, "searchClasses": self.search_classes, "listMembers": self.list_members, "getSignature": self.get_signature, "searchByString": self.search_by_string, "findImplementations": self.find_implementations, "xref": self.xref, "decompile": self.decompile, "matchSignature": self.match_signature, "diffSessions": self.diff_sessions, "probe": self.probe, "listManifest": self.list_manifest, "findComponent": self.find_component, "searchResources": self.search_resources, "resourceRefs": self.resource_refs, "resourceSecurity": self.resource_security, "doctor": self.doctor}

    def call(self, tool: str, **args) -> dict:
        """The result envelope, or a failure with code, message and suggestion. Argument names may be in camel case."""
        try:
            if tool not in self.tools:
                raise bad_argument(f"no tool {tool!r}", ", ".join(self.tools))
            fn = self.tools[tool]
            known = {re.sub("_", "", n).lower(): n for n in inspect.signature(fn).parameters}
            bound = {}
            for name, value in args.items():
                key = name.replace("_", "").lower()
                if key not in known:
                    raise bad_argument(f"unknown argument {name!r}", f"one of {', '.join(inspect.signature(fn).parameters)}")
                bound[known[key]] = checked(name, value, inspect.signature(fn).parameters[known[key]])
            missing = [n for n, p in inspect.signature(fn).parameters.items() if p.default is p.empty and n not in bound]
            if missing:
                raise bad_argument(f"missing argument {', '.join(missing)}", f"give {', '.join(missing)}")
            return fn(**bound)
        except EngineError as e:
            return envelope.fail(e)
        except ValueError as e:
            return envelope.fail(bad_argument(str(e)))

    # -------------------------------------------------------------- loading

    def load_apk(self, path: str, from_device: bool = False, package_name: str = "", splits: bool = True, backend: str = "", max_apk_bytes: int | None = None, force: bool = False) -> dict:
        if from_device:
            raise EngineError("ADB_UNAVAILABLE", "devices are not reached from a cluster", "pull the package first and load the files")
        session, known = self.index.load(self.index.expand(path, splits), "apk", self.owner, parser=backend, most=max_apk_bytes, force=force)
        return self._fingerprint(session, known)

    def load_aar(self, path: str, merge_into: str = "", backend: str = "", max_apk_bytes: int | None = None, force: bool = False) -> dict:
        into = self.index.session(merge_into) if merge_into else ""
        session, known = self.index.load([self.index.resolve(path)], "aar", self.owner, "library", into, backend, max_apk_bytes, force)
        facts = self.index.table("facts", session)
        named = F.regexp_extract_all("rule", F.lit(containers.KEPT_NAME), 1)
        names = facts.select(F.explode("keep").alias("rule")).select(F.explode(named).alias("name")).distinct()
        kept = names.withColumn("descriptor", d.normalize_desc(F.col("name"))).join(self.index.table("classes", session).select("descriptor"), "descriptor", "left_semi")
        return self._fingerprint(session, known, hardcodableKeep=sorted(r["name"] for r in kept.collect()), rCount=facts.agg(F.coalesce(F.sum("r_count"), F.lit(0))).first()[0])

    def load_dex(self, path: str, session_id: str = "", format: str = "auto", source: str = "app", backend: str = "", max_apk_bytes: int | None = None, force: bool = False) -> dict:
        if format not in ("auto", "apk", "aar", "jar", "dex", "odex", "vdex"):
            raise bad_argument(f"unknown format {format!r}")
        into = self.index.session(session_id) if session_id else ""
        session, known = self.index.load([self.index.resolve(path)], "dex", self.owner, source, into, backend, max_apk_bytes, force, format)
        return self._fingerprint(session, known)

    def _fingerprint(self, session: str, known: bool, **more) -> dict:
        row = self.index.sessions().where(F.col("session_id") == session).first()
        counts = {r["name"]: r.n for r in match.table_counts({n: self.index.table(n, session) for n in ("classes", "methods", "fields", "strings", "xref_edges")}).collect()}
        packed = self._verdict(session)
        item = {"sessionId": session, "kind": row.kind, "label": row.label, "package": row.pkg, "versionName": row.version_name, "versionCode": row.version_code, "sha256": row.sha256, "counts": counts, "packed": packed["packed"], "reused": known} | more
        out = envelope.ok([item], session_id=session, hint="search by string first: it leads to methods most directly")
        return out | ({"code": "PACKED_TARGET"} if packed["packed"] else {})

    def session_list(self) -> dict:
        own = self.index.owners().where(F.col("owner") == self.owner).select("session_id")
        found = self.index.sessions().join(own, "session_id", "left_semi").orderBy(F.col("created_at").desc(), "session_id")
        items = [{"sessionId": r.session_id, "package": r.pkg, "kind": r.kind, "label": r.label, "createdAt": str(r.created_at), "indexAvailable": self.index.exists(f"classes/session_id={r.session_id}")} for r in found.collect()]
        return envelope.ok(items)

    def unload(self, session_id: str, keep_files: bool = False) -> dict:
        session = self.index.session(session_id)
        left = self.index.release(session, self.owner, keep_files)
        return envelope.ok([{"sessionId": session, "ownersLeft": left, "deleted": not left and not keep_files}], session_id=session)

    def stats(self, session_id: str = "") -> dict:
        session = self.index.session(session_id) if session_id else None
        of = lambda name: self.index.table(name, session)
        tables = ("classes", "methods", "fields", "strings", "string_refs", "xref_edges", "annotations", "components", "native_libs")
        counts = {r["name"]: r.n for r in match.table_counts({n: of(n) for n in tables}).collect()}
        by_source = {r.source: r.n for r in match.count_by(of("classes"), ["source"]).collect()}
        dex = rows(of("dex").orderBy("session_id", "dex_idx"), 24)
        return envelope.ok([{"counts": counts, "classesBySource": by_source, "dex": dex}], session_id=session or "")

    # -------------------------------------------------------------- packers

    def _verdict(self, session: str) -> dict:
        of = lambda name: self.index.table(name, session)
        assets = of("facts").select("session_id", F.explode("assets").alias("name"))
        libs = of("native_libs")
        apps = of("manifest")
        found = packers.evidence(of("classes"), libs.select("session_id", "name"), assets, apps.select("session_id", "application"))
        sizes = of("dex").groupBy("session_id").agg(F.sum("size").alias("dex_bytes"))
        shape = match.count_by(of("classes"), ["session_id"], "classes").join(sizes, "session_id", "left").join(packers.mean_entropy(of("strings")), "session_id", "left").fillna(0, ["dex_bytes"]).fillna(0.0, ["entropy"])
        row = packers.verdict(found, shape).first()
        if row is None:
            return {"packed": False, "vendors": [], "stringEntropy": 0.0, "evidence": [], "confidence": "none"}
        out = row.asDict(recursive=True)
        out["evidence"] = out["evidence"] or []
        out.pop("session_id")
        return out

    def check_packer(self, session_id: str) -> dict:
        session = self.index.session(session_id)
        found = self._verdict(session)
        found["recommendation"] = "unpack it first: what is indexed is the packer's own code" if found["packed"] else "nothing speaks for a packer"
        return envelope.ok([found], session_id=session) | ({"code": "PACKED_TARGET"} if found["packed"] else {})

    # -------------------------------------------------------------- shapes

    def class_items(self, session: str, classes: DataFrame) -> DataFrame:
        own = lambda name: self.index.table(name, session).select(F.col("class_descriptor").alias("descriptor"))
        c = match.with_counts(classes, ["descriptor"], {"methods": own("methods"), "fields": own("fields")})
        k = F.col("descriptor")
        return c.select(
            k, d.binary_name(k).alias("binaryName"), d.java_type(k).alias("javaName"), F.col("simple_name").alias("simpleName"), F.translate("package", "/", ".").alias("package"), "kind", "source", d.flag_names(F.col("access_flags"), d.CLASS_FLAGS).alias("accessFlags"), d.binary_name(F.col("super_descriptor")).alias("superClass"),
            F.transform("interfaces", d.binary_name).alias("interfaces"), F.col("origin_file").alias("originFile"), F.col("dex_idx").alias("dexIdx"), d.internal_name(k).alias("reflector"), d.class_for_name(k).alias("classForName"), "methods", "fields",
        )

    def method_items(self, session: str, methods: DataFrame, evidence: int = 0, parts: tuple[str, ...] = ("strings", "members")) -> DataFrame:
        """methods joined with their classes, in the shape of a method item; evidence: so many strings, calls and fields of each. parts:
        which of them, strings or members (calls and fields). The methods are written once for all that is looked up by them."""
        methods = materialize(methods, "methods") if evidence else methods
        # What few methods need is looked up; for many, the last join leaves out what others have.
        few = bool(evidence) and methods.count() <= graph.FRONTIER_ROWS
        looked_up = lambda df, key: df.join(F.broadcast(methods.select(F.col("method_key").alias(key))), key, "left_semi") if few else df
        classes = self.index.table("classes", session).select(F.col("descriptor").alias("class_descriptor"), "source", "dex_idx")
        m = methods.join(classes, "class_descriptor")
        owner, name, params, ret = (F.col(c) for c in ("class_descriptor", "name", "params_descriptor", "return_descriptor"))
        words = d.method_flag_names(F.col("access_flags"), name)
        out = m.select(
            "method_key", d.binary_name(owner).alias("class"), owner.alias("classDescriptor"), "source", F.col("dex_idx").alias("dexIdx"), name, F.when(F.col("is_constructor"), "constructor").otherwise("method").alias("kind"), words.alias("modifiers"), F.col("is_static").alias("static"), F.col("is_constructor").alias("constructor"),
            F.col("param_count").alias("paramCount"), F.col("method_key").alias("smali"), d.reflector_method(owner, name, params, ret).alias("reflector"), d.java_method(owner, name, params, ret, F.col("access_flags")).alias("java"), d.binary_name(ret).alias("returnType"), F.transform(d.split_params(params), d.binary_name).alias("params"),
            params.alias("paramsDescriptor"), ret.alias("returnDescriptor"), "shorty", d.class_for_name(owner).alias("classForName"), (F.col("access_flags").bitwiseAND(0x1000) != 0).alias("synthetic"),
        )
        if not evidence:
            return out
        if "strings" in parts:
            refs = looked_up(self.index.table("string_refs", session), "method_key")
            top = ranking.top_k(refs, ["method_key"], [F.length("value").desc(), "value"], evidence).groupBy("method_key").agg(F.sort_array(F.collect_list(F.struct("rn", "value")))["value"].alias("referredStrings"))
            out = out.join(top if few else top.hint("merge"), "method_key", "left")
        if "members" in parts:
            edges = looked_up(self.index.table("xref_edges", session).where(F.col("kind").isin(*INVOKES, *FIELD_KINDS)), "caller_key")
            own = lambda kinds: F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("callee_descriptor")))
            first = lambda label: F.when(F.size(label) > 0, F.slice(F.sort_array(label), 1, evidence)).alias(label)
            both = edges.groupBy(F.col("caller_key").alias("method_key")).agg(own(INVOKES).alias("invokedMethods"), own(FIELD_KINDS).alias("accessedFields"))
            both = both.select("method_key", first("invokedMethods"), first("accessedFields"))
            out = out.join(both if few else both.hint("merge"), "method_key", "left")
        return out

    def field_items(self, session: str, fields: DataFrame) -> DataFrame:
        classes = self.index.table("classes", session).select(F.col("descriptor").alias("class_descriptor"), "source", "dex_idx")
        owner, name, kind, flags = (F.col(c) for c in ("class_descriptor", "name", "type_descriptor", "access_flags"))
        return fields.join(classes, "class_descriptor").select(d.binary_name(owner).alias("class"), owner.alias("classDescriptor"), "source", F.col("dex_idx").alias("dexIdx"), name, F.lit("field").alias("kind"), d.flag_names(flags, d.FIELD_FLAGS).alias("modifiers"), F.col("is_static").alias("static"), d.binary_name(kind).alias("type"), kind.alias("typeDescriptor"), d.smali_field(owner, name, kind).alias("smali"), d.reflector_field(owner, name, kind).alias("reflector"), d.java_field(name, kind, flags).alias("java"), d.class_for_name(owner).alias("classForName"))

    def scoped(self, session: str, scope: str) -> DataFrame:
        return filters.scope_filter(self.index.table("classes", session), scope)

    def one_class(self, session: str, name: str, scope: str = "all"):
        """The class of a name in any spelling, or of a simple name. More than one is an error."""
        if not name:
            raise bad_argument("cls is missing", "give a class name in any spelling")
        desc = d.to_desc(name)
        tail = desc[1:-1]
        found = self.scoped(session, scope).where((F.col("descriptor") == desc) | (F.col("simple_name") == name) | F.col("descriptor").endswith(f"/{tail};")).orderBy((F.col("descriptor") == desc).desc(), F.length("descriptor"), "descriptor").limit(20).collect()
        if not found:
            raise EngineError("NOT_FOUND", f"no class {name!r}", "search for classes by prefix")
        if found[0].descriptor != desc and len(found) > 1:
            raise bad_argument(f"{name!r} fits several classes: {', '.join(r.descriptor for r in found[:6])}", "give the full name")
        return found[0]

    def annotated(self, session: str, name: str) -> DataFrame:
        """Classes (class_descriptor) with an annotation, by full name, @Name or Name."""
        plain = name.strip().lstrip("@")
        if not plain or ("%" in plain or "_" in plain) and "." not in plain and "/" not in plain:
            raise bad_argument(f"not an annotation name: {name!r}", "a name, @Name, a.b.Name or La/b/Name;")
        own = self.index.table("annotations", session).where("method_key IS NULL")
        if "." in plain or "/" in plain or plain.endswith(";"):
            return own.where(F.col("descriptor") == d.to_desc(plain)).select("class_descriptor").distinct()
        return own.where(F.ilike(F.col("descriptor"), F.lit(f"%/{filters.like_escape(plain)};"), F.lit("\\"))).select("class_descriptor").distinct()

    # -------------------------------------------------------------- searches

    def found_classes(self, session: str, query: str = "", kind: str = "prefix", scope: str = "all", package_filter: str = "", annotated_with: str = "") -> DataFrame:
        found = self.scoped(session, scope).withColumn("binary", d.binary_name(F.col("descriptor")))
        if kind == "exact":
            found = filters.name_filter(found, query, "exact", ["simple_name"], also=F.col("descriptor") == d.to_desc(query))
        elif kind == "prefix":
            text = query.replace(".", "/")
            if package_filter:
                found = filters.name_filter(found, query, "prefix", ["simple_name"], "package", package_filter)
            elif query:
                full = "L" + text.removeprefix("L") if "/" in text else "L" + text
                found = found.where(filters.prefix(F.col("descriptor"), full) | filters.prefix(F.col("package"), text) | filters.prefix(F.col("simple_name"), query))
        elif kind == "regex":
            found = filters.name_filter(found, query, "regex", ["binary", "simple_name"])
        else:
            raise bad_argument(f"unknown kind {kind!r}", "exact, prefix or regex")
        if annotated_with:
            found = found.join(self.annotated(session, annotated_with).select(F.col("class_descriptor").alias("descriptor")), "descriptor", "left_semi")
        return found

    def search_classes(self, session_id: str, query: str = "", kind: str = "prefix", scope: str = "all", limit: int = 50, package_filter: str = "", annotated_with: str = "") -> dict:
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        found = self.found_classes(session, query, kind, scope, package_filter, annotated_with)
        items = rows(self.class_items(session, found).orderBy(F.length("descriptor"), "descriptor"), limit)
        return envelope.ok(items, found.count(), session)

    def list_members(self, session_id: str, cls: str = "", include: str = "both", scope: str = "all", limit: int = 50, name_pattern: str = "", with_strings: int = 0) -> dict:
        if include not in ("both", "methods", "fields"):
            raise bad_argument(f"unknown include {include!r}", "both, methods or fields")
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        desc = self.one_class(session, cls, scope).descriptor
        own = lambda name: self.index.table(name, session).where(F.col("class_descriptor") == desc)
        pick = lambda df: df.where(F.col("name").rlike(filters.checked_regex(name_pattern))) if name_pattern else df
        methods, fields = pick(own("methods")), pick(own("fields"))
        items, total = [], 0
        if include != "fields":
            items += rows(self.method_items(session, methods, 6 if with_strings else 0).drop("method_key").orderBy(F.col("static").desc(), "name", "paramCount", "smali"), limit)
            total += methods.count()
        if include != "methods":
            items += rows(self.field_items(session, fields).orderBy(F.col("static").desc(), "name"), max(0, limit - len(items)) or 1)
            total += fields.count()
        return envelope.ok(items[:limit], total, session)

    def get_signature(self, session_id: str, cls: str = "", member: str = "", scope: str = "all") -> dict:
        session = self.index.session(session_id)
        if not cls and ("->" in member or "#" in member):
            cls = d.parse_method_ref(member)[0] if "(" in member or ":" not in member else d.parse_field_ref(member)[0]
        row = self.one_class(session, cls, scope)
        head = rows(self.class_items(session, self.index.table("classes", session).where(F.col("descriptor") == row.descriptor)), 1)[0]
        notes = self.index.table("annotations", session).where((F.col("class_descriptor") == row.descriptor) & F.col("method_key").isNull()).orderBy(F.col("visibility").desc(), "descriptor")
        head["annotations"] = [{"descriptor": r.descriptor, "javaName": snippets.java_name(r.descriptor), "visibility": VISIBILITY.get(r.visibility), "values": r["args"]} for r in notes.limit(50).collect()]
        head["snippet"] = snippets.class_snippet(row.descriptor)
        if not member:
            return envelope.ok([head], session_id=session)
        own = lambda name: self.index.table(name, session).where(F.col("class_descriptor") == row.descriptor)
        if ":" in member and "(" not in member:
            name, args, ret = d.parse_field_ref(member)[1], None, None
        else:
            _, name, args, ret = d.parse_method_ref(member)
        methods = own("methods").where(F.col("name") == name)
        if args is not None:
            methods = methods.where(F.col("params_descriptor") == f"({''.join(args)})")
        if ret:
            methods = methods.where(F.col("return_descriptor") == ret)
        found = self.method_items(session, methods, 6).drop("method_key").orderBy("name", "paramCount", "smali").limit(50).collect()
        overloads = {r.method_key: r.overloads for r in match.with_overloads(own("methods").where(F.col("name") == name), ["class_descriptor", "name"], "overloads").collect()}
        items = [r.asDict(recursive=True) | {"overloads": overloads[r.smali], **method_code(r, r.referredStrings or [])} for r in found]
        if args is None:
            items += [r.asDict(recursive=True) | pasted(snippets.field_snippet(r.classDescriptor, r["name"], r.typeDescriptor)) for r in self.field_items(session, own("fields").where(F.col("name") == name)).collect()]
        if not items:
            raise EngineError("NOT_FOUND", f"{row.descriptor} has no member {member!r}", "list its members")
        return envelope.ok(items, session_id=session, **{"class": head})

    def pool(self, session: str, want: grams.Wanted, fits: Callable[[DataFrame], DataFrame], text: str | None = None) -> tuple[DataFrame, bool]:
        """(strings of the session that fit, or the given one; whether many may). Few that have the grams of one of the alternatives are
        looked up. If many have them, all strings are compared once, and those that fit are written for all that is looked up by them."""
        strings = self.index.table("strings", session)
        if text is not None:
            return fits(strings.where(F.col("id") == string_id(F.lit(text)))), False
        if want is None:
            return fits(strings), True
        few = grams.few_keys(grams.candidates(self.index.table("string_grams", session), want), "id")
        return (materialize(fits(strings), "pool"), True) if few is None else (fits(strings.where(F.col("id").isin(*few))), False)

    def string_hits(self, session: str, text: str, how: str, scope: str, method_limit: int, min_len: int) -> tuple[DataFrame, DataFrame]:
        """(a row for each string that a method in scope refers to, all strings of the pool that fit)."""
        want = grams.wanted(text, how)
        pool, many = self.pool(session, want, lambda df: filters.text_filter(df, "value", text, how, min_len, "lc"), text if how == "exact" else None)
        refs = self.index.table("refs_by_string", session)
        if how in ("contains", "prefix"):
            # Spark tries this where references come from, before it deals them out. A pattern is tried on distinct strings alone.
            refs = filters.text_filter(refs, "value", text, how, min_len)
        if want is not None or how == "exact":
            refs = grams.probe(refs, pool.select("id"), "id")
        # The class of a method stands before the first ";->" of its key (a class name has no semicolon), so of methods the keys alone are
        # dealt out. They are compared with a table of what is found, the smaller side, and need no sort.
        classed = refs.select("method_key", "value", F.concat(F.substring_index("method_key", ";->", 1), F.lit(";")).alias("descriptor"))
        found = match.probe(classed, [(pool.select("value", "len"), "value"), (self.scoped(session, scope).select("descriptor"), "descriptor")])
        known = self.index.table("methods", session).select("method_key").distinct()
        refs = match.probe(found.select("value", "len", "method_key").hint("shuffle_hash"), [(known, "method_key")])
        # Counts and ranks both read them; Spark would join the methods for each.
        refs = materialize(refs, "hits") if many else refs
        top = match.reverse_top_k(refs, "value", "method_key", ["len"], method_limit)
        return top.groupBy("value", "len", "method_count").agg(F.sort_array(F.collect_list(F.struct("rn", "method_key")))["method_key"].alias("methods")), pool

    def search_by_string(self, session_id: str, text: str = "", match: str = "contains", scope: str = "all", limit: int = 50, method_limit: int = 8, min_len: int = 0) -> dict:
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        hits, pool = self.string_hits(session, text, match, scope, ranking.clamp_limit(method_limit, 8), min_len)
        found = rows(hits.orderBy("method_count", "len", "value"), limit)
        items = [{"string": r["value"], "length": r["len"], "methodCount": r["method_count"], "methods": r["methods"], "moreMethods": r["method_count"] - len(r["methods"])} for r in found]
        return envelope.ok(items, hits.count(), session, poolMatches=pool.count())

    def implementations(self, session: str, interface: str = "", super_class: str = "", method: str = "", scope: str = "all", transitive: bool = True, include_abstract: bool = True) -> DataFrame:
        """Classes below an interface or a class, or with a method; every condition that is given has to hold."""
        every, found = self.index.table("classes", session), self.scoped(session, scope)
        if not (interface or super_class or method):
            raise bad_argument("give an interface, a superClass or a method")
        up = every.select(F.col("descriptor").alias("child"), F.col("super_descriptor").alias("parent")).where("parent IS NOT NULL")
        faces = every.select(F.col("descriptor").alias("child"), F.explode("interfaces").alias("parent"))
        for name, edges, first in ((interface, up.unionByName(faces), faces), (super_class, up, up)):
            if name:
                roots = self.spark.createDataFrame([(d.to_desc(name),)], "parent string")
                near = first.join(roots, "parent", "left_semi").select(F.col("child").alias("node"))
                below = graph.closure(edges, roots) if transitive else near
                found = found.join(below.select(F.col("node").alias("descriptor")), "descriptor", "left_semi")
        if method:
            _, name, args, _ = d.parse_method_ref(method)
            own = self.index.table("methods", session).where(F.col("name") == name)
            own = own.where(F.col("params_descriptor") == f"({''.join(args)})") if args is not None else own
            found = found.join(own.select(F.col("class_descriptor").alias("descriptor")), "descriptor", "left_semi")
        return found if include_abstract else found.where(filters.flags_clear(F.col("access_flags"), 0x600))

    def sample_members(self, session: str, most: int = 6) -> DataFrame:
        """(descriptor, sampleMembers): the first methods of each class by name."""
        own = self.index.table("methods", session).select("class_descriptor", "name", "method_key")
        first = ranking.top_k(own, ["class_descriptor"], ["name", "method_key"], most)
        return first.groupBy(F.col("class_descriptor").alias("descriptor")).agg(F.sort_array(F.collect_list("method_key")).alias("sampleMembers"))

    def find_implementations(self, session_id: str, interface: str = "", super_class: str = "", method: str = "", scope: str = "all", limit: int = 50, transitive: bool = True, include_abstract: bool = True) -> dict:
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        found = self.implementations(session, interface, super_class, method, scope, transitive, include_abstract)
        shown = self.class_items(session, found).join(self.sample_members(session), "descriptor", "left")
        return envelope.ok(rows(shown.orderBy(F.col("source").desc(), "descriptor"), limit), found.count(), session)

    def invocations(self, session: str, by: str = "caller_key") -> DataFrame:
        """Calls, from the copy that is clustered by callers or by callees."""
        edges = self.index.table("edges_by_callee" if by == "callee_descriptor" else "xref_edges", session)
        return edges.where(F.col("kind").isin(*INVOKES)).select("caller_key", "callee_descriptor", "kind", "hits")

    def edges_met(self, session: str, seeds: DataFrame, direction: str, depth: int, scope: str = "all") -> DataFrame:
        """(depth, kind, hits, caller_key, callee_descriptor) of the calls met from the methods (method_key) in seeds."""
        source, target = ("callee_descriptor", "caller_key") if direction == "callers" else ("caller_key", "callee_descriptor")
        full = graph.walk_rows(self.invocations(session, source), seeds.select(F.col("method_key").alias(source)), depth, source, target, grams.probe)
        if scope != "all":
            kept = self.scoped(session, scope).select(F.col("descriptor").alias("_class"))
            full = full.join(kept, F.substring_index("caller_key", "->", 1) == F.col("_class"), "left_semi")
        return full.select(F.col("hop").alias("depth"), match.decode(F.col("kind"), KINDS).alias("kind"), "hits", "caller_key", "callee_descriptor")

    def method_seeds(self, session: str, method: str, clazz: str = "") -> DataFrame:
        """(method_key) of the methods that a reference, or a class, stands for."""
        known, edges = self.index.table("methods", session), self.invocations(session, "callee_descriptor")
        if not method:
            return known.where(F.col("class_descriptor") == self.one_class(session, clazz).descriptor).select("method_key")
        owner, name, args, ret = d.parse_method_ref(method)
        if clazz or (owner and not edges.where(F.col("callee_descriptor").startswith(owner + "->")).limit(1).count()):
            owner = self.one_class(session, clazz or owner).descriptor
        keys = known.select("method_key").unionByName(edges.select(F.col("callee_descriptor").alias("method_key"))).distinct()
        start = (owner or "") + "->" + name + ("(" if args is None else f"({''.join(args)})" + (ret or ""))
        return keys.where(F.col("method_key").startswith(start) if owner else F.col("method_key").contains(start))

    def xref(self, session_id: str, method: str = "", clazz: str = "", direction: str = "callers", depth: int = 1, limit: int = 50, scope: str = "all") -> dict:
        if direction not in ("callers", "callees"):
            raise bad_argument(f"unknown direction {direction!r}", "callers or callees")
        if not (method or clazz):
            raise bad_argument("give a method or a clazz")
        session, limit, depth = self.index.session(session_id), ranking.clamp_limit(limit), min(max(int(depth), 1), 3)
        seeds = self.method_seeds(session, method, clazz)
        if not seeds.limit(1).count():
            raise EngineError("NOT_FOUND", f"no method {method or clazz!r}", "search for it by string or by class")
        found = materialize(self.edges_met(session, seeds, direction, depth, scope), "xref-edges")
        first, second = ("caller", "to") if direction == "callers" else ("from", "callee")
        shown = found.orderBy("depth", F.col("hits").desc(), "caller_key", "callee_descriptor", "kind").limit(limit).collect()
        items = [{"depth": r.depth, "kind": r.kind, "hits": r.hits, first: r.caller_key, second: r.callee_descriptor} for r in shown]
        levels = {r.depth: r.n for r in match.count_by(found, ["depth"]).collect()}
        return envelope.ok(items, sum(levels.values()), session, levels=[levels.get(k, 0) for k in range(1, depth + 1)])

    def decompile(self, session_id: str, target: str = "", format: str = "auto", max_lines: int = 400) -> dict:
        """An outline from the index; other formats need a decompiler, which is not part of an engine."""
        if format not in ("auto", "outline"):
            raise EngineError("DECOMPILER_UNAVAILABLE", f"no decompiler for {format!r}", "use the outline")
        session, most = self.index.session(session_id), min(max(int(max_lines), 20), 4000)
        row = self.one_class(session, target.split("->")[0].split("#")[0])
        name = d.parse_method_ref(target)[1] if "->" in target or "#" in target else None
        desc = row.descriptor
        own = self.index.table("methods", session).where(F.col("class_descriptor") == desc)
        own = own.where(F.col("name") == name) if name else own
        fields = self.index.table("fields", session).where(F.col("class_descriptor") == desc)
        line = lambda df, part, key, order, text: df.select(F.lit(part).alias("part"), key.alias("key"), F.lit(order).alias("order"), text.alias("line"))
        flags = lambda table: F.array_join(d.flag_names(F.col("access_flags"), table), " ")
        keys = own.select("method_key")
        out = line(fields, 1, F.col("name"), 0, F.concat(F.lit("  .field "), flags(d.FIELD_FLAGS), F.lit(" "), "name", F.lit(":"), "type_descriptor")) if not name else None
        parts = [line(own, 2, F.col("method_key"), 0, F.concat(F.lit("  .method "), F.array_join(d.method_flag_names(F.col("access_flags"), F.col("name")), " "), F.lit(" "), "name", "params_descriptor", "return_descriptor")), line(self.index.table("string_refs", session).join(keys, "method_key", "left_semi"), 2, F.col("method_key"), 1, F.concat(F.lit('    const-string "'), "value", F.lit('"'))), line(self.index.table("xref_edges", session).join(keys.select(F.col("method_key").alias("caller_key")), "caller_key", "left_semi"), 2, F.col("caller_key"), 2, F.concat(F.lit("    "), match.decode(F.col("kind"), KINDS), F.lit(" "), "callee_descriptor"))]
        body = reduce(DataFrame.unionByName, [*([out] if out is not None else []), *parts]).orderBy("part", "key", "order", "line")
        lines = [f".class {desc}", f".super {row.super_descriptor}", *[f".implements {i}" for i in row.interfaces]] + [r.line for r in body.limit(most).collect()]
        return envelope.ok([{"target": target, "format": "outline", "code": "\n".join(lines[:most]), "lines": min(len(lines), most)}], session_id=session, reason="no decompiler: outline of the index")

    def matching_methods(self, session: str, params=None, return_type: str = "", modifiers=None, referred_strings=None, accessed_fields=None, invoked_methods=None, name_pattern: str = "", scope: str = "all", package_prefix: str = "", require_constructor: bool = False) -> DataFrame:
        """Methods for which every given condition holds."""
        classes = self.scoped(session, scope).select(F.col("descriptor").alias("class_descriptor"), "package")
        found = self.index.table("methods", session).join(classes, "class_descriptor")
        if params is not None:
            wanted = as_list(params)
            found = found.where(F.col("param_count") == len(wanted))
            types = d.split_params(F.col("params_descriptor"))
            for k, w in enumerate(wanted):
                if w not in ("*", "?", "any"):
                    found = found.where(types[k] == d.to_desc(w))
        if return_type and return_type not in ("any", "*", "void?"):
            found = found.where(F.col("return_descriptor") == d.to_desc(return_type))
        for word in as_list(modifiers):
            if word == "constructor":
                found = found.where(F.col("name") == "<init>")
            elif word in d.MODIFIERS:
                found = found.where(filters.flags_set(F.col("access_flags"), d.MODIFIERS[word]))
            else:
                raise bad_argument(f"unknown modifier {word!r}", ", ".join(d.MODIFIERS))
        if require_constructor:
            found = found.where("is_constructor")
        if package_prefix:
            found = found.where(filters.package_prefix(F.col("package"), package_prefix))
        if name_pattern:
            found = found.where(F.col("name").rlike(filters.checked_regex(name_pattern)))
        fields, calls = as_list(accessed_fields), as_list(invoked_methods)
        strings = as_texts(referred_strings)
        if max(len(strings), len(fields), len(calls)) > 6:
            raise bad_argument("six strings, fields or calls at most", "use the most telling ones")
        refs = self.index.table("string_refs", session)
        edges = self.index.table("xref_edges", session).withColumnRenamed("caller_key", "method_key")
        evidences = [refs.where(F.col("value") == s) for s in strings]
        evidences += [edges.where(F.col("kind").isin(*FIELD_KINDS) & callee(d.parse_field_ref(f))) for f in fields]
        evidences += [edges.where(F.col("kind").isin(*INVOKES) & callee(d.parse_method_ref(m)[:3])) for m in calls]
        return match.semi_all(found, evidences, ["method_key"]).drop("package")

    def match_signature(self, session_id: str, params=None, return_type: str = "", modifiers=None, referred_strings=None, accessed_fields=None, invoked_methods=None, name_pattern: str = "", scope: str = "all", package_prefix: str = "", limit: int = 50, require_constructor: bool = False) -> dict:
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        found = self.matching_methods(session, params, return_type, modifiers, referred_strings, accessed_fields, invoked_methods, name_pattern, scope, package_prefix, require_constructor)
        shown = self.method_items(session, found, 6).drop("method_key").orderBy(F.col("source").desc(), "classDescriptor", "name", "paramsDescriptor").limit(limit).collect()
        strings = as_texts(referred_strings)
        items = [r.asDict(recursive=True) | {**method_code(r, strings)} for r in shown]
        return envelope.ok(items, found.count(), session)

    # -------------------------------------------------------------- comparison

    def feature_classes(self, session: str, scope: str) -> DataFrame:
        return self.scoped(session, scope).select("descriptor", F.coalesce("super_descriptor", F.lit("")).alias("super"), "interfaces", "kind", "package", "source")

    def features(self, session: str, scope: str, own: DataFrame | None = None, index=None) -> DataFrame:
        """Classes with the sets of their members. own: those of feature_classes() that are wanted, if not all; index: an index with few
        members of other classes, where there is one."""
        whole, index = index is None or index is self.index, index or self.index
        classes = self.feature_classes(session, scope) if own is None else own
        wanted = lambda df: df.join(own.select("descriptor"), "descriptor", "left_semi") if whole and own is not None else df
        # All rows of a class are in one task before its sets are made: nothing is gained by sets of what each task has read of it.
        of = lambda df: wanted(df).repartition("descriptor").groupBy("descriptor")
        table = lambda name, *columns: index.table(name, session).select(F.col("class_descriptor").alias("descriptor"), *columns)
        each = lambda column, *parts: F.sort_array(F.array_distinct(F.array_compact(F.transform(column, lambda x: F.concat(*[p if isinstance(p, Column) else x[p] for p in parts])))))
        member = lambda *columns: F.collect_list(F.struct(*columns)).alias("_all")
        method = ("name", "params_descriptor", "return_descriptor")
        methods = of(table("methods", *method)).agg(member(*method)).select("descriptor", each("_all", *method).alias("sigs"), each("_all", *method[1:]).alias("shapes"), each("_all", "name").alias("method_names"))
        field = ("name", "type_descriptor")
        fields = of(table("fields", *field)).agg(member(*field)).select("descriptor", each("_all", "name", F.lit(":"), "type_descriptor").alias("fields"), each("_all", "name").alias("field_names"))
        strings = index.table("string_refs", session).select(F.substring_index("method_key", "->", 1).alias("descriptor"), "value")
        strings = of(strings).agg(F.slice(F.sort_array(F.collect_set("value")), 1, 200).alias("strings"))
        out = classes.join(methods, "descriptor", "left").join(fields, "descriptor", "left").join(strings, "descriptor", "left")
        empty = F.array().cast("array<string>")
        out = out.select("descriptor", "super", "interfaces", "kind", "package", "source", *[F.coalesce(c, empty).alias(c) for c in ("sigs", "shapes", "method_names", "fields", "field_names", "strings")])
        digest = F.concat(F.array_join("sigs", "|"), F.lit("#"), F.array_join("fields", "|"), F.lit("#"), "super")
        return out.withColumn("sig_hash", F.substring(F.sha1(digest.cast("binary")), 1, 16))

    def compare(self, a: str, b: str, scope: str = "app", min_score: float = 0.45, shape: str = "named") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(renamed pairs, features of the classes of a and of b that the other doesn't have, stored, descriptors in both).

        Versions have most classes in common, so members are read of the others alone."""
        classes = [self.feature_classes(s, scope) for s in (a, b)]
        same = materialize(diff.unchanged(*classes, ["descriptor"]), "unchanged")
        own = [materialize(df.join(same, "descriptor", "left_anti"), "own-classes") for df in classes]
        index = self.index.about(dict(zip((a, b), own, strict=True)))
        own_a, own_b = fa, fb = [materialize(self.features(s, scope, df, index), "features") for s, df in zip((a, b), own, strict=True)]
        exact = materialize(diff.exact_pairs(own_a, own_b, "descriptor", "sig_hash").select("key_a", "key_b", F.lit(1.0).alias("score"), F.lit("exact-structure").alias("how")), "exact")
        gone = lambda df, key: df.join(exact.select(F.col(key).alias("descriptor")), "descriptor", "left_anti").withColumn("n_interfaces", F.size("interfaces"))
        sets = {"sigs" if shape == "named" else "shapes": "shape", "strings": "strings", "field_names": "fields", "method_names": "names"}
        weights = {column: diff.WEIGHTS[part] for column, part in sets.items()}
        fuzzy = pairing.pair_by_sets(gone(own_a, "key_a"), gone(own_b, "key_b"), "descriptor", "super", weights, ["n_interfaces", "kind"], float(min_score), diff.WEIGHTS["interfaces"], diff.OTHER_INTERFACES)
        return materialize(exact.unionByName(fuzzy.withColumn("how", F.lit("fuzzy"))), "renamed"), fa, fb, same

    def diff_sessions(self, session_a: str = "", session_b: str = "", limit: int = 50, min_score: float = 0.45, scope: str = "app", shape: str = "named") -> dict:
        if shape not in ("named", "structural"):
            raise bad_argument(f"unknown shape {shape!r}", "named or structural")
        a, b, limit = self.index.session(session_a), self.index.session(session_b), ranking.clamp_limit(limit)
        renamed, fa, fb, same = self.compare(a, b, scope, min_score, shape)
        # Rows of either side alone: what is not renamed of those that aren't in both.
        alone = lambda df, key: df.join(renamed.select(F.col(key).alias("descriptor")), "descriptor", "left_anti")
        removed, added = materialize(alone(fa, "key_a"), "removed"), materialize(alone(fb, "key_b"), "added")
        keys = lambda df: df.select("descriptor", "sigs", "package")
        full = renamed.join(keys(fa).toDF("key_a", "sigs_a", "package_a"), "key_a").join(keys(fb).toDF("key_b", "sigs_b", "package_b"), "key_b")
        full = full.withColumns({"only_a": F.array_except("sigs_a", "sigs_b"), "only_b": F.array_except("sigs_b", "sigs_a")})
        full = full.withColumns({"count_a": F.size("sigs_a"), "count_b": F.size("sigs_b"), "kept": F.size("sigs_a") - F.size("only_a")})
        full = full.withColumns({c: F.slice(c, 1, 10) for c in ("only_a", "only_b")}).drop("sigs_a", "sigs_b")
        items = []
        for r in full.orderBy(F.col("score").desc(), "key_a").limit(limit).collect():
            names = {"from": snippets.java_name(r.key_a), "to": snippets.java_name(r.key_b), "fromDescriptor": r.key_a, "toDescriptor": r.key_b}
            packages = {"packageFrom": r.package_a.replace("/", "."), "packageTo": r.package_b.replace("/", ".")}
            members = {"methodsOnlyInA": r.only_a, "methodsOnlyInB": r.only_b, "methodCount": {"a": r.count_a, "b": r.count_b}, "kept": r.kept}
            items.append({"change": "renamed", "score": r.score, "how": r.how, **names, **packages, **members})
        for change, df in (("removed", removed), ("added", added)):
            items += [{"change": change, "class": snippets.java_name(r.descriptor), "descriptor": r.descriptor, "superClass": r["super"], "source": r.source, "methodCount": len(r.sigs), "sampleMethods": r.sigs[:6], "sampleStrings": r.strings[:4]} for r in df.orderBy("descriptor").limit(limit).collect()]
        tables = {"renamed": renamed, "removed": removed, "added": added, "unchanged": same}
        counts = {r["name"]: r.n for r in match.table_counts(tables).collect()}
        return envelope.ok(items, counts["renamed"] + counts["removed"] + counts["added"], a, summary=counts, sessionB=b)

    # -------------------------------------------------------------- manifest and resources

    def components(self, session: str, name: str, component_type: str, exported: bool | None) -> DataFrame:
        if component_type and component_type not in (*COMPONENT_TYPES, "component"):
            raise bad_argument(f"unknown componentType {component_type!r}", ", ".join(COMPONENT_TYPES))
        found = self.index.table("components", session)
        found = found.where(F.col("type") == component_type) if component_type not in ("", "component") else found
        found = found.where(F.lower("name").contains(name.lower())) if name else found
        return filters.three_valued(found, "exported", exported).drop("session_id")

    def list_manifest(self, session_id: str, component_type: str = "", query: str = "", exported: bool | None = None, limit: int = 50) -> dict:
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        found = self.components(session, query, component_type, exported)
        row = self.index.table("manifest", session).first()
        if row is None:
            raise EngineError("NOT_FOUND", f"{session} has no manifest", "load a package")
        shown = rows(ranking.top_k(found, ["type"], ["name"], limit).drop("rn").orderBy("type", "name"), 4 * limit)
        item = {k: v for k, v in row.asDict(recursive=True).items() if k != "session_id"}
        return envelope.ok([item | {"components": {t: [c for c in shown if c["type"] == t] for t in COMPONENT_TYPES}}], 1, session, componentTotal=found.count())

    def find_component(self, session_id: str, name: str = "", component_type: str = "", exported: bool | None = None, limit: int = 50) -> dict:
        if not name and not component_type and exported is None:
            raise bad_argument("give a name, a componentType or exported")
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        found = self.components(session, name, component_type, exported)
        return envelope.ok(rows(found.orderBy("type", "name"), limit), found.count(), session)

    def resources(self, session: str) -> DataFrame:
        if not self.index.exists(f"resource_entries/session_id={session}"):
            raise EngineError("NOT_FOUND", f"{session} has no readable resource table", "search its strings instead")
        return self.index.table("resource_entries", session)

    def found_resources(self, session: str, query: str = "", match: str = "contains", resource_type: str = "") -> DataFrame:
        found = self.resources(session)
        if match == "contains":
            found = found.where(F.lower("name").contains(query.lower()))
        elif match == "prefix":
            found = found.where(F.col("name").startswith(query))
        elif match == "regex":
            found = found.where(F.col("name").rlike(filters.checked_regex(query)))
        else:
            raise bad_argument(f"unknown match {match!r}", "contains, prefix or regex")
        return (found.where(F.col("type") == resource_type) if resource_type else found).drop("session_id")

    def search_resources(self, session_id: str, query: str = "", match: str = "contains", resource_type: str = "", limit: int = 50) -> dict:
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        found = self.found_resources(session, query, match, resource_type)
        return envelope.ok(rows(found.orderBy("type", "name", "id"), limit), found.count(), session)

    def resource_uses(self, session: str, resource: str, resource_type: str = "") -> tuple[DataFrame, list[str]]:
        """((method_key, value, via) of each use, the spellings looked for)."""
        name = resource.rpartition(".")[2]
        kind = resource_type or (resource.split(".")[-2] if resource.count(".") >= 1 and resource.split(".")[-2] != "R" else "")
        spellings = [name, *([f"{kind}.{name}", f"R.{kind}.{name}"] if kind else [f"R.{name}"])]
        want = grams.either(*[grams.of_lowered(s) for s in spellings])
        hits, _ = self.pool(session, want, lambda df: df.where(filters.any_of([F.col("value").contains(s) for s in spellings])))
        refs = self.index.table("refs_by_string", session)
        refs = refs if want is None else grams.probe(refs, hits, "id")
        found = refs.drop("id").join(hits.select("value"), "value").select("method_key", "value", F.lit("string").alias("via"))
        if not found.limit(1).count():
            tail = f"/R${kind};" if kind else "/R$"
            by_class = F.col("callee_owner").endswith(tail) if kind else F.col("callee_owner").contains(tail)
            consts = self.index.table("xref_edges", session).where((F.col("kind") == 9) & (by_class | F.col("callee_owner").endswith("/BuildConfig;")))
            found = consts.select(F.col("caller_key").alias("method_key"), F.col("callee_owner").alias("value"), F.lit("const-class").alias("via"))
        return found, spellings

    def resource_refs(self, session_id: str, resource: str = "", resource_type: str = "", limit: int = 50) -> dict:
        if not resource:
            raise bad_argument("resource is missing", "a name such as app_name, or R.string.app_name")
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit)
        found, spellings = self.resource_uses(session, resource, resource_type)
        return envelope.ok(rows(found.orderBy("value", "method_key"), limit), found.count(), session, candidates=spellings)

    def resource_security(self, session_id: str, limit: int = 50) -> dict:
        session = self.index.session(session_id)
        of = lambda name: self.index.table(name, session)
        manifest = of("manifest").withColumn("dangerous", F.filter("uses_permissions", lambda p: filters.any_keyword(p, DANGEROUS))).first()
        limit = ranking.clamp_limit(limit)
        sets = lambda df, *cols: [r.asDict() for r in df.select(*cols).distinct().orderBy(*cols).limit(limit).collect()]
        exported = sets(filters.three_valued(of("components"), "exported", True), "type", "name", "permission")
        libs = sets(of("native_libs"), "abi", "name")
        there = self.index.exists(f"resource_entries/session_id={session}")
        item = {"available": there, "manifestPackage": manifest and manifest.package, "minSdk": manifest and manifest.min_sdk, "targetSdk": manifest and manifest.target_sdk, "application": manifest and manifest.application, "usesPermissions": (manifest.uses_permissions if manifest else [])[:limit], "dangerousPermissions": (manifest.dangerous if manifest else [])[:limit], "exportedComponents": exported, "nativeLibs": libs, "resourceTypes": [r["type"] for r in sets(of("resource_entries"), "type")] if there else []}
        return envelope.ok([item], session_id=session)

    def doctor(self) -> dict:
        """A row for each session: whether its tables are there, their bytes, whether they can be read, schema version, owners and issues;
        and tables without a session. Changes nothing."""
        known = self.index.sessions()
        owners = match.ref_count(self.index.owners(), "session_id", "owner")
        stored = self.index.table("classes").select("session_id").distinct()
        lost = match.orphans(known.select("session_id"), stored, ["session_id"], "missing-tables", "unregistered")
        items, issues = [], [f"{r.session_id}: {r.kind}" for r in lost.orderBy("kind", "session_id").collect()]
        missing = {i.partition(":")[0] for i in issues if i.endswith("missing-tables")}
        for r in known.join(owners, "session_id", "left").orderBy("session_id").collect():
            problems = ["missing-tables"] if r.session_id in missing else []
            if r.schema_version != schema.SCHEMA_VERSION:
                problems.append("stale-schema")
                issues.append(f"{r.session_id}: stale-schema")
            broken = self.index.unreadable(r.session_id)
            problems += [f"unreadable {n}" for n in broken]
            issues += [f"{r.session_id}: unreadable {n}" for n in broken]
            items.append({"sessionId": r.session_id, "kind": r.kind, "package": r.pkg, "exists": r.session_id not in missing, "sizeBytes": self.index.size(r.session_id), "schemaVersion": r.schema_version, "createdAt": str(r.created_at), "owners": r.owners or 0, "quickCheck": "ok" if not broken else "failed", "issues": problems})
        items += [{"sessionId": i.partition(":")[0], "kind": "unregistered", "exists": True, "issues": ["unregistered"]} for i in issues if i.endswith("unregistered")]
        return envelope.ok(items, issues=issues, sessions=known.count(), cacheBytes=self.index.size())

    def probe(self, session_id: str, question: str = "", limit: int = 12, target: str = "", max_depth: int = 2) -> dict:
        """Keywords of a question to strings and classes, and a closer look at a target; one part's failure leaves the others."""
        session, limit = self.index.session(session_id), ranking.clamp_limit(limit, 12)
        words, strings, classes, errors = keywords(question), [], [], []
        for w in words:
            for out, most, fn in ((strings, 3, lambda w=w: self.search_by_string(session, w, limit=3)), (classes, 4, lambda w=w: self.search_classes(session, ".*" + re.escape(w) + ".*", "regex", limit=4))):
                try:
                    out += fn()["items"][:most]
                except EngineError as e:
                    errors.append(f"{w}: {e.message}")
        item = {"keywords": words, "strings": strings[:limit], "classes": [c["descriptor"] for c in classes][:limit], "candidates": sorted({m for s in strings for m in s["methods"]})[:limit]}
        if item["candidates"]:
            owner, name, args, ret = d.parse_method_ref(item["candidates"][0])
            item["snippet"] = snippets.method_snippet(owner, name, args or [], ret or "V", [strings[0]["string"]])
        if classes:
            item["implementations"] = [c["descriptor"] for c in self.find_implementations(session, interface=classes[0]["binaryName"], limit=6)["items"]]
        if target:
            for label, fn in (("xref", lambda: self.xref(session, target, depth=max_depth, limit=limit)["items"]), ("signature", lambda: self.get_signature(session, member=target)["items"]), ("outline", lambda: self.decompile(session, target)["items"][0]["code"])):
                try:
                    item[label] = fn()
                except EngineError as e:
                    errors.append(f"{label}: {e.message}")
        return envelope.ok([item | {"xrefErrors": errors}], session_id=session)
