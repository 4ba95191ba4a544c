"""The engine on packages of known content."""

import json

import pytest

from lodeframe.plans import envelope, snippets
from lodeframe.plans.tools import Engine
from lodeframe.sources import containers
from lodeframe.sources.classfile import parse_class
from lodeframe.sources.dex import Dex, DexError, args_json
from lodeframe.sources.resources import parse_arsc, parse_axml, read_manifest
from tests import builders as b


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    top = tmp_path_factory.mktemp("artifacts")

    def put(name: str, blob: bytes) -> str:
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(blob)
        return str(path)

    one = [b.dex(c) for c in b.demo_v1()]
    table = b.arsc("com.example.demo", {"string": ["app_name", "DemoTag"], "layout": ["main"]})
    split = lambda name, s: b.archive({"classes.dex": b.dex([b.cls(f"{b.D}split/{name};", methods=[("id", "()", b.STR, 1, [("str", s)])])])})
    out = {
        "v1": put("v1.apk", b.package(one, b.manifest("com.example.demo", 1, "1.0.0", "com.example.demo.DemoApp"))),
        "v2": put("v2.apk", b.package([b.dex(c) for c in b.demo_v2()], b.manifest("com.example.demo2", 2, "2.0.0"), resources=table)),
        "packed": put("packed.apk", b.package([b.dex([b.cls("Lcom/stub/StubApp;"), b.cls("Lcom/qihoo/util/NSU;"), b.cls("Lcom/example/shelled/RealApp;")])], b.manifest("com.example.packed", 1, "1", "com.stub.StubApp"), {"lib/arm64-v8a/libjiagu_64.so": b"x", "assets/ijiami.ajm": b"x"})),
        "dex": put("bare.dex", one[0]),
        "jar": put("embedded.jar", b.archive({"classes.dex": one[1]})),
        "vdex": put("payload.vdex", b"vdex021\0" + b"\0" * 40 + one[0] + b"junk" + one[0]),
        "cdx": put("cdx.vdex", b"vdex021\0cdex001" + b"\1" * 200),
        "junk": put("junk.bin", b"nothing"),
        "aar": put("lib-http.aar", b.archive({
            "classes.jar": b.archive({"lib/http/Client.class": b.java_class("lib/http/Client", methods=[("get", "(Ljava/lang/String;)V", 1, [("str", "http-get"), ("const", "lib/http/Dep"), ("sput", "lib/http/Dep", "n", "I"), ("call", "static", "lib/http/Dep", "go", "()V")])]), "lib/http/Dep.class": b.java_class("lib/http/Dep", faces=["java/lang/Runnable"])}),
            "libs/deps.jar": b.archive({"lib/http/Dep.class": b.java_class("lib/http/Dep"), "lib/http/Extra.class": b.java_class("lib/http/Extra", parent="lib/http/Client"), "module-info.class": b"x"}),
            "AndroidManifest.xml": b'<manifest package="lib.http" xmlns:a="http://schemas.android.com/apk/res/android"><application><activity a:name=".A" a:exported="false"/></application></manifest>',
            "R.txt": b"int string a 0x1\nint string b 0x2\nint id c 0x3\n", "consumer-rules.pro": b"# x\n-keep class lib.http.Client { *; }\n-keepclassmembers class lib.http.Gone {\n  void x();\n}\n-dontwarn a.b\n", "jni/arm64-v8a/libhttp.so": b"x",
        })),
    }
    put("split/base.apk", b.package(one, b.manifest("com.example.demo", 1, "1.0.0")))
    put("split/split_config.arm64_v8a.apk", split("Abi64", "split-arm64"))
    put("split/split_config.zh.apk", split("LocaleZh", "split-zh"))
    return out | {"split": str(top / "split"), "top": str(top)}


@pytest.fixture(scope="module")
def engine(spark, files, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("index")), [files["top"]])


@pytest.fixture(scope="module")
def v1(engine, files):
    out = engine.call("loadApk", path=files["v1"])
    assert out["ok"], out
    return out["sessionId"]


@pytest.fixture(scope="module")
def v2(engine, files):
    return engine.call("loadApk", path=files["v2"])["sessionId"]


def names(out, key="binaryName"):
    assert out["ok"], out
    return [i[key] for i in out["items"]]


def test_parsers_alone(files):
    image = Dex(b.dex(b.demo_v1()[0]))
    classes = {c["descriptor"]: c for c in image.classes()}
    assert len(classes) == 6 and not image.notes and image.counts()["classes"] == 6
    user = classes[f"{b.D}User;"]
    assert user["source_file"] == "A.java" and [a["descriptor"] for a in user["annotations"]] == ["Ldemo/Keep;"] and json.loads(user["annotations"][0]["args"]) == {"value": "com.example.demo.User"}
    describe = next(m for m in user["methods"] if m["name"] == "describe")
    assert describe["strings"] == ["user-describe:"] and [r[0] for r in describe["refs"]] == [4, 1]
    odd = Dex(b.dex([b.cls("La/B;", methods=[("m", "()", "V", 1, [("str", "nul\0 é \U0001f600 \ud800")]), ("cut", "()", "V", 1, [("raw", 0x18)])])]))
    found = {m["name"]: m for m in next(odd.classes())["methods"]}
    assert found["m"]["strings"] == ["nul\0 é \U0001f600 �"] and found["cut"]["partial"] and odd.notes
    with pytest.raises(DexError):
        Dex(b"dex\n035\0" + b"\0" * 200)
    assert containers.carve(open(files["vdex"], "rb").read()) == [b.dex(b.demo_v1()[0])]
    assert containers.dex_members(["classes10.dex", "classes.dex", "x", "classes2.dex"]) == ["classes.dex", "classes2.dex", "classes10.dex"]
    client = parse_class(b.java_class("a/B", methods=[("x", "()V", 1, [("get", "a/B", "f", "I"), ("str", "s")])]))
    assert client["descriptor"] == "La/B;" and client["methods"][0]["strings"] == ["s"] and client["methods"][0]["refs"][0][:3] == [11, "La/B;", "f"]
    m = read_manifest(b.axml(b.manifest("p", 3, "x")))
    assert (m["package"], m["version_code"], m["min_sdk"], m["meta_data"]) == ("p", 3, 24, {"demo.channel": "mcp"}) and [c["exported"] for c in m["components"]] == [True, None, None]
    assert parse_axml(b.axml(("a", {}, [("b", {"k": 7}, [])])))["children"][0]["attrs"] == {"k": 7}
    entries, notes = parse_arsc(b.arsc("p", {"string": ["a", "b"], "id": ["c"]}))
    assert [(e["type"], e["name"], e["id"]) for e in entries] == [("string", "a", "0x7f010000"), ("string", "b", "0x7f010001"), ("id", "c", "0x7f020000")] and not notes
    assert parse_arsc(b"\x02\x00\x0c\x00broken")[1]
    assert "_blob" in args_json({"v": "\x01" * 60}) and len(args_json({f"k{k}": "x" * 190 for k in range(60)})) <= 4096
    assert containers.sniff(b"PK\x03\x04", "x.zip", {"AndroidManifest.xml", "classes.dex"}) == "apk" and containers.sniff(b"dey\n036") == "odex"


def test_loading(engine, files, v1):
    again = engine.call("loadApk", path=files["v1"])
    assert again["sessionId"] == v1 and again["items"][0]["reused"] and again["items"][0]["counts"]["classes"] == 9
    assert engine.call("loadApk", path="/etc/passwd")["code"] == "INVALID_PATH" and engine.call("loadApk", path=files["top"] + "/none")["code"] == "INVALID_PATH"
    assert engine.call("loadApk", path=files["v1"], maxApkBytes=10)["code"] == "APK_TOO_LARGE"
    assert engine.call("loadDex", path=files["cdx"])["code"] == "UNSUPPORTED_FORMAT" and engine.call("loadDex", path=files["junk"])["code"] == "UNSUPPORTED_FORMAT"
    assert engine.call("loadApk", path=files["v1"], backend="other")["code"] == "BACKEND_UNAVAILABLE"
    split = engine.call("loadApk", path=files["split"])
    assert split["items"][0]["counts"]["classes"] == 11
    assert names(engine.call("searchByString", sessionId=split["sessionId"], text="split-arm64", match="exact"), "string") == ["split-arm64"]
    vdex = engine.call("loadDex", path=files["vdex"])
    assert vdex["items"][0]["counts"]["classes"] == 6
    grown = engine.call("loadDex", path=files["jar"], sessionId=vdex["sessionId"])
    assert grown["items"][0]["counts"]["classes"] == 8
    assert engine.call("loadDex", path=files["jar"], sessionId=vdex["sessionId"])["items"][0]["counts"] == grown["items"][0]["counts"]


def test_aar(engine, files):
    alone = engine.call("loadAar", path=files["aar"])
    assert alone["items"][0]["counts"]["classes"] == 3 and alone["items"][0]["rCount"] == 3 and alone["items"][0]["hardcodableKeep"] == ["lib.http.Client"]
    host = engine.call("loadApk", path=files["split"], splits=False)["sessionId"]
    merged = engine.call("loadAar", path=files["aar"], mergeInto=host)
    assert merged["items"][0]["counts"]["classes"] == 12
    assert engine.call("listManifest", sessionId=host)["items"][0]["package"] == "com.example.demo"
    assert names(engine.call("searchClasses", sessionId=host, query="lib.http", scope="library")) == ["lib.http.Dep", "lib.http.Extra", "lib.http.Client"]
    assert names(engine.call("resourceSecurity", sessionId=host), "nativeLibs") == [[{"abi": "arm64-v8a", "name": "libhttp.so"}]]


def test_packer(engine, files, v1):
    out = engine.call("loadApk", path=files["packed"])
    assert out["code"] == "PACKED_TARGET"
    item = engine.call("checkPacker", sessionId=out["sessionId"])["items"][0]
    assert item["packed"] and item["confidence"] == "high" and {e["type"] for e in item["evidence"]} == {"native", "entryClass", "applicationClass", "payloadAsset"}
    clean = engine.call("checkPacker", sessionId=v1)["items"][0]
    assert not clean["packed"] and clean["confidence"] == "none" and clean["stringEntropy"] > 2


def test_classes(engine, v1):
    of = lambda **a: engine.call("searchClasses", sessionId=v1, **a)
    assert of(query="com.example.demo")["total"] == 9
    assert names(of(query="com.example.demo.User", kind="exact")) == ["com.example.demo.User"]
    assert names(of(query=".*Adapter.*", kind="regex")) == ["com.example.demo.UserAdapter"]
    assert of(query="([bad", kind="regex")["code"] == "BAD_ARGUMENT" and of(query="x", scope="odd")["code"] == "BAD_ARGUMENT" and of(quary="x")["code"] == "BAD_ARGUMENT"
    for spelling in ("demo.Keep", "@Keep", "Ldemo/Keep;"):
        assert names(of(annotatedWith=spelling)) == ["com.example.demo.User"]
    assert of(annotatedWith="Ke_p")["code"] == "BAD_ARGUMENT"
    item = of(query="com.example.demo.User", kind="exact")["items"][0]
    assert (item["methods"], item["fields"], item["kind"], item["package"], item["superClass"]) == (5, 3, "class", "com.example.demo", "java.lang.Object")
    assert len(of(query="com", limit=2)["items"]) == 2 and of(query="com", limit=2)["truncated"]


def test_members_and_signatures(engine, v1):
    of = lambda **a: engine.call("listMembers", sessionId=v1, cls="com.example.demo.User", **a)
    assert of()["total"] == 8 and of(include="fields")["total"] == 3 and names(of(namePattern="^get"), "name") == ["getName"]
    shown = {i["name"]: i for i in of(withStrings=1)["items"]}
    assert shown["describe"]["referredStrings"] == ["user-describe:"] and len(shown["describe"]["invokedMethods"]) == 2 and shown["create"]["static"] and shown["<init>"]["constructor"]
    sig = engine.call("getSignature", sessionId=v1, cls="User", member="describe")
    item = sig["items"][0]
    assert item["java"] == "public java.lang.String describe(java.lang.String)" and item["reflector"].startswith("com.example.demo.User->describe(") and item["shorty"] == "LL" and item["overloads"] == 1
    assert sig["class"]["annotations"][0]["visibility"] == "runtime" and not snippets.check_balance(item["snippet"])
    assert names(engine.call("getSignature", sessionId=v1, cls="User", member="mToken:Ljava/lang/String;"), "type") == ["java.lang.String"]
    assert engine.call("getSignature", sessionId=v1, cls="User", member="nothing")["code"] == "NOT_FOUND" and engine.call("getSignature", sessionId=v1, cls="Nothing")["code"] == "NOT_FOUND"


def test_strings(engine, v1):
    of = lambda **a: engine.call("searchByString", sessionId=v1, **a)
    hit = of(text="Hello, ", match="exact")
    assert hit["total"] == 1 and hit["items"][0]["methods"] == [f"{b.D}JavaGreeter;->greet({b.STR}){b.STR}"] and hit["items"][0]["moreMethods"] == 0
    assert names(of(text="LAMBDA"), "string") == ["lambda", "lambda-name"] and of(text="a")["code"] == "BAD_ARGUMENT" and of(text="(bad", match="regex")["code"] == "BAD_ARGUMENT"
    assert names(of(text="^adapter", match="regex", minLen=8), "string") == ["adapter-bind"]


def test_strings_that_no_code_refers_to(engine, tmp_path_factory):
    """Constants of static fields and of a class file's pool are found in the pool, and belong to no method; those of a losing class go."""
    top = tmp_path_factory.mktemp("constants")
    engine.index.allowed = [*engine.index.allowed, engine.index._qualified(str(top))]
    field = [("KEY", b.STR, 0x19)]
    say = [("say", "()", b.STR, 9, [("str", "said")])]
    image = b.dex([b.cls("Lk/A;", fields=field, methods=say, constants=["only-a-constant", "said"]), b.cls("Lk/B;", fields=field, constants=["other \u00e9 constant"])])
    twice = b.dex([b.cls("Lk/B;", fields=field, constants=["of a class that loses"])])
    (top / "k.apk").write_bytes(b.package([image, twice], b.manifest("k", 1, "1")))
    (top / "k.jar").write_bytes(b.archive({"k/C.class": b.java_class("k/C", methods=[("say", "()V", 9, [("str", "said")])], constants=["pool-constant", "said"])}))
    for tool, path, found, lost in (("loadApk", "k.apk", ["only-a-constant", "other \u00e9 constant"], "of a class that loses"), ("loadDex", "k.jar", ["pool-constant"], "none")):
        loaded = engine.call(tool, path=str(top / path))
        of = lambda text, s=loaded["sessionId"], **a: {k: v for k, v in engine.call("searchByString", sessionId=s, text=text, **a).items() if k in ("total", "poolMatches")}
        assert loaded["items"][0]["counts"]["strings"] == len(found) + 1
        for text in found:
            assert of(text, match="exact") == {"total": 0, "poolMatches": 1}
        assert of("constant") == {"total": 0, "poolMatches": len(found)} and of("said", match="exact") == {"total": 1, "poolMatches": 1}
        assert of(lost, match="exact") == {"total": 0, "poolMatches": 0}
    cut = Dex(image)
    assert cut.constants(0) == [] and not cut.notes and cut.constants(len(image)) == [] and cut.notes


def test_hierarchy(engine, v1):
    of = lambda **a: engine.call("findImplementations", sessionId=v1, **a)
    assert names(of(interface="com.example.demo.Greeter")) == ["com.example.demo.JavaGreeter", "com.example.demo.MainActivity$$ExternalSyntheticLambda0", "com.example.demo.UserAdapter"]
    assert names(of(superClass="android.app.Activity")) == ["com.example.demo.MainActivity"]
    assert names(of(method="greet", includeAbstract=False)) == names(of(interface="com.example.demo.Greeter")) and of(method="greet")["total"] == 4
    assert of()["code"] == "BAD_ARGUMENT"


def test_xref(engine, v1):
    out = engine.call("xref", sessionId=v1, method="com.example.demo.User->getName", depth=2)
    assert out["ok"] and out["total"] == 3 and out["levels"] == [3, 0] and {i["caller"].split("->")[1].split("(")[0] for i in out["items"]} == {"describe", "greet", "onCreate"}
    down = engine.call("xref", sessionId=v1, method="MainActivity->onClick", direction="callees", depth=1)
    assert {i["callee"].split("->")[1].split("(")[0] for i in down["items"]} == {"getNameForLog", "e"} and {i["kind"] for i in down["items"]} == {"invoke-virtual", "invoke-static"}
    assert engine.call("xref", sessionId=v1, method="nowhere")["code"] == "NOT_FOUND" and engine.call("xref", sessionId=v1, method="x", direction="up")["code"] == "BAD_ARGUMENT"


def test_match_and_outline(engine, v1):
    of = lambda **a: engine.call("matchSignature", sessionId=v1, **a)
    hits = of(params=["java.lang.String"], returnType="java.lang.String")
    assert hits["total"] == 5 and all(i["params"] == ["java.lang.String"] and i["returnType"] == "java.lang.String" for i in hits["items"])
    assert names(of(referredStrings=["DemoTag", "sign_in_clicked"], invokedMethods="User->getName", accessedFields=["token"]), "name") == ["onCreate"]
    assert names(of(modifiers=["static"], namePattern="^c"), "name") == ["concat", "create"] and of(modifiers=["odd"])["code"] == "BAD_ARGUMENT"
    assert names(of(params=["*", "String"], packagePrefix="com.example"), "name") == [] and of(requireConstructor=True)["total"] == 6
    code = engine.call("decompile", sessionId=v1, target="com.example.demo.JavaGreeter")["items"][0]["code"]
    assert ".implements Lcom/example/demo/Greeter;" in code and 'const-string "Hello, "' in code and engine.call("decompile", sessionId=v1, target="User", format="java")["code"] == "DECOMPILER_UNAVAILABLE"


def test_diff(engine, v1, v2):
    out = engine.call("diffSessions", sessionA=v1, sessionB=v2)
    assert out["summary"] == {"renamed": 3, "removed": 5, "added": 2, "unchanged": 1}
    pairs = {i["from"].rpartition(".")[2]: (i["to"], round(i["score"], 3)) for i in out["items"] if i["change"] == "renamed"}
    assert pairs == {"User": ("a.b.c", 0.477), "JavaGreeter": ("a.b.e", 0.640), "MainActivity": ("a.b.f", 0.613)}
    assert {i["class"] for i in out["items"] if i["change"] == "added"} == {"a.b.d", "a.b.g"}
    assert engine.call("diffSessions", sessionA=v1, sessionB=v1)["summary"] == {"renamed": 0, "removed": 0, "added": 0, "unchanged": 9}


def test_manifest_and_resources(engine, v1, v2):
    item = engine.call("listManifest", sessionId=v1)["items"][0]
    assert item["min_sdk"] == 24 and item["uses_permissions"] == ["android.permission.INTERNET"] and [len(item["components"][t]) for t in ("activity", "service", "receiver", "provider")] == [1, 1, 0, 1]
    of = lambda **a: engine.call("findComponent", sessionId=v1, **a)
    assert names(of(exported=True), "name") == [".MainActivity"] and of(exported=False)["total"] == 0 and names(of(name="SERV"), "name") == [".DemoService"] and names(of(componentType="activity"), "name") == [".MainActivity"] and of()["code"] == "BAD_ARGUMENT"
    assert engine.call("searchResources", sessionId=v1, query="app")["code"] == "NOT_FOUND" and names(engine.call("searchResources", sessionId=v2, query="APP", resourceType="string"), "id") == ["0x7f010000"]
    assert names(engine.call("resourceRefs", sessionId=v2, resource="R.string.DemoTag"), "via") == ["string"]
    safe = engine.call("resourceSecurity", sessionId=v2)["items"][0]
    assert safe["available"] and safe["dangerousPermissions"] == ["android.permission.INTERNET"] and safe["resourceTypes"] == ["layout", "string"] and not engine.call("resourceSecurity", sessionId=v1)["items"][0]["available"]


def test_probe_stats_doctor(engine, v1):
    out = engine.call("probe", sessionId=v1, question='Where is "sign_in_clicked" used by MainActivity?', target="com.example.demo.User->getName")["items"][0]
    assert out["keywords"] == ["sign_in_clicked", "MainActivity"] and out["candidates"] and out["snippet"] and out["xref"] and "getName" in out["outline"] and not out["xrefErrors"]
    stats = engine.call("stats", sessionId=v1)["items"][0]
    assert stats["counts"]["classes"] == 9 and stats["classesBySource"] == {"app": 9} and len(stats["dex"]) == 3
    health = engine.call("doctor")
    assert health["issues"] == [] and health["cacheBytes"] > 0
    assert all(i["exists"] and i["quickCheck"] == "ok" and i["sizeBytes"] > 0 and i["owners"] >= 1 for i in health["items"])
    assert engine.call("stats", sessionId=3)["code"] == "BAD_ARGUMENT" and engine.call("checkPacker")["code"] == "BAD_ARGUMENT"
    assert engine.call("searchClasses", sessionId=v1, query="User", limit="many")["code"] == "BAD_ARGUMENT"


def test_loaders_side_by_side_and_paths_with_a_scheme(engine, spark, files, tmp_path):
    one, two = (Engine(spark, f"file://{tmp_path}/index", [f"file://{files['top']}"], f"owner{k}") for k in (1, 2))
    now = one.index.sessions().count()
    assert now == 0
    first = one.call("loadDex", path=f"file://{files['dex']}")["sessionId"]
    # Both have read the catalogue before either writes.
    row = tuple(one.index.sessions().first())
    one.index.upsert(("ses_a", *row[1:]), "owner1")
    two.index.upsert(("ses_b", *row[1:]), "owner2")
    assert {r.session_id for r in two.index.sessions().collect()} == {first, "ses_a", "ses_b"}
    assert two.call("loadDex", path="/etc/hosts")["code"] == "INVALID_PATH"
    issues = two.call("doctor")["issues"]
    assert issues == ["ses_a: missing-tables", "ses_b: missing-tables"]


def test_format_is_what_the_caller_says(engine, files, tmp_path_factory):
    from pathlib import Path

    plain = Path(files["top"]) / "no-extension"
    plain.write_bytes(Path(files["v1"]).read_bytes())
    assert engine.call("loadDex", path=str(plain))["items"][0]["package"] == "com.example.demo"
    assert engine.call("loadDex", path=files["dex"], format="jar", force=True)["code"] == "UNSUPPORTED_FORMAT"
    assert engine.call("loadDex", path=files["dex"], format="odd")["code"] == "BAD_ARGUMENT"


def test_nothing_is_cut_beyond_the_old_limits(spark):
    from lodeframe.operators import graph

    entries, _ = parse_arsc(b.arsc("p", {"string": [f"name{k}" for k in range(700)]}))
    assert len(entries) == 700
    jar = b.archive({f"a/C{k}.class": b"x" for k in range(20_100)})
    assert len(containers.class_entries(containers.open_zip(jar))) == 20_100
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 131)], "child long, parent long")
    below = graph.closure(chain, chain.where("parent = 0").select("parent"))
    assert below.count() == 130 and below.agg({"depth": "max"}).first()[0] == 130


def test_owners(engine, spark, files, v2):
    other = Engine(spark, engine.index.root, [files["top"]], "other")
    session = other.call("loadDex", path=files["dex"])["sessionId"]
    assert names(other.call("sessionList"), "sessionId") == [session] and session not in names(engine.call("sessionList"), "sessionId")
    engine.call("loadDex", path=files["dex"])
    assert other.call("unload", sessionId=session)["items"][0] == {"sessionId": session, "ownersLeft": 1, "deleted": False}
    assert engine.call("unload", sessionId=session)["items"][0]["deleted"] and engine.call("stats", sessionId=session)["code"] == "SESSION_NOT_FOUND"
    assert engine.call("searchClasses", sessionId=v2)["total"] == 6


def test_envelope():
    out = envelope.ok([{"name": "n" * 20, "k": k} for k in range(2000)], max_bytes=4000)
    assert envelope.size_of(out) <= 4000 and out["truncated"] and out["total"] == 2000
    assert envelope.size_of(envelope.shorten({"name": "x", "list": ["y" * 100] * 100})) <= envelope.ITEM_BYTES
    assert snippets.kotlin_string('a"$\n') == '"a\\"\\$\\n"' and snippets.check_balance("a { ( ] }") == ["bracket ]"]
