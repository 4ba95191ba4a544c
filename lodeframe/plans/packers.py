"""Packers by what they leave: native libraries, entry classes, payloads in assets, and a structure that a real program would not have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.functions.text import entropy
from lodeframe.operators.rules import evidence_rollup, scan_rules

#: Library name prefix, vendor, entry class.
NATIVE = (
    ("libjiagu", "360 加固 (jiagu)", "com.stub.StubApp"), ("libDexHelper", "爱加密 Ijiami", "com.secneo.apkwrapper.ApplicationWrapper"), ("libdexjni", "爱加密 Ijiami", None), ("libSecShell", "腾讯乐固 Legu/TBS", "com.tencent.tbs.TBSShell"),
    ("libshell", "腾讯乐固 Legu", None), ("libshellx", "腾讯乐固 Legu (64bit)", None), ("libmobisec", "梆梆 BangCle", "com.stub.STUB.Application"), ("libnetmobsec", "网御 NetMobSec", None), ("libnesec", "网御 NetMobSec", None),
    ("libsh_shell", "360 加固", None), ("libprotect", "ProtectMyApp", None), ("libpmp", "ProtectMyApp", None), ("libdexguard", "DexGuard (Collapsar)", None), ("libTPCore-lib", "Naga 加固", None), ("libnaga", "Naga 加固", None),
    ("libexec", "通用壳 loader", None), ("libalisec", "阿里云壳", None), ("libcrashsdk", "腾讯 Bugly 壳（常与乐固同现）", None), ("libstub", "通用 stub", None), ("libSXCli", "深信服", None), ("libvbox", "VBox 虚拟化壳", None),
    ("libdatatran", "通用壳 loader", None), ("libsecneo", "爱加密 secneo", None), ("libijiami", "爱加密 Ijiami", None), ("libtuprotector", "图盟 TUProtector", None), ("libpxrt", "Pxrt 壳", None), ("libcryptex", "Cryptex 壳", None),
)
#: Class descriptor pattern, vendor.
CLASSES = (
    (r"^Lcom/stub/StubApp;?$", "360 加固 com.stub.StubApp"), (r"^Lcom/stub/STUB/", "梆梆 com.stub.STUB.*"), (r"^Lcom/tencent/bugly/stub", "腾讯 bugly.stub"), (r"^Lcom/qihoo/util/", "360 com.qihoo.util"), (r"^Lcom/qihoo/", "360 壳相关"),
    (r"^Lcom/s/h/e/l/l", "字面 com.s.h.e.l.l 壳入口"), (r"^Lcom/billy/android", "com.billy.android 动态加载"), (r"^Lcom/secneo/apkwrapper", "爱加密 secneo.apkwrapper"), (r"^Lcom/ijiami/", "爱加密 com.ijiami.*"), (r"^Lcom/tencent/SecShell", "腾讯乐固 SecShell"),
    (r"^Lcom/tbs/", "腾讯 TBS 壳"), (r"^Lcom/bangcle/", "梆梆"), (r"^Lcom/naga/", "Naga"), (r"^Lcom/google/and/", "通用 DexHelper 壳"), (r"^Lcom/wrapper/Stub", "通用 wrapper stub"), (r"^Lme/pya/", "ProtectYourApp"), (r"^Lcom/ptrvsapp/", "PtrvsApp"),
    (r"^Lcom/mobilelinux/", "娜迦 mobilelinux"), (r"^Lcom/virtualapp/", "VirtualApp 型壳"),
)
#: Payload names, and the limits of the structural heuristics.
PAYLOAD = r"(?i)(^assets/(?:\(?\d|libexec|dexj|ijiami|sec\.|shell|data\.|lic|tup|nags))|(^assets/.{0,16}\.(ajm|yag|kk|tup|nags|dat|bin)$)"
PAYLOAD_VENDOR = "加密 payload 候选"
#: What the structural heuristics call a session.
FEW_HINT, ODD_HINT = "主 dex 类数极少", "字符串熵异常高"
BIG_DEX, FEW_CLASSES, HIGH_ENTROPY, SOME_CLASSES, PACKED_CLASSES = 1_500_000, 200, 6.9, 2000, 400


def library_name(col):
    return F.regexp_replace(F.regexp_replace(F.lower(col), r"^lib/[^/]*/", ""), r"\.so$", "")


def evidence(classes: DataFrame, libs: DataFrame, assets: DataFrame, applications: DataFrame) -> DataFrame:
    """(session_id, type, vendor, detail, entryClassHint). classes: descriptor; libs: name; assets: name; applications: application."""
    spark = classes.sparkSession
    natives = spark.createDataFrame([(k, p.lower(), v, e) for k, (p, v, e) in enumerate(NATIVE)], "rank int, pattern string, vendor string, hint string")
    kinds = spark.createDataFrame([(k, p, v) for k, (p, v) in enumerate(CLASSES)], "rank int, pattern string, vendor string")
    row = lambda kind, detail, hint: ("session_id", F.lit(kind).alias("type"), "vendor", detail.alias("detail"), hint.alias("entryClassHint"))
    none = F.lit(None).cast("string")
    one = scan_rules(libs.withColumn("_n", library_name(F.col("name"))), "_n", natives, "prefix")
    one = one.groupBy("session_id", "name").agg(F.min(F.struct("rank", "vendor", "hint")).alias("r")).select("session_id", "name", "r.*").select(*row("native", F.col("name"), F.col("hint")))
    two = scan_rules(classes, "descriptor", kinds).groupBy("session_id", "vendor").agg(F.min("descriptor").alias("descriptor")).select(*row("entryClass", F.col("descriptor"), none))
    three = assets.where(F.col("name").rlike(PAYLOAD)).withColumn("vendor", F.lit(PAYLOAD_VENDOR)).select(*row("payloadAsset", F.col("name"), none))
    app = applications.where("application IS NOT NULL").withColumn("_d", F.concat(F.lit("L"), F.translate("application", ".", "/"), F.lit(";")))
    four = scan_rules(app, "_d", kinds).select(*row("applicationClass", F.col("application"), none))
    return one.unionByName(two).unionByName(three).unionByName(four)


def verdict(found: DataFrame, shape: DataFrame) -> DataFrame:
    """shape: session_id, classes, dex_bytes, entropy. A row for each session."""
    few = (F.col("dex_bytes") > BIG_DEX) & (F.col("classes") < FEW_CLASSES)
    odd = (F.col("entropy") > HIGH_ENTROPY) & (F.col("classes") < SOME_CLASSES)
    hint = F.when(few, FEW_HINT).when(odd, ODD_HINT)
    heuristic = shape.where(few | odd).select("session_id", F.lit("heuristic").alias("type"), hint.alias("vendor"), F.concat(F.lit("classes="), "classes").alias("detail"), F.lit(None).cast("string").alias("entryClassHint"))
    all_found = found.unionByName(heuristic)
    rolled = evidence_rollup(shape.select("session_id", "classes", "entropy").join(all_found, "session_id", "left"), ["session_id", "classes", "entropy"], F.col("type").isin("native", "entryClass", "applicationClass"))
    shown = all_found.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("type", "vendor", "detail", "entryClassHint"))).alias("evidence"), F.bool_or(F.col("type") == "heuristic").alias("heuristic"))
    out = rolled.join(shown, "session_id", "left")
    packed = F.col("strong") | (F.coalesce("heuristic", F.lit(False)) & (F.col("classes") < PACKED_CLASSES))
    return out.select("session_id", packed.alias("packed"), F.filter(F.split("vendors", ","), lambda v: v != "").alias("vendors"), F.round("entropy", 3).alias("stringEntropy"), "evidence", "confidence")


def mean_entropy(strings: DataFrame) -> DataFrame:
    return strings.where("value <> ''").groupBy("session_id").agg(F.avg(entropy(F.col("value"))).alias("entropy"))
