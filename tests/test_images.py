"""Images of one package are parsed side by side; what is broken is an error row, and the rest is kept."""

from pyspark.sql import functions as F

from lodeframe.plans.index import Index
from lodeframe.sources import ingest
from tests import builders as b


def files(spark, blobs):
    rows = [(f"s{k}", k, f"f{k}.apk", "app", blob) for k, blob in enumerate(blobs)]
    return spark.createDataFrame(rows, "session_id string, file_ord int, name string, source string, content binary")


def image(k):
    return b.dex([b.cls(f"Lcom/a/C{k};", methods=[("m", "()", "V", 1, [("str", f"text {k}")])])])


def test_five_images_in_five_tasks(spark):
    package = b.package([image(k) for k in range(5)], b.manifest("p", 1, "1"))
    parsed = ingest.parse_files(files(spark, [package])).withColumn("task", F.spark_partition_id())
    classes = parsed.where("entity = 'class'").select("dex_idx", "task").collect()
    assert sorted(r.dex_idx for r in classes) == [0, 1, 2, 3, 4] and len({r.task for r in classes}) == 5
    assert {r.entity for r in parsed.select("entity").distinct().collect()} >= {"class", "dex", "manifest", "facts"}


def test_a_broken_image_is_an_error_row(spark):
    package = b.package([image(0), image(1)[:60] + b"\xff" * 200, image(2)], b.manifest("p", 1, "1"))
    rows = ingest.parse_files(files(spark, [package, b"PK\x03\x04 nothing", b.package([image(7)], b.manifest("q", 1, "1"))])).collect()
    bad = [r for r in rows if r.entity == "error"]
    assert sorted((r.session_id, r.dex_idx) for r in bad) == [("s0", 1), ("s1", 0)] and "classes2.dex" in bad[0].payload + bad[1].payload
    assert sorted((r.session_id, r.dex_idx) for r in rows if r.entity == "class") == [("s0", 0), ("s0", 2), ("s2", 2 * ingest.DEX_PER_FILE)]


def test_more_than_a_thousand_images_keep_their_numbers(spark, tmp_path):
    package = b.package([image(k) for k in range(1005)], b.manifest("p", 1, "1"))
    other = b.package([image(5000)], b.manifest("p", 1, "1"))
    tables = ingest.normalise(ingest.parse_files(files(spark, [package, other]).withColumn("session_id", F.lit("s"))))
    index = Index(spark, str(tmp_path / "index"))
    index.write({n: tables[n] for n in ("dex", "classes")})
    found = index.table("classes", "s").select("descriptor", "dex_idx", "origin_file").collect()
    assert len(found) == 1006 and len({r.dex_idx for r in found}) == 1006
    assert {r.origin_file for r in found if r.descriptor == "Lcom/a/C5000;"} == {"f1.apk"}
