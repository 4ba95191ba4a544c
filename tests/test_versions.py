"""Comparison of two versions: members are read of the classes alone that one of them doesn't have."""

from pyspark.sql import functions as F

from lodeframe.plans.tools import Engine
from lodeframe.plans.version_queries import Versions

DIR = "/root/testdata/sf0.001"


def test_members_are_read_of_classes_of_one_version_alone(spark):
    index, read = Versions(spark, DIR), []
    about = index.about
    index.about = lambda classes: read.append(about(classes)) or read[0]
    renamed, fa, fb, same = Engine(spark, index=index).compare("v1", "v2", scope="all")
    unchanged = {r.descriptor for r in same.collect()}
    for side, df in (("v1", fa), ("v2", fb)):
        own = {r.descriptor for r in df.collect()}
        assert own and not own & unchanged
        every = {r.descriptor for r in index.table("classes", side).collect()}
        assert own == every - unchanged
    # Line items of other classes go into no step after the first.
    owners = {r.owner for r in read[0].tables["calls"].select("owner").distinct().collect()}
    assert owners and not owners & unchanged
    # What is read that way is what all members give.
    for side, df in (("v1", fa), ("v2", fb)):
        sets = lambda x: {r.descriptor: (r.sigs, r.fields, r.strings, r.sig_hash) for r in x.collect()}
        whole = Engine(spark, index=index).features(side, "all").where(~F.col("descriptor").isin(*unchanged))
        assert sets(df) == sets(whole)
