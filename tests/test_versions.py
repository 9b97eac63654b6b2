"""Changes in place rewrite what they touch, show at once, and are refused when another came first."""

import os

import pytest
from pyspark.sql import functions as F

from tallygrain.sources.versions import Conflict, Versioned

SCHEMA = "site string, id long, count long, note string"


def table(spark, path, n=400, partitions=16):
    t = Versioned(spark, f"file://{path}", ["site", "id"], partitions)
    t.create(spark.createDataFrame([(f"s{i % 3}" if i % 50 else None, i, 1, "old") for i in range(n)], SCHEMA))
    return t


def data(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path / "data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_an_upsert_rewrites_what_it_touches(spark, tmp_path):
    t = table(spark, tmp_path)
    before = data(tmp_path)
    delta = spark.createDataFrame([("s1", 4, 5, "new"), ("s9", 9000, 1, "added"), (None, 50, 2, "null key")], SCHEMA)
    assert t.upsert(delta, {"count": lambda old, new: old + new}) <= 3
    got = {(r.site, r.id): (r["count"], r.note) for r in t.rows().collect()}
    assert len(got) == 401 and got["s1", 4] == (6, "new") and got["s9", 9000] == (1, "added") and got[None, 50] == (3, "null key") and got["s2", 5] == (1, "old")
    after = data(tmp_path)
    assert sum(v for k, v in after.items() if k not in before) < 0.6 * sum(before.values())  # bytes follow the delta
    assert before.items() <= after.items()
    assert t.rows(1).count() == 400  # who reads the version before is not disturbed
    kept = {f for own in t.version(1)["files"].values() for f in own} & {f for own in t.version(2)["files"].values() for f in own}
    assert len(kept) >= 13


def test_updates_and_deletes(spark, tmp_path):
    t = table(spark, tmp_path)
    keys = spark.createDataFrame([("s1", 4), ("s2", 8), ("s2", 8), ("none", 1)], "site string, id long")
    t.update(keys, {"note": "stale", "count": None})
    got = {(r.site, r.id): (r["count"], r.note) for r in t.rows().collect()}
    assert len(got) == 400 and got["s1", 4] == got["s2", 8] == (None, "stale") and sum(v == (1, "old") for v in got.values()) == 398
    t.delete(keys)
    assert t.rows().count() == 398
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == 0 and t.number() == 3


def test_a_failed_change_is_not_seen(spark, tmp_path):
    t = table(spark, tmp_path)
    want = rows(t.rows())
    with pytest.raises(Exception, match="lost"):
        t.change(spark.createDataFrame([("s1", 4)], "site string, id long"), lambda old: old.withColumn("note", F.raise_error(F.lit("lost"))))
    assert t.number() == 1 and rows(t.rows()) == want


def test_the_second_of_two_changes_is_refused(spark, tmp_path):
    t = table(spark, tmp_path)
    keys = spark.createDataFrame([("s1", 4)], "site string, id long")

    def made(old):
        Versioned(spark, t.path, t.key, t.partitions).delete(keys)  # another's change comes first
        return old

    with pytest.raises(Conflict):
        t.change(keys, made)
    assert t.number() == 2 and t.rows().count() == 399


def test_sweeping(spark, tmp_path):
    t = table(spark, tmp_path)
    for k in range(3):
        t.upsert(spark.createDataFrame([("s1", 4, k, "x")], SCHEMA))
    want = rows(t.rows())
    assert t.swept(keep=2) == 2 and rows(t.rows()) == want and t.rows(3).count() == 400
    assert t.swept() == 1 and rows(t.rows()) == want and len(data(tmp_path)) == len([f for own in t.version()["files"].values() for f in own])


def test_no_table(spark, tmp_path):
    with pytest.raises(ValueError):
        Versioned(spark, f"file://{tmp_path}", ["id"]).rows()
