"""A flush is all of a run or nothing; a parser's call ends by its deadline and within its memory."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tallygrain.plans import views
from tallygrain.sources import flush, recorded

NESTED = "task_id long, run_id string, attempts array<struct<provider:string,events:array<struct<node:string,ms:long>>,candidates:array<struct<url:string>>,llm_calls:array<struct<model:string>>>>"


def tree(spark, run, n, parts=3):
    rows = [(i, run, [("p", [("a", i), ("b", 2)], [("u",)] * (i % 3), []), ("q", [], [("v",)], [])]) for i in range(n)]
    return views.flush_tasks(spark.createDataFrame(rows, NESTED).repartition(parts))


def rows(df):
    return sorted(map(repr, df.collect()))


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_a_flush_is_read_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}"
    tables = tree(spark, "r1", 25)
    flush.flush(tables, path, "r1")
    for name, df in tables.items():
        back = flush.flushed(spark, path, name)
        assert rows(back) == rows(df) and back.dtypes == df.dtypes
    assert flush.flushed(spark, path, "llm_calls").count() == 0
    with pytest.raises(ValueError):
        flush.flushed(spark, path, "nothing")


def test_a_run_counts_once(spark, tmp_path):
    path = f"file://{tmp_path}"
    flush.flush(tree(spark, "r1", 8), path, "r1")
    before = files(tmp_path)
    flush.flush(tree(spark, "r1", 8), path, "r1")
    assert files(tmp_path) == before and flush.flushed(spark, path, "tasks").count() == 8
    flush.flush(tree(spark, "r/2 ü", 5), path, "r/2 ü")
    assert flush.flushed(spark, path, "tasks").count() == 13


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    flush.flush(tree(spark, "r1", 4), path, "r1")
    tables = tree(spark, "r2", 60, 6)
    bad = tables | {"node_events": tables["node_events"].withColumn("node", F.when(F.col("task_id") == 41, F.raise_error(F.lit("lost"))).otherwise(F.col("node")))}
    with pytest.raises(Exception, match="lost"):
        flush.flush(bad, path, "r2")
    assert {r.run_id for r in flush.flushed(spark, path, "tasks").collect()} == {"r1"}
    flush.swept(path)  # what tasks wrote before the job failed
    assert len([f for f in files(tmp_path) if f.endswith(".parquet")]) == sum(len(v) for m in flush.manifests(path) for v in m["files"].values())
    flush.flush(tables, path, "r2")  # the run can be flushed again
    assert flush.flushed(spark, path, "tasks").count() == 64


def test_a_draft_is_no_manifest(spark, tmp_path):
    path = f"file://{tmp_path}"
    flush.flush(tree(spark, "r1", 3), path, "r1")
    (tmp_path / "manifests" / "_draft").write_text("{")
    (tmp_path / "data" / "tasks" / "loose.parquet").write_text("no file")
    assert flush.flushed(spark, path, "tasks").count() == 3
    assert flush.swept(path) == 1


def test_an_empty_run(spark, tmp_path):
    path = f"file://{tmp_path}"
    flush.flush(tree(spark, "r1", 0, 1), path, "r1")
    assert flush.flushed(spark, path, "attempts").count() == 0 and len(flush.manifests(path)) == 1


def test_parsers_have_a_deadline_and_room(spark):
    def loops(html, url):
        while True:
            pass

    def greedy(html, url):
        return {"n": len(bytearray(4 << 30))}

    def exits(html, url):
        os._exit(3)

    def sleeps(html, url):
        time.sleep(60)

    kept = dict(recorded.PARSERS)
    recorded.PARSERS.update(loops=loops, greedy=greedy, exits=exits, sleeps=sleeps, quits=lambda html, url: exit(1), fine=lambda html, url: {"n": len(html)}, odd=lambda html, url: {"x": {1, 2} and object})
    try:
        names = ["fine", "loops", "greedy", "exits", "sleeps", "quits", "odd", "fine"]
        began = time.time()
        got = recorded.run_parsers(spark.createDataFrame([("u", "abc"), ("v", None)], "url string, html string").coalesce(1), names, seconds=0.4, megabytes=256).collect()
    finally:
        recorded.PARSERS.clear()
        recorded.PARSERS.update(kept)
    assert time.time() - began < 40
    told = {(r.url, r.position): (r.ok, r.output or r.error) for r in got}
    assert len(told) == 16
    for url, n in (("u", 3), ("v", 0)):
        assert told[url, 0] == told[url, 7] == (True, '{"n": %d}' % n)
        assert told[url, 1] == told[url, 4] == (False, "TimeoutError: over 0.4 s")
        assert told[url, 2] == (False, "MemoryError: ") and told[url, 3] == (False, "ChildProcessError: ended with 3")
        assert told[url, 5][1].startswith("SystemExit") and told[url, 6][0]


def test_a_parsers_process_does_not_hold_the_batch(spark):
    """However large the pages of a batch, the process of the calls is not the larger for them."""
    from pyspark.sql import functions as F

    def held(html, url):
        with open("/proc/self/statm") as f:
            return {"mb": int(f.read().split()[1]) * 4096 >> 20}

    kept = dict(recorded.PARSERS)
    recorded.PARSERS.update(held=held)
    try:
        most = []
        for letters in (1, 200_000):
            pages = spark.range(400).coalesce(1).select(F.col("id").cast("string").alias("url"), F.repeat(F.lit("x"), F.lit(letters)).alias("html"))
            ran = recorded.run_parsers(pages, ["held"])
            n, mb = ran.agg(F.count("*"), F.max(F.get_json_object("output", "$.mb").cast("int"))).first()
            assert n == 400
            most.append(mb)
    finally:
        recorded.PARSERS.clear()
        recorded.PARSERS.update(kept)
    assert most[1] < most[0] + 50, most
