"""Streams give what their batch forms give, in any order of arrival, and forget what no longer matters."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import runlog
from tallygrain.sources import recorded
from tallygrain.streaming import polls, runs

RUNS = "id long, url string, outcome string, scraped_at timestamp"
POLLS = "job_id string, kind string, at timestamp, status string"
START = datetime.datetime(2024, 1, 1)


def after(seconds):
    return START + datetime.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, schema, build, name):
    """The rows that a stream of these batches has given, and how many rows of state are left."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.table(name).collect(), left[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, f"u{rng.randint(0, 3)}", rng.choice(["success", "success", "scrape_failed"]), after(rng.choice([rng.uniform(0, 20_000), 60 * rng.randint(0, 300)]))) for i in range(140)]
    rows.sort(key=lambda r: r[3] + datetime.timedelta(seconds=rng.uniform(0, 3000)))  # up to 50 minutes late
    batches = [rows[a : a + 28] for a in range(0, 140, 28)] + [[(999, "end", "success", after(90_000))], [(1000, "end", "success", after(200_000))]]
    got, left = streamed(spark, tmp_path, batches, RUNS, lambda df: runs.dedup_stream(df, late="1 hour"), f"dedup{seed}")
    want = [r.id for r in runlog.dedup_successes(spark.createDataFrame(rows, RUNS)).collect()]
    assert sorted(r.id for r in got if r.id < 900) == sorted(want)
    assert 0 < len(want) < 140 and left <= 3  # nothing of the four URLs is held any more


def outcome(rows, deadline):
    """Job by job, poll by poll."""
    start, told = {}, {}
    for job, kind, at, _ in rows:
        if kind == "request":
            start[job] = min(at, start.get(job, at))
    for job, s in start.items():
        own = {}
        for j, kind, at, status in rows:
            if j == job and kind == "poll" and at <= s + datetime.timedelta(seconds=deadline):
                own[at] = status
        n, end = 0, "timeout"
        for at in sorted(own):
            n += 1
            state = {"building": "pending", "done": "ready", "error": "failed", "Unauthorized": "auth_error"}[own[at]]
            if state != "pending":
                end = state
                break
        told[job] = (end, n)
    return told


@pytest.mark.parametrize("seed", [3, 4])
def test_jobs_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for j in range(25):
        s = rng.uniform(0, 2000)
        rows.append((f"j{j}", "request", after(s), None))
        rows += [(f"j{j}", "poll", after(s + 10 * k), rng.choice(["building"] * 5 + ["done", "error", "Unauthorized"])) for k in range(1, rng.randint(2, 12))]
    again = [(j, "request", at + datetime.timedelta(seconds=rng.choice([5, 300])), None) for j, kind, at, _ in rows if kind == "request" and rng.random() < 0.5]
    sent = sorted(rows + again + rng.sample(rows, 20), key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 100)))  # polls come twice, too
    batches = [sent[a : a + 60] for a in range(0, len(sent), 60)] + [[("end", "poll", after(9_000), "building")], [("end", "poll", after(300_000), "building")], [("end", "poll", after(600_000), "building")]]
    got, left = streamed(spark, tmp_path, batches, POLLS, lambda df: polls.poll_stream(df, 60, late="2 minutes", keep_s=3600), f"jobs{seed}")
    assert sorted(r.job_id for r in got if r.event == "triggered") == sorted(f"j{j}" for j in range(25))  # each once
    ended = {r.job_id: (r.outcome, r.polls) for r in got if r.event == "ended"}
    assert ended == outcome(rows, 60) and len(ended) == 25
    first = {j: at for j, kind, at, _ in rows if kind == "request"}
    recordedly = spark.createDataFrame([(j, (at - first[j]).total_seconds(), status) for j, kind, at, status in rows if kind == "poll"], "job_id string, at double, status string")
    assert ended == {r.job_id: (r.outcome, r.polls) for r in recorded.poll_outcomes(recordedly, 60).collect()}
    assert left <= 4  # ended jobs are forgotten


def test_polls_without_a_request_start_nothing(spark, tmp_path):
    rows = [("a", "poll", after(1), "done"), ("b", "request", after(2), None), ("b", "poll", after(3), "building")]
    got, _ = streamed(spark, tmp_path, [rows, [("end", "poll", after(9_000), "done")], [("end", "poll", after(20_000), "done")]], POLLS, lambda df: polls.poll_stream(df, 10), "lone")
    assert sorted((r.job_id, r.event, r.outcome) for r in got) == [("b", "ended", "timeout"), ("b", "triggered", None)]


def test_surges_leave_out_what_is_too_late(spark, tmp_path):
    # a batch is held against the watermark that stood before the one ahead of it
    rows = [[(1, "s", "invalid_target", after(0)), (2, "s", "success", after(60))], [(3, "s", "success", after(200_000))], [(6, "s", "success", after(200_100))], [(4, "s", "success", after(30))], [(5, "s", "success", after(400_000))], [(7, "s", "success", after(400_100))]]
    got, _ = streamed(spark, tmp_path, rows, "id long, site string, outcome string, scraped_at timestamp", runs.surge_stream, "surges")
    assert {r.total for r in got if r.invalid} == {2} and {r.total for r in got} == {2}
