"""Views over the trace: errors, task results, funnel, run summary, failure kinds, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def v_errors(events: DataFrame, tasks: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Errors and warnings with their task, and the provider of their attempt."""
    out = events.where(F.col("status").isin("error", "warning")).join(tasks.select("task_id", "row_index", "product_name"), "task_id")
    return out if attempts is None else out.join(attempts.select("attempt_id", "provider"), "attempt_id")


def v_task_result(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    cols = [F.col(c).alias(f"run_{c}") for c in ("started_at", "finished_at", "status")]
    return tasks.join(runs.select("run_id", *cols, "provider_chain"), "run_id")


def v_funnel(events: DataFrame) -> DataFrame:
    return events.where("status <> 'warning'").groupBy("run_id", "node").agg(
        F.count("*").alias("event_count"), F.sum("candidates_in").alias("candidates_in"), F.sum("candidates_out").alias("candidates_out"), F.avg("duration_ms").alias("avg_duration_ms")
    )


def failure_distribution(tasks: DataFrame) -> DataFrame:
    """Counts of failure kinds of each run as a JSON object, kinds in order."""
    per = tasks.groupBy("run_id", "failure_kind").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.coalesce("failure_kind", F.lit("null")).alias("k"), "n")))
    return per.groupBy("run_id").agg(F.to_json(F.map_from_entries(pairs)).alias("failure_distribution"))


def v_run_summary(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    ms = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    return runs.join(failure_distribution(tasks), "run_id", "left").select("run_id", "status", "provider_chain", ms.cast("long").alias("duration_ms"), F.coalesce("failure_distribution", F.lit("{}")).alias("failure_distribution"))


def run_totals(tasks: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return tasks.groupBy("run_id").agg(F.count_if(v == "match").alias("n_match"), F.count_if(v == "no_match").alias("n_no_match"), F.count_if(v == "error").alias("n_error"))


def attempt_rollup(candidates: DataFrame, keys: list[str]) -> DataFrame:
    d, b, n = F.col("v_domain"), F.col("v_brand"), F.col("v_numeric")
    ok = lambda c: F.coalesce(c, F.lit("")) != "fail"
    return candidates.groupBy(*keys).agg(F.count("*").alias("found"), F.count_if(d == "pass").alias("alive_after_domain"), F.count_if((d == "pass") & ok(b) & ok(n)).alias("alive_after_base"))


def failure_kind(t: dict[str, Column]) -> Column:
    """The first that holds of a task's aggregates: status and verdict, error kinds, call states, providers, candidates.

    t: is_error, is_match, domain_missing, llm_parse, llm_error, budget, provider_error, n_candidates, n_domain, n_base,
    n_numeric_fail, llm_ok.
    """
    return (
        F.when(t["is_error"], "unknown_error")
        .when(t["is_match"], "matched")
        .when(t["domain_missing"], "domain_map_missing")
        .when(t["llm_parse"], "llm_parse_error")
        .when(t["llm_error"], "llm_error")
        .when(t["budget"], "budget_exhausted")
        .when(t["provider_error"], "provider_error")
        .when(t["n_candidates"] == 0, "no_search_results")
        .when(t["n_domain"] == 0, "all_domain_filtered")
        .when((t["n_base"] == 0) & (t["n_numeric_fail"] > 0), "numeric_mismatch")
        .when(t["n_base"] == 0, "brand_mismatch")
        .when(t["llm_ok"], "llm_no_match")
        .otherwise("unknown_error")
    )


def flush_tasks(nested: DataFrame) -> dict[str, DataFrame]:
    """Child relations of nested task rows (task_id, run_id, attempts array of structs with events, candidates and llm_calls)."""
    attempts = nested.select("run_id", "task_id", F.posexplode("attempts").alias("n", "a")).select("run_id", "task_id", (F.col("n") + 1).alias("attempt_no"), "a")
    key = ["run_id", "task_id", "attempt_no"]

    def child(field: str) -> DataFrame:
        return attempts.select(*key, F.posexplode(F.col("a")[field]).alias("seq", "x")).select(*key, (F.col("seq") + 1).alias("seq"), "x.*")

    plain = [f for f in nested.schema["attempts"].dataType.elementType.names if f not in ("events", "candidates", "llm_calls")]
    return {
        "tasks": nested.drop("attempts"),
        "attempts": attempts.select(*key, *[F.col("a")[f].alias(f) for f in plain]),
        "node_events": child("events"),
        "candidates": child("candidates"),
        "llm_calls": child("llm_calls"),
    }


def skipped_events(attempts: DataFrame, reached: DataFrame, nodes: list[str]) -> DataFrame:
    """An event 'skipped' for every node an attempt never came to."""
    every = attempts.select("attempt_id", F.explode(F.array(*[F.lit(n) for n in nodes])).alias("node"))
    return every.join(reached.select("attempt_id", "node"), ["attempt_id", "node"], "left_anti").withColumn("status", F.lit("skipped")).withColumn("duration_ms", F.lit(0))


def provider_comparison(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("provider").agg(F.count("*").alias("attempts"), F.round(F.avg("alive_after_domain"), 2).alias("avg_alive"), F.sum((F.col("verdict") == "match").cast("int")).alias("matched"))


def stage_events(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One event for each node of each attempt, from its judged candidates: how many went in and came out, and how it ended.

    A node that nothing came to is skipped; a search that found nothing warns; a website without a host is an error.
    """
    passed = lambda c: F.coalesce(F.col(c), F.lit("")) == "pass"
    kept = lambda c: F.coalesce(F.col(c), F.lit("")) != "fail"
    base = passed("v_domain") & kept("v_brand") & kept("v_numeric")
    per = candidates.groupBy(*keys).agg(F.count("rank").alias("n0"), F.count_if(passed("v_domain")).alias("n1"), F.count_if(base).alias("n2"), F.count_if(passed("v_distinguishing")).alias("n3"), F.any_value("target").alias("target"))
    steps = (("search", F.lit(0).cast("long"), "n0"), ("domain_filter", F.col("n0"), "n1"), ("base_match", F.col("n1"), "n2"), ("distinguishing", F.col("n2"), "n3"))
    events = []
    for i, (node, n_in, out) in enumerate(steps):
        skipped = F.lit(False) if not i else n_in == 0
        status = F.when(skipped, "skipped").when(F.lit(node == "domain_filter") & F.col("target").isNull(), "error").when(F.lit(not i) & (F.col(out) == 0), "warning").otherwise("ok")
        events.append(F.struct(F.lit(i + 1).cast("long").alias("seq"), F.lit(node).alias("node"), n_in.alias("candidates_in"), F.col(out).alias("candidates_out"), status.alias("status")))
    return per.select(*keys, F.explode(F.array(*events)).alias("e")).select(*keys, "e.*")


def run_scopes(marks: DataFrame) -> DataFrame:
    """Each run's status from its marks (run_id, seq, mark): running until the first of completed, failed and interrupted;
    what is marked after that does not count. Tasks done are those marked before."""
    end = F.col("mark").isin("completed", "failed", "interrupted")
    per = marks.groupBy("run_id").agg(F.min(F.when(end, F.struct("seq", "mark"))).alias("end"))
    done = marks.join(per, "run_id").where((F.col("mark") == "task_done") & (F.col("end").isNull() | (F.col("seq") < F.col("end.seq")))).groupBy("run_id").agg(F.count("*").alias("n_done"))
    return per.join(done, "run_id", "left").select("run_id", F.coalesce("end.mark", F.lit("running")).alias("status"), F.coalesce("n_done", F.lit(0)).alias("n_done"))
