"""Registered queries over run logs, parsers, golden samples, workbooks and sinks, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrain import config, fixtures as fx
from tallygrain.catalog import query
from tallygrain.functions import text, urls
from tallygrain.operators import brands, candidates as cand, repair, runlog
from tallygrain.plans import reports, views
from tallygrain.session import shared_dir
from tallygrain.sources import flush, recorded, sinks, versions

# ---- run log ------------------------------------------------------------------------------------------------------


@query(fx.sql("SELECT site, count(*) AS total, count_if(outcome = 'invalid_target') AS invalid FROM scrape_runs WHERE scraped_at > (SELECT max(scraped_at) FROM scrape_runs) - INTERVAL 24 HOUR GROUP BY 1", "scrape_runs"))
def window_counts(spark, d):
    runs = fx.scrape_runs(spark, d)
    as_of = runs.agg(F.max("scraped_at")).first()[0]
    return runlog.count_window(runs, F.lit(as_of))


@query(fx.sql("SELECT site, count(*) + 1 AS next_version FROM parsers GROUP BY 1", "parsers"))
def next_versions(spark, d):
    return runlog.next_version(fx.parsers(spark, d))


ATTEMPTS = "#attempts AS (SELECT run_id, ['duckduckgo', 'serper'][task_id % 2 + 1] AS provider, candidates_out AS alive_after_domain, CASE WHEN status = 'ok' AND candidates_out > 4 THEN 'match' ELSE 'no_match' END AS verdict FROM node_events) "


def _attempts(spark, d):
    return fx.node_events(spark, d).selectExpr("run_id", "element_at(array('duckduckgo', 'serper'), cast(task_id % 2 + 1 AS int)) AS provider", "candidates_out AS alive_after_domain", "CASE WHEN status = 'ok' AND candidates_out > 4 THEN 'match' ELSE 'no_match' END AS verdict")


@query(fx.sql(ATTEMPTS + "SELECT provider, count(*) AS attempts, round(avg(alive_after_domain), 2) AS avg_alive, count_if(verdict = 'match') AS matched FROM attempts JOIN runs USING (run_id) WHERE runs.status = 'completed' GROUP BY 1", "node_events", "runs"))
def provider_figures(spark, d):
    done = fx.runs(spark, d).where("status = 'completed'").select("run_id")
    return views.provider_comparison(_attempts(spark, d).join(done, "run_id"))


REPORTS = "#reports AS (SELECT id AS idx, url, site, outcome, path, CASE WHEN outcome = 'escalated' THEN ['parser_broken', 'infra_failure', 'api_malformed'][id % 3 + 1] END AS reason, CASE WHEN path <> 'fast' THEN site || '|' || path END AS signature FROM scrape_runs)"


def _reports(spark, d):
    return fx.scrape_runs(spark, d).selectExpr("id AS idx", "url", "site", "outcome", "path", "CASE WHEN outcome = 'escalated' THEN element_at(array('parser_broken', 'infra_failure', 'api_malformed'), cast(id % 3 + 1 AS int)) END AS escalation_reason", "CASE WHEN path <> 'fast' THEN concat(site, '|', path) END AS escalation_signature")


@query(fx.sql(REPORTS + " SELECT coalesce(signature, 'unknown') AS signature, min_by(reason, idx) AS reason, count(*) AS affected, md5(string_agg(url, ',' ORDER BY idx)) AS members FROM reports WHERE reason IS NOT NULL GROUP BY 1", "scrape_runs"))
def escalations_by_signature(spark, d):
    g = reports.escalation_groups(_reports(spark, d))
    return g.select("signature", "reason", "affected", F.md5(F.array_join("urls", ",").cast("binary")).alias("members"))


ESCALATIONS = "#esc AS (SELECT site || '|' || outcome || '|' || coalesce(path, 'none') AS signature, min_by(outcome, id) AS reason, count(*) AS affected_count, CASE WHEN min(id) % 2 = 0 THEN 'open' ELSE 'resolved' END AS status, min(id) AS first_seq FROM scrape_runs WHERE outcome <> 'success' GROUP BY 1)"


def _escalations(spark, d):
    news = fx.scrape_runs(spark, d).where("outcome <> 'success'").selectExpr("concat_ws('|', site, outcome, coalesce(path, 'none')) AS signature", "outcome AS reason", "url AS snapshot", "id AS seq")
    none = spark.createDataFrame([], "signature string, reason string, affected_count long, snapshot string, status string, first_seq long")
    return runlog.upsert_escalations(none, news).withColumn("status", F.when(F.col("first_seq") % 2 == 0, "open").otherwise("resolved"))


@query(fx.sql(ESCALATIONS + " SELECT signature, reason, affected_count, first_seq FROM esc WHERE status = 'open'", "scrape_runs"))
def open_escalations(spark, d):
    return runlog.open_escalations(_escalations(spark, d)).select("signature", "reason", "affected_count", "first_seq")


@query(
    fx.sql(
        ESCALATIONS
        + """, last AS (SELECT url, max_by(site, id) AS site, max_by(outcome, id) AS outcome, max_by(struct_pack(p := path), id).p AS path FROM scrape_runs GROUP BY 1),
        e AS (SELECT string_split(signature, '|')[1] AS site, min_by(signature, first_seq) AS signature, min_by(reason, first_seq) AS reason FROM esc WHERE status = 'open' GROUP BY 1)
        SELECT u.url, last.site, outcome, path, e.signature AS escalation_signature, e.reason AS escalation_reason FROM (SELECT DISTINCT url FROM scrape_runs UNION ALL SELECT 'https://s9.example/none') u LEFT JOIN last USING (url) LEFT JOIN e ON e.site = last.site""",
        "scrape_runs",
    )
)
def live_report(spark, d):
    runs = fx.scrape_runs(spark, d)
    listed = runs.select("url").distinct().unionByName(spark.createDataFrame([("https://s9.example/none",)], "url string"))
    return reports.report_rows(listed, runs, _escalations(spark, d)).drop("latency_ms")


@query(fx.sql("SELECT site, count(*) AS goldens, count_if(captured_at % 1000 = 0) AS failed, count_if(captured_at % 1000 = 0) = 0 AS promote FROM goldens GROUP BY 1", "goldens"))
def promotion_exam(spark, d):
    rows = fx.goldens(spark, d).select("site", F.col("id").alias("golden_id"), F.when(F.col("captured_at") % 1000 == 0, "price").alias("mismatch"))
    return runlog.golden_exam(rows)


@query(fx.sql("SELECT id, site FROM goldens WHERE id NOT IN (SELECT g.id FROM goldens g JOIN parsers p ON p.site = g.site WHERE p.status = 'active' AND (g.captured_at + p.id) % 9 = 0)", "goldens", "parsers"))
def control_experiment(spark, d):
    g = fx.goldens(spark, d)
    active = fx.parsers(spark, d).where("status = 'active'").select("site", F.col("id").alias("parser_id"))
    control = g.join(F.broadcast(active), "site").select(F.col("id").alias("golden_id"), ((F.col("captured_at") + F.col("parser_id")) % 9 == 0).alias("passed"))
    return runlog.stale_goldens(g, control).select("id", "site")


TRIES = """WITH tries AS (SELECT 'u' || CAST(event_id // 5 AS VARCHAR) AS url, event_id % 5 AS position, event_id % 7 AS parser_id, user_id % 4 = 0 AS ok, CASE WHEN user_id % 8 = 0 THEN 'blob' END AS distrust, CASE WHEN user_id % 4 > 0 THEN event_type END AS error FROM events)"""


def _tries(spark, d):
    return fx.read(spark, d, "events").selectExpr("concat('u', cast(event_id div 5 AS string)) AS url", "event_id % 5 AS position", "event_id % 7 AS parser_id", "user_id % 4 = 0 AS ok", "CASE WHEN user_id % 8 = 0 THEN 'blob' END AS distrust", "CASE WHEN user_id % 4 > 0 THEN event_type END AS error")


@query(
    TRIES
    + """, w AS (SELECT *, min(CASE WHEN ok AND distrust IS NULL THEN position END) OVER (PARTITION BY url) AS win FROM tries)
        SELECT url, max(CASE WHEN position = win THEN parser_id END) AS winner, coalesce(string_agg(coalesce(error, distrust), '|' ORDER BY position) FILTER (WHERE win IS NULL OR position < win), '') AS errors FROM w GROUP BY 1"""
)
def first_passing_parser(spark, d):
    out = runlog.first_passing_parser(_tries(spark, d))
    return out.select("url", "winner", F.array_join("errors", "|").alias("errors"))


@query(
    TRIES
    + """, w AS (SELECT *, count(*) OVER (PARTITION BY url) AS chain, coalesce(min(CASE WHEN ok THEN position END) OVER (PARTITION BY url), max(position) OVER (PARTITION BY url)) AS last FROM tries)
        SELECT url, 'scraper_' || CAST(position AS VARCHAR) AS final_provider, CASE WHEN ok THEN 'match' ELSE 'no_match' END AS verdict, position + 1 AS attempts_run,
        CASE WHEN chain > 1 THEN CASE WHEN error IS NULL THEN '' ELSE error || ' ' END || '(via scraper_' || CAST(position AS VARCHAR) || ')' ELSE coalesce(error, '') END AS reason, 'backup_' || CAST(position AS VARCHAR) = CASE WHEN position > 0 THEN 'backup_' || CAST(position AS VARCHAR) ELSE 'fast' END AS is_backup
        FROM w WHERE position = last"""
)
def scraper_fallback(spark, d):
    from tallygrain.functions.prices import success_path

    rows = _tries(spark, d).selectExpr("url", "position AS provider_rank", "concat('scraper_', cast(position AS string)) AS provider", "CASE WHEN ok THEN 'match' ELSE 'no_match' END AS verdict", "error AS reason")
    out = cand.provider_chain(rows, ["url"])
    place = F.substring_index("final_provider", "_", -1).cast("long")
    return out.withColumn("is_backup", success_path(place + 1) == F.concat(F.lit("backup_"), place.cast("string")))


@query("SELECT user_id AS site, event_id AS round, event_type = 'error' AND coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'error', false) AS abort FROM events")
def consecutive_empty(spark, d):
    rows = fx.read(spark, d, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("round"), (F.col("event_type") == "error").alias("empty"))
    return runlog.empty_twice(rows).select("site", "round", "abort")


@query(fx.sql("SELECT site, id, CAST(row_number() OVER (PARTITION BY site ORDER BY id DESC) AS BIGINT) AS position FROM parsers WHERE status = 'active'", "parsers"))
def parsers_newest_first(spark, d):
    return runlog.parsers_by_hits(fx.parsers(spark, d), fx.scrape_runs(spark, d).where("outcome = 'none'")).select("site", "id", F.col("position").cast("long").alias("position"))


@query("SELECT event_type AS provider, CAST(sum(event_id % 9 + 1) - sum(CASE WHEN event_id % 3 > 0 THEN event_id % 4 ELSE 0 END) AS BIGINT) AS calls FROM events GROUP BY 1")
def provider_call_deltas(spark, d):
    e = fx.read(spark, d, "events")
    after = e.groupBy(F.col("event_type").alias("provider")).agg(F.sum(F.col("event_id") % 9 + 1).alias("calls"))
    before = e.where("event_id % 3 > 0").groupBy(F.col("event_type").alias("provider")).agg(F.sum(F.col("event_id") % 4).alias("calls"))
    return runlog.provider_calls(before, after)


@query(
    """WITH t AS (SELECT user_id, event_id, unnest(list_value(['price', 'title', 'brand'][event_id % 3 + 1], 'image')) AS field, true AS rep FROM events
        UNION ALL SELECT user_id, event_id, ['price', 'title', 'image'][event_id % 3 + 1], false FROM events WHERE event_id % 2 = 0),
    l AS (SELECT user_id, field, max(event_id) AS last, max(event_id) FILTER (WHERE NOT rep) AS off FROM t GROUP BY 1, 2)
    SELECT CAST(user_id AS VARCHAR) AS url, string_agg(field, ',' ORDER BY field) AS open FROM l WHERE off IS NULL OR off < last GROUP BY 1"""
)
def regression_ledger(spark, d):
    e = fx.read(spark, d, "events")
    one = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 3 + 1).cast("int"))
    rows = e.select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("round"), F.array(one("price", "title", "brand"), F.lit("image")).alias("reported"), F.when(F.col("event_id") % 2 == 0, F.array(one("price", "title", "image"))).alias("resolved"))
    return runlog.ledger(rows).select("url", F.array_join("open", ",").alias("open"))


@query(fx.sql("#m AS (SELECT CASE WHEN path = 'fast' THEN 'fast path (parser)' WHEN path = 'agent_repaired' THEN 'agent repair' WHEN path = 'backup_1' THEN 'backup scraper 1' END AS a, CASE WHEN outcome = 'infra_error' THEN CASE WHEN id % 2 = 0 THEN 'infra alert' ELSE 'infra alert' END END AS b, CASE WHEN outcome = 'scrape_failed' THEN 'terminal failure' END AS c, CASE WHEN path IS NULL AND outcome IN ('scrape_failed', 'infra_error') THEN 'no run record' END AS x FROM (SELECT id, path, CASE outcome WHEN 'escalated' THEN 'scrape_failed' WHEN 'invalid_target' THEN 'infra_error' ELSE outcome END AS outcome FROM scrape_runs)) SELECT mechanism, count(*) AS n FROM (SELECT unnest(list_filter([a, b, c, x], lambda v: v IS NOT NULL)) AS mechanism FROM m) GROUP BY 1", "scrape_runs"))
def mechanism_counts(spark, d):
    runs = fx.scrape_runs(spark, d).withColumn("o", F.when(F.col("outcome") == "escalated", "scrape_failed").when(F.col("outcome") == "invalid_target", "infra_error").otherwise(F.col("outcome")))
    error = F.when(F.col("id") % 2 == 0, "HTTP 429").otherwise("timeout")
    return reports.mechanism_tally(runs.select(reports.mechanisms(F.col("o"), F.col("path"), F.lit("parser"), F.lit(None).cast("string"), error).alias("mechanisms")))


# ---- golden buckets, review and repair ----------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderkey % 2 WHEN 0 THEN NULL ELSE 'x y' END ELSE CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority ELSE trim(o_orderstatus) END END AS value FROM orders")
def correction_values(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.when(k % 2 == 0, " N/A ").otherwise(" x y ")).when(k % 4 == 0, F.element_at(F.array(F.lit("-"), F.lit("None"), F.lit("  ")), (k % 3 + 1).cast("int"))).when(k % 4 == 1, F.col("o_orderpriority")).otherwise(F.concat(F.lit(" "), F.col("o_orderstatus")))
    return fx.read(spark, d, "orders").select(k.alias("id"), repair.correction(raw).alias("value"))


@query("SELECT o_orderkey AS id, 'cs_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS version, least(o_orderkey % 6, 2) AS rung, o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AS absent FROM orders")
def repair_stamps(spark, d):
    k = F.col("o_orderkey")
    missing = F.when(k % 2 == 0, F.array(F.lit("price"))).otherwise(F.array().cast("array<string>"))
    stage = F.when(k % 3 == 0, "gate").otherwise("sandbox")
    return fx.read(spark, d, "orders").select(k.alias("id"), repair.version_stamp(F.col("o_orderdate")).alias("version"), runlog.ladder_step(k % 6, 3).alias("rung"), repair.no_source(stage, missing).alias("absent"))


@query("SELECT o_orderkey AS id, CASE WHEN r >= 1 THEN 'deepseek-v4-pro' ELSE 'deepseek-v4-flash' END AS model, CAST(CASE WHEN r >= 1 THEN 0.3 ELSE 0.1 END AS DOUBLE) AS temperature, r >= 1 AS thinking FROM (SELECT o_orderkey, o_orderkey % 4 AS r FROM orders)")
def model_ladder(spark, d):
    m = repair.ladder_models(F.col("o_orderkey") % 4)
    return fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), m["model"].alias("model"), m["temperature"].alias("temperature"), m["thinking"].alias("thinking"))


@query(
    """WITH a AS (SELECT event_id // 500 AS round, 'u' || CAST(user_id AS VARCHAR) AS url, CASE WHEN event_id = 4200 THEN 'q' WHEN event_type = 'purchase' THEN 'y' ELSE 'n' END AS answer, event_type AS f, event_id FROM events),
    one AS (SELECT round, url, max_by(answer, event_id) AS answer, max_by(f, event_id) AS f FROM a WHERE answer <> 'q' GROUP BY 1, 2),
    l AS (SELECT url, max_by(answer, round) AS answer, max_by(f, round) AS f, max(round) AS round FROM one WHERE round < (SELECT coalesce(min(round), 10) FROM a WHERE answer = 'q') AND round < 10 GROUP BY 1)
    SELECT c.url, CASE WHEN answer = 'y' THEN 'accepted' ELSE 'open' END AS state, CASE WHEN answer = 'n' THEN f ELSE '' END AS fields, round FROM (SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS url FROM events) c LEFT JOIN l USING (url)"""
)
def review_loop(spark, d):
    e = fx.read(spark, d, "events").selectExpr("event_id div 500 AS round", "concat('u', cast(user_id AS string)) AS url", "CASE WHEN event_id = 4200 THEN 'q' WHEN event_type = 'purchase' THEN 'y' ELSE 'n' END AS answer", "event_type AS f", "event_id")
    one = e.where("answer <> 'q'").groupBy("round", "url").agg(F.max_by("answer", "event_id").alias("answer"), F.array(F.max_by("f", "event_id")).alias("fields"))
    quit_ = e.where("answer = 'q'").select("round", F.lit(None).cast("string").alias("url"), "answer", F.lit(None).cast("array<string>").alias("fields"))
    out = repair.review_rounds(e.select("url").distinct(), one.select("round", "url", "answer", "fields").unionByName(quit_))
    return out.withColumn("fields", F.array_join("fields", ","))


@query(fx.sql("#c AS (SELECT row_index, provider_rank, query_idx FROM candidates WHERE result_idx = 0) SELECT row_index, provider_rank, query_idx, row_number() OVER (ORDER BY row_index, provider_rank, query_idx) <= 37 AS allowed FROM c", "candidates"))
def call_budget(spark, d):
    calls = fx.candidates(spark, d).where("result_idx = 0").select("row_index", "provider_rank", "query_idx")
    return cand.within_budget(calls, 37)


@query(fx.sql("SELECT n.task_id AS attempt_id, n.node, 'skipped' AS status, 0 AS duration_ms FROM (SELECT DISTINCT task_id, unnest(['search', 'domain_filter', 'base_match', 'distinguishing', 'aggregate', 'emit']) AS node FROM tasks) n WHERE (n.task_id, n.node) NOT IN (SELECT (task_id, node) FROM node_events WHERE candidates_out > 4)", "node_events", "tasks"))
def skipped_nodes(spark, d):
    tasks = fx.tasks(spark, d).select(F.col("task_id").alias("attempt_id")).distinct()
    reached = fx.node_events(spark, d).where("candidates_out > 4").select(F.col("task_id").alias("attempt_id"), "node").distinct()
    out = views.skipped_events(tasks, reached, ["search", "domain_filter", "base_match", "distinguishing", "aggregate", "emit"])
    return out.select("attempt_id", "node", "status", "duration_ms")


# ---- trace and sinks ----------------------------------------------------------------------------------------------


@query(fx.sql("SELECT run_id, task_id, 1 + event_id % 2 AS attempt_no, row_number() OVER (PARTITION BY run_id, task_id, event_id % 2 ORDER BY event_id) AS seq, node, status FROM node_events", "node_events"))
def trace_flush(spark, d):
    none = F.array().cast("array<struct<model:string,tokens:bigint>>")
    rows = fx.node_events(spark, d).groupBy("run_id", "task_id", (F.col("event_id") % 2).alias("n")).agg(F.array_sort(F.collect_list(F.struct("event_id", "node", "status"))).alias("events"))
    attempt = F.struct("n", F.transform("events", lambda e: F.struct(e["node"].alias("node"), e["status"].alias("status"))).alias("events"), none.alias("llm_calls"), F.transform("events", lambda e: F.struct(e["event_id"].alias("rank"))).alias("candidates"))
    # an attempt that has no events is empty, so the second keeps its number
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<node:string,status:string>>").alias("events"), none.alias("llm_calls"), F.array().cast("array<struct<rank:bigint>>").alias("candidates"))
    nested = rows.groupBy("run_id", "task_id").agg(F.array_sort(F.collect_list(attempt), lambda a, b: (a["n"] - b["n"]).cast("int")).alias("attempts"))
    nested = nested.withColumn("attempts", F.when((F.size("attempts") == 1) & (F.col("attempts")[0]["n"] == 1), F.concat(F.array(empty), "attempts")).otherwise(F.col("attempts")))
    events = views.flush_tasks(nested)["node_events"]
    return events.select("run_id", "task_id", F.col("attempt_no").cast("long").alias("attempt_no"), F.col("seq").cast("long").alias("seq"), "node", "status")


@query(
    fx.sql(
        """SELECT 'node_events' AS relation, run_id, task_id, node, status, count(*) AS n FROM node_events WHERE run_id <> 'run3' GROUP BY ALL
        UNION ALL SELECT 'tasks', run_id, task_id, NULL, verdict, count(*) FROM tasks WHERE run_id <> 'run3' GROUP BY ALL""",
        "node_events",
        "tasks",
    )
)
def atomic_flush(spark, d):
    """Each run flushed as one, one of them twice: it counts once."""
    path = shared_dir(spark, "flush")
    events, tasks = (f(spark, d).drop("ts") for f in (fx.node_events, fx.tasks))
    for run in ("run0", "run1", "run2", "run4", "run1"):
        flush.flush({"node_events": events.where(F.col("run_id") == run), "tasks": tasks.where(F.col("run_id") == run)}, path, run)
    told = [flush.flushed(spark, path, n).groupBy(F.lit(n).alias("relation"), "run_id", "task_id", F.col("node") if n == "node_events" else F.lit(None).cast("string").alias("node"), F.col("status" if n == "node_events" else "verdict").alias("status")).agg(F.count("*").alias("n")) for n in ("node_events", "tasks")]
    return told[0].unionByName(told[1])


@query(fx.sql("SELECT task_id, run_id, NULL::VARCHAR AS product_name, verdict FROM tasks", "tasks"))
def payload_suppressed(spark, d):
    return sinks.suppressed(fx.tasks(spark, d).select("task_id", "run_id", "product_name", "verdict"), ["product_name"], store=False)


_BAD = "CASE row_index % 7 WHEN 0 THEN 'website is missing' WHEN 1 THEN 'country is missing' END"


@query(
    fx.sql(
        f"""SELECT row_index, product_name, error, CASE WHEN error IS NOT NULL THEN 'error' WHEN row_index % 5 = 0 THEN NULL WHEN row_index % 2 = 0 THEN 'match' ELSE 'no_match' END AS match_verdict,
        CASE WHEN error IS NULL AND row_index % 2 = 0 AND row_index % 5 > 0 THEN 'https://x.example/' || CAST(row_index AS VARCHAR) ELSE 'not found' END AS match_url,
        CASE WHEN error IS NOT NULL OR row_index % 5 = 0 THEN '{{}}' ELSE '{{"domain":"pass","brand":' || CASE WHEN row_index % 2 = 0 THEN '"pass"' ELSE 'null' END || ',"numeric":null,"distinguishing":null}}' END AS match_trace,
        CASE WHEN error IS NOT NULL THEN error WHEN row_index % 5 > 0 THEN 'because' END AS match_reason FROM (SELECT row_index, product_name, {_BAD} AS error FROM sku_tasks)""",
        "sku_tasks",
    )
)
def enriched_workbook(spark, d):
    rows = fx.sku_tasks(spark, d).select("row_index", "product_name", F.expr(_BAD).alias("error"))
    even = F.col("row_index") % 2 == 0
    none = F.lit(None).cast("string")
    got = rows.where("row_index % 5 > 0").select("row_index", F.when(even, "match").otherwise("no_match").alias("verdict"), F.when(even, F.concat(F.lit("https://x.example/"), F.col("row_index").cast("string"))).alias("matched_url"), F.lit("pass").alias("v_domain"), F.when(even, "pass").alias("v_brand"), none.alias("v_numeric"), none.alias("v_distinguishing"), F.lit("because").alias("reason"))
    return sinks.enriched(rows, got)


@query(fx.sql("SELECT id, url, CASE WHEN outcome = 'escalated' THEN 'resolved' ELSE outcome END AS outcome, CASE WHEN outcome = 'escalated' THEN 'human' ELSE path END AS path FROM scrape_runs WHERE outcome <> 'invalid_target'", "scrape_runs"))
def point_changes(spark, d):
    runs = fx.scrape_runs(spark, d)
    changed = sinks.updated(runs, runs.where("outcome = 'escalated'"), {"outcome": "resolved", "path": "human"})
    return sinks.deleted(changed, runs.where("outcome = 'invalid_target'")).select("id", "url", "outcome", "path")


@query(
    fx.sql(
        """SELECT 'parsers' AS relation, site, count(*) AS n, 0 AS without_parser, (SELECT count(*) FROM parsers WHERE site = 's1') AS gone FROM parsers WHERE site <> 's1' GROUP BY 2
        UNION ALL SELECT 'goldens', site, count(*), 0, (SELECT count(*) FROM goldens WHERE site = 's1') FROM goldens WHERE site <> 's1' GROUP BY 2
        UNION ALL SELECT 'scrape_runs', site, count(*), count_if(winning_parser_id IS NULL OR winning_parser_id IN (SELECT id FROM parsers WHERE site = 's1')), (SELECT count(*) FROM scrape_runs WHERE site = 's1') FROM scrape_runs WHERE site <> 's1' GROUP BY 2""",
        "scrape_runs", "parsers", "goldens",
    )
)
def site_cleared(spark, d):
    tables = {"parsers": fx.parsers(spark, d), "scrape_runs": fx.scrape_runs(spark, d), "goldens": fx.goldens(spark, d)}
    left, gone = sinks.clear_site(tables, "s1")
    out = None
    for name, df in left.items():
        lacks = F.count_if(F.col("winning_parser_id").isNull()) if name == "scrape_runs" else F.lit(0).cast("long")
        one = df.groupBy("site").agg(F.count("*").alias("n"), lacks.alias("without_parser")).select(F.lit(name).alias("relation"), "site", "n", "without_parser", F.lit(gone[name]).cast("long").alias("gone"))
        out = one if out is None else out.unionByName(one)
    return out


@query(fx.sql("SELECT id, site, NULL::VARCHAR AS note, NULL::BIGINT AS retries FROM scrape_runs", "scrape_runs"))
def schema_evolved(spark, d):
    return sinks.evolved(fx.scrape_runs(spark, d).select("id", "site"), "id long, note string, retries long")


@query(fx.sql("SELECT id, site, outcome, CASE WHEN site = 's2' THEN 'second' ELSE 'first' END AS batch FROM scrape_runs UNION ALL SELECT id, site, outcome, 'log' FROM scrape_runs WHERE site <> 's2'", "scrape_runs"))
def appended_log(spark, d):
    """Two appends, then one site's partition written over."""
    runs = fx.scrape_runs(spark, d).select("id", "site", "outcome")
    path = shared_dir(spark, "log")
    sinks.append(runs.withColumn("batch", F.lit("first")), path, "site")
    sinks.append(runs.withColumn("batch", F.lit("log")), path, "site")
    sinks.overwrite_partitions(runs.where("site = 's2'").withColumn("batch", F.lit("second")), path, "site")
    return spark.read.parquet(path).select("id", "site", "outcome", "batch")


@query(
    """SELECT user_id, n, latest, CASE WHEN user_id % 9 = 5 THEN 'stale' ELSE 'open' END AS status FROM (
        SELECT user_id, count(*) FILTER (WHERE event_id % 2 = 0 OR user_id % 4 = 1) AS n, max(event_id) FILTER (WHERE event_id % 2 = 0 OR user_id % 4 = 1) AS latest FROM events GROUP BY 1)
    WHERE n > 0 AND user_id % 11 <> 7"""
)
def changed_in_place(spark, d):
    """Counters by user: made from every other event, the others' added for some users, some marked, some deleted."""
    e = fx.read(spark, d, "events").select("user_id", "event_id")
    counted = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("latest"), F.lit("open").alias("status"))
    table = versions.Versioned(spark, shared_dir(spark, "counters"), ["user_id"], 16)
    table.create(counted(e.where("event_id % 2 = 0")))
    table.upsert(counted(e.where("event_id % 2 = 1 AND user_id % 4 = 1")), {"n": lambda old, new: old + new, "latest": F.greatest})
    users = e.select("user_id").distinct()
    table.update(users.where("user_id % 9 = 5"), {"status": "stale"})
    table.delete(users.where("user_id % 11 = 7"))
    return table.rows()


# ---- sources ------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS row_index, trim(coalesce(CASE WHEN p_partkey % 11 > 0 THEN p_name END, 'nan')) AS product_name, CASE p_partkey % 4 WHEN 0 THEN 'tesco' WHEN 1 THEN NULL ELSE 'argos' END AS website, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'uk' END AS country, CASE WHEN p_partkey % 4 = 1 THEN 'website is missing' WHEN p_partkey % 6 = 0 THEN 'country is missing' END AS error FROM part")
def workbook_rows(spark, d):
    k = F.col("p_partkey")
    df = fx.read(spark, d, "part").select(k, F.when(k % 11 > 0, F.concat(F.lit(" "), F.col("p_name"))).alias("sku"), F.when(k % 4 == 0, " Tesco ").when(k % 4 == 1, F.when(k % 8 == 1, "NaN").otherwise("  ")).otherwise("ARGOS").alias("web"), F.when(k % 6 > 0, "UK").alias("land"))
    return recorded.sku_rows(df, "sku", "web", "land", "p_partkey")


@query(fx.sql("SELECT string_agg(website, ', ' ORDER BY i) AS websites FROM (SELECT website, min(row_index) AS i FROM sku_tasks GROUP BY 1)", "sku_tasks"))
def website_list(spark, d):
    return recorded.website_summary(fx.sku_tasks(spark, d))


def _coldstart(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "Standard").when(k % 5 == 1, " discounted").when(k % 5 == 2, "mystery").when(k % 5 == 3, "multipack")
    return fx.read(spark, d, "part").select(k.alias("Row Index"), kind.alias(" Page-Type"), F.when(k % 3 > 0, F.concat(F.lit(" https://x.example/"), k.cast("string"))).alias("URL"), F.lit("late").alias("page type"))


_COLD = "SELECT p_partkey AS row_index, CASE p_partkey % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'discounted' WHEN 2 THEN 'mystery' WHEN 3 THEN 'multipack' END AS page_type, CASE WHEN p_partkey % 3 > 0 THEN 'https://x.example/' || CAST(p_partkey AS VARCHAR) END AS url FROM part"


@query(f"SELECT *, CASE WHEN url IS NULL THEN 'url is missing' WHEN page_type IS NULL THEN 'page type is missing' WHEN page_type = 'mystery' THEN 'page type is unknown' END AS problem FROM ({_COLD}) WHERE page_type IS NOT NULL OR url IS NOT NULL")
def coldstart_rows(spark, d):
    return recorded.coldstart_rows(_coldstart(spark, d), "row_index")[0]


@query(f"SELECT m AS page_type FROM (SELECT unnest(['standard', 'discounted', 'out_of_stock', 'membership']) AS m) WHERE m NOT IN (SELECT page_type FROM ({_COLD}) WHERE url IS NOT NULL AND page_type IS NOT NULL)")
def coldstart_missing(spark, d):
    return recorded.coldstart_rows(_coldstart(spark, d), "row_index", "tesco")[1]


@query("SELECT 'l' || CAST(page_id % 4 AS VARCHAR) AS label, url, CASE WHEN page_id % 2 = 0 THEN 'given.example' ELSE lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) END AS host FROM pages")
def report_url_rows(spark, d):
    k = F.col("page_id")
    return recorded.report_urls(fx.read(spark, d, "pages").select(F.concat(F.lit("l"), (k % 4).cast("string")).alias("label"), "url", F.when(k % 2 == 0, "given.example").otherwise("  ").alias("host")))


@query("SELECT b AS brand, row_number() OVER (ORDER BY -length(b), lower(b), b) AS position, length(b) >= 4 AND regexp_matches(b, '[A-Za-z]') AS fuzzy_safe FROM (SELECT DISTINCT trim(b) AS b FROM (SELECT p_brand AS b FROM part UNION ALL SELECT substr(p_type, 1, 3) FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT ' ')) WHERE b <> ''")
def brand_dictionary(spark, d):
    part = fx.read(spark, d, "part")
    names = part.select(F.col("p_brand").alias("b")).unionAll(part.select(F.substring("p_type", 1, 3))).unionAll(part.select(F.col("p_size").cast("string"))).unionAll(spark.createDataFrame([(" ",), (None,)], "b string"))
    return brands.positions(brands.dictionary(names, "b")).select(F.col("name").alias("brand"), "position", "fuzzy_safe")


@query("SELECT 'tallygrain_nation' AS relation, count(*) AS n FROM nation UNION ALL SELECT 'tallygrain_region', count(*) FROM region UNION ALL SELECT 'tallygrain_supplier', count(*) FROM supplier")
def catalog_counts(spark, d):
    names = ["region", "nation", "supplier"]
    for t in names:
        fx.read(spark, d, t).createOrReplaceTempView(f"tallygrain_{t}")
    return recorded.table_counts(spark, [f"tallygrain_{t}" for t in names]).withColumnRenamed("table", "relation")


@query(fx.sql("#q AS (SELECT DISTINCT 'duckduckgo' AS provider, product_name AS query FROM sku_tasks) SELECT q.provider, q.query, c.result_idx, c.title, c.url FROM q JOIN candidates c ON c.product_name = q.query AND c.provider_rank = 0 AND c.query_idx = 0 WHERE c.result_idx < 4 AND c.k % 3 > 0", "sku_tasks", "candidates"))
def recorded_results(spark, d):
    asked = fx.sku_tasks(spark, d).select(F.lit("duckduckgo").alias("provider"), F.col("product_name").alias("query")).distinct()
    # results without a title are dropped after the first k
    rows = fx.candidates(spark, d).where("provider_rank = 0 AND query_idx = 0").select(F.lit("duckduckgo").alias("provider"), F.col("product_name").alias("query"), "result_idx", F.when(F.col("k") % 3 > 0, F.col("title")).otherwise("").alias("title"), "url")
    return cand.top_k(recorded.recorded_search(asked, rows), 4)


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 200 WHEN page_id % 3 = 1 THEN 404 END AS status, CASE WHEN page_id % 3 = 0 THEN 'golden' WHEN page_id % 3 = 1 THEN 'fetched' ELSE 'none' END AS origin,
    CASE WHEN page_id % 3 = 0 THEN length(html) + 3 WHEN page_id % 3 = 1 THEN length(html) END AS n FROM pages"""
)
def html_resolved(spark, d):
    p = fx.read(spark, d, "pages").withColumn("url", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))
    goldens = p.where("page_id % 3 = 0").select("url", F.col("page_id").alias("id"), F.lit("old").alias("html_snapshot"))
    goldens = goldens.unionByName(p.where("page_id % 3 = 0").select("url", (F.col("page_id") + 10**9).alias("id"), F.concat(F.lit("new"), F.col("html")).alias("html_snapshot")))
    out = recorded.resolve_html(p.select("page_id", "url"), goldens, p.where("page_id % 3 <> 2").select("url", F.lit(404).alias("status"), "html"))
    return out.select("page_id", "status", "origin", F.length("html").cast("long").alias("n"))


@query("SELECT site, url FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY length(html) DESC, page_id) AS n FROM (SELECT 's' || CAST(page_id % 5 AS VARCHAR) AS site, * FROM pages) WHERE page_id % 4 > 0) WHERE n = 1")
def largest_pages(spark, d):
    p = fx.read(spark, d, "pages").withColumn("site", F.concat(F.lit("s"), (F.col("page_id") % 5).cast("string")))
    p = p.withColumns({"status": F.when(F.col("page_id") % 4 > 0, 200).otherwise(500), "idx": F.col("page_id")})
    return recorded.representative_page(p).select("site", "url")


@query(
    "SELECT string_agg(code, ', ' ORDER BY code) AS codes, name, region, gl FROM (VALUES "
    + ", ".join(f"({i}, '{c}', '{config.COUNTRY_NAMES[c]}', '{config.DDG_REGION[c]}', '{config.SERPER_GL[c]}')" for i, c in enumerate(config.DDG_REGION))
    + f") t(k, code, name, region, gl) WHERE k IN (SELECT n_nationkey % {len(config.DDG_REGION)} FROM nation) GROUP BY 2, 3, 4"
)
def country_table(spark, d):
    """Of the countries that the nations stand for."""
    known = list(config.DDG_REGION)
    code = F.element_at(F.array(*map(F.lit, known)), (F.col("n_nationkey") % len(known) + 1).cast("int"))
    names = F.create_map(*[F.lit(x) for c in known for x in (c, config.COUNTRY_NAMES[c])])
    codes = fx.read(spark, d, "nation").select(code.alias("code")).distinct().withColumn("name", F.element_at(names, F.col("code")))
    return reports.country_rows(codes.select("code", "name", urls.search_region(F.col("code")).alias("region"), urls.search_gl(F.col("code")).alias("gl"))).select("codes", "name", "region", "gl")
