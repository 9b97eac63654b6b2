import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallygrain.operators import candidates as cand, runlog
from tallygrain.plans import reports, views
from tallygrain.sources import recorded, sinks


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


RUNS = "id long, url string, site string, outcome string, winning_parser_id long, scraped_at timestamp"


def test_dedup_window(spark):
    rows = [(1, "a", "s", "scrape_failed", None, at(0)), (2, "a", "s", "success", 1, at(10)), (3, "a", "s", "success", 1, at(20)), (4, "a", "s", "success", 1, at(3700)), (5, "a", "s", "success", 1, at(3800)), (6, "b", "s", "success", 1, at(21)), (7, "a", "s", "scrape_failed", None, at(30))]
    df = spark.createDataFrame(rows, RUNS)
    assert sorted(r.id for r in runlog.dedup_successes(df).collect()) == [1, 2, 4, 6, 7]
    assert runlog.dedup_successes(df.limit(0)).count() == 0


def test_parser_order_and_prunes(spark):
    parsers = spark.createDataFrame([("s", 1, "active"), ("s", 2, "active"), ("s", 3, "active"), ("s", 4, "retired"), ("t", 5, "active")], "site string, id long, status string")
    runs = spark.createDataFrame([(i, "u", "s", "success", 2 if i < 5 else 1, at(i)) for i in range(7)], RUNS)
    order = runlog.parsers_by_hits(parsers, runs).orderBy("site", "position").collect()
    assert [(r.site, r.id, r.hits) for r in order] == [("s", 2, 5), ("s", 1, 2), ("s", 3, 0), ("t", 5, 0)]
    cap = spark.createDataFrame([("s", i, "active") for i in range(1, 5)], "site string, id long, status string")
    hits = spark.createDataFrame([(i, "u", "s", "success", 2 if i < 3 else 4, at(i)) for i in range(13)], RUNS)
    assert [(r.site, r.id) for r in runlog.prune_hard_cap(cap, hits).collect()] == [("s", 1)]
    assert runlog.prune_hard_cap(parsers, runs).count() == 0
    wins = [1] * 60 + [2] + [1] * 60
    history = spark.createDataFrame([(i, "u", "s", "success", p, at(i)) for i, p in enumerate(wins)], RUNS)
    assert [r.id for r in runlog.prune_stale(parsers, history, 50).collect()] == [2]


@pytest.mark.parametrize(("bad", "good", "surge"), [(25, 5, True), (2, 100, False), (2, 1, False), (2, 3, True)])
def test_surge(spark, bad, good, surge):
    rows = [(i, "u", "s", "invalid_target" if i < bad else "success", None, at(i)) for i in range(bad + good)] + [(999, "u", "s", "invalid_target", None, at(-90000))]
    got = runlog.count_window(spark.createDataFrame(rows, RUNS), F.lit(at(3600))).withColumn("x", runlog.is_surge(F.col("total"), F.col("invalid"))).first()
    assert (got.total, got.invalid, got.x) == (bad + good, bad, surge)


def test_goldens(spark):
    rows = [(1, "s", "standard", False, "human", 1, 10), (2, "s", "standard", True, "human", 9, 10), (3, "s", "standard", False, "auto", 2, 10), (4, "s", "standard", False, "auto", 8, 10), (5, "s", "multipack", True, "auto", 1, 10)]
    df = spark.createDataFrame(rows, "id long, site string, page_type string, is_stale boolean, created_by string, captured_at long, snapshot_bytes long")
    plan, evict = runlog.prune_plan(df, 1, 2)
    assert sorted(r.id for r in evict.collect()) == [2, 3]
    assert {r.page_type: (r.delete_count, r.under_coverage) for r in plan.collect()} == {"standard": (2, False), "multipack": (0, True)}
    have = spark.createDataFrame([("s", "standard", "u1")], "site string, page_type string, url string")
    new = spark.createDataFrame([("s", "standard", "u1", 1), ("s", "standard", "u2", 2), ("s", "standard", "u2", 3), ("s", "standard", "u3", 4), ("s", "standard", "u4", 5)], "site string, page_type string, url string, id long")
    assert [r.url for r in runlog.seed_goldens(have, new, 3).orderBy("id").collect()] == ["u2", "u3"]
    need = spark.createDataFrame([("s", "standard", 2), ("s", "discounted", 1), ("s", "multipack", 0)], "site string, page_type string, least int")
    assert sorted((r.page_type, r.n) for r in runlog.coverage_shortfall(need, runlog.coverage(df.where("id = 1"))).collect()) == [("discounted", 0), ("standard", 1)]
    exam = spark.createDataFrame([("s", 1, None), ("s", 2, "price"), ("t", 3, None)], "site string, golden_id int, mismatch string")
    assert {r.site: r.promote for r in runlog.golden_exam(exam).collect()} == {"s": False, "t": True}
    control = spark.createDataFrame([(1, True), (1, False), (3, False)], "golden_id long, passed boolean")
    assert sorted(r.id for r in runlog.stale_goldens(df, control).collect()) == [2, 3, 4, 5]


def test_escalations(spark):
    none = spark.createDataFrame([], "signature string, reason string, affected_count long, snapshot string, status string, first_seq long")
    news = lambda rows: spark.createDataFrame(rows, "signature string, reason string, snapshot string, seq long")
    one = runlog.upsert_escalations(none, news([("a", "r1", "x", 1), ("a", "r2", "y", 2), ("b", "r", "z", 3)]))
    two = runlog.upsert_escalations(one.withColumn("status", F.when(F.col("signature") == "a", "resolved").otherwise(F.col("status"))), news([("a", "r3", "w", 4), ("c", "r", "v", 5)]))
    assert sorted(tuple(r)[:5] for r in two.collect()) == [("a", "r1", 3, "x", "resolved"), ("b", "r", 1, "z", "open"), ("c", "r", 1, "v", "open")]


def test_small_lifecycle(spark):
    tried = spark.createDataFrame([("u", 0, 5, False, None, "boom"), ("u", 1, 6, True, "blob", None), ("u", 2, 7, True, None, None), ("u", 3, 8, True, None, None), ("v", 0, 5, False, None, "x")], "url string, position int, parser_id int, ok boolean, distrust string, error string")
    assert {r.url: (r.winner, r.errors) for r in runlog.first_passing_parser(tried).collect()} == {"u": (7, ["boom", "blob"]), "v": (None, ["x"])}
    rounds = spark.createDataFrame([("s", 0, True), ("s", 1, False), ("s", 2, True), ("s", 3, True)], "site string, round int, empty boolean")
    assert [r["round"] for r in runlog.empty_twice(rounds).where("abort").collect()] == [3]
    assert [r.x for r in spark.range(4).select(runlog.ladder_step(F.col("id"), 2).alias("x")).collect()] == [0, 1, 1, 1]
    book = spark.createDataFrame([("u", 0, ["b", "a"], None), ("u", 1, ["c"], ["a"]), ("v", 0, ["a"], None), ("v", 1, None, ["a"])], "url string, round int, reported array<string>, resolved array<string>")
    assert [(r.url, r.open) for r in runlog.ledger(book).collect()] == [("u", ["b", "c"])]


RESULT = "row_index int, website string, query_idx int, result_idx int, title string, url string"


def test_candidates(spark):
    rows = [(1, "tesco", 0, 0, "first", "https://www.tesco.com/products/1?srsltid=a"), (1, "tesco", 1, 0, "second", "https://www.tesco.com/products/1?srsltid=b"), (1, "tesco", 1, 1, "gallery", "https://www.tesco.com/gallery"), (1, "tesco", 1, 2, "foreign", "https://x.org/products/1"), (2, "nowhere", 0, 0, "x", "https://y.org")]
    ranked = cand.rank_candidates(spark.createDataFrame(rows, RESULT), ["row_index"])
    got = cand.domain_verdicts(ranked).orderBy("row_index", "rank").collect()
    assert [(r.row_index, r["rank"], r.title, r.v_domain, r.reject) for r in got] == [(1, 1, "first", "pass", None), (1, 2, "gallery", "fail", "not_product_page"), (1, 3, "foreign", "fail", "host"), (2, 1, "x", "fail", "host")]
    top = spark.createDataFrame([(0, "t", "u"), (1, "", "u"), (2, "t", "u")], "result_idx int, title string, url string")
    assert [r.result_idx for r in cand.top_k(top, 2).collect()] == [0]


def test_task_results(spark):
    schema = "row_index int, url string, rank int, v_domain string, v_brand string, v_numeric string, v_distinguishing string"
    rows = [(1, "a", 1, "pass", "pass", "pass", "fail"), (1, "b", 2, "pass", "pass", "unknown", "pass"), (2, "c", 1, "fail", None, None, None), (2, "d", 2, "pass", "fail", None, None), (2, "e", 3, "pass", "unknown", None, None)]
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "row_index int")
    got = {r.row_index: r for r in cand.task_results(tasks, spark.createDataFrame(rows, schema), ["row_index"]).collect()}
    assert (got[1].verdict, got[1].matched_url) == ("match", "b")
    assert (got[2].verdict, got[2].v_brand, got[2].considered) == ("no_match", "fail", 2 + 1)
    assert (got[3].verdict, got[3].considered, got[3].v_domain, got[3].reason) == ("no_match", 0, None, "no search results")
    attempts = spark.createDataFrame([(1, 0, "d", "no_match", ""), (1, 1, "s", "match", "ok"), (2, 0, "d", "match", ""), (2, 1, "s", "match", ""), (3, 0, "d", "no_match", "x")], "row_index int, provider_rank int, provider string, verdict string, reason string")
    chain = {r.row_index: (r.final_provider, r.attempts_run, r.reason) for r in cand.provider_chain(attempts, ["row_index"]).collect()}
    assert chain == {1: ("s", 2, "ok (via s)"), 2: ("d", 1, "(via d)"), 3: ("d", 1, "x")}
    b, n, alive = cand.base_verdicts(F.lit("fail"), F.lit("pass"), F.lit("pass"))
    assert tuple(spark.range(1).select(b, n, alive).first()) == ("fail", None, False)
    x = cand.apply_decision(F.lit(True), F.col("id"), F.lit(1), F.lit(False), F.lit(3))
    assert [r[0] for r in spark.range(3).select(x).collect()] == ["fail", "pass", "fail"]
    calls = spark.createDataFrame([(2, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0)], "row_index int, provider_rank int, query_idx int")
    assert sorted((r.row_index, r.provider_rank, r.query_idx) for r in cand.within_budget(calls, 2).where("allowed").collect()) == [(1, 0, 0), (1, 0, 1)]
    assert cand.within_budget(calls, 0).where("allowed").count() == 0


def test_failure_cascade(spark):
    off = dict(is_error=False, is_match=False, domain_missing=False, llm_parse=False, llm_error=False, budget=False, provider_error=False, n_candidates=5, n_domain=3, n_base=2, n_numeric_fail=1, llm_ok=True)
    cases = [({"is_error": True, "is_match": True}, "unknown_error"), ({"is_match": True}, "matched"), ({"domain_missing": True, "llm_parse": True}, "domain_map_missing"), ({"llm_parse": True, "llm_error": True}, "llm_parse_error"), ({"llm_error": True}, "llm_error"), ({"budget": True}, "budget_exhausted"), ({"provider_error": True, "n_candidates": 0}, "provider_error"), ({"n_candidates": 0}, "no_search_results"), ({"n_domain": 0}, "all_domain_filtered"), ({"n_base": 0}, "numeric_mismatch"), ({"n_base": 0, "n_numeric_fail": 0}, "brand_mismatch"), ({}, "llm_no_match"), ({"llm_ok": False}, "unknown_error")]
    for change, want in cases:
        assert spark.range(1).select(views.failure_kind({k: F.lit(v) for k, v in (off | change).items()}).alias("x")).first().x == want


def test_reports(spark):
    one = lambda rows: reports.latency_stats(spark.createDataFrame([(x,) for x in rows], "latency_ms long")).first()
    assert tuple(one([4, 1, 3, 2])) == (2, 3, 4, 1, 4, 10)
    assert tuple(one([5] * 10 + [7] * 10)) == (6, 7, 7, 5, 7, 120)
    df = spark.createDataFrame([("a", "success"), ("a", "zzz"), ("b", None)], "label string, outcome string")
    assert {r.label: (r.total, r.success, r.other) for r in reports.outcome_crosstab(df, "label").collect()} == {"a": (2, 1, 1), "b": (1, 0, 1), "TOTAL": (3, 1, 2)}
    m = reports.mechanisms(F.lit("infra_error"), F.lit(None).cast("string"), F.lit("api"), F.lit(None).cast("string"), F.lit("HTTP 429"))
    assert spark.range(1).select(m.alias("x")).first().x == ["infra alert: rate limit", "no run record"]
    codes = spark.createDataFrame([("uk", "United Kingdom", "uk-en", "gb"), ("gb", "United Kingdom", "uk-en", "gb"), ("de", "Germany", "de-de", "de")], "code string, name string, region string, gl string")
    assert sorted(r.codes for r in reports.country_rows(codes).collect()) == ["de", "gb, uk"]


def test_trace_tables(spark):
    nested = spark.createDataFrame([(1, "r", [("p", [("search", 3)], [("u1",), ("u2",)], []), ("q", [], [], [("ok",)])])], "task_id int, run_id string, attempts array<struct<provider:string,events:array<struct<node:string,n:int>>,candidates:array<struct<url:string>>,llm_calls:array<struct<status:string>>>>")
    t = views.flush_tasks(nested)
    assert {k: v.count() for k, v in t.items()} == {"tasks": 1, "attempts": 2, "node_events": 1, "candidates": 2, "llm_calls": 1}
    assert [(r.attempt_no, r.provider) for r in t["attempts"].orderBy("attempt_no").collect()] == [(1, "p"), (2, "q")]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(0, "Tea", " Tesco ", "UK"), (1, None, "argos", None), (2, "x", None, "de")], "i int, sku string, web string, country string")
    df.write.parquet(str(tmp_path / "w"))
    with pytest.raises(KeyError, match="columns not found: nope"):
        recorded.read_workbook(spark, str(tmp_path / "w"), ["sku", "nope"])
    rows = recorded.sku_rows(recorded.read_workbook(spark, str(tmp_path / "w"), ["sku"]), "sku", "web", "country", "i")
    assert [(r.product_name, r.website, r.error) for r in rows.orderBy("row_index").collect()] == [("Tea", "tesco", None), ("nan", "argos", "country is missing"), ("x", None, "website is missing")]
    assert recorded.website_summary(rows).first().websites == "tesco, argos"
    results = spark.createDataFrame([(0, "match", "u", "pass", "pass", None, "pass", "")], "row_index int, verdict string, matched_url string, v_domain string, v_brand string, v_numeric string, v_distinguishing string, reason string")
    out = {r.row_index: (r.match_verdict, r.match_url, r.match_trace) for r in sinks.enriched(rows, results).collect()}
    assert out[0] == ("match", "u", '{"domain":"pass","brand":"pass","numeric":null,"distinguishing":"pass"}') and out[1] == ("error", "not found", "{}")
    cold = spark.createDataFrame([(0, "Standard", "u"), (1, "x", "v"), (2, "standard", None), (3, None, None)], "n int, `Page Type` string, url string")
    got, missing = recorded.coldstart_rows(cold, "n", "argos")
    assert [r.problem for r in got.orderBy("row_index").collect()] == [None, "page type is unknown", "url is missing"] and [r.page_type for r in missing.collect()] == ["discounted"]
    golden = spark.createDataFrame([("u", "old", 1), ("u", "new", 2)], "url string, html_snapshot string, id int")
    fetched = spark.createDataFrame([("v", 200, "f"), ("u", 200, "g")], "url string, status int, html string")
    asked = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    assert {r.url: (r.html, r.origin) for r in recorded.resolve_html(asked, golden, fetched).collect()} == {"u": ("new", "golden"), "v": ("f", "fetched"), "w": (None, "none")}
    pages = spark.createDataFrame([("s", 0, 200, "a", "xx"), ("s", 1, 200, "b", "yy"), ("s", 2, 404, "c", "zzzz")], "site string, idx int, status int, url string, html string")
    assert recorded.representative_page(pages).first().url == "a"
    assert recorded.provider_chain(["duckduckgo", "serper"]) == [(0, "duckduckgo"), (1, "serper")]
    with pytest.raises(ValueError):
        recorded.provider_chain("zzz")
    recorded.PARSERS.update(good=lambda h, u: {"n": len(h)}, bad=lambda h, u: 1 / 0)
    tried = recorded.run_parsers(spark.createDataFrame([("u", "abc")], "url string, html string"), ["bad", "good"]).orderBy("position").collect()
    assert [(r.ok, r.output, r.error) for r in tried] == [(False, None, "ZeroDivisionError: division by zero"), (True, '{"n": 3}', None)]


def test_search_source(spark):
    def fake(query, k, country):
        return [(f"{query} {i}", f"https://e.org/{i}", "") for i in range(k)] + [("", "https://no.title", "")]

    recorded.PROVIDERS["fake"] = fake
    spark.dataSource.register(recorded.search_source("fake"))
    df = spark.read.format("tallygrain_fake").option("queries", "tea\npen").option("k", "2").load()
    assert sorted((r.query, r.result_idx, r.title) for r in df.collect()) == [("pen", 0, "pen 0"), ("pen", 1, "pen 1"), ("tea", 0, "tea 0"), ("tea", 1, "tea 1")]


def test_sinks(spark, tmp_path):
    parsers = spark.createDataFrame([("s", 1), ("t", 2)], "site string, id long")
    runs = spark.createDataFrame([("s", 1, 1), ("t", 2, 1), ("t", 3, 2)], "site string, id long, winning_parser_id long")
    out, gone = sinks.clear_site({"parsers": parsers, "scrape_runs": runs}, "s")
    assert gone == {"parsers": 1, "scrape_runs": 1} and sorted((r.id, r.winning_parser_id) for r in out["scrape_runs"].collect()) == [(2, None), (3, 2)]
    assert sorted(tuple(r) for r in sinks.updated(parsers, parsers.where("id = 1"), {"site": "x"}).collect()) == [("t", 2), ("x", 1)]
    assert [r.id for r in sinks.deleted(parsers, parsers.where("id = 1")).collect()] == [2]
    assert sinks.evolved(parsers, "site string, mode string").columns == ["site", "id", "mode"]
    sinks.append(parsers, str(tmp_path / "t"), "site")
    sinks.overwrite_partitions(parsers.where("site = 's'").withColumn("id", F.lit(9).cast("long")), str(tmp_path / "t"), "site")
    assert sorted((r.site, r.id) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("s", 9), ("t", 2)]
    assert sinks.inject_region("a<!-- BEGIN x -->old<!-- END x -->b", "x", " new ") == "a<!-- BEGIN x -->\nnew\n<!-- END x -->b"
    assert sinks.markdown_table(parsers.orderBy("id")) == "| site | id |\n| --- | --- |\n| s | 1 |\n| t | 2 |"
    assert sinks.suppressed(parsers, ["site"], False).where("site IS NOT NULL").count() == 0


def test_model_calls(spark):
    from tallygrain.operators import repair

    tasks = spark.createDataFrame([(1, "Tea", ["Tetley"], {"count": 4.0, "abv_percent": 3.9})], "row_index int, product_name string, brands array<string>, numerics map<string,double>")
    alive = spark.createDataFrame([(1, 1, "b", "u2", None, [], {}), (1, 0, "a", "u1", "s\nt", ["X"], {"volume_ml": 330.0})], "row_index int, llm_index int, title string, url string, snippet string, brands array<string>, numerics map<string,double>")
    text = repair.match_prompts(tasks, alive).first().prompt
    assert text == "Query:\n  title: Tea\n  brand: [Tetley]\n  numeric: {abv_percent=3.9, count=4}\n\nCandidates:\n  [0] title: a\n      url: u1\n      brand: [X] | numeric: {volume_ml=330}\n      snippet: s t\n  [1] title: b\n      url: u2\n      brand: [] | numeric: {}"
    rows = spark.createDataFrame([(1, True, 0), (1, True, 1), (1, False, None), (2, True, 0), (3, True, 0)], "row_index int, alive boolean, llm_index int")
    replies = spark.createDataFrame([(1, '{"match_idx": 1}'), (2, '{"match_idx": 7}')], "row_index int, reply string")
    got = [(r.row_index, r.llm_index, r.v_distinguishing) for r in repair.decided(rows, replies).orderBy("row_index", "llm_index").collect()]
    assert got == [(1, None, None), (1, 0, "fail"), (1, 1, "pass"), (2, 0, "fail"), (3, 0, "fail")]
    assert [tuple(r.x) for r in spark.range(3).select(repair.ladder_models(F.col("id")).alias("x")).collect()] == [("deepseek-v4-flash", 0.1, False), ("deepseek-v4-pro", 0.3, True), ("deepseek-v4-pro", 0.3, True)]
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    answers = spark.createDataFrame([(0, "a", "n", ["price"]), (0, "b", "n", ["title"]), (1, "a", "y", None), (2, None, "q", None), (3, "b", "y", None)], "round int, url string, answer string, fields array<string>")
    assert {r.url: (r.state, r.fields) for r in repair.review_rounds(cases, answers).collect()} == {"a": ("accepted", []), "b": ("open", ["title"]), "c": ("open", [])}
    assert [r[0] for r in spark.createDataFrame([(" N/A ",), (" x ",), ("-",)], "v string").select(repair.correction(F.col("v"))).collect()] == [None, "x", None]
    assert spark.range(1).select(repair.version_stamp(F.lit(at(1))).alias("x")).first().x == "cs_20240101_000001"


def test_chat_clients_are_made_once():
    from tallygrain.operators import repair

    made = []
    repair.CLIENTS.update(qwen=lambda *a: made.append(a) or a, deepseek=lambda *a: ("deepseek", *a))
    try:
        first = repair.chat_client("qwen/other", 0.2)
        assert first is repair.chat_client("qwen/other", 0.2) and made == [("other", 0.2, False)]
        assert repair.chat_client("deepseek-v4-pro")[0] == "deepseek" and repair.chat_client("unheard-of", 0.2) == ("unheard-of", 0.2, False)
        del repair.CLIENTS["deepseek"]
        with pytest.raises(KeyError):
            repair.chat_client("deepseek-v4-pro", 0.9)
    finally:
        repair.CLIENTS.clear()
        repair._made.clear()
