"""Run-log and parser life cycle: windows, prunes, seeds, upserts, exams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain import config

C = config.ScrapingConfig()


def dedup_successes(runs: DataFrame, seconds: int = C.dedup_seconds) -> DataFrame:
    """Runs as they are recorded: a success within the window of the last recorded success of its URL is left out.

    Only recorded successes reset the window, so it is a fold over a URL's successes in order of time. They stream past in
    that order, and all that is held is the time of the last one recorded. Successes without a time count as the oldest.
    """
    import numpy as np
    import pyarrow as pa

    gap = seconds * 1_000_000

    def run(batches):
        url, last = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            own, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (u, t) in enumerate(zip(own, at)):
                if i == 0 and last is None or u != url or t - last >= gap:
                    keep[i], url, last = True, u, t
            yield pa.record_batch([batch.column(2).filter(pa.array(keep))], ["id"])

    micros = F.coalesce(F.unix_micros(F.col("scraped_at").cast("timestamp")), F.lit(-(1 << 62)))
    ok = runs.where("outcome = 'success'").select("url", micros.alias("t"), F.col("id").cast("long").alias("id"))
    kept = ok.repartition("url").sortWithinPartitions("url", "t", "id").mapInArrow(run, "id long")
    return runs.where("outcome <> 'success'").unionByName(runs.join(kept, "id", "left_semi").select(runs.columns))


def hit_rates(runs: DataFrame) -> DataFrame:
    return runs.where("outcome = 'success' AND winning_parser_id IS NOT NULL").groupBy("site", "winning_parser_id").agg(F.count("*").alias("hits"))


def parsers_by_hits(parsers: DataFrame, runs: DataFrame) -> DataFrame:
    """Active parsers of each site with their order: most hits first, then the newest."""
    hits = hit_rates(runs).select("site", F.col("winning_parser_id").alias("id"), "hits")
    rows = parsers.where("status = 'active'").join(hits, ["site", "id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("hits"), F.desc("id"))))


def count_window(runs: DataFrame, as_of: Column, hours: int = C.surge_window_hours) -> DataFrame:
    """Runs and invalid targets of each site within the last hours."""
    recent = runs.where(F.col("scraped_at") > as_of - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy("site").agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "invalid_target").alias("invalid"))


def is_surge(total: Column, invalid: Column) -> Column:
    return (total >= C.surge_min_total) & ((invalid / total > C.surge_ratio) | (invalid > C.surge_count))


def surges(runs: DataFrame, hours: int = C.surge_window_hours) -> DataFrame:
    """Each second with runs, its site's counts over the hours up to it, and whether they are a surge.

    Counts by second and site enter a running total when they happen and leave it when they are too old, so each second costs
    one step, however long the window is, and a busy site does not bring all its runs to one task.
    """
    second = F.unix_seconds(F.col("scraped_at").cast("timestamp"))
    per = runs.groupBy("site", second.alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "invalid_target").alias("bad"))
    gone = per.select("site", (F.col("s") + hours * 3600 + 1).alias("s"), (-F.col("n")).alias("n"), (-F.col("bad")).alias("bad"), F.lit(False).alias("own"))
    w = Window.partitionBy("site").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    both = per.withColumn("own", F.lit(True)).unionByName(gone).select("site", "s", "own", F.sum("n").over(w).alias("total"), F.sum("bad").over(w).alias("invalid"))
    return both.where("own").drop("own").withColumn("surge", is_surge(F.col("total"), F.col("invalid")))


def recent_winners(runs: DataFrame, window: int = C.prune_window) -> DataFrame:
    """Distinct winners of each site's last runs that have one."""
    w = Window.partitionBy("site").orderBy(F.desc("id"))
    last = runs.where("winning_parser_id IS NOT NULL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= window)
    return last.select("site", F.col("winning_parser_id").alias("id")).distinct()


def prune_stale(parsers: DataFrame, runs: DataFrame, window: int = C.prune_window) -> DataFrame:
    """Active parsers with a history but no win among the site's last winning runs."""
    ever = runs.where("winning_parser_id IS NOT NULL").select("site", F.col("winning_parser_id").alias("id")).distinct()
    return parsers.where("status = 'active'").join(ever, ["site", "id"], "left_semi").join(recent_winners(runs, window), ["site", "id"], "left_anti")


def prune_hard_cap(parsers: DataFrame, runs: DataFrame, limit: int = C.parser_limit) -> DataFrame:
    """Of each site that is full, the active parser with the fewest hits, the oldest of equals."""
    hits = hit_rates(runs).select("site", F.col("winning_parser_id").alias("id"), "hits")
    rows = parsers.where("status = 'active'").join(hits, ["site", "id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    per = rows.groupBy("site").agg(F.count("*").alias("active"), F.min(F.struct("hits", "id")).alias("x"))
    return per.where(F.col("active") >= limit).select("site", "x.id", "x.hits")


def seed_goldens(existing: DataFrame, products: DataFrame, cap: int = C.golden_max) -> DataFrame:
    """Products that become golden samples: distinct new URLs, oldest first, while their bucket is below the cap."""
    keys = ["site", "page_type"]
    have = existing.groupBy(*keys).agg(F.count("*").alias("have"))
    new = products.groupBy(*keys, "url").agg(F.min("id").alias("id")).join(existing.select(*keys, "url").distinct(), [*keys, "url"], "left_anti")
    ranked = new.join(have, keys, "left").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id")))
    return ranked.where(F.col("n") <= cap - F.coalesce("have", F.lit(0))).select(*keys, "url", "id")


def prune_plan(goldens: DataFrame, minimum: int = C.golden_min, maximum: int = C.golden_max) -> tuple[DataFrame, DataFrame]:
    """(buckets with their counts, samples to evict): above the maximum, stale first, then automatic, then oldest; a bucket
    whose active samples are below the minimum keeps all."""
    keys = ["site", "page_type"]
    per = goldens.groupBy(*keys).agg(F.count("*").alias("before"), F.count_if(~F.col("is_stale")).alias("active"), F.sum("snapshot_bytes").alias("bytes"))
    delete = F.when(F.col("active") < minimum, 0).otherwise(F.greatest(F.lit(0), F.col("before") - maximum))
    per = per.withColumn("delete_count", delete).withColumn("under_coverage", F.col("active") < minimum)
    order = Window.partitionBy(*keys).orderBy((~F.col("is_stale")).cast("int"), (F.col("created_by") != "auto").cast("int"), "captured_at", "id")
    evict = goldens.withColumn("n", F.row_number().over(order)).join(per.select(*keys, "delete_count"), keys).where(F.col("n") <= F.col("delete_count"))
    return per, evict.select("id", *keys)


def coverage(goldens: DataFrame) -> DataFrame:
    return goldens.where(~F.col("is_stale")).groupBy("site", "page_type").agg(F.count("*").alias("n"))


def coverage_shortfall(required: DataFrame, have: DataFrame) -> DataFrame:
    """Required (site, page_type, least) that have fewer."""
    return required.join(have, ["site", "page_type"], "left").where(F.coalesce("n", F.lit(0)) < F.col("least")).select("site", "page_type", F.coalesce("n", F.lit(0)).alias("n"), "least")


def upsert_escalations(state: DataFrame, news: DataFrame) -> DataFrame:
    """Escalations by signature: the count grows, the first reason and snapshot stay, a resolved one stays resolved.

    state: signature, reason, affected_count, snapshot, status, first_seq. news: signature, reason, snapshot, seq.
    """
    add = news.select("signature", "reason", F.lit(1).cast("long").alias("affected_count"), "snapshot", F.lit("open").alias("status"), F.col("seq").alias("first_seq"))
    both = state.select(add.columns).withColumn("old", F.lit(0)).unionByName(add.withColumn("old", F.lit(1)))
    order = F.struct("old", "first_seq")
    return both.groupBy("signature").agg(
        F.min_by("reason", order).alias("reason"),
        F.sum("affected_count").alias("affected_count"),
        F.min_by("snapshot", order).alias("snapshot"),
        F.min_by("status", order).alias("status"),
        F.min("first_seq").alias("first_seq"),
    )


def next_version(parsers: DataFrame) -> DataFrame:
    return parsers.groupBy("site").agg((F.count("*") + 1).alias("next_version"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each URL."""
    rest = [c for c in runs.columns if c != "url"]
    return runs.groupBy("url").agg(F.max_by(F.struct(*rest), "id").alias("r")).select("url", "r.*")


def first_passing_parser(attempts: DataFrame) -> DataFrame:
    """Of parsers tried on a page in order: the first that passed and is trusted, and the errors of those before it.

    Columns: url, position, parser_id, ok, distrust, error. A page where none passed has a row without a winner.
    """
    good = F.col("ok") & F.col("distrust").isNull()
    per = attempts.groupBy("url").agg(F.min(F.when(good, F.struct("position", "parser_id"))).alias("win"), F.collect_list(F.struct("position", F.coalesce("error", "distrust").alias("e"))).alias("all"))
    before = F.filter("all", lambda a: F.col("win").isNull() | (a["position"] < F.col("win.position")))
    return per.select("url", F.col("win.parser_id").alias("winner"), F.transform(F.array_sort(before), lambda a: a["e"]).alias("errors"))


def golden_exam(candidate_results: DataFrame) -> DataFrame:
    """Of a candidate parser on a site's golden samples (site, golden_id, mismatch): whether it passes all."""
    return candidate_results.groupBy("site").agg(F.count("*").alias("goldens"), F.count_if(F.col("mismatch").isNotNull()).alias("failed")).withColumn("promote", F.col("failed") == 0)


def stale_goldens(goldens: DataFrame, control: DataFrame) -> DataFrame:
    """Golden samples that no active parser reproduces; one without any active parser is stale too.

    control: golden_id, passed of each active parser.
    """
    good = control.where("passed").select(F.col("golden_id").alias("id")).distinct()
    return goldens.join(good, "id", "left_anti")


def empty_twice(rounds: DataFrame) -> DataFrame:
    """Rounds at which a second empty one in a row ends the loop."""
    w = Window.partitionBy("site").orderBy("round")
    return rounds.withColumn("abort", F.col("empty") & F.coalesce(F.lag("empty").over(w), F.lit(False)))


def ladder_step(round_no: Column, rungs: int) -> Column:
    """The rung of a round, the last one repeating."""
    return F.least(round_no, F.lit(rungs - 1))


def ledger(rounds: DataFrame) -> DataFrame:
    """Fields of each URL still open after its review rounds: reported ones are added, resolved ones go, in order.

    Columns: url, round, reported, resolved (arrays). URLs with nothing open are left out; fields are sorted.
    """
    none = F.array().cast("array<string>")
    steps = F.array_sort(F.collect_list(F.struct("round", "reported", "resolved")))
    fold = F.aggregate(steps, none, lambda acc, x: F.array_except(F.array_union(acc, F.coalesce(x["reported"], none)), F.coalesce(x["resolved"], none)))
    return rounds.groupBy("url").agg(F.array_sort(fold).alias("open")).where(F.size("open") > 0)


def runs_with_parsers(runs: DataFrame, parsers: DataFrame) -> DataFrame:
    """Runs with the status of their winner, where they have one."""
    own = parsers.select("site", F.col("id").alias("winning_parser_id"), F.col("status").alias("parser_status"))
    return runs.join(own, ["site", "winning_parser_id"], "left")


def newest_results(runs: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each site, newest first, ids settling ties."""
    w = Window.partitionBy("site").orderBy(F.desc("scraped_at"), F.desc("id"))
    return runs.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def open_escalations(state: DataFrame) -> DataFrame:
    """Open ones, the most affecting first, then the newest."""
    return state.where("status = 'open'").orderBy(F.desc("affected_count"), F.desc("first_seq"), "signature")


def site_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each site in each table."""
    out = None
    for name, df in tables.items():
        one = df.groupBy("site").agg(F.count("*").alias("n")).withColumn("relation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def provider_calls(before: DataFrame, after: DataFrame) -> DataFrame:
    """Calls of each provider between two readings of its counter."""
    return after.join(before.withColumnRenamed("calls", "was"), "provider", "left").groupBy("provider").agg(F.sum(F.col("calls") - F.coalesce("was", F.lit(0))).alias("calls"))
