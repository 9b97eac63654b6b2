"""Reports over scrape runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain import config


def outcome_crosstab(reports: DataFrame, by: str) -> DataFrame:
    """Outcomes of each label, and of all as TOTAL; what is none of the four is other."""
    o = F.col("outcome")
    counts = [F.count("*").alias("total"), *[F.count_if(o == x).alias(x) for x in config.OUTCOMES], F.count_if(~F.coalesce(o, F.lit("")).isin(*config.OUTCOMES)).alias("other")]
    return reports.groupBy(by).agg(*counts).unionByName(reports.agg(F.lit("TOTAL").alias(by), *counts))


def shares(reports: DataFrame) -> DataFrame:
    n = reports.groupBy("outcome").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 0).cast("long"))


def path_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.coalesce("path", F.lit("(no run record)")).alias("path")).agg(F.count("*").alias("n"))


def latency_stats(reports: DataFrame, coarse: int = 16) -> DataFrame:
    """By position in the sorted list: the upper median, the 95th percentile at int(0.95 n); the mean rounds down.

    In two levels: counts by the high bits say in which block of 2 ** ``coarse`` values a position lies, and only those two
    blocks' values are ranked, each block by itself. No task sees more than a block's distinct values or the list of blocks.
    """
    x = F.col("latency_ms")
    freq = reports.where(x.isNotNull()).groupBy("latency_ms").agg(F.count("*").alias("c")).withColumn("block", F.shiftright("latency_ms", coarse))
    blocks = freq.groupBy("block").agg(F.sum("c").alias("c"))
    total = freq.agg(F.sum("c").alias("n"), F.sum(x * F.col("c")).alias("sum_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"))
    upto = F.sum("c").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    places = total.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.floor(F.col("n") * p).alias("i")) for k, p in (("median", 0.5), ("p95", 0.95))])).alias("p")).select("p.*")
    upto = blocks.withColumn("upto", upto)
    inside = upto.crossJoin(F.broadcast(places)).where((F.col("upto") > F.col("i")) & (F.col("upto") - F.col("c") <= F.col("i")))
    inside = inside.select("kind", "block", (F.col("i") - F.col("upto") + F.col("c")).alias("left"))  # one block for each place
    w = Window.partitionBy("kind").orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    ranked = freq.join(F.broadcast(inside), "block").withColumn("here", F.sum("c").over(w)).where(F.col("here") > F.col("left"))
    at = ranked.agg(*[F.min(F.when(F.col("kind") == k, x)).alias(f"{k}_ms") for k in ("median", "p95")])
    return total.crossJoin(F.broadcast(at)).select(F.floor(F.col("sum_ms") / F.col("n")).cast("long").alias("avg_ms"), "median_ms", "p95_ms", "min_ms", "max_ms", "sum_ms")


def mechanisms(outcome: Column, path: Column, source: Column, reason: Column, error: Column) -> Column:
    """Labels of what a run went through."""
    limited = F.lower(error).rlike("ratelimit|rate limit|429|too many requests")
    return F.filter(
        F.array(
            F.when(path == "fast", F.when(source == "api", "fast path (API)").otherwise("fast path (parser)"))
            .when(path == "agent_repaired", "agent repair")
            .when(path == "retried", "extraction retry")
            .when(path.startswith("backup_"), F.concat(F.lit("backup scraper "), F.substring_index(path, "_", -1)))
            .when(path == "invalid_target", "invalid-target detection")
            .when(path == "escalated", F.concat(F.lit("escalated: "), F.coalesce(reason, F.lit("unknown")))),
            F.when(outcome == "infra_error", F.when(F.coalesce(limited, F.lit(False)), "infra alert: rate limit").otherwise("infra alert")),
            F.when(outcome == "scrape_failed", "terminal failure"),
            F.when(path.isNull() & outcome.isin("scrape_failed", "infra_error"), "no run record"),
        ),
        lambda m: m.isNotNull(),
    )


def mechanism_tally(reports: DataFrame) -> DataFrame:
    each = reports.select(F.explode("mechanisms").alias("m"))
    return each.groupBy(F.trim(F.substring_index("m", ":", 1)).alias("mechanism")).agg(F.count("*").alias("n"))


def escalation_groups(reports: DataFrame) -> DataFrame:
    """Escalated reports by signature, with their members in order."""
    e = reports.where("escalation_reason IS NOT NULL")
    return e.groupBy(F.coalesce("escalation_signature", F.lit("unknown")).alias("signature")).agg(F.min_by("escalation_reason", "idx").alias("reason"), F.count("*").alias("affected"), F.transform(F.array_sort(F.collect_list(F.struct("idx", "url"))), lambda x: x["url"]).alias("urls"))


def layer_mix(candidates: DataFrame) -> DataFrame:
    """How often each verdict was given in each layer; not reached is 'none'."""
    layers = ("domain", "brand", "numeric", "distinguishing")
    each = candidates.select(F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.coalesce(F.col(f"v_{x}"), F.lit("none")).alias("verdict")) for x in layers])).alias("e"))
    return each.groupBy("e.layer", "e.verdict").agg(F.count("*").alias("n"))


def report_rows(urls: DataFrame, runs: DataFrame, escalations: DataFrame) -> DataFrame:
    """Each URL with its newest run and the first open escalation whose signature names its site."""
    from tallygrain.operators.runlog import latest_run

    last = latest_run(runs).select("url", "site", "outcome", "path", "latency_ms")
    first = escalations.where("status = 'open'").groupBy(F.substring_index("signature", "|", 1).alias("site")).agg(F.min_by(F.struct("signature", "reason"), "first_seq").alias("e"))
    return urls.join(last, "url", "left").join(first, "site", "left").select(*urls.columns, "site", "outcome", "path", "latency_ms", F.col("e.signature").alias("escalation_signature"), F.col("e.reason").alias("escalation_reason"))


def country_rows(columns: DataFrame) -> DataFrame:
    """Countries that share a name and all their codes' mappings, collapsed: code, name, region, gl."""
    return columns.groupBy("name", "region", "gl").agg(F.array_join(F.array_sort(F.collect_list("code")), ", ").alias("codes"))
