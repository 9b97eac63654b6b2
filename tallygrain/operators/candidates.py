"""Candidate sets: ranking, first-of-a-kind, verdict layers, and one result for each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain import config
from tallygrain.functions import urls

LAYERS = ("domain", "brand", "numeric", "distinguishing")


def top_k(results: DataFrame, k: int = config.SEARCH_K) -> DataFrame:
    """The first k results of each query, cut before rows without title or link go."""
    return results.where((F.col("result_idx") < k) & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def rank_candidates(results: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """URLs cleaned, the first of each clean URL in an attempt kept, and its rank (from 1) in query, then result order.

    One shuffle by the attempt's key serves both windows, and what comes after by that key; URLs are cleaned behind it, by all
    tasks. dealt: the results are partitioned by the key, or part of it, already.
    """
    clean = (results if dealt else results.repartition(*keys)).withColumn("url", urls.clean_url(F.col("url")))
    first = clean.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "url").orderBy("query_idx", "result_idx"))).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("query_idx", "result_idx")))


def domain_verdicts(candidates: DataFrame) -> DataFrame:
    """v_domain, and why a candidate was refused: host first, then the page's shape; an unknown website refuses all."""
    target = urls.domain_for(F.col("website"))
    host = urls.netloc(F.col("url"))
    on_host = target.isNotNull() & (host != "") & urls.host_matches(host, target)
    reject = F.when(~F.coalesce(on_host, F.lit(False)), "host").when(~urls.is_product_url(F.col("website"), F.col("url")), "not_product_page")
    return candidates.withColumn("reject", reject).withColumn("v_domain", F.when(F.col("reject").isNull(), "pass").otherwise("fail"))


def reject_counts(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.groupBy(*keys).agg(F.count_if(F.col("reject") == "host").alias("rejected_host"), F.count_if(F.col("reject") == "not_product_page").alias("rejected_page"))


def base_verdicts(brand: Column, numeric: Column, domain: Column) -> tuple[Column, Column, Column]:
    """(brand, numeric, alive): brand only where the domain passed, numeric only where brand did not fail."""
    b = F.when(domain == "pass", brand)
    n = F.when((domain == "pass") & (b != "fail"), numeric)
    return b, n, (domain == "pass") & (b != "fail") & (F.coalesce(n, F.lit("")) != "fail")


def depth(trace: dict[str, Column]) -> Column:
    """Place of the last layer that was reached, 0 if none."""
    out = F.lit(0)
    for i, layer in enumerate(LAYERS, 1):
        out = F.when(trace[layer].isNotNull(), i).otherwise(out)
    return out


def llm_index(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Dense index from 0 of the alive candidates, null for others."""
    w = Window.partitionBy(*keys, "alive").orderBy("rank")
    return candidates.withColumn("llm_index", F.when(F.col("alive"), F.row_number().over(w) - 1))


def apply_decision(alive: Column, index: Column, match_idx: Column, parse_error: Column, alive_count: Column) -> Column:
    """The chosen candidate passes, other alive ones fail; no usable choice fails all."""
    usable = ~F.coalesce(parse_error, F.lit(False)) & match_idx.between(0, alive_count - 1)
    return F.when(alive, F.when(usable & (index == match_idx), "pass").otherwise("fail"))


def task_results(tasks: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each task: the first candidate that passed the last layer, else the deepest trace (the first of equals).

    Columns of candidates: keys, url, rank, v_domain .. v_distinguishing, llm_reason. A task without candidates has a row.
    """
    trace = F.struct(*[F.col(f"v_{x}") for x in LAYERS])
    d = depth({x: F.col(f"v_{x}") for x in LAYERS})
    passed = F.col("v_distinguishing") == "pass"
    per = candidates.groupBy(*keys).agg(
        F.count("*").alias("considered"),
        F.min_by(F.when(passed, F.struct("url", trace.alias("t"))), F.when(passed, F.col("rank"))).alias("hit"),
        F.max_by(trace, F.struct(d, -F.col("rank"))).alias("deep"),
    )
    out = tasks.join(per, keys, "left")
    t = F.coalesce("hit.t", "deep")
    return out.select(
        *keys,
        F.when(F.col("hit").isNotNull(), "match").otherwise("no_match").alias("verdict"),
        F.col("hit.url").alias("matched_url"),
        *[t[f"v_{x}"].alias(f"v_{x}") for x in LAYERS],
        F.coalesce("considered", F.lit(0)).alias("considered"),
        F.when(F.coalesce("considered", F.lit(0)) == 0, "no search results").otherwise("").alias("reason"),
    )


def provider_chain(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts of an ordered chain to each task's result: providers up to the first match count, the last of them decides.

    Columns: keys, provider_rank, provider, verdict, reason. A longer chain names the provider in the reason.
    """
    first = F.min(F.when(F.col("verdict") == "match", F.col("provider_rank")))
    per = attempts.groupBy(*keys).agg(first.alias("hit"), F.max("provider_rank").alias("last"), F.count("*").alias("chain"), F.collect_list(F.struct("provider_rank", "provider", "verdict", "reason")).alias("all"))
    rank = F.coalesce("hit", "last")
    got = F.try_element_at(F.filter("all", lambda a: a["provider_rank"] == rank), F.lit(1))
    reason = F.coalesce(got["reason"], F.lit(""))
    return per.select(
        *keys,
        got["provider"].alias("final_provider"),
        got["verdict"].alias("verdict"),
        F.size(F.filter("all", lambda a: a["provider_rank"] <= rank)).cast("long").alias("attempts_run"),
        F.when(F.col("chain") > 1, F.concat(reason, F.when(reason != "", " ").otherwise(""), F.lit("(via "), got["provider"], F.lit(")"))).otherwise(reason).alias("reason"),
    )


def url_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct URLs of two sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def stratified_sample(df: DataFrame, stratum: str, ids: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same number of each stratum as far as there are, by a hash of the id."""
    strata = max(df.select(stratum).distinct().count(), 1)
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ids).cast("string")).cast("binary")), ids)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n // strata).drop("_n")


def within_budget(calls: DataFrame, budget: int) -> DataFrame:
    """Marks calls that a budget covers, in their fixed order (task, provider, query)."""
    key = F.struct("row_index", "provider_rank", "query_idx")
    first = calls.select(key.alias("k")).orderBy("k").limit(budget).agg(F.max("k").alias("upto"), F.count("*").alias("n"))
    return calls.crossJoin(F.broadcast(first)).withColumn("allowed", (F.col("n") > 0) & (key <= F.col("upto"))).drop("upto", "n")


def flag_matched(candidates: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """is_matched: the candidate's URL is its task's; every candidate with that URL is flagged."""
    return candidates.join(results.select(*keys, "matched_url"), keys, "left").withColumn("is_matched", F.coalesce(F.col("url") == F.col("matched_url"), F.lit(False))).drop("matched_url")


def agreement(old: DataFrame, new: DataFrame) -> DataFrame:
    """How two runs' URLs agree, row by row: same, both none, only one, different."""
    both = old.select("row_index", F.col("url").alias("a")).join(new.select("row_index", F.col("url").alias("b")), "row_index", "full")
    kind = F.when(F.col("a").isNull() & F.col("b").isNull(), "both_none").when(F.col("a").isNull(), "only_new").when(F.col("b").isNull(), "only_old").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
