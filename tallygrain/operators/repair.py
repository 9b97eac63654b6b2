"""Operators around model calls: prompts, recorded replies, the repair ladder and the review loop. Replies are data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain import config
from tallygrain.functions import jsonx
from tallygrain.functions.quantity import render_attrs


def match_prompts(tasks: DataFrame, alive: DataFrame) -> DataFrame:
    """row_index and prompt: the query, then every alive candidate by its index.

    tasks: row_index, product_name, brands, numerics. alive: row_index, llm_index, title, url, snippet, brands, numerics.
    """

    def brands(c: str) -> Column:
        return F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))

    index = F.concat(F.lit("  ["), F.col("llm_index").cast("string"), F.lit("] "))
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n      snippet: "), F.regexp_replace(F.substring("snippet", 1, 160), "\n", " "))).otherwise("")
    line = F.concat(index, F.lit("title: "), F.col("title"), F.lit("\n      url: "), F.col("url"), F.lit("\n      brand: "), brands("brands"), F.lit(" | numeric: "), render_attrs(F.col("numerics")), snippet)
    lines = alive.select("row_index", "llm_index", line.alias("line")).groupBy("row_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("llm_index", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("Query:\n  title: "), F.col("product_name"), F.lit("\n  brand: "), brands("brands"), F.lit("\n  numeric: "), render_attrs(F.col("numerics")), F.lit("\n\nCandidates:\n"))
    return tasks.join(lines, "row_index").select("row_index", F.concat(head, "lines").alias("prompt"))


def decided(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates (row_index, alive, llm_index) with v_distinguishing and llm_reason of their task's recorded reply."""
    from tallygrain.operators.candidates import apply_decision

    d = replies.select("row_index", jsonx.decision(F.col("reply")).alias("d"))
    n = candidates.where("alive").groupBy("row_index").agg(F.count("*").alias("_n"))
    rows = candidates.join(d, "row_index", "left").join(n, "row_index", "left")
    v = apply_decision(F.col("alive"), F.col("llm_index"), F.col("d.match_idx"), F.coalesce("d.parse_error", F.lit(True)), F.coalesce("_n", F.lit(0)))
    return rows.select(*candidates.columns, v.alias("v_distinguishing"), F.col("d.reason").alias("llm_reason"))


def no_source(stage: Column, missing_required: Column) -> Column:
    """Whether the last attempt ran but lacked required fields, which speaks for a page without them."""
    return (stage == "gate") & (F.size(missing_required) > 0)


def ladder_models(rung: Column, settings: config.ScrapingConfig = config.ScrapingConfig()) -> Column:
    """struct(model, temperature, thinking) of a rung; the last one repeats, and thinks."""
    n = len(settings.repair_models)
    i = F.least(rung, F.lit(n - 1)) + 1
    return F.struct(
        F.element_at(F.array(*[F.lit(m) for m in settings.repair_models]), i.cast("int")).alias("model"),
        F.element_at(F.array(*[F.lit(t) for t in settings.repair_temperatures]), i.cast("int")).alias("temperature"),
        (i == n).alias("thinking"),
    )


def repair_ladder(attempts: DataFrame, rungs: int) -> DataFrame:
    """One outcome for each URL from its recorded attempts, in order: no_product on the first turn ends it as invalid;
    source_absent counts where the attempt before lacked required fields; the first that passes its gates promotes; a ladder
    that is used up escalates.

    Columns: url, rung, verdict (no_product, source_absent, generated), stage, missing_required, ok.
    """
    w = Window.partitionBy("url").orderBy("rung")
    absent = F.coalesce(no_source(F.lag("stage").over(w), F.lag("missing_required").over(w)), F.lit(False))
    end = (
        F.when((F.col("verdict") == "no_product") & (F.col("rung") == 0), "invalid_target")
        .when((F.col("verdict") == "source_absent") & absent, "source_absent")
        .when((F.col("verdict") == "generated") & F.col("ok"), "promoted")
    )
    rows = attempts.where(F.col("rung") < rungs).withColumn("end", end)
    return rows.groupBy("url").agg(F.coalesce(F.min_by("end", F.when(F.col("end").isNotNull(), F.col("rung"))), F.lit("escalated")).alias("outcome"), F.coalesce(F.min(F.when(F.col("end").isNotNull(), F.col("rung"))), F.max("rung")).cast("int").alias("rung"))


def review_rounds(cases: DataFrame, answers: DataFrame, most: int = 10) -> DataFrame:
    """State of each case after a person's recorded answers, round by round: y accepts and n reports fields, until q.

    cases: url. answers: round, url (null for q), answer, fields. A case nobody accepted stays open.
    """
    stop = answers.where("answer = 'q'").agg(F.coalesce(F.min("round"), F.lit(most)).alias("stop"))
    live = answers.crossJoin(F.broadcast(stop)).where((F.col("round") < F.col("stop")) & (F.col("round") < most) & F.col("answer").isin("y", "n"))
    last = live.groupBy("url").agg(F.max_by("answer", "round").alias("answer"), F.max_by("fields", "round").alias("fields"), F.max("round").alias("round"))
    return cases.join(last, "url", "left").select("url", F.when(F.col("answer") == "y", "accepted").otherwise("open").alias("state"), F.when(F.col("answer") == "n", F.col("fields")).otherwise(F.array().cast("array<string>")).alias("fields"), "round")


def correction(x: Column) -> Column:
    """A person's value for a field; dashes and words for nothing are null."""
    t = F.trim(x)
    return F.when(F.lower(t).isin("-", "none", "null", "n/a", ""), None).otherwise(t)


def traced(df: DataFrame, site: str, version: str, as_of: Column) -> DataFrame:
    """A parser's output with the columns that tell where it is from; a URL that it has stays."""
    return df.withColumns({"website": F.lit(site), "source_type": F.lit("html"), "scraped_at": as_of, "parser_version": F.lit(version)})


def version_stamp(at: Column) -> Column:
    return F.concat(F.lit("cs_"), F.date_format(at, "yyyyMMdd_HHmmss"))


#: Makers of chat clients: provider -> function(model, temperature, thinking); a client is made once for each setting.
CLIENTS: dict[str, Callable] = {}
_made: dict[tuple, object] = {}


def chat_client(model: str, temperature: float = 0.1, thinking: bool = False):
    """The client of a model's provider - the one before the slash, else the one that lists it, else the default."""
    name, _, bare = model.rpartition("/")
    provider = name if name in config.MODEL_PROVIDERS else next((p for p, models in config.MODEL_PROVIDERS.items() if model in models), config.DEFAULT_PROVIDER)
    if provider not in CLIENTS:
        raise KeyError(f"no client is registered for {provider}")
    key = provider, bare if name == provider else model, temperature, thinking
    if key not in _made:
        _made[key] = CLIENTS[provider](*key[1:])
    return _made[key]
