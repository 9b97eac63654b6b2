"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent and normalised, w ~ p ** a. The exponent is found by bisection between 0
(all sources alike) and 1 (as they are): the largest at which the weights' entropy reaches a target, or the smallest at
which no source is repeated more than a limit. All candidate exponents of a round are evaluated by one aggregate over
the table of source totals, so that table is never collected.

The weights are realised within a token budget. A source's quota is as many whole passes over its documents as fit, and a
part of one more. Documents lie in 1024 blocks by a hash of doc_id, and each pass takes the blocks in a permutation of its own: a
Feistel network keyed by seed, source and pass gives every block its place, which the result carries (``mix_place``), so a
reader that goes by pass and place reads each pass in its order. The last pass ends inside a block, which is cut by the same
rule on finer and finer blocks until the next document would not fit: sizes are summed by block, and no source's documents
are gathered or sorted.

Defined cases: a null source is the source ""; a null text has no tokens; documents without tokens (and sources that hold
only such) come once; rows that share a doc_id within a source lie in one block and are taken or left together; an empty
table gives no rows; input columns named as one of the result's five mix columns give way to it, any other name is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch

#: Blocks of one level, and how many levels a 60-bit hash has.
FANOUT, LEVELS = 1024, 6
#: Bits of half a block's number, and rounds of the network that permutes blocks.
HALF, ROUNDS_KEYED = 5, 4
#: Exponents that one round of the bisection evaluates, and rounds: the exponent's error is below PROBES ** -ROUNDS.
PROBES, ROUNDS = 32, 5
#: Bytes of sources' names that are broadcast at most.
NAMES = 8 << 20


def word_count(text: Column) -> Column:
    """Words: runs of characters other than space and \\x09-\\x0D."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def digit(level: int) -> Column:
    """The block of a document at a level: ten bits of its hash."""
    return F.shiftrightunsigned(F.col("h"), 10 * level).bitwiseAND(F.lit(FANOUT - 1)).cast("int")


def place(seed: int, level: int, block: Column | None = None) -> Column:
    """The place, from 0, that a pass's permutation gives a block: ``ROUNDS_KEYED`` Feistel rounds on its two halves of five bits."""
    half, block = F.lit((1 << HALF) - 1), F.col("block") if block is None else block
    left, right = F.shiftright(block, HALF), block.bitwiseAND(half)
    for r in range(ROUNDS_KEYED):
        key = F.xxhash64(F.lit(seed), F.lit(level), F.lit(r), F.col("source"), F.col("epoch").cast("long"), right)
        left, right = right, left.bitwiseXOR(key.bitwiseAND(half).cast("int"))
    return F.shiftleft(left, HALF).bitwiseOR(right)


def bisect_exponent(totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None = None) -> float:
    """The exponent for one of the two targets; both are monotone in it.

    target_entropy: in nats; weights' entropy falls as the exponent grows, and the largest exponent that still reaches it
    is sought (1 if the shares reach it as they are, 0 if nothing does). max_repeats: the most passes over any source
    within the budget, or, without one, when the source that is repeated least is seen once; the smallest exponent that
    keeps to it. A budget that no exponent keeps to the limit is refused.
    """
    low, high = 0.0, 1.0
    shares = totals.where("tokens > 0")
    whole = shares.agg(F.sum("tokens").alias("all"))
    shares = shares.crossJoin(F.broadcast(whole)).select((F.col("tokens") / F.col("all")).alias("p"), "all")
    extremes = shares.agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.max("all").alias("all")).first()
    if extremes.p0 is None:
        return 1.0
    if target_entropy is None and budget is not None and budget > max_repeats * extremes["all"]:
        raise ValueError(f"{budget} tokens of {extremes['all']} repeat every source more than {max_repeats} times")
    for _ in range(ROUNDS):
        tries = [low + (high - low) * i / PROBES for i in range(PROBES + 1)]
        if target_entropy is not None:  # entropy of p^a / z is log z - a * sum(p^a log p) / z
            cols = [
                (F.log(F.sum(F.pow("p", F.lit(a)))) - a * F.sum(F.pow("p", F.lit(a)) * F.log("p")) / F.sum(F.pow("p", F.lit(a)))).alias(f"e{i}")
                for i, a in enumerate(tries)
            ]
            row = shares.agg(*cols).first()
            good = [v is None or v >= target_entropy for v in row]
            k = max((i for i, g in enumerate(good) if g), default=None)
            if k is None:
                return 0.0
            if k == PROBES:
                return tries[-1]
            low, high = tries[k], tries[k + 1]
        else:  # the smallest source is repeated most: p0^(a - 1) times what the budget leaves for p^a = 1
            if budget is None:
                repeats = [(extremes.p0 / extremes.p1) ** (a - 1) for a in tries]
            else:
                row = shares.agg(*[F.sum(F.pow(F.col("p") / extremes.p0, F.lit(a))).alias(f"z{i}") for i, a in enumerate(tries)]).first()
                repeats = [budget / extremes["all"] / (extremes.p0 * z) for z in row]
            k = next(i for i, r in enumerate(repeats) if r <= max_repeats or i == PROBES)
            if k == 0:
                return tries[0]
            low, high = tries[k - 1], tries[k]
    return low if target_entropy is not None else high


def quotas(totals: DataFrame, exponent: float, budget: int | None) -> DataFrame:
    """source, tokens, weight, quota (tokens to take), passes (whole ones) and rest (tokens of the last pass).

    budget null: as many tokens as let the least repeated source be seen exactly once.
    """
    live = F.col("tokens") > 0
    z = totals.where(live).agg(
        F.sum(F.pow("tokens", F.lit(exponent))).alias("z"), F.max(F.col("tokens") / F.pow("tokens", F.lit(exponent))).alias("most")
    )
    rows = totals.crossJoin(F.broadcast(z)).withColumn("weight", F.when(live, F.pow("tokens", F.lit(exponent)) / F.col("z")).otherwise(0.0))
    whole = F.lit(float(budget)) if budget is not None else F.col("most") * F.col("z")
    rows = rows.withColumn("quota", F.floor(F.col("weight") * whole + 1e-6 * F.col("weight")).cast("long"))
    rows = rows.withColumn("quota", F.when(live & (F.abs(F.col("quota") - F.col("tokens")) <= 1), F.col("tokens")).otherwise(F.col("quota")))
    passes = F.when(live, F.expr("quota div tokens")).otherwise(1)
    return rows.select("source", "tokens", "weight", "quota", passes.cast("long").alias("passes"), F.when(live, F.col("quota") % F.col("tokens")).otherwise(0).alias("rest"))


def cut_places(rows: DataFrame, plan: DataFrame, seed: int, scratch: Scratch, hint) -> DataFrame:
    """source, cut0 .. cut5: where a source's last pass ends, as a place at each level.

    Level by level, the blocks that fit are taken and the first that does not is opened, until nothing of it fits; its place
    is the cut. A level that is not opened has none.
    """
    open_ = plan.where("rest > 0").select("source", F.col("passes").alias("epoch"), F.lit("").alias("path"), F.col("rest").alias("left"))
    open_ = scratch.save(open_, "open0")
    cuts = None
    for level in range(LEVELS):
        path = F.concat_ws(".", *[digit(i) for i in range(level)]) if level else F.lit("")
        inside = rows.withColumn("path", path).join(hint(open_), ["source", "path"])
        blocks = inside.groupBy("source", "path", "epoch", "left", digit(level).alias("block")).agg(F.sum("n").alias("n"), F.countDistinct("h").alias("docs"))
        blocks = blocks.withColumn("place", place(seed, level))
        order = Window.partitionBy("source", "path").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        blocks = blocks.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") > F.col("left"))
        own = F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("block"))
        first = blocks.groupBy("source").agg(F.min(F.struct("place", "epoch", own.alias("own"), (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "docs")).alias("x"))
        first = scratch.save(first.select("source", "x.*"), f"cut{level}")
        one = first.select("source", F.col("place").alias(f"cut{level}"))
        cuts = one if cuts is None else cuts.join(one, "source", "left")
        open_ = first.where("docs > 1 and left > 0").select("source", "epoch", F.col("own").alias("path"), "left")
        if not open_.limit(1).count():
            break
    return cuts.select("source", *[F.col(f"cut{i}") if f"cut{i}" in cuts.columns else F.lit(None).cast("int").alias(f"cut{i}") for i in range(LEVELS)])


def before_cut(seed: int) -> Column:
    """Whether a document comes before its source's cut in the last pass; epoch is that pass."""
    out = F.lit(False)
    for level in reversed(range(LEVELS)):
        own = place(seed, level, digit(level))
        cut = F.col(f"cut{level}")
        out = F.when(cut.isNull() | (own > cut), False).when(own < cut, True).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: int | None = None,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    small_sources: int = 50_000,
) -> DataFrame:
    """The documents' columns, once for each time a document is drawn, with mix_epoch (the pass), mix_block, mix_place (the
    block's place in the pass), mix_tokens and mix_weight.

    Exactly one of target_entropy and max_repeats steers the exponent. Tables of sources: joined by broadcast up to
    ``small_sources`` rows of at most 64 bytes and NAMES bytes of names, else by a shuffle whose skewed keys Spark splits.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give a target entropy or a limit of repeats")
    scratch = Scratch(docs.sparkSession, "mixing")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(F.lit(seed), source, key).bitwiseAND(F.lit((1 << 60) - 1))
    # the documents' own columns travel as one, so that no name of theirs meets one of these
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("source"), hashed.alias("h"), word_count(F.col(text_col)).alias("n"))
    rows = scratch.save(own.select("source", "h", "n"), "sizes")
    totals = scratch.save(rows.groupBy("source").agg(F.sum("n").alias("tokens")), "totals")
    exponent = bisect_exponent(totals, target_entropy, max_repeats, budget)
    plan = scratch.save(quotas(totals, exponent, budget), "plan")
    size = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("names")).first()
    hint = F.broadcast if size.n <= small_sources and size.names <= NAMES else (lambda df: df)
    plan = scratch.save(plan.join(cut_places(rows, plan, seed, scratch, hint), "source", "left"), "whole")
    drawn = own.join(hint(plan.select("source", "weight", "passes", *[f"cut{i}" for i in range(LEVELS)])), "source")
    more = before_cut(seed).cast("long")
    times = F.col("passes") + F.when(F.col("n") > 0, more).otherwise(F.when(F.col("passes") > 0, 0).otherwise(1))
    drawn = drawn.withColumn("epoch", F.col("passes")).withColumn("times", times).where("times > 0")
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).withColumn("block", digit(0))
    mixed = {"mix_epoch": F.col("epoch"), "mix_block": F.col("block"), "mix_place": place(seed, 0), "mix_tokens": F.col("n"), "mix_weight": F.col("weight")}
    keep = [F.col("row")[c].alias(c) for c in docs.columns if c not in mixed]
    return drawn.select(*keep, *[c.alias(k) for k, c in mixed.items()])
