"""From search results to one result for each product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.functions.fuzzy import compare_brands_exact_first
from tallygrain.functions.quantity import compare_numerics, extract_numerics
from tallygrain.operators import brands as names_in
from tallygrain.operators import candidates as ops
from tallygrain.session import saved


def text_facts(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """text, country, brands and numerics of distinct texts: however many candidates have a title, it is read once."""
    found = names_in.brands_of(texts, names_in.dictionary(brands))
    return texts.join(found, "text").withColumn("numerics", extract_numerics(F.col("text"), F.col("country")))


def judged(results: DataFrame, brands: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """Ranked candidates with all verdicts; the offline last layer takes the first that is alive.

    brands: the dictionary, in the column brandname_en. Titles of candidates that the domain layer refused are not read.
    dealt: the results are partitioned by the keys, or part of them, already.
    """
    rows = saved(ops.domain_verdicts(ops.rank_candidates(results, keys, dealt)), "ranked")
    country = F.coalesce("country", F.lit(""))
    both = rows.where("v_domain = 'pass'").select(F.explode(F.array(*[F.struct(F.col(c).alias("text"), country.alias("country")) for c in ("title", "product_name")])).alias("x"))
    facts = saved(text_facts(saved(both.select("x.*").where("text <> ''").distinct(), "texts"), brands), "facts")
    for side, column in (("own", "product_name"), ("other", "title")):
        # a refused candidate has a key that nothing equals, and not one that all of them share
        wanted = F.when(F.col("v_domain") == "pass", F.col(column)).otherwise(F.concat(F.lit("\0"), "url"))
        told = facts.select(F.col("text").alias(f"{side}_text"), F.col("country").alias(f"{side}_country"), F.col("brands").alias(f"{side}_brands"), F.col("numerics").alias(f"{side}_numerics"))
        rows = rows.withColumn("wanted", wanted).join(told, (F.col("wanted") == F.col(f"{side}_text")) & (country == F.col(f"{side}_country")), "left").drop("wanted", f"{side}_text", f"{side}_country")
    none = F.array().cast("array<string>")
    own = supplied_or(F.col("brand"), F.coalesce("own_brands", none))
    brand = compare_brands_exact_first(own, F.coalesce("other_brands", none))
    b, n, alive = ops.base_verdicts(brand, compare_numerics(F.col("own_numerics"), F.col("other_numerics")), F.col("v_domain"))
    rows = rows.withColumn("v_brand", b).withColumn("v_numeric", n).withColumn("alive", F.coalesce(alive, F.lit(False)))
    rows = ops.llm_index(rows.drop("own_brands", "own_numerics", "other_brands", "other_numerics"), keys)
    return rows.withColumn("v_distinguishing", F.when(F.col("alive"), F.when(F.col("llm_index") == 0, "pass").otherwise("fail")))


def supplied_or(supplied: Column, found: Column) -> Column:
    """A brand that is given, trimmed (blank ones: none), else those found."""
    given = F.coalesce(supplied, F.lit(""))
    return F.when(given == "", found).when(F.trim(given) == "", F.array().cast("array<string>")).otherwise(F.array(F.trim(given)))


def match_results(tasks: DataFrame, results: DataFrame, brands: DataFrame, dealt: bool = False) -> DataFrame:
    """The matched URL, or the deepest trace, of every product over one provider's results."""
    return ops.task_results(tasks.select("row_index", "product_name", "website"), judged(results, brands, ["row_index"], dealt), ["row_index"])
