"""URLs of a plain form are cleaned without being parted by an expression, as any others are."""

from itertools import product

from pyspark.sql import functions as F

from tallygrain import config
from tallygrain.functions import urls


def test_plain_urls_are_cleaned_as_any(spark):
    params = ["", "a", "a=1", "utm_source=x", "UTM_", "utm", "ref", "ref_=", "refer=1", "a=ref", "=gclid", "srsltid=a=b?c", "utm_a+b", "gclid "]
    asked = ["?" + "&".join(p) for n in (1, 2, 3) for p in product(params[: 14 if n < 3 else 6], repeat=n)]
    odd = ["http://h", "https://h/p#", "https://h?#f", "https://h#f?ref=1", "HTTP://H/?ref", "http:///p?ref", "//h/p?ref", "h?ref=1&b", "https://h/?r%65f=1", "https://h/?Kef=1", "https://h/?msclKid=1&a", "https://h/p\x01?ref=1", "https://é/?ref=1&b", "https://h/?a\n&ref=1\n", "https://?ref=1", "", None]
    rows = spark.createDataFrame([(f"{base}{q}{f}",) for base in ("https://h.example/p", "http://h") for q in ["", *asked] for f in ("", "#", "#x?ref=1&y")] + [(u,) for u in odd], "url string")
    u = F.col("url")
    bad = rows.select(u, u.rlike(urls.PLAIN).alias("plain"), urls.clean_url(u).alias("got"), urls.clean_any(u, config.STRIP_QUERY_PARAMS).alias("want"))
    assert bad.where("NOT got <=> want").collect() == []
    assert bad.where("plain").count() > 1000 and bad.where("plain IS NOT TRUE").count() >= 9
    parts = rows.select(*[c for i, f in ((2, urls.netloc), (3, urls.path)) for c in (f(u).alias(f"got{i}"), urls.part(u, i).alias(f"want{i}"))])
    assert parts.where("NOT (got2 <=> want2 AND got3 <=> want3)").collect() == []
    none = rows.where("NOT url <=> ''").select(urls.clean_url(u, []).alias("got"), urls.clean_any(u, []).alias("want"))
    assert none.where("NOT got <=> want").count() == 0


def test_candidates_are_made_and_cleaned_by_all_tasks(spark, tmp_path):
    """Of one file, and in one shuffle."""
    from tallygrain import catalog

    spark.range(100).selectExpr("id AS p_partkey", "'ring' AS p_name", "'Brand#7' AS p_brand", "1 AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = catalog.QUERIES["ranked_candidates"](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and plan.index("Exchange hash") > plan.index("Generate")  # below what makes rows of a task
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
