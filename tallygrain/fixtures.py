"""Relations derived from the synthetic tables: the same in Spark and, in ``VIEWS``, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.session import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def sku_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS row_index",
        "concat(p_brand, ' ', p_name, ' ', cast(1 + p_partkey % 6 AS string), ' x ', cast(p_size * 10 AS string), 'ml') AS product_name",
        "CASE p_partkey % 4 WHEN 0 THEN 'tesco' WHEN 1 THEN 'argos' WHEN 2 THEN 'amazon.nl' ELSE 'unlisted' END AS website",
        "CASE p_partkey % 3 WHEN 0 THEN 'uk' WHEN 1 THEN 'de' ELSE 'nl' END AS country",
        "p_brand AS brand",
        "p_size AS size",
    )


SKU_TASKS = """SELECT p_partkey AS row_index, p_brand || ' ' || p_name || ' ' || CAST(1 + p_partkey % 6 AS VARCHAR) || ' x ' || CAST(p_size * 10 AS VARCHAR) || 'ml' AS product_name,
    CASE p_partkey % 4 WHEN 0 THEN 'tesco' WHEN 1 THEN 'argos' WHEN 2 THEN 'amazon.nl' ELSE 'unlisted' END AS website,
    CASE p_partkey % 3 WHEN 0 THEN 'uk' WHEN 1 THEN 'de' ELSE 'nl' END AS country, p_brand AS brand, p_size AS size FROM part"""

def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand dictionary: the products' brands and one more."""
    extra = spark.createDataFrame([("Quixotic",)], "brandname_en string")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("brandname_en")).unionByName(extra)


_URL = """CASE WHEN k % 5 = 4 THEN 'https://www.example.org/products/' || lpad({s}, 6, '0')
    WHEN website = 'tesco' THEN 'https://www.tesco.com/' || CASE WHEN k % 7 = 3 THEN 'gallery/' ELSE 'products/' END || lpad({s}, 6, '0')
    WHEN website = 'argos' THEN 'https://www.argos.co.uk/product/' || lpad({s}, 6, '0')
    WHEN website = 'amazon.nl' THEN 'https://www.amazon.nl/dp/B000' || lpad({s}, 6, '0')
    ELSE 'https://shop.example.com/item/' || lpad({s}, 6, '0') END
    || CASE WHEN query_idx = 1 THEN '?srsltid=q' || {k} WHEN k % 3 = 0 THEN '?utm_source=x&keep=' || {k} WHEN k % 3 = 1 THEN '?' ELSE '' END"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten results of each of two query variants and two providers for every task; the variants overlap.

    Tasks are dealt by row_index before they become rows, so that all tasks work and no candidate needs to move to its attempt.
    """
    rows = sku_tasks(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row_index").withColumn("provider_rank", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("query_idx", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("result_idx", F.explode(F.sequence(F.lit(0), F.lit(9))))
    rows = rows.withColumn("k", F.col("result_idx") + F.col("query_idx") * 5 + F.col("provider_rank") * 3)
    rows = rows.withColumn("item", (F.col("row_index") * 7 + F.col("k") * 13) % 1000000)
    rows = rows.withColumn("url", F.expr(_URL.format(s="cast(item AS string)", k="cast(k AS string)")))
    title = F.when(F.col("k") % 2 == 0, F.col("product_name")).otherwise(F.concat(F.when(F.col("k") % 4 == 1, "Quixotic thing ").otherwise("Brand#00 thing "), (1 + F.col("k") % 6).cast("string"), F.lit(" x "), (F.col("size") * 10 + F.col("k")).cast("string"), F.lit("ml")))
    return rows.select("row_index", "product_name", "website", "country", "brand", "size", "provider_rank", "query_idx", "result_idx", "k", title.alias("title"), "url")


CANDIDATES = f"""SELECT row_index, product_name, website, country, brand, size, provider_rank, query_idx, result_idx, k,
    CASE WHEN k % 2 = 0 THEN product_name ELSE CASE WHEN k % 4 = 1 THEN 'Quixotic thing ' ELSE 'Brand#00 thing ' END || CAST(1 + k % 6 AS VARCHAR) || ' x ' || CAST(size * 10 + k AS VARCHAR) || 'ml' END AS title,
    {_URL.format(s="CAST(item AS VARCHAR)", k="CAST(k AS VARCHAR)")} AS url
    FROM (SELECT t.*, p.provider_rank, q.query_idx, r.result_idx, r.result_idx + q.query_idx * 5 + p.provider_rank * 3 AS k,
                 (row_index * 7 + (r.result_idx + q.query_idx * 5 + p.provider_rank * 3) * 13) % 1000000 AS item
          FROM sku_tasks t, (SELECT unnest([0, 1]) AS provider_rank) p, (SELECT unnest([0, 1]) AS query_idx) q, (SELECT CAST(unnest(range(10)) AS INTEGER) AS result_idx) r)"""


def scrape_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "concat('https://s', cast(user_id % 3 AS string), '.example/p/', cast(user_id % 50 AS string)) AS url",
        "concat('s', cast(user_id % 3 AS string)) AS site",
        "CASE event_type WHEN 'error' THEN 'escalated' WHEN 'signup' THEN 'invalid_target' ELSE 'success' END AS outcome",
        "CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_id % 7 END AS winning_parser_id",
        "CASE event_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'backup_1' WHEN 2 THEN 'agent_repaired' END AS path",
        "cast(round(value * 1000, 0) AS bigint) AS latency_ms",
        "ts AS scraped_at",
    )


SCRAPE_RUNS = """SELECT event_id AS id, 'https://s' || CAST(user_id % 3 AS VARCHAR) || '.example/p/' || CAST(user_id % 50 AS VARCHAR) AS url,
    's' || CAST(user_id % 3 AS VARCHAR) AS site,
    CASE event_type WHEN 'error' THEN 'escalated' WHEN 'signup' THEN 'invalid_target' ELSE 'success' END AS outcome,
    CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE event_id % 7 END AS winning_parser_id,
    CASE event_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'backup_1' WHEN 2 THEN 'agent_repaired' END AS path,
    CAST(round(value * 1000, 0) AS BIGINT) AS latency_ms, ts AS scraped_at FROM events"""


def parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr("concat('s', cast(n_nationkey % 3 AS string)) AS site", "cast(n_nationkey div 3 AS bigint) AS id", "CASE WHEN n_nationkey div 3 % 5 = 4 THEN 'retired' ELSE 'active' END AS status")


PARSERS = "SELECT 's' || CAST(n_nationkey % 3 AS VARCHAR) AS site, CAST(n_nationkey // 3 AS BIGINT) AS id, CASE WHEN n_nationkey // 3 % 5 = 4 THEN 'retired' ELSE 'active' END AS status FROM nation"


def node_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id",
        "concat('run', cast(user_id % 5 AS string)) AS run_id",
        "user_id AS task_id",
        "element_at(array('search', 'domain_filter', 'base_match', 'distinguishing', 'aggregate'), cast(event_id % 5 + 1 AS int)) AS node",
        "CASE event_id % 11 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'ok' END AS status",
        "event_id % 20 AS candidates_in",
        "event_id % 20 % 7 AS candidates_out",
        "cast(round(value * 10, 0) AS bigint) AS duration_ms",
        "ts",
    )


NODE_EVENTS = """SELECT event_id, 'run' || CAST(user_id % 5 AS VARCHAR) AS run_id, user_id AS task_id,
    ['search', 'domain_filter', 'base_match', 'distinguishing', 'aggregate'][event_id % 5 + 1] AS node,
    CASE event_id % 11 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'ok' END AS status,
    event_id % 20 AS candidates_in, event_id % 20 % 7 AS candidates_out, CAST(round(value * 10, 0) AS BIGINT) AS duration_ms, ts FROM events"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "array('matched', 'no_search_results', 'brand_mismatch', 'llm_no_match')"
    return node_events(spark, sf_dir).select("task_id", "run_id").distinct().selectExpr("task_id", "run_id", "task_id % 97 AS row_index", "concat('sku ', cast(task_id AS string)) AS product_name", f"element_at({kinds}, cast(task_id % 4 + 1 AS int)) AS failure_kind", "CASE task_id % 4 WHEN 0 THEN 'match' ELSE 'no_match' END AS verdict", "CASE task_id % 3 WHEN 0 THEN 'serper' WHEN 1 THEN 'duckduckgo' END AS final_provider")


TASKS = """SELECT DISTINCT task_id, run_id, task_id % 97 AS row_index, 'sku ' || CAST(task_id AS VARCHAR) AS product_name,
    ['matched', 'no_search_results', 'brand_mismatch', 'llm_no_match'][task_id % 4 + 1] AS failure_kind,
    CASE task_id % 4 WHEN 0 THEN 'match' ELSE 'no_match' END AS verdict,
    CASE task_id % 3 WHEN 0 THEN 'serper' WHEN 1 THEN 'duckduckgo' END AS final_provider FROM node_events"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_events(spark, sf_dir).groupBy("run_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).withColumn("status", F.lit("completed")).withColumn("provider_chain", F.lit("duckduckgo,serper"))


RUNS = "SELECT run_id, min(ts) AS started_at, max(ts) AS finished_at, 'completed' AS status, 'duckduckgo,serper' AS provider_chain FROM node_events GROUP BY run_id"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in whole cents."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS id",
        "l_partkey AS part",
        "concat('p', cast(l_suppkey AS string)) AS seller",
        "l_shipdate AS shipped",
        "cast(round(l_extendedprice * 100, 0) AS bigint) AS list_c",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(round(l_extendedprice * (1 - l_discount) * 100, 0) AS bigint) END AS price_c",
        "CASE WHEN l_partkey % 3 = 0 THEN cast(round(l_extendedprice * (1 - l_discount) * (1 - l_tax) * 100, 0) AS bigint) END AS member_c",
        "l_linestatus = 'O' AS in_stock",
        "CASE WHEN l_partkey % 2 = 0 THEN cast(cast(l_quantity AS int) AS string) END AS pack_qty",
    )


PRODUCTS = """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS part, 'p' || CAST(l_suppkey AS VARCHAR) AS seller, l_shipdate AS shipped, CAST(round(l_extendedprice * 100, 0) AS BIGINT) AS list_c,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(round(l_extendedprice * (1 - l_discount) * 100, 0) AS BIGINT) END AS price_c,
    CASE WHEN l_partkey % 3 = 0 THEN CAST(round(l_extendedprice * (1 - l_discount) * (1 - l_tax) * 100, 0) AS BIGINT) END AS member_c,
    l_linestatus = 'O' AS in_stock, CASE WHEN l_partkey % 2 = 0 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS pack_qty FROM lineitem"""


def goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).selectExpr("id", "seller", "shipped", "concat('s', cast(part % 3 AS string)) AS site", "CASE part % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'discounted' WHEN 2 THEN 'membership' WHEN 3 THEN 'multipack' ELSE 'out_of_stock' END AS page_type", "part % 4 = 0 AS is_stale", "CASE WHEN part % 7 = 0 THEN 'human' ELSE 'auto' END AS created_by", "list_c AS captured_at", "list_c % 1000 AS snapshot_bytes", "concat('u', cast(part AS string)) AS url")


GOLDENS = """SELECT id, seller, shipped, 's' || CAST(part % 3 AS VARCHAR) AS site,
    CASE part % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'discounted' WHEN 2 THEN 'membership' WHEN 3 THEN 'multipack' ELSE 'out_of_stock' END AS page_type,
    part % 4 = 0 AS is_stale, CASE WHEN part % 7 = 0 THEN 'human' ELSE 'auto' END AS created_by, list_c AS captured_at, list_c % 1000 AS snapshot_bytes,
    'u' || CAST(part AS VARCHAR) AS url FROM products"""

VIEWS = {"sku_tasks": SKU_TASKS, "candidates": CANDIDATES, "scrape_runs": SCRAPE_RUNS, "parsers": PARSERS, "node_events": NODE_EVENTS, "tasks": TASKS, "runs": RUNS, "products": PRODUCTS, "goldens": GOLDENS}
#: Which views a view stands on.
NEEDS = {"candidates": ["sku_tasks"], "tasks": ["node_events"], "runs": ["node_events"], "goldens": ["products"]}


def sql(body: str, *views: str) -> str:
    """A query over derived relations, which it names as CTEs."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " if body.lstrip().startswith("#") else " ") + body.lstrip().removeprefix("#")
