"""Sinks. Tables are functional: a change is a new relation from the old one and a delta, written over its partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def enriched(rows: DataFrame, results: DataFrame) -> DataFrame:
    """The input with the four result columns; a row with an error gets the error verdict, no URL and an empty trace."""
    trace = F.to_json(F.struct(*[F.col(f"v_{x}").alias(x) for x in ("domain", "brand", "numeric", "distinguishing")]), {"ignoreNullFields": "false"})
    r = results.select("row_index", "verdict", "matched_url", trace.alias("trace"), "reason")
    bad = F.col("error").isNotNull()
    return rows.join(r, "row_index", "left").select(
        *rows.columns,
        F.when(bad, "error").otherwise(F.col("verdict")).alias("match_verdict"),
        F.when(bad, "not found").otherwise(F.coalesce("matched_url", F.lit("not found"))).alias("match_url"),
        F.when(bad, "{}").otherwise(F.coalesce("trace", F.lit("{}"))).alias("match_trace"),
        F.when(bad, F.col("error")).otherwise(F.col("reason")).alias("match_reason"),
    )


def suppressed(df: DataFrame, columns: list[str], store: bool) -> DataFrame:
    """Payload columns kept or emptied."""
    return df if store else df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def updated(df: DataFrame, ids: DataFrame, values: dict) -> DataFrame:
    """The rows whose id is listed, changed."""
    marked = df.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.select(*[F.when(F.col("_hit"), F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def deleted(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def clear_site(tables: dict[str, DataFrame], site: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """A site's rows out of every table, references from other sites' runs to its parsers emptied; and how many went."""
    gone = {n: df.where(F.col("site") == site).count() for n, df in tables.items()}
    out = {n: df.where(~F.col("site").eqNullSafe(F.lit(site))) for n, df in tables.items()}
    if {"parsers", "scrape_runs"} <= tables.keys():
        ids = tables["parsers"].where(F.col("site") == site).select(F.col("id").alias("winning_parser_id")).distinct().withColumn("_gone", F.lit(True))
        runs = out["scrape_runs"].join(ids, "winning_parser_id", "left")
        out["scrape_runs"] = runs.withColumn("winning_parser_id", F.when(F.col("_gone").isNull(), F.col("winning_parser_id"))).select(tables["scrape_runs"].columns)
    return out, gone


def evolved(df: DataFrame, schema: str) -> DataFrame:
    """The table with columns that a newer schema adds, empty."""
    return df.unionByName(df.sparkSession.createDataFrame([], schema), allowMissingColumns=True)


def inject_region(text: str, name: str, body: str) -> str:
    """Markdown with the region between two markers replaced; a text without the markers is an error."""
    start, end = f"<!-- BEGIN {name} -->", f"<!-- END {name} -->"
    a, b = text.find(start), text.find(end)
    if a < 0 or b < a:
        raise ValueError(f"no region {name}")
    return f"{text[: a + len(start)]}\n{body.strip()}\n{text[b:]}"


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small table in Markdown; longer ones are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows")
    cells = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v).replace("|", r"\|") for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells)


def markdown_tables(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """by, body: a Markdown table for each value of a column, its rows in order of the columns."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*columns, line.alias("line")))).alias("rows"))
    head = "\n".join("| " + " | ".join(x) + " |" for x in (columns, ["---"] * len(columns)))
    return rows.select(by, F.concat_ws("\n", F.lit(head), F.transform("rows", lambda r: r["line"])).alias("body"))


def injected(text: Column, name: str, body: Column) -> Column:
    """``inject_region`` of a column of texts; a text without the markers is an error."""
    start = F.lit(f"<!-- BEGIN {name} -->")
    a, b = F.locate(f"<!-- BEGIN {name} -->", text), F.locate(f"<!-- END {name} -->", text)
    whole = F.concat(F.substring(text, F.lit(1), a - 1), start, F.lit("\n"), F.trim(body), F.lit("\n"), F.substring(text, b, F.length(text)))
    return F.when((a > 0) & (b > a), whole).otherwise(F.raise_error(F.lit(f"no region {name}")))
