"""Sources. Calls to search engines, page fetchers and models are data here: recorded tables, or a provider that a user
registers; readers for workbooks, JSON bodies and dimensions."""

from __future__ import annotations

import json
import multiprocessing
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallygrain import config
from tallygrain.functions.detect import poll_state
from tallygrain.functions.text import cell
from tallygrain.functions.urls import hostname

SEARCH_SCHEMA = "query string, result_idx int, title string, url string, snippet string"
#: Registered search providers: name -> function(query, k, country) -> iterator of (title, url, snippet).
PROVIDERS: dict[str, Callable[[str, int, str], Iterator[tuple[str, str, str]]]] = {}
#: Registered scrapers: site -> (order, name).
SCRAPERS: dict[str, list[tuple[int, str]]] = {}
#: Vetted page parsers: name -> function(html, url) -> dict. Source text is never executed.
PARSERS: dict[str, Callable[[str, str], dict]] = {}


def register_scraper(site: str, name: str, order: int = 1) -> None:
    SCRAPERS[site] = sorted([*SCRAPERS.get(site, []), (order, name)])


def provider_chain(spec: str | list[str]) -> list[tuple[int, str]]:
    """(rank, name) of one provider or an ordered list; unknown names and empty lists are errors."""
    names = [spec] if isinstance(spec, str) else list(spec)
    bad = [n for n in names if n not in {*config.PROVIDERS, *PROVIDERS}]
    if bad or not names:
        raise ValueError(f"unknown search providers: {bad}")
    return list(enumerate(names))


def search_source(provider_name: str) -> type[DataSource]:
    """A data source of a registered provider, to pass to spark.dataSource.register; its format is tallygrain_<name>.

    One partition for each query of the option ``queries`` (one a line); the first k results of a query (option ``k``), those
    without title or link left out; a call that fails is tried again (option ``tries``, three by default).
    """
    provider = PROVIDERS[provider_name]  # travels with the class: readers run in processes of their own

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [InputPartition(q) for q in self.options["queries"].split("\n") if q]

        def read(self, partition):
            k, tries = int(self.options.get("k", config.SEARCH_K)), int(self.options.get("tries", 3))
            rows = []
            for left in range(tries - 1, -1, -1):
                try:
                    rows = list(provider(partition.value, k, self.options.get("country", "uk")))
                    break
                except OSError:
                    if not left:
                        raise
            for i, (title, url, snippet) in enumerate(rows[:k]):
                if title and url:
                    yield partition.value, i, title, url, snippet

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"tallygrain_{provider_name}"

        def schema(self) -> str:
            return SEARCH_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    return Source


def recorded_search(queries: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded results of the queries that are asked."""
    return queries.join(recorded, ["provider", "query"])


def read_workbook(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table of products; columns that are not there are an error before any work. Excel needs an engine for pandas."""
    if path.endswith((".xlsx", ".xls")):
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path))
    elif path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
    else:
        df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {', '.join(missing)}")
    return df


def sku_rows(df: DataFrame, sku: str, web: str, country: str, index: str) -> DataFrame:
    """row_index, product_name, website, country and error: rows without website or country are told, the rest goes on."""
    rows = df.select(F.col(index).alias("row_index"), F.trim(F.coalesce(F.col(sku).cast("string"), F.lit("nan"))).alias("product_name"), cell(F.col(web)).alias("website"), cell(F.col(country)).alias("country"))
    return rows.withColumn("error", F.when(F.col("website").isNull(), "website is missing").when(F.col("country").isNull(), "country is missing"))


def website_summary(rows: DataFrame) -> DataFrame:
    """Distinct websites in order of first appearance, comma-joined."""
    first = rows.where("website IS NOT NULL").groupBy("website").agg(F.min("row_index").alias("i"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "website"))), lambda x: x["website"]), ", ").alias("websites"))


def coldstart_rows(df: DataFrame, index: str, site: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows of page_type and url with their problems, mandatory page types without a row). Headers are normalised, the first
    of equal ones counts, blank rows go."""
    import re

    names: dict[str, str] = {}
    for c in df.columns:
        names.setdefault(re.sub(r"[\s-]+", "_", c.strip().lower()), c)
    need = [c for c in ("page_type", "url") if c not in names]
    if need:
        raise KeyError(f"columns not found: {', '.join(need)}")
    rows = df.select(F.col(f"`{names[index]}`").alias("row_index"), cell(F.col(f"`{names['page_type']}`")).alias("page_type"), F.nullif(F.trim(F.col(f"`{names['url']}`")), F.lit("")).alias("url"))
    rows = rows.where("page_type IS NOT NULL OR url IS NOT NULL")
    problem = F.when(F.col("url").isNull(), "url is missing").when(F.col("page_type").isNull(), "page type is missing").when(~F.col("page_type").isin(*config.PAGE_TYPES), "page type is unknown")
    rows = rows.withColumn("problem", problem)
    own = config.SITE_PROFILES.get(site, {})
    must = [p for p in config.PAGE_TYPES if own.get(p, (True, config.MANDATORY_PAGE_TYPES.get(p, True)))[1]]
    spark = df.sparkSession
    missing = spark.createDataFrame([(p,) for p in must], "page_type string").join(rows.where("problem IS NULL"), "page_type", "left_anti")
    return rows, missing


def report_urls(df: DataFrame) -> DataFrame:
    """label, url and host, the host taken from the URL where it is blank."""
    host = F.coalesce(F.nullif(F.trim(F.col("host")), F.lit("")), hostname(F.col("url"))) if "host" in df.columns else hostname(F.col("url"))
    return df.select("label", "url", host.alias("host"))


def resolve_html(rows: DataFrame, goldens: DataFrame, fetched: DataFrame, force_fetch: bool = False) -> DataFrame:
    """Each row's page and where it is from: the newest golden sample of the URL, else what was fetched."""
    cache = goldens.groupBy("url").agg(F.max_by("html_snapshot", "id").alias("cached"))
    got = rows.join(cache, "url", "left").join(fetched.select("url", "status", F.col("html").alias("fresh")), "url", "left")
    html = F.col("fresh") if force_fetch else F.coalesce("cached", "fresh")
    origin = F.when(html.isNull(), "none").when(F.lit(force_fetch) | F.col("cached").isNull(), "fetched").otherwise("golden")
    return got.select(*rows.columns, F.when(origin == "golden", 200).otherwise(F.col("status")).alias("status"), html.alias("html"), origin.alias("origin"))


def representative_page(fetched: DataFrame) -> DataFrame:
    """Of each site the largest page with status 200, the first of equals."""
    return fetched.where("status = 200").groupBy("site").agg(F.max_by(F.struct("url", "html"), F.struct(F.length("html"), -F.col("idx"))).alias("p")).select("site", "p.*")


def table_counts(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Rows of every table of the catalog."""
    out = None
    for n in sorted(names or [t.name for t in spark.catalog.listTables()]):
        one = spark.table(n).agg(F.lit(n).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


class Sandbox:
    """Calls in a process of their own, with a deadline and room of memory for each: what overruns either is killed and told, and
    the next call gets a new process."""

    def __init__(self, functions: list[Callable[[str, str], dict]], seconds: float, megabytes: int):
        self.functions, self.seconds, self.megabytes = functions, seconds, megabytes
        self.process = self.pipe = None

    def start(self) -> None:
        """The process of the next calls; it holds what the worker holds when it starts."""
        context = multiprocessing.get_context("fork")  # functions need not be sent
        self.pipe, theirs = context.Pipe()
        self.process = context.Process(target=self.serve, args=(theirs,), daemon=True)
        self.process.start()
        theirs.close()

    def serve(self, pipe) -> None:
        import resource

        with open("/proc/self/statm") as f:
            held = int(f.read().split()[0]) * resource.getpagesize()
        most = held + (self.megabytes << 20)
        resource.setrlimit(resource.RLIMIT_AS, (most, most))
        while True:
            i, html, url = pipe.recv()
            try:
                told = (True, json.dumps(self.functions[i](html, url), default=str), None)
            except BaseException as e:  # whatever a plug-in raises belongs to its row, an exit too
                told = (False, None, f"{type(e).__name__}: {e}")
            pipe.send(told)

    def call(self, i: int, html: str, url: str) -> tuple[bool, str | None, str | None]:
        if self.process is None:
            self.start()
        try:
            self.pipe.send((i, html, url))
            if self.pipe.poll(self.seconds):
                return self.pipe.recv()
            told = (False, None, f"TimeoutError: over {self.seconds:g} s")
        except (EOFError, OSError):
            self.process.join(1)
            told = (False, None, f"ChildProcessError: ended with {self.process.exitcode}")
        self.stop()
        return told

    def stop(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.pipe.close()
            self.process = self.pipe = None


#: Pages that a task holds as texts at a time, with what came of them.
SLICE = 64


def run_parsers(pages: DataFrame, names: list[str], seconds: float = 10.0, megabytes: int = 512) -> DataFrame:
    """Registered parsers on every page, in order: url, position, parser, ok, output (JSON) or error. One parser's failure is
    a row like any other.

    Each call has so many seconds, and so many megabytes besides what the worker holds: one that loops ends as TimeoutError,
    one that asks for more as MemoryError, one that takes its process down as ChildProcessError. A task keeps one process for its calls.
    """
    chosen = [(i, n, PARSERS[n]) for i, n in enumerate(names)]

    def run(batches):
        box = Sandbox([f for *_, f in chosen], seconds, megabytes)
        box.start()  # before there are pages whose memory the process would share
        try:
            yield from tried((batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE)), box)
        finally:
            box.stop()

    def tried(batches, box):
        for batch in batches:
            rows = []
            for url, html in zip(*(c.to_pylist() for c in batch.columns)):
                for i, n, _ in chosen:
                    rows.append((url, i, n, *box.call(i, html or "", url)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()))], ["url", "position", "parser", "ok", "output", "error"])

    return pages.select("url", "html").mapInArrow(run, "url string, position int, parser string, ok boolean, output string, error string")


def poll_end(status: Column) -> Column:
    """pending, ready or failed, or auth_error where access was refused."""
    return F.when(F.lower(status).isin("unauthorized", "forbidden"), "auth_error").otherwise(poll_state(status))


def poll_outcomes(polls: DataFrame, deadline: int) -> DataFrame:
    """How each job's polling ended, from its recorded polls (job_id, at, status): ready or failed at the first such state by
    the deadline (seconds from the start), auth_error where access was refused, else timeout; and how many polls it took.

    Polls after the end do not count, and none triggers the job again.
    """
    own = polls.where(F.col("at") <= deadline).withColumn("state", poll_end(F.col("status")))
    per = own.groupBy("job_id").agg(F.min(F.when(F.col("state") != "pending", F.struct("at", "state"))).alias("end"), F.sort_array(F.collect_list("at")).alias("times"))
    took = F.size(F.filter("times", lambda t: F.col("end").isNull() | (t <= F.col("end.at"))))
    known = polls.select("job_id").distinct().join(per, "job_id", "left")
    return known.select("job_id", F.coalesce("end.state", F.lit("timeout")).alias("outcome"), F.coalesce(F.when(F.col("times").isNotNull(), took), F.lit(0)).cast("long").alias("polls"))


def zipped(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows with what other stages made of them, side by side by row_index; a row that a stage lacks has nulls there."""
    for other in others:
        rows = rows.join(other, "row_index", "left")
    return rows


def sandbox_outcome(ok: Column, output: Column, error: Column, fault: Column) -> Column:
    """struct(ok, value, error_type, message) of a parser's run: a violation found in its source, a timeout, another exception,
    or its value."""
    kind = F.when(fault.isNotNull(), "Violation").when(ok, None).when(error.startswith("TimeoutError"), "Timeout").otherwise("Exception")
    return F.struct(kind.isNull().alias("ok"), F.when(kind.isNull(), output).alias("value"), kind.alias("error_type"), F.when(kind == "Violation", fault).when(kind.isNotNull(), error).alias("message"))
