"""A run's task tree, flushed as one: all of its tables become readable together or not at all, and a run's flush counts once.

Tasks write Parquet files that nobody reads yet and tell the driver their names. The driver's commit publishes one manifest
of a run, a single file, and readers take only files that a manifest names. So a failed task, a killed driver or a speculative
copy leaves nothing readable, and a flush that is repeated finds its run's manifest and adds nothing.

Paths are URIs of file systems that pyarrow opens (file, hdfs, s3, gs) and that driver and executors share. A run is flushed by
one writer at a time.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tallygrain_flush"


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def manifest_of(path: str, run: str) -> str:
    return f"{path}/manifests/{uuid.uuid5(uuid.NAMESPACE_URL, run).hex}.json"


def exists(files, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, and their rows, by table."""

    files: dict[str, list] = field(default_factory=dict)


class FlushWriter(DataSourceArrowWriter):
    """Rows of (table, a struct for each table): each task writes one file of each table that it has rows of."""

    def __init__(self, path: str, run: str, schema: StructType):
        self.path, self.run, self.tables = path, run, [f.name for f in schema.fields if f.name != "table"]
        self.schemas = {n: schema[n].dataType.json() for n in self.tables}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        files, root = opened(self.path)
        task, writers, told = uuid.uuid4().hex, {}, Written()
        try:
            for batch in iterator:
                kind = batch.column("table")
                for name in self.tables:
                    rows = batch.filter(pc.equal(kind, name)).column(name)
                    if not len(rows):
                        continue
                    table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(rows)])
                    if name not in writers:
                        files.create_dir(f"{root}/data/{name}", recursive=True)
                        at = f"data/{name}/{task}.parquet"
                        writers[name] = pq.ParquetWriter(f"{root}/{at}", table.schema, compression="zstd", filesystem=files)
                        told.files[name] = [at, 0]
                    writers[name].write_table(table)
                    told.files[name][1] += len(rows)
        finally:
            for w in writers.values():
                w.close()
        return told

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        final = manifest_of(root, self.run)
        if exists(files, final):  # the run has been flushed
            return self.abort(messages)
        files.create_dir(f"{root}/manifests", recursive=True)
        names = {n: [m.files[n] for m in messages if m and n in m.files] for n in self.tables}
        draft = f"{root}/manifests/_{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"run": self.run, "files": names, "schemas": self.schemas}).encode())
        files.move(draft, final)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        for at, _ in (f for m in messages if m for f in m.files.values()):
            files.delete_file(f"{root}/{at}")


class FlushSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FlushWriter:
        if overwrite:
            raise ValueError("a flush adds a run; it overwrites none")
        return FlushWriter(self.options["path"], self.options["run"], schema)


def flush(tables: dict[str, DataFrame], path: str, run: str) -> None:
    """All rows of a run's tables, by one job and one commit."""
    spark = next(iter(tables.values())).sparkSession
    spark.dataSource.register(FlushSource)
    kinds = {n: df.schema for n, df in tables.items()}

    def tagged(name: str, df: DataFrame) -> DataFrame:
        own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.select(F.lit(name).alias("table"), *[own.alias(n) if n == name else F.lit(None).cast(kind).alias(n) for n, kind in kinds.items()])

    rows = functools.reduce(DataFrame.unionByName, [tagged(n, df) for n, df in tables.items()])
    rows.write.format(FORMAT).mode("append").option("path", path).option("run", run).save()


def manifests(path: str) -> list[dict]:
    from pyarrow import fs

    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return [json.loads(files.open_input_stream(f.path).read()) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json")]


def flushed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's rows of all runs whose flush was committed."""
    told = manifests(path)
    names = [f"{path}/{at}" for m in told for at, _ in m["files"].get(table, [])]
    schema = next((m["schemas"][table] for m in told if table in m["schemas"]), None)
    if schema is None:
        raise ValueError(f"no flush has a table {table}")
    schema = StructType.fromJson(json.loads(schema))
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def swept(path: str) -> int:
    """Delete data files that no manifest names, left by jobs that were killed; how many there were. No flush may be under way."""
    from pyarrow import fs

    files, root = opened(path)
    named = {f"{root}/{at}" for m in manifests(path) for own in m["files"].values() for at, _ in own}
    loose = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and f.path not in named]
    for at in loose:
        files.delete_file(at)
    return len(loose)
