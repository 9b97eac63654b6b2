"""Tables that are changed in place: a change rewrites the partitions that it touches and no others, and shows at once.

A table is a folder of Parquet files and a list of versions. A version names the files of every partition; the current one is
the newest. A change reads the touched partitions of the current version, writes their new files beside the old ones, and
publishes the next version by one new file, so readers see all of a change or nothing, and one that reads an older version is not
disturbed. Two changes at a time would both publish the same number: the second is refused and may be made again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallygrain.sources.flush import exists, opened


class Conflict(RuntimeError):
    """Another change has been published meanwhile."""


class Versioned:
    """A table at a URI that driver and executors share, partitioned by a hash of its key."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], partitions: int = 64):
        self.spark, self.path, self.key, self.partitions = spark, path, key, partitions

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.partitions)).cast("int")

    # ---- versions

    def number(self) -> int:
        """Of the current version; 0 if there is none."""
        from pyarrow import fs

        files, root = opened(self.path)
        found = files.get_file_info(fs.FileSelector(f"{root}/versions", allow_not_found=True))
        return max((int(f.base_name.split(".")[0]) for f in found if f.base_name[0].isdigit()), default=0)

    def version(self, number: int | None = None) -> dict:
        files, root = opened(self.path)
        n = self.number() if number is None else number
        if not n:
            return {"schema": None, "files": {}}
        return json.loads(files.open_input_stream(f"{root}/versions/{n:010d}.json").read())

    def publish(self, number: int, told: dict) -> None:
        files, root = opened(self.path)
        files.create_dir(f"{root}/versions", recursive=True)
        final, draft = f"{root}/versions/{number:010d}.json", f"{root}/versions/_{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(told).encode())
        if exists(files, final):
            files.delete_file(draft)
            raise Conflict(f"version {number} has been published")
        files.move(draft, final)

    # ---- reading and writing

    def rows(self, number: int | None = None, slots: list[int] | None = None) -> DataFrame:
        """The rows of a version (the current one), or of some of its partitions."""
        told = self.version(number)
        if told["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        schema = StructType.fromJson(told["schema"])
        names = [f"{self.path}/{f}" for s, own in told["files"].items() if slots is None or int(s) in slots for f in own]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame) -> dict[str, list[str]]:
        """The rows as new files; their names by partition."""
        from pyarrow import fs

        batch = f"data/{uuid.uuid4().hex}"
        rows.withColumn("slot_", self.slot()).repartition("slot_").write.option("compression", "zstd").partitionBy("slot_").parquet(f"{self.path}/{batch}")
        files, root = opened(self.path)
        out: dict[str, list[str]] = {}
        for f in files.get_file_info(fs.FileSelector(f"{root}/{batch}", recursive=True)):
            if f.path.endswith(".parquet"):
                out.setdefault(f.path.split("slot_=")[1].split("/")[0], []).append(f.path.removeprefix(f"{root}/"))
        return out

    def create(self, rows: DataFrame) -> None:
        """The first version."""
        self.publish(self.number() + 1, {"schema": rows.schema.jsonValue(), "files": self.write(rows)})

    def change(self, keys: DataFrame, made: Callable[[DataFrame], DataFrame]) -> int:
        """Publish ``made`` of the rows of the partitions that the keys lie in; how many partitions that were."""
        n = self.number()
        told = self.version(n)
        touched = sorted(r[0] for r in keys.select(self.slot()).distinct().collect())  # at most one row a partition
        if touched:
            new = self.write(made(self.rows(n, touched)))
            left = {s: own for s, own in told["files"].items() if int(s) not in touched}
            self.publish(n + 1, {"schema": told["schema"], "files": left | new})
        return len(touched)

    def upsert(self, delta: DataFrame, update: dict[str, Callable[[Column, Column], Column]] | None = None) -> int:
        """Rows of the delta, one a key, put in place of those with their key, or added.

        update: for a column, what it becomes from its old and new value where the key is known; others take the new value. A key
        with a null is known by it.
        """
        columns = self.rows().columns
        update = update or {}
        new = delta.select(*self.key, F.struct(*columns).alias("new_")).withColumn("slot_", self.slot())

        def made(old: DataFrame) -> DataFrame:
            both = old.select(*self.key, F.struct(*columns).alias("old_"))
            on = [both[k].eqNullSafe(new[k]) for k in self.key]
            joined = both.join(new, on, "full").select("old_", "new_")
            o, d = F.col("old_"), F.col("new_")
            value = lambda c: F.when(o.isNull(), d[c]).when(d.isNull(), o[c]).otherwise(update[c](o[c], d[c]) if c in update else d[c])
            return joined.select(*[value(c).alias(c) for c in columns])

        return self.change(delta, made)

    def update(self, keys: DataFrame, values: dict[str, object]) -> int:
        """Columns set on the rows whose key is listed."""
        marked = keys.select(*self.key).distinct().withColumn("hit_", F.lit(True))

        def made(old: DataFrame) -> DataFrame:
            joined = old.join(marked, self.key, "left")
            return joined.select(*[F.when(F.col("hit_"), F.lit(values[c])).otherwise(F.col(c)).cast(old.schema[c].dataType).alias(c) if c in values else F.col(c) for c in old.columns])

        return self.change(keys, made)

    def delete(self, keys: DataFrame) -> int:
        """Rows whose key is listed go."""
        return self.change(keys, lambda old: old.join(keys.select(*self.key).distinct(), self.key, "left_anti").select(old.columns))

    def swept(self, keep: int = 1) -> int:
        """Delete versions but for the newest, and files that none of those names; how many files."""
        from pyarrow import fs

        files, root = opened(self.path)
        last = self.number()
        live = {f"{root}/{f}" for n in range(max(1, last - keep + 1), last + 1) for own in self.version(n)["files"].values() for f in own}
        for n in range(1, last - keep + 1):
            if exists(files, at := f"{root}/versions/{n:010d}.json"):
                files.delete_file(at)
        loose = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/data", recursive=True)) if f.path.endswith(".parquet") and f.path not in live]
        for at in loose:
            files.delete_file(at)
        return len(loose)
