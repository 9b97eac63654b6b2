"""Session settings and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def build_session(app: str = "tallygrain", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session as the tests and the bench use it; on a cluster, pass the same settings to spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a context, so that Python functions can import it there."""
    context = spark.sparkContext
    if context in _shipped:
        return spark
    root = Path(__file__).resolve().parent
    fd, path = tempfile.mkstemp(suffix=".zip", prefix="tallygrain-")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables that all executors see: under spark.checkpoint.dir, or a temporary one in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"tallygrain-{os.getuid()}")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what is read many times is worked out once, and again by no lost executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
