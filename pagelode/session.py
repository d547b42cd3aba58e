"""Session helpers: session factory, table access, shared scratch tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows and bytes, as text, that a side may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Spark's setting to remove the shuffle files of a query when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(name: str = "pagelode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that UDFs can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pagelode-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as made:
        for path in sorted(root.rglob("*.py")):
            made.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (`spark.checkpoint.dir`); only a local session gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pagelode-")
    spark.conf.set("spark.checkpoint.dir", made)
    atexit.register(_remove, spark, made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def write_scratch(df: DataFrame, name: str, tidy: bool = False) -> str:
    """Write `df` under the shared folder and return the path: it cuts lineage and survives lost executors.

    `tidy` removes the shuffle files of the write when it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, str(tidy or before == "true").lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """`df` as a written table in the shared folder."""
    schema = df.schema
    return df.sparkSession.read.schema(schema).parquet(write_scratch(df, name, tidy))


def drop_scratch(spark: SparkSession, path: str) -> None:
    _remove(spark, path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting that `df` has at most `rows` rows and `size` bytes; else leave the join to shuffle.

    The count runs the plan of `df` once more: what is dear to compute should be a stored table.
    """
    width = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    held = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), width.alias("bytes")).first()
    return F.broadcast(df) if held["n"] <= rows and held["bytes"] <= size else df
