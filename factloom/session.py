"""Session helpers: a local session for tests and bench, engine settings, and tables written to the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are bounded in rows and in bytes, so that very long texts cannot fill a worker.
ARROW_ROWS = 4000
ARROW_BYTES = 32 << 20


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factloom")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that they need no PYTHONPATH."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).parent
    folder = Path(tempfile.mkdtemp(prefix="factloom-ship-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "factloom.zip", "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(folder / "factloom.zip"))
    _shipped.add(sc.applicationId)


def shipped(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A Python function of columns that sends this package to the workers when it is used, if a session is there."""

    @functools.wraps(udf)
    def call(*cols):
        if (spark := SparkSession.getActiveSession()) is not None:
            ship(spark)
        return udf(*cols)

    return call


def tune(spark: SparkSession) -> None:
    """Ship the package and bound Arrow batches in this session; a smaller setting of the caller stays."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        try:
            small = now is not None and 0 < int(now) <= most
        except ValueError:
            small = False
        if not small:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, else (tests, local mode) a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, there, True)
        spark.conf.set("spark.checkpoint.dir", "file://" + there)
        there = "file://" + there
    return there


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


@contextlib.contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffles of the queries within serve nothing else: Spark deletes them when a query ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def settled(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage, is computed once however often it is read, stays readable when executors are lost, and a later
    reader takes only the columns it needs. It is deleted when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with clean_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing will read again, as those of a past round."""
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if path:
            deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path of the shared folder."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and the named columns, each worked out once. They come from a generator of one row, which filters don't pass: pushed below
    a projection they would work out its expressions, Python functions too, a second time."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def sorted_join(side: DataFrame) -> DataFrame:
    """A side of a join whose size follows the data: it is met by sorting, never broadcast. Spark would choose by the size of its files, which for
    packed tables of short rows is a small part of what the driver holds when it builds the broadcast."""
    return side.hint("merge")


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows cost much each, over all cores: where the files give fewer splits than there are cores, rows are dealt round;
    where they give enough, as any large table does, nothing is shuffled. Only for plain scans, whose splits are known before they run."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
