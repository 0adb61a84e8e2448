"""Session settings and the one way this package cuts long lineages."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "copse", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    parallel = 8 if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, set up on first use.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is
    used only by a local master, where driver and executors share one disk.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made.

    Iterative plans read their last state twice per round, so without a cut
    the plan would double each round. Files outlive a lost executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read it back.

    For tables that several steps read: later scans prune columns and row
    groups, and join planning knows their true size. :func:`cut` suits the
    small states of loops. ``group_rows`` bounds the rows of a row group, and so
    of a batch that is read: tables of long arrays need that.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"
    grouped(df.write, group_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grouped(writer: DataFrameWriter, rows: int | None) -> DataFrameWriter:
    """``writer`` with at most so many rows in a row group; batches of the reader end with it."""
    return writer if rows is None else writer.option("parquet.block.row.count.limit", rows)


def removed(df: DataFrame) -> None:
    """Delete the files behind a :func:`written` table that nothing reads any more."""
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/").split(":", 1)[-1]
    jvm = spark.sparkContext._jvm
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(root.lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Functions that run in workers are pickled by module name, so workers must
    be able to import the package wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
