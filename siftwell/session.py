"""The SparkSession this engine expects, and the shared folder that cuts lineage."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "siftwell", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow. On a cluster shuffles keep its own number of partitions, which AQE coalesces; a local
    master has 8 unless told otherwise."""
    b = SparkSession.builder.master(master).appName(app)
    if shuffle_partitions is None and _is_local(master):
        shuffle_partitions = 8
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | ({} if shuffle_partitions is None else {"spark.sql.shuffle.partitions": str(shuffle_partitions)}) | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset and all is one process (tests) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not _is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and kept when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once an application, so that Arrow functions can import it there.

    Arrow batches are also cut to 1,000 rows where the session has the default of 10,000: rows here are whole texts.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId not in _SHIPPED:
        here = pathlib.Path(__file__).resolve().parent
        path = pathlib.Path(tempfile.mkdtemp(prefix="siftwell-")) / "siftwell_code.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, f"{here.name}/{p.relative_to(here)}")
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)
    return spark
