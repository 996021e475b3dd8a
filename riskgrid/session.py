"""Session helpers.

Cluster jobs get their session from the caller; these helpers only fill in
settings that are unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on.  Applied only where the session has no value.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # polygon rows can be large; keep Arrow batches small for the kernels
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "riskgrid") -> SparkSession:
    """A local session for tests and the bench (UI off, no extra servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the cluster and is read as is.  Only when it is
    unset (local tests) a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if sc.master.startswith("local"):
            d = tempfile.mkdtemp(prefix="riskgrid-ckpt-", dir=os.environ.get("RISKGRID_SCRATCH", "/tmp"))
        else:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(d)
    return d


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a unique ``key`` over as many tasks as the session shuffles into: Spark sizes tasks by bytes, and geometry
    is little text but much work a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


class Tables:
    """Tables of one job, written as Parquet into the shared checkpoint folder: they cut the lineage, survive lost
    executors, and carry their size, by which Spark decides what to broadcast.  ``drop`` removes those that were only
    kept; a ``result`` stays."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/riskgrid-{uuid.uuid4().hex}"
        self.n = 0

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}-{name}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame) -> DataFrame:
        return self._written(df, "kept")

    def result(self, df: DataFrame) -> DataFrame:
        return self._written(df, "result")

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}-kept")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskgrid`` importable in the Python workers (the Arrow kernels run there):
    zip the package once per application and hand it to ``addPyFile``, which copies it
    to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="riskgrid-pkg-")
    archive = shutil.make_archive(os.path.join(stage, "riskgrid"), "zip", root_dir=os.path.dirname(pkg_dir),
                                  base_dir="riskgrid")
    sc.addPyFile(archive)
    _SHIPPED.add(app)
