"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings this library relies on.  AQE re-plans joins and aggregations at
# runtime from real shuffle statistics: it turns a join into a broadcast join
# only when the materialised side is below the threshold (a size-checked
# broadcast), coalesces small partitions, and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def scale_conf(input_bytes: float, executors: int = 1000, cores_per_executor: int = 4,
               target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Partitioning settings sized from the input volume.

    Shuffle stages start with enough partitions for ~``target_partition_bytes``
    each (AQE then coalesces small ones and splits skewed join partitions);
    scans read ~128 MB splits.  For 100 TB this gives about 400k initial
    shuffle partitions, a few hundred waves of tasks over 4,000 cores, and
    partitions that fit comfortably in executor memory (spilling otherwise).
    """
    slots = executors * cores_per_executor
    parts = max(slots * 2, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def get_spark(master: str = "local[8]", app: str = "riskloom",
              shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster the master and memory come from spark-submit; this helper is
    for tests, notebooks and the bench.
    """
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskloom`` importable in Python workers (for the pandas UDFs
    of the kNN blocks and cohort kernels), as ``--py-files`` would: the
    package is zipped once per application and added with ``addPyFile``,
    which Spark distributes to every executor."""
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect session: no SparkContext
        sc, key = None, id(spark)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="riskloom-pkg-"), "riskloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith((".py", ".txt")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the job sets this to a shared, durable
    location and we only read it.  Only when it is unset (local tests) do we
    pick a fresh folder under the system temp dir.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        # A folder of this machine is shared by all only in local mode.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame, by: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write the rows as Parquet into the shared checkpoint folder and read
    them back.  With ``by`` the rows of each value of that column have files
    of their own, so that a filter on it reads no others.  ``group_bytes`` is for
    rows of some megabytes: writers and readers hold that much at a time, not
    a hundred rows and Parquet's 128 MB.

    The files outlive a lost executor, and later steps read only the columns
    and row groups that they need.  Used by operators whose intermediate
    results are read again, or whose plans would grow every round."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/riskloom-{uuid.uuid4().hex}"
    # By default the writer looks at its size every 100 rows.
    small = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(compression="zstd", **small).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        return int(os.environ.get("RISKLOOM_PARTITIONS", "8"))
