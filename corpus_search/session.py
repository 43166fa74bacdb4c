"""Session helpers: building a local session for tests/bench and locating shared scratch space.

On a cluster the session comes from the platform; the only thing we read from it is
``spark.checkpoint.dir``, the shared folder used for lineage cuts and job-local files.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpus_search") -> SparkSession:
    """Session for tests and the bench (local mode). UI stays off."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        .getOrCreate()
    )
    ship_package(spark)
    return spark


_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> str:
    """Make ``corpus_search`` importable in the Python workers (what ``--py-files`` does).

    Executor-side code (Arrow batch functions, grouped/stateful functions) refers to this
    package, so its modules must be importable wherever the tasks run. The package is zipped
    on the driver once per application and added with ``addPyFile``; Spark serves it to every
    executor. A no-op when already done for this application. Returns the zip's path.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return _SHIPPED[app]
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="corpus-search-pkg-")  # build artifact on the driver
    path = os.path.join(out_dir, "corpus_search.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, names in os.walk(pkg_dir):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED[app] = path
    return path


_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Unset, a local session (tests) gets a folder of its own, the same for the whole application; on a
    cluster, where a machine's own folder would not be shared, that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = _LOCAL_ROOTS.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="corpus-search-ckpt-")
        _LOCAL_ROOTS[sc.applicationId] = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise ``df`` as parquet in the shared folder and read it back.

    Unlike ``localCheckpoint`` this survives executor loss, because the files live in the
    shared folder and the re-read plan has no lineage back to the inputs.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it lies; callers that want it spread ask for a repartition."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
