"""Session helpers: a tuned local/cluster session and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tallyspark") -> SparkSession:
    """Build (or reuse) a session with AQE on, UI off and UTC time.

    Under ``spark-submit`` (or with SPARK_MASTER set) ``master`` stays None and the
    launcher's settings win; only a plain ``python`` run falls back to local mode. The
    shuffle partition count should then be sized to the data (e.g. ~128 MB of
    shuffle data per partition), AQE coalesces the rest.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or os.environ.get("SPARK_MASTER")
    if master or not submitted:
        builder = builder.master(master or f"local[{cpus}]")
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset
    (unit tests on a laptop) a private folder under /tmp is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tallyspark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tallyspark/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a fresh folder of the shared scratch space and read it back.

    Later stages read the written rows, so values that depend on the layout (row numbers,
    partition ids) are the same in all of them, also after an executor is lost.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SHIPPED_KEY = "tallyspark.shipped"


def ship_package(spark: SparkSession) -> None:
    """Make ``tallyspark`` importable in Python workers (like ``--py-files``).

    Needed when the driver imports the package from a path the executors do not
    have (e.g. a notebook or a driver run from another folder). The package is
    zipped once per application next to the package and handed to
    ``SparkContext.addPyFile``, which serves it to every executor. A read-only
    install is assumed to be on the executors already (``--py-files``).
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if spark.conf.get(_SHIPPED_KEY, None) == app:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(r, f) for r, _, fs in os.walk(pkg_dir) for f in fs if f.endswith(".py"))
    digest = hashlib.sha1("".join(f"{f}:{os.path.getmtime(f)}" for f in files).encode()).hexdigest()[:12]
    out_dir = os.path.join(os.path.dirname(pkg_dir), "build")
    try:
        os.makedirs(out_dir, exist_ok=True)
        if not os.access(out_dir, os.W_OK):
            raise OSError(out_dir)
    except OSError:
        # read-only install: use the session's shared checkpoint folder when it is a plain
        # file system path; otherwise the package is expected on the executors (--py-files)
        shared = ensure_checkpoint_dir(spark)
        if not shared.startswith(("file:", "/")):
            spark.conf.set(_SHIPPED_KEY, app)
            return
        out_dir = os.path.join(shared.replace("file:", "", 1), "tallyspark-pkg")
        os.makedirs(out_dir, exist_ok=True)
    zpath = os.path.join(out_dir, f"tallyspark-{digest}.zip")
    if not os.path.exists(zpath):
        tmp = zpath + f".{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.relpath(f, os.path.dirname(pkg_dir)))
        os.replace(tmp, zpath)
    sc.addPyFile(zpath)
    spark.conf.set(_SHIPPED_KEY, app)
