"""Session helpers: where checkpoints go, how input is spread over tasks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "strandline", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; a folder of
    our own only where that is unset (tests on one machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(named or _own_folder())


def _own_folder() -> str:
    """A folder for one machine, removed when the driver ends."""
    folder = tempfile.mkdtemp(prefix="strandline-checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (shared storage)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    """Number of partitions for CPU-heavy stages: follows the cluster and the
    session's shuffle setting, so it grows with both."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row per key (rows delivered twice carry the same facts). The
    explicit repartition keeps AQE from folding the rows into a few tasks,
    and dropDuplicates reuses it, so there is one exchange."""
    return df.repartition(tasks(df.sparkSession), *key).dropDuplicates(list(key))


_SHIPPED: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that they
    need no shared installation of it."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    from pathlib import Path

    here = Path(__file__).resolve().parent
    if here.is_dir() and not any(p.suffix == ".zip" for p in here.parents):
        folder = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        copy = Path(folder, "src", here.name)
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "strandline_package"), "zip", copy.parent))
    _SHIPPED[app] = True
