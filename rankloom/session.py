"""Session set-up for local work, and the shared folder for written intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_scratch: dict[str, str] = {}
# Paths handed out within each open scope, the innermost last.
_scopes: list[list[str]] = []


def local_session(app: str, cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench. A cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for a cluster where it is not installed.

    Functions that run in Python workers are looked up there by the name of their module.
    """
    package = Path(__file__).resolve().parent
    # The driver serves this file for as long as the application runs.
    folder = tempfile.mkdtemp(prefix="rankloom-package-")
    archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session may go without the setting; it then gets one temporary folder.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="rankloom-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten there."""
    path = f"{scratch_dir(spark)}/rankloom/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete what was written at a path of :func:`scratch_path`; nothing may read it any more."""
    if not path.startswith(f"{scratch_dir(spark)}/rankloom/"):
        raise ValueError(f"{path} is no path of scratch_path")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end.

    Whatever outlives the scope has to be written before that, to a path from outside. After an error the
    tables stay, for whoever looks into it.
    """
    _scopes.append([])
    done = False
    try:
        yield
        done = True
    finally:
        paths = _scopes.pop()
        for path in paths if done else ():
            remove_scratch(spark, path)


def materialise(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, or to ``path``, and go on from the files.

    The files outlive any executor, and the lineage ends there.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
