"""Session-level helpers: cutting lineage, size-checked broadcasts, worker paths."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that ``join_small`` broadcasts; beyond it a shuffle join is used.
BROADCAST_BYTES = 16 << 20

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Tables made in each open scope of ``tables``, the innermost last.
_SCOPES: list[list[DataFrame]] = []


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package: from the source tree in local mode, else from a zip that the driver serves.

    The zip is made once a context; executors fetch it like any file added to the application.
    """
    package, context = Path(__file__).resolve().parent, spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        env, root = context.environment, str(package.parent)
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
        return
    if getattr(context, "_refrain_zip", None):
        return
    context._refrain_zip = os.path.join(tempfile.mkdtemp(prefix="refrain-"), f"{package.name}.zip")  # the driver's own; it sends it
    with zipfile.ZipFile(context._refrain_zip, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(context._refrain_zip)


def prepare(spark: SparkSession) -> None:
    """What an application does once for its session: workers find the package, and Arrow batches have 1000 rows unless it chose a number.

    Operators work with any setting; batches of 10 000 long texts, Spark's default, only cost executors more memory.
    """
    workers_see_package(spark)
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode one is made where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    made = context._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="refrain-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with the session's codec or another, and read it back: lineage ends there.

    Lost executors then cost a re-read, never a recomputation of the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/refrain-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._refrain_path = path
    _file_system(out).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))  # at the end of the application, if nothing deletes it before
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def _file_system(df: DataFrame):
    return df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._refrain_path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


@contextmanager
def tables() -> Iterator[list[DataFrame]]:
    """Tables that ``cut`` makes inside the block are deleted when it ends, but for those taken off the list it yields."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_refrain_path", None)
        if path:
            _file_system(df).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def table_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table made by ``cut``."""
    return int(_file_system(df).getContentSummary(df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._refrain_path)).getLength())


def join_small(big: DataFrame, small: DataFrame, on, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a table made by ``cut``; broadcast it only if its written size is under ``limit``.

    Beyond the limit Spark's shuffled joins, which adaptive execution can split on skew, take over.
    Four times the compressed size is taken as the size in memory.
    """
    if 4 * table_bytes(small) <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)
