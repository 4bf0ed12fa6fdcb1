"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch. Texts are whole documents, so batches are kept short to bound a Python worker's memory.
BATCH_ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Hold the session's Arrow batches to ``rows`` rows at most; a smaller bound, of another operator or the user, stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders that this session has made below the shared one.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = f"{scratch_root(spark)}/helixframe/{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def mark() -> int:
    """Where the session stands, for cleanup(since=...)."""
    return len(_made)


def cleanup(spark: SparkSession, *, since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove what operators of this session have written to the shared folder, but for the table ``keep``.

    With ``since``, a mark(), only what came after it. Results not yet saved that read it go with it.
    """
    files = keep.inputFiles() if keep is not None else []
    kept = [folder for folder in _made[since:] if any(folder.rsplit("/", 1)[-1] in f for f in files)]
    for folder in _made[since:]:
        if folder not in kept:
            _removed(spark, folder)
    _made[since:] = kept


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs a reread only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Remove the files of tables made by written(), once nothing reads them any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _removed(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
