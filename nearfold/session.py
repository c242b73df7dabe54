"""The session's side of the engine: making the package known to executors, and the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch where the session sets no limit: rows alone would let a batch of long texts grow at will.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once for each Spark application, and bound Arrow batches by bytes.

    Functions that run in Python workers are pickled by reference, so the workers must be able to import the package
    wherever they run and whatever the driver's working directory is.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="nearfold-code-"), "nearfold.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("nearfold", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, a single machine) a temporary one is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext._jsc.sc()
    if not named:
        made = context.getCheckpointDir()
        named = made.get().rsplit("/", 1)[0] if made.isDefined() else tempfile.mkdtemp(prefix="nearfold-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write narrow rows to the shared folder and go on from there.

    Spark removes them when nothing uses them any more if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set when
    the session starts; ``sweep`` does in any case.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder's name in the shared folder; it begins with the application's, so that ``sweep`` finds it."""
    return f"{shared_dir(spark).rstrip('/')}/nearfold-{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """As ``cut``, but as Parquet, for many or wide rows: compressed, and read column by column."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def sweep(spark: SparkSession) -> int:
    """Remove what this application wrote to the shared folder, checkpoints included; results that read it are then void.

    To be called when a job is done with its results; returns how many folders there were.
    """
    paths = [f"{shared_dir(spark).rstrip('/')}/nearfold-{spark.sparkContext.applicationId}-*"]
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        paths.append(f"{made.get()}/*")
    found = 0
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for one in system.globStatus(path) or []:
            found += bool(system.delete(one.getPath(), True))
    return found
