"""What executors and driver share: the package's modules, and a folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gritstone-")) / "gritstone.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; a temporary one only in local mode, which is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gritstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder, True)
    return folder.rstrip("/")


#: Bytes of an Arrow batch, with one row at least, where the session keeps Spark's own 64 MB or the 16 MB of ``gritstone.llm``.
BATCHES, THEIRS, OURS = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "16777216b"), "4194304b"


def bound_batches(spark: SparkSession) -> None:
    """A Python worker holds several copies of a batch, so its memory goes by this and the longest row, not by the input."""
    if spark.conf.get(BATCHES, THEIRS[0]) in THEIRS:
        spark.conf.set(BATCHES, OURS)


def written_once(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, for what reads them more than once."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
