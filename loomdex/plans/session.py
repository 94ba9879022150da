"""Makes this package importable where Python workers run."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}
#: Rows of an Arrow batch where the session sets none: texts of some KB each must fit in a worker's memory several times.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, one of our own in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomdex-shared-")
    return _OWN[app]


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the files under a path as they are now: it changes with any file's name, size or time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(at, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join([path, *sorted(seen)]).encode()).hexdigest()[:32]


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, and a lost executor costs nothing that was done."""
    path = f"{shared_dir(df.sparkSession)}/loomdex-steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files once, so executors need no copy of their own, and bounds Arrow batches."""
    if spark.conf.get(_BATCH[0], None) in (None, "10000"):
        spark.conf.set(*_BATCH)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        path = os.path.join(tempfile.mkdtemp(prefix="loomdex-"), "loomdex.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((root / "loomdex").rglob("*.py")):
                z.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
