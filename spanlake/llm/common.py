"""What the training-data operators share: the folder for intermediate tables, and table loading.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``, which every executor
can read, so a lost executor costs a reread and never a recomputation that could differ. Only where that
setting is missing (tests, a laptop) does this module make a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN_ROOTS: dict[str, str] = {}
#: Where each stored table lies, for its release.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI or path that Spark can open."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        path = tempfile.mkdtemp(prefix="spanlake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN_ROOTS[app] = f"file://{path}"
    return _OWN_ROOTS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table called ``name`` in the shared folder."""
    return f"{shared_root(spark)}/spanlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = out, path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned and that nothing reads any more; what was made of them is written."""
    for df in tables:
        _, path = _PATHS.pop(id(df))
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a function makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
