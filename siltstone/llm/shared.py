"""Tables written between the phases of a job.

They go to the shared folder named by ``spark.checkpoint.dir``, so that a lost
executor costs a reread and not a recomputation of the whole lineage. Where
the setting is absent (tests on one machine) a folder of our own is set.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark then removes a write's shuffle files as soon as the write has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_now.isDefined():
            folder = set_now.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            folder = tempfile.mkdtemp(prefix="siltstone-")
            spark.sparkContext.setCheckpointDir(folder)
    top = f"{folder.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}"
    if top not in _made:
        _made.add(top)
        atexit.register(_remove, spark, top)
    return top


_made: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before us
        pass


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df, computed once, stored as Parquet in the shared folder and read back; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def erase(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, _paths.pop(t))


def known_id(docs: DataFrame, id_col: str) -> Column:
    """The id in its own type, a null as 0 or empty; whether it is null has to stand beside it."""
    kind = docs.schema[id_col].dataType
    return F.coalesce(F.col(id_col), F.lit(0 if isinstance(kind, T.NumericType) else "").cast(kind))
