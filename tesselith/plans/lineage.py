"""Cut lineage by a table written to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where a local session has none, an own temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tesselith-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside are deleted at its end, not when the driver next collects its garbage."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(_TIDY, before) if before is not None else spark.conf.unset(_TIDY)


def materialise(df: DataFrame, name: str = "step", tidy: bool = False) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: a short lineage that outlives executors.

    With ``tidy`` the shuffle files of the write are deleted at its end (see ``tidied``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidied(spark) if tidy else contextlib.nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesselith_path = path
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``; nothing may read it later."""
    path = getattr(df, "_tesselith_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end; what was made from them must be written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)
