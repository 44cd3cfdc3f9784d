"""Files that the driver and all executors share.

Everything an operator writes between two jobs lives below the folder named by
``spark.checkpoint.dir``.  The setting is read from the session; only a local
session without one gets a folder of its own.
"""

from __future__ import annotations

import atexit
import gc
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_DEFAULT = "file:///tmp/checkpoints/junctura"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder, from the session's ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_DEFAULT
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; removed when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def mark() -> int:
    """A point in time, for :func:`release`."""
    return len(_made)


def release(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the folders made since a :func:`mark` whose session is alive, but not those of the tables to keep."""
    kept = {df.folder for df in keep}
    stay = [x for x in _made[since:] if x[1] in kept]
    gone = [x for x in _made[since:] if x[1] not in kept]
    _made[since:] = stay
    for spark, path in gone:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session is gone: the folder is left to the cluster's own clean-up
            pass


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    gone = {df.folder for df in tables}
    for at in range(len(_made) - 1, -1, -1):
        if _made[at][1] in gone:
            remove(*_made.pop(at))


atexit.register(release)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage.  ``folder`` of the result says where."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


REST = "__rest"


def narrowed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own`` that ``docs`` has, and all others as one struct, so that their names play no part."""
    others = [n for n in docs.columns if n not in own]
    quoted = ["`" + n.replace("`", "``") + "`" for n in others]
    rest = [F.struct(*[F.col(q).alias(f"c{i}") for i, q in enumerate(quoted)]).alias(REST)] if others else []
    return docs.select(*[n for n in own if n in docs.columns], *rest)


def widened(df: DataFrame, names: list[str], *own: str) -> DataFrame:
    """The columns ``names`` again, in their order."""
    place = {n: i for i, n in enumerate(n for n in names if n not in own)}
    return df.select(*[F.col(REST)[f"c{place[n]}"].alias(n) if n in place else F.col(n) for n in names])


def settle(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files that no DataFrame refers to any more: it follows the collector, which comes late on a large heap.

    The scheduler holds its last job until there is another, so a job of one row goes first."""
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast, but only after a count shows ``max_rows`` narrow rows at most."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_heavy(left: DataFrame, right: DataFrame, on: list[str], heavy: Column, max_rows: int = 100_000) -> DataFrame:
    """The inner join of two tables where the rows of ``right`` that are ``heavy`` meet very many of ``left``.

    Those are broadcast, so their partners stay where they are; the others meet by a
    shuffle.  ``right`` has a row a key.  Above ``max_rows`` heavy rows (each has its
    thousands of partners, so the data are large) all meet by the shuffle."""
    hot = right.where(heavy)
    n = hot.limit(max_rows + 1).count()
    if not 0 < n <= max_rows:
        return left.join(right, on)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(~heavy), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str, max_rows: int = 20_000) -> DataFrame:
    return left.join(checked_broadcast(right, max_rows), on, how)


# --- on the executors ---------------------------------------------------------


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def put_bytes(uri: str, data: bytes) -> None:
    """Write a whole file; it appears under its name only when complete, so retries are safe."""
    path = _local(uri)
    part = f"{path or uri}.{uuid.uuid4().hex}.tmp"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def open_file(uri: str):
    """A seekable binary file."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)
