"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str, bool]] = []
_writes = 0

#: Tables that ``saved`` writes between two calls of ``tidy``.
TIDY = 8


#: The most rows in an Arrow batch: texts can be long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; from now on the session sends smaller batches to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, None) or 10_000) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only on a local master, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts lineage in a way that outlives any executor.  The tables go when the
    session ends; inside ``scratch`` they go with it unless ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path, keep))
    global _writes
    _writes += 1
    if _writes % TIDY == 0:
        tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets the driver give up plans, broadcasts and shuffles that nothing refers to, and the memory that they held.

    An operator of many short jobs makes hundreds of plans.  Left to itself the JVM grows its
    heap to the bound before it collects them, and keeps what it has grown to.  Outside the
    heap the compiler and hundreds of threads leave free memory to the C library, which keeps it.
    """
    gc.collect()  # Python's references hold the JVM's objects
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)
    release_memory()


def trim_native(spark: SparkSession) -> bool:
    """Gives memory that the driver's JVM has freed outside its heap back to the system; False where it can't."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    lang = jvm.java.lang
    try:
        # by reflection: the server's own class isn't open to callers
        of = lambda name: lang.Class.forName(name)
        kinds = array(lang.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;"))
        invoke = of("javax.management.MBeanServer").getMethod("invoke", kinds)
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args = array(lang.Object, commands, "systemTrimNativeHeap", array(lang.Object), array(lang.String))
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # another JVM or C library
        return False
    return True


@contextlib.contextmanager
def scratch():
    """Tables that ``saved`` writes inside go at the end, but for those with ``keep``."""
    start = len(_written)
    try:
        yield
    finally:
        inside = _written[start:]
        _written[start:] = [x for x in inside if x[2]]
        for spark, path, keep in inside:
            if not keep:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder's owner cleans up then
            return


#: Keys with at least 1/HEAVY of a table's rows, at most HEAVY keys, are joined by broadcast; no other key has as many.
HEAVY = 1024


def frequent(rows: DataFrame, key: str, least: int = 32) -> list:
    """The values of ``key`` that have at least ``least`` rows and 1/HEAVY of all rows each.

    Rarer keys can't fill a task, and without frequent ones the plan needs no broadcast.
    """
    enough = max(least, rows.count() / HEAVY)
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    return [r[0] for r in per.where(F.col("_n") >= enough).orderBy(F.desc("_n"), key).limit(HEAVY).collect()]


def spread_join(rows: DataFrame, others: DataFrame, key: str, keys: list, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``others`` on ``key`` (inner, left or left_semi) without a task for all rows of a key.

    ``keys`` are the frequent ones: their narrow rows of ``others``, a few a key, are broadcast.
    Null keys meet nothing, and a left join keeps them where they are.
    """
    rest = rows.where(F.col(key).isNotNull())
    if keys:
        top = F.col(key).isin(keys)
        hot = rows.where(top).join(F.broadcast(others.where(top)), key, how)
        out = hot.unionByName(rest.where(~top).join(others.where(~top), key, how))
    else:
        out = rest.join(others, key, how)
    if how == "left":
        more = [F.lit(None).cast(f.dataType).alias(f.name) for f in others.schema if f.name != key]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *more))
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema) -> DataFrame:
    """``fn`` on every Arrow batch; it returns one batch or yields several."""

    def run(batches):
        for b in batches:
            out = fn(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Gives freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def record(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c) for c in cols.values()], names=list(cols))


def binaries(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int) -> DataFrame:
    """Up to ``per_class`` labelled documents of each class, the lowest by a hash of the id.

    This is the bounded sample that a model is fitted on; scoring never uses it.
    Labels are reduced to one row per document (the largest label), so repeated
    label rows don't repeat documents.
    """
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(keep)
    lab = lab.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = None
    for cls in (0, 1):
        part = lab.where(F.col("label") == cls).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    text = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return text.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def in_hash_order(ids: np.ndarray, seed: int) -> np.ndarray:
    """A repeatable shuffle that depends on the ids and not on their order."""
    keys = np.array([zlib.crc32(f"{seed}:{int(i)}".encode()) for i in ids], np.int64)
    return np.lexsort((ids, keys))
