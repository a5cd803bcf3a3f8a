"""What the operators of this subpackage share: reading tables, and tables staged in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, one of this machine's own if all runs in
    this process; on a cluster that is an error, as other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = f"file://{tempfile.gettempdir()}/mnemolake-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Spark's own setting: a query's shuffle files go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and lost executors cost no rework. What was
    shuffled for it is deleted at once, as nothing reads it again, and the driver gives back the memory that the query took."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
        give_back_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what staged() wrote for df."""
    if path := getattr(df, "staged_path", None):
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep for later of this process's freed memory. A Python worker serves
    one task after another; what each of them once needed at its height would otherwise add up beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def give_back_driver(spark: SparkSession) -> str:
    """The same for the driver's JVM. Compiling the code of query after query takes and frees memory outside the heap, which the
    C library keeps: some 330 MB after one small run of the pipeline, more with each query that follows. The JVM's own command
    for that is asked for through its management interface; a JVM without it (before 17.0.9, other systems) keeps the memory.
    Returns what the JVM says."""
    sc = spark.sparkContext
    jvm = sc._jvm
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's own class is closed to callers, its public interface is not
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = sc._gateway.new_array(jvm.java.lang.Object, 4)  # the bean, the command, no parameters, no signature
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return str(invoke.invoke(server, args))
    return ""


def literal_array(values: list, kind: str) -> Column:
    """One constant of type array<kind>, however many values; folded once by the optimizer."""
    text = F.lit(",".join(map(str, values)))
    return F.split(text, ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def rows_column(schema, wanted: dict[str, str]) -> None:
    missing = [c for c in wanted if c not in schema.names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
