"""What the training-data operators share: tables, Arrow maps, shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Where this library lies, for Python workers that start elsewhere.
_ROOT = str(Path(__file__).resolve().parents[2])
_OWN: dict[str, str] = {}
#: Python workers live on between stages: these make them give freed memory back to the system.
_FREEING = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of a row group of stored tables, which each writing task holds in memory.
_GROUP = 32 << 20
#: The tables stored by each settled() that is at work.
_USED: list[list[DataFrame]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, whose executors are
    its driver, may leave it unset and then has a temporary one."""
    try:
        named = spark.conf.get("spark.checkpoint.dir")
    except PySparkException:  # unset
        named = None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lumenlake-")
    return _OWN[app]


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that what follows
    depends on files and not on the tasks or executors that made them. The files lie under
    the application's id; discard() deletes what is used up, the rest may go when it has ended."""
    spark = df.sparkSession
    path = _place(spark, label)
    df.write.option("parquet.block.size", _GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lies_at = path
    if _USED:
        _USED[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """stored(make()), then without the tables that were stored on the way."""
    _USED.append([])
    try:
        out = make()
    finally:
        used = _USED.pop()
    out = stored(out, label)
    discard(*used)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lies_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        if name := getattr(df, "_named", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _parts(spark: SparkSession, n: int) -> Callable[[Column], Column]:
    """The part of a row by its monotonically_increasing_id: numbers whose buckets, of n, are all different, dealt
    in turn to the tasks that numbered the rows."""
    spread = spark.range(32 * n).select(F.col("id").cast("int").alias("v"))
    first = dict(spread.groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("b")).agg(F.min("v")).collect())  # n rows
    numbers = F.expr(f"array({', '.join(str(first.get(b, b)) for b in range(n))})")
    return lambda rid: F.get(numbers, (F.shiftright(rid, 33) % n).cast("int"))


def stored_in_parts(df: DataFrame, label: str) -> DataFrame:
    """Like stored(), for rows with a monotonically_increasing_id `rid`: adds the column `part` and keeps the table
    bucketed by it, one file a task, without a shuffle. beside() joins it in place."""
    spark = df.sparkSession
    path, name = _place(spark, label), f"lumenlake_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = _parts(spark, n)
    df.withColumn("part", part(F.col("rid"))).write.option("compression", "zstd").option("parquet.block.size", _GROUP).bucketBy(n, "part").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._lies_at, out._named, out._n, out._part = path, name, n, part
    if _USED:
        _USED[-1].append(out)
    return out


def beside(rows: DataFrame, found: DataFrame, how: str, label: str, then: Callable[[DataFrame], DataFrame], **gathered: Column) -> DataFrame:
    """then(rows of stored_in_parts joined by rid with aggregates of found), stored. Only found is shuffled, to
    where the rows lie."""
    spark = rows.sparkSession
    dealt = found.withColumn("part", rows._part(F.col("rid"))).repartition(rows._n, "part")
    each = dealt.groupBy("part", "rid").agg(*[c.alias(k) for k, c in gathered.items()])
    flag = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(flag)
    spark.conf.set(flag, "false")  # both sides lie by part, which is part of the join's key
    try:
        return stored(then(rows.join(each.hint("merge"), ["part", "rid"], how)), label)
    finally:
        spark.conf.set(flag, before)


def mapped(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: StructType | str) -> DataFrame:
    """mapInArrow by a function that yields lists of columns in the order of schema."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    env = df.sparkSession.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [_ROOT, env.get("PYTHONPATH")]))
        env.update({k: v for k, v in _FREEING.items() if k not in env})

    def run(batches):
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def values(column: pa.Array) -> Iterator:
    """A column's values one at a time, so that a batch of long texts is not held twice."""
    return (x.as_py() for x in column)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
