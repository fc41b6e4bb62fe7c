"""Helpers shared by the training-data operators: text expressions, scratch storage and column hygiene."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters outside this class.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Beginning of the names of tables in buckets.
TABLE = "quern_"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset (local tests), a temporary one."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quern.scratch.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quern-scratch-")
        spark.conf.set("quern.scratch.dir", place)
    return place.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


class Scope(threading.local):
    """Tables saved since the scopes of this thread began, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[DataFrame]] = []

    def note(self, df: DataFrame) -> DataFrame:
        if self.open:
            self.open[-1].append(df)
        return df


_scope = Scope()


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are saved inside are deleted at the end, but those that are handed to what this gives: a result that is
    read later. An operator's lazy result must be saved inside, as it reads such tables."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scope.open.append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scope.open.pop()
        for df in own:
            if not any(df is k for k in kept):
                dropped(df)
        for df in kept:
            _scope.note(df)


@contextmanager
def no_shuffles_kept(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a query as soon as it ends: what comes out of these is written to tables."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with no_shuffles_kept(spark):
        df.write.option("compression", "zstd").parquet(path)
    return _scope.note(spark.read.schema(df.schema).parquet(path))


def saved_by(df: DataFrame, key: str, tasks: int, name: str) -> DataFrame:
    """Like saved(), as a table in buckets of the key: joins on it move only their other side. df is dealt by the key already."""
    spark = df.sparkSession
    path = fresh(spark, name)
    named = TABLE + path.rpartition("-")[2]
    with no_shuffles_kept(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(tasks, key).sortBy(key).saveAsTable(named)
    return _scope.note(spark.table(named))


def dropped(df: DataFrame) -> None:
    """Deletes a table of saved() or saved_by() that nothing reads any more; its rows must not be asked for again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    inside = jvm.org.apache.hadoop.fs.Path(scratch(spark)).toUri().getPath()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(inside + "/"):
            spark.sql(f"drop table if exists {TABLE}{folder.rpartition('-')[2]}")
            path.getFileSystem(conf).delete(path, True)


def hashed(row: Column, kind: T.DataType) -> Column:
    """A hash of a value of any type; maps, which can't be hashed, count as their sorted entries wherever they stand."""

    def plain(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.MapType):
            return plain(F.array_sort(F.map_entries(value)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: plain(x, kind.elementType)) if _has_map(kind.elementType) else value
        if isinstance(kind, T.StructType) and _has_map(kind):
            return F.when(value.isNotNull(), F.struct(*[plain(value.getField(f.name), f.dataType).alias(f"c{k}") for k, f in enumerate(kind)]))
        return value

    columns = [(row.getField(f.name), f.dataType) for f in kind] if isinstance(kind, T.StructType) else [(row, kind)]
    return F.xxhash64(*[plain(c, k) for c, k in columns], *[c.isNull() for c, _ in columns])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def identified(docs: DataFrame) -> DataFrame:
    """d (a struct of all columns, so that their names clash with nothing) and own, a number that names the row and orders it.

    Where no doc_id is null or on several rows, own is the doc_id. Else it is the row's place in the order of doc_id,
    nulls last, and of a hash of the row among equal ones; rows that are equal in all columns are one row first. Places are
    counted within ranges of that order, of which only the sizes meet.
    """
    counted = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    if counted.isEmpty():
        return held.select("d", F.col("d")["doc_id"].cast("long").alias("own"))
    rows = held.select("d", F.col("d")["doc_id"].alias("its id"), hashed(F.col("d"), docs.schema).alias("hash")).dropDuplicates(["its id", "hash"])
    order = (F.col("its id").isNull(), F.col("its id"), F.col("hash"))
    ranged = saved(rows.select("its id", "hash").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    sizes = ranged.groupBy(F.col("part").alias("its part")).agg(F.count("*").alias("n"))
    before = sizes.select("its part", (F.sum("n").over(W.orderBy("its part")) - F.col("n")).alias("before"))  # a row for each range
    placed = ranged.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*order))).join(before, F.col("part") == F.col("its part"))
    placed = placed.select(F.col("its id").alias("same id"), F.col("hash").alias("same hash"), (F.col("before") + F.col("place") - 1).alias("own"))
    return rows.join(placed, F.col("its id").eqNullSafe(F.col("same id")) & (F.col("hash") == F.col("same hash"))).select("d", "own")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def tasks_for(df: DataFrame, each: int) -> int:
    """Number of tasks for so many bytes of df each, by the planner's estimate of files; at least a shuffle's usual number."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return usual if size >= 1 << 60 else min(max(usual, size // each), 1 << 20)  # that large: not known


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a lambda variable isn't recomputed where the optimizer merges projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """All words of the text, in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
