"""Places of data, readers and sinks."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalars import half_even


@dataclass(frozen=True)
class Places:
    """Base folders, as URIs that the whole cluster reads."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/data/raw"

    @property
    def ext(self) -> str:
        return f"{self.root}/data/ext"

    @property
    def cache(self) -> str:
        return f"{self.root}/data/cache"

    @property
    def outputs(self) -> str:
        return f"{self.root}/outputs"


def project_root(start: str | None = None, variable: str = "QUERN_ROOT", parents: int = 12) -> Path:
    """The folder that the environment variable names, else the nearest one upwards with a project file, else the current one."""
    if named := os.environ.get(variable):
        return Path(named).resolve()
    here = Path(start or os.getcwd()).resolve()
    for folder in [here, *here.parents][: parents + 1]:
        if (folder / "pyproject.toml").exists() or (folder / ".git").exists():
            return folder
    return Path.cwd()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Without a schema all columns are text, for blocks to convert, or for `typed`. Empty fields, NA and
    NaN are missing."""
    df = spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True)
    return df.withColumns({f.name: F.when(~F.col(f"`{f.name}`").isin("", "NA", "NaN", "nan", "null"), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, T.StringType) and "." not in f.name})


WHOLE, FRACTION, TRUTH, TEXT = 1, 2, 4, 8
#: What a column is read as by the kinds of values that it has; all others are text.
READ_AS = {0: "double", WHOLE: "long", FRACTION: "double", WHOLE | FRACTION: "double", TRUTH: "boolean"}


def kinds(df: DataFrame) -> dict[str, str]:
    """The type of each text column: whole numbers, fractions (a column of missing values alone too), truth values or text.

    One aggregation over all columns: the kinds of values join, so that parts of the table combine in any order. Whole
    numbers beyond 64 bits are fractions, and the words for infinity are too.
    """

    def kind(c: Column) -> Column:
        said = F.trim(c)
        whole = said.rlike("^[+-]?[0-9]+$")
        fraction = said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(said).isin("inf", "-inf", "infinity", "-infinity")
        fits = said.try_cast("long").isNotNull()
        return F.when(c.isNull(), 0).otherwise(F.when(whole & fits, WHOLE).when(fraction, FRACTION).when(said.isin("True", "False", "TRUE", "FALSE", "true", "false"), TRUTH).otherwise(TEXT))

    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    found = df.agg(*[F.coalesce(F.bit_or(kind(F.col(f"`{c}`"))), F.lit(0)).alias(str(k)) for k, c in enumerate(texts)]).first() if texts else ()
    return {c: READ_AS.get(found[k], "string") for k, c in enumerate(texts)}


def typed(df: DataFrame) -> DataFrame:
    """df with its text columns as what `kinds` finds them to be."""
    return df.withColumns({c: F.trim(F.col(f"`{c}`")).cast(kind) for c, kind in kinds(df).items() if kind != "string"})


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that spark.checkpoint.dir names; where that is unset, a local session gets one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables in a place of their own in the shared folder; their sizes are known to the planner."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, options: Mapping[str, str] | None = None) -> DataFrame:
        """df computed once; options are the writer's."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.options(**options or {}).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that are deleted at the end: what is read after it must be settled() inside."""
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables.clear()


def shared_csv(df: DataFrame, name: str) -> str:
    """df as CSV files with a header in a new place of the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}.csv"
    df.write.csv(path, header=True)
    return path


def cache_key(df: DataFrame, settings: dict) -> str:
    """Differs when the settings, the columns, or the files that are read differ."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        files.append((name, status.getLen(), status.getModificationTime()))
    return hashlib.md5(json.dumps([settings, df.schema.jsonValue(), files], sort_keys=True).encode()).hexdigest()[:12]


def stored(df: DataFrame, places: Places, name: str, settings: dict | None = None) -> DataFrame:
    """df from the cache folder, written there first if this content isn't.

    A writer writes under a name of its own, and publishes by one rename that fails where the table is there already: of
    several at a time the first one counts, the others let go of theirs, and nobody reads or replaces half a table.
    """
    spark = df.sparkSession
    path = f"{places.cache}/{name}-{cache_key(df, settings or {})}.parquet"
    gateway, jvm, conf = spark.sparkContext._gateway, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, own = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        df.write.parquet(own.toString())
        try:
            options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(own, target, options)
        except Exception:
            if not fs.exists(target):
                raise
            fs.delete(own, True)
    return spark.read.parquet(path)


def write_predictions(df: DataFrame, path: str, column: str = "prediction", order: str = "_org_idx", truncate: bool = False) -> None:
    """One CSV file with the column `target`, in the order of the rows' ids: whole numbers, half to even or cut off.

    A submission is one file by its format; it holds one number per test row.
    """
    whole = F.col(column).cast("long") if truncate else half_even(F.col(column))
    df.select(order, whole.alias("target")).orderBy(order).select("target").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_filled(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).option("header", True).save(path)


def write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    """JSON on any file system that Spark writes to: UTF-8, indented by two."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(json.dumps(meta, ensure_ascii=False, indent=2).encode()))
    stream.close()


def utc_iso(now: float | None = None) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(now))


def run_id(prefix: str, middle: str | None = None, now: float | None = None) -> str:
    return "_".join([prefix, *([middle] if middle else []), time.strftime("%Y%m%d_%H%M%SZ", time.gmtime(now))])


def looked_up(df: DataFrame, answers: DataFrame, address: str, to: Sequence[str]) -> DataFrame:
    """A geocoding source as a table of answers, by a left join; of several answers to an address the least counts."""
    answer = F.min(F.struct(*to)).alias("answer")
    named = answers.groupBy(F.col(address).alias("asked address")).agg(answer).select("asked address", *[F.col("answer")[c].alias(c) for c in to])
    return df.join(named, F.col(address) == F.col("asked address"), "left").drop("asked address")
