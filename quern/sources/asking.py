"""A source that answers one address at a time and limits how often it may be asked: a geocoding service, say."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest wait before an address is tried again, in seconds.
LONGEST = 30.0


def answers(spark, place: str, address: str, fields: str) -> DataFrame:
    """(address, found, fields) of all addresses that have been asked; fields as DDL."""
    schema = f"`{address}` string, found boolean, {fields}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/answers")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{place}/answers")


def asked(df: DataFrame, address: str, client: Callable[[str], Sequence[object] | None], place: str, fields: str,
          per_second: float = 20.0, tries: int = 3, tasks: int = 4, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The answers to all addresses of df, of which only those are asked that the table at `place` doesn't have.

    client: gives the fields of an address, or None where it has none; it runs in tasks, and raises where asking failed.
    Distinct unknown addresses are dealt to `tasks` tasks, each of which asks at its share of `per_second`, so that the
    limit holds for the whole job. A failure is tried again, `tries` times in all, after waits that double; an address that
    still fails isn't answered, and is asked anew next time. Each answer is written to a journal as it comes, by a rename,
    before the next address is asked: a task that is lost goes on where its predecessor was, and asks nothing twice. At the
    end the answers are appended to the table and the journal goes. `place` is a URI that Spark and pyarrow both write to.
    """
    spark = df.sparkSession
    known = answers(spark, place, address, fields)
    unknown = df.select(F.col(f"`{address}`").cast("string").alias(address)).filter(F.col(f"`{address}`").isNotNull()).distinct()
    unknown = unknown.join(known.select(address), address, "left_anti").repartition(tasks, address)
    names = known.columns
    between = tasks / per_second

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(f"{place}/journal")
        files.create_dir(folder)

        def answered(said: str) -> list | None:
            path = f"{folder}/{hashlib.md5(said.encode()).hexdigest()}"
            if files.get_file_info(path).type == fs.FileType.File:
                with files.open_input_stream(path) as held:
                    return json.loads(held.read())
            for k in range(tries):
                try:
                    found = client(said)
                except OSError:
                    wait(min(LONGEST, between * 2**k))
                    continue
                row = [said, found is not None, *(found if found is not None else [None] * (len(names) - 2))]
                own = f"{path}.{uuid.uuid4().hex}"
                with files.open_output_stream(own) as out:
                    out.write(json.dumps(row).encode())
                files.move(own, path)
                wait(between)
                return row
            return None

        for batch in batches:
            rows = [r for r in map(answered, batch.column(0).to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=kept)

    kept = pa.schema([(f.name, {"string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in known.schema])
    unknown.mapInArrow(ask, known.schema).write.mode("append").parquet(f"{place}/answers")
    journal = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/journal")
    journal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(journal, True)
    return answers(spark, place, address, fields)
