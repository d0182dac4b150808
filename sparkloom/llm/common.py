"""Helpers shared by the corpus operators: table access, shared scratch tables, grouped streaming."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as all contracts here define it: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates words, for splitting.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is named, one is made on a single machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written once into the shared folder, to cut lineage and to survive lost executors.

    ``drop`` deletes a table that no later step reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.id, self.tables = spark, uuid.uuid4().hex, {}
        self.root = f"{scratch_root(spark)}/sparkloom-{self.id}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """``df`` written and read again. ``small``: much less than what it was made from, so its rows are first gathered in partitions of a useful size, of which there are few."""
        df = df.hint("rebalance") if small else df
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, col: str) -> DataFrame:
        """``keep`` with rows dealt by ``col`` into buckets, so that joins on it move the other side only."""
        n = partitions(self.spark)
        self.tables[name] = f"sparkloom_{self.id}_{name}"
        df.repartition(n, col).write.bucketBy(n, col).sortBy(col).mode("overwrite").option("path", self.path(name)).saveAsTable(self.tables[name])
        self.reclaim()  # what was shuffled is as large as the table
        return self.spark.table(self.tables[name])

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            self._delete(self.path(name))

    def reclaim(self) -> None:
        """Let Spark delete shuffle files whose frames are gone: between the steps of an operator they would add up on disk."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the JVM may have ended first
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes that one Arrow batch holds at most, the same for all operators: a frame may run after another operator was called.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and in bytes, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_keys(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first one, cut so that the rows of a key stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        if not len(cols[0]):
            continue
        if held and held[-1][0][-1] != cols[0][0]:
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        # The last key may go on in the next batch.
        last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if cols[0][0] != cols[0][-1] else 0
        if last:
            yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in cols])]
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def text_map(df: DataFrame, start: Callable[[], Callable[[list[tuple]], list[tuple]]], schema: str, rows: int = 256) -> DataFrame:
    """Run Python code over slices of at most ``rows`` rows of ``df`` and return its tuples as ``schema``.

    ``start`` runs once per task and returns a function from a list of row tuples to a list of output
    tuples, so memory is bounded by a slice however large an Arrow batch is.
    """
    bound_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = step(list(zip(*(c.to_pylist() for c in part.columns))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def is_key(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether each row has an id of its own."""
    odd = docs.groupBy(F.col(id_col).alias("k")).agg(F.count("*").alias("c")).where((F.col("c") > 1) | F.col("k").isNull())
    return odd.isEmpty()


def with_key(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", key: str = "__key") -> DataFrame:
    """``docs`` with a long column ``key`` that tells rows apart and keeps the order of ids.

    It is the id itself where that is a key. Else rows are sorted by id (null last) and content, numbered and written once.
    """
    if is_key(docs, id_col):
        return docs.withColumn(key, F.col(id_col).cast("long"))
    ordered = docs.orderBy(F.asc_nulls_last(id_col), F.xxhash64(*docs.columns))
    return scratch.keep(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")
