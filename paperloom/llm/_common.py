"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def may_train(doc_id: str = "doc_id") -> Column:
    """Rows that a model may learn from. A row without an id takes no part."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 != 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a local session gets a new one of its own; a cluster has to name one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='paperloom-')}"
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def _stage_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{_stage_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Removes the tables that ``staged`` wrote in this application: when no frame that reads them is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that the broadcast side of ``join_spread`` holds at most, and rows from which a key may be called hot.
HOT_KEYS = 50_000
HOT_ROWS = 1000


def join_spread(rows: DataFrame, keyed: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``keyed``, one row a key, whose column ``size`` is the number of rows of that key.

    Rows of hot keys stay where they are and meet a broadcast: as every hot key
    has over ``total / HOT_KEYS`` rows, there are ``HOT_KEYS`` of them at most,
    whatever the data. All others are joined by a shuffle in which no key is
    larger. Both frames are read twice: hand in staged ones.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = keyed.filter(F.col(size) > most).drop(size)
    rest = keyed.filter(F.col(size) <= most).drop(size)
    if hot.isEmpty():
        return rows.join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


Batch = Callable[[pa.RecordBatch], list[pa.Array]]


def with_arrow_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Batch]) -> DataFrame:
    """``df`` and the columns ``fields``, computed batch by batch; a column of ``df`` with such a name goes. ``make`` runs once a task."""
    new_names = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new_names]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            new = compute(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *new], names=names)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return [x or "" for x in batch.column(batch.schema.names.index(name)).to_pylist()]


def chunks(texts: list[str], most_docs: int, most_chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with so many documents and characters at most (one text at least)."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= most_docs or held + len(text) > most_chars):
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def own(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out
