"""What the text operators share: column selection, scratch tables and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches are kept small, since a text may be long: setting, our value, Spark's own.  Other values stay.
BATCH_LIMITS = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000", "10000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20), "67108864b"),
)
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark's own reader finds it, so any store Spark can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (tests, a laptop) gets a temporary folder; a cluster gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cartoloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settled(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder, its lineage cut.

    Reliable checkpoint: the files outlive any executor, and Spark's cleaner removes them
    once nothing refers to them.
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame, *, compression: str = "snappy") -> DataFrame:
    """The frame as a Parquet table in the shared folder, for what is read more than once or by columns.

    The folders go when the application ends.
    """
    path = scratch(frame.sparkSession)
    frame.write.parquet(path, compression=compression)
    return frame.sparkSession.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nobody has yet; what is there goes when the application ends."""
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(_forget, spark)
    _stored.append(path)
    return path


_stored: list[str] = []


def _forget(spark: SparkSession) -> None:
    for path in _stored:
        with contextlib.suppress(Exception):  # the gateway may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, in any case of letters."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def without_names(docs: DataFrame, results: str) -> DataFrame:
    """The table without columns whose names, in any case of letters, are those of results (a schema in short form)."""
    names = {f.split()[0].lower() for f in re.split(r", (?![^<]*>)", results)}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def columns_of(docs: DataFrame) -> list[str]:
    """Name and type of each column, quoted."""
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names, whatever else the table has."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def arrow_rows(frame: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``work`` yields columns as dicts; empty results are skipped."""
    spark = frame.sparkSession
    for setting, value, usual in BATCH_LIMITS:
        if spark.conf.get(setting, usual) == usual:
            spark.conf.set(setting, value)
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow],
                schema=arrow,
            )

    return frame.mapInArrow(run, fields)


def text_list(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column as Python strings, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker's Python objects stay bounded when texts are long."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
