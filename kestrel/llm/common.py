"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir, scratch_dir

# fixed values: the white space that separates words, and a word
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_CHARS = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read from there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row in column ``name``, the same on every scan.

    Spark's own row numbers follow from how the input is split, which may be otherwise
    on each scan (it looks at the cores of the moment).  A row of Parquet files is numbered
    by its file and its place in there; rows from anything else are numbered in one scan
    that is written to the shared folder, and the steps read what it wrote.
    """
    try:
        at = docs.select("*", F.col("_metadata.file_path").alias("path__"), F.col("_metadata.row_index").alias("row__"))
        paths = [r[0] for r in at.select("path__").distinct().orderBy("path__").collect()]  # a row a file
    except AnalysisException:  # no files, or files without row places
        return saved(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)))), "path__ string, file__ long")
    number = F.shiftleft(F.col("file__"), 40) + F.col("row__")  # 2^40 rows a file, 2^23 files
    return at.join(F.broadcast(files), "path__").select(*docs.columns, number.alias(name))


def by_slices(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
              text: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: ``make()`` runs once per task and gives a
    function of one record batch.  Batches are cut so that a slice holds about
    ``SLICE_CHARS`` bytes of text, or one row: memory follows the longest text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            size = batch.schema.get_field_index(text)
            step = max(1, batch.num_rows)
            if size >= 0 and batch.num_rows:
                step = max(1, int(SLICE_CHARS / max(1, batch.column(size).nbytes / batch.num_rows)))
            for at in range(0, batch.num_rows, step):
                out = work(batch.slice(at, step))
                if out.num_rows:
                    yield out
    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; a null text counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]
