"""What the operators share: reading texts in Arrow batches, cutting lineage, bounded sketches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes A-Z lower-cased, others as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER; what is no digit, letter or byte of a non-ASCII character becomes a blank.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words of letters, digits and non-ASCII characters after lower-casing A-Z, as a pattern over raw text.
WORD_CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

ID, TEXT = "__id", "__text"


def words(text: bytes) -> list[bytes]:
    """The words of a text: A-Z lower-cased, split at ASCII characters other than letters and digits."""
    return text.translate(WORDS).split()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns needed, under names that clash with none; a null text is an empty one."""
    return docs.select(docs[id_col].cast("long").alias(ID), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias(TEXT))


def texts(batch: pa.RecordBatch, name: str = TEXT) -> list[bytes]:
    """A batch's texts as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, rows: int | None = 1000, size: int = 64 << 20) -> DataFrame:
    """mapInArrow with a function of one batch, of at most ``rows`` rows and about ``size`` bytes, as what it makes of
    them is held at once; a row that is larger comes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, rows or batch.num_rows, size):
                if (out := function(piece)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch."""
    if batch.num_rows <= rows and batch.nbytes <= size:
        if batch.num_rows:
            yield batch
        return
    lengths = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            lengths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    so_far, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        before = so_far[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(so_far, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors see.

    A folder of this machine stands in only where the setting is absent and all work is on this machine, as in tests.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with the bits of a long column's values modulo its size set.

    Built by an aggregation over at most 2**(bits - 6) groups, so what reaches the driver has that bound
    whatever the number of rows.
    """
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    words_ = (
        df.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words_.toArrow().to_batches():
        out[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
    return out


def bitmap_for(df: DataFrame, column: str) -> np.ndarray:
    """The same for the rows of a table at hand, with 16 bits for each of them, from 2**16 to 2**27 bits (16 MB).

    Beyond eight million rows more and more of the others pass as well: that costs shuffled rows, not results.
    """
    return bitmap(df, column, max(16, min(27, (16 * df.count()).bit_length())))


def in_bitmap(bitmap_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which int64 values have their bit set."""
    slot = values.view(np.uint64) & np.uint64(len(bitmap_) * 64 - 1)
    return (bitmap_[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def smallest_hashes(df: DataFrame, column: str, n: int, by: str) -> DataFrame:
    """The rows with the n smallest hashes of a column for each value of ``by``, or about as many.

    Rows are counted first, so that only a little more than n of each value go to the window that cuts them.
    """
    rows, place, at = fresh(df, "rows", "place", "at")
    space = 1 << 40
    hashed = df.withColumn(at, F.pmod(F.xxhash64(column), F.lit(space)))
    counts = df.groupBy(by).agg(F.count("*").alias(rows))
    near = hashed.join(counts, by).where(F.col(at) < F.lit(float(space)) * F.least(F.lit(1.0), F.lit(1.25 * n) / F.col(rows))).drop(rows)
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(column), column))
    return near.withColumn(place, order).where(F.col(place) <= n).drop(place, at)


def about(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """About n of the rows, those with the smallest hashes of some columns; all rows where there are no more."""
    space = 1 << 40
    rows = df.count()
    return df if rows <= n else df.where(F.pmod(F.xxhash64(*columns), F.lit(space)) < F.lit(int(space * (n / rows))))


def only(rows: DataFrame, chosen: DataFrame, column: str) -> DataFrame:
    """The rows (ID, TEXT) whose id is in a column of a table, once each.

    A bitmap of the ids keeps most texts where they are; only the rest takes part in a join.
    """
    ids = checkpoint(chosen.select(F.col(column).alias("chosen")).distinct())
    bits = rows.sparkSession.sparkContext.broadcast(bitmap_for(ids, "chosen"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at = np.flatnonzero(in_bitmap(bits.value, batch.column(0).to_numpy(zero_copy_only=False)))
        return batch.take(pa.array(at)) if len(at) else None

    near = map_batches(rows.where(F.col(ID).isNotNull()), run, rows.schema)
    return near.join(ids, near[ID] == ids["chosen"], "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of a table has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder; smaller than a checkpoint for many narrow rows.

    The table is removed when the driver's Python ends.
    """
    import atexit
    import uuid

    spark = df.sparkSession
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(folder)

    def remove() -> None:
        if context._jsc is not None:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(folder)
