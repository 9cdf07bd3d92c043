"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII lower-casing; other letters stay, as the word rules ask for A-Z only.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8: runs without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of 8 bytes
SHORT_WORD = 64


def word_hashes(texts: list[str], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of all texts, one after another, and how many each text has.

    Words of up to ``SHORT_WORD`` bytes start from their length and mix in 8 bytes a round, all words
    side by side; longer ones take XXH64. ``table`` maps bytes first (lower case).
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = [r.translate(table) for r in raw] if table else raw
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    buffer = b" ".join([*raw, b" " * 7])  # so that 8 bytes can be read at any word's start
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[np.frombuffer(buffer, np.uint8)]]).view(np.int8)))  # starts and ends in turn
    first, last = edges[::2], edges[1::2]
    size = last - first
    eight = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live = np.flatnonzero(size <= SHORT_WORD)
    for at in range(0, SHORT_WORD, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        x = (h[live] ^ (eight[first[live] + at] & _KEEP[np.minimum(size[live] - at, 8)])) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h[live] = x ^ (x >> np.uint64(29))
    for i in np.flatnonzero(size > SHORT_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(buffer[first[i] : last[i]], 20)
    return h, np.diff(np.searchsorted(first, np.concatenate([[0], ends])))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, so that others' names can't clash; a null text is empty."""
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c) for c in more)
    )


def bucket_of(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id falls in bucket 0 of the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[dict], Iterable[tuple]]], chunk: int = 4096) -> DataFrame:
    """mapInArrow by rows: ``start()`` runs once a task and returns row dict -> output tuples."""
    from pyspark.sql.types import StructType

    kinds = StructType.fromDDL(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, fn, out = to_arrow_schema(kinds), start(), []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target, strict=True)], schema=target)

        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                    out.extend(fn(dict(zip(names, row, strict=True))))
                    if len(out) >= chunk:
                        yield flush()
                        out = []
        if out:
            yield flush()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="paceforge-"))
    return sc.getCheckpointDir()


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: compressed, and later readers take only the columns they need.

    Nothing reads the shuffles behind the table again, so their files go when it is written and not at some
    later time. Tables in a ``folder`` of ``scratch_folder`` go with it.
    """
    spark = df.sparkSession
    path, before = f"{folder or shared_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A folder for tables that only the steps of one operator read."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is; it need not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
