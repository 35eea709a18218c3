"""Helpers shared by the operators: words, null rules, lineage cuts, Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def words_of(text: str | None) -> list[str]:
    """Words of a text; a null text has none."""
    return WORDS.findall(text) if text else []


def utf8(text: str) -> bytes:
    """UTF-8 bytes; lone surrogates, which Spark cannot hold, are replaced."""
    return text.encode("utf-8", "replace")


def cut(df: DataFrame, rows: int | None = None, narrow: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Checkpoint files outlive executors, so a lost executor costs no recompute.
    What comes out of a shuffle is written by two tasks a core, or fewer if the
    caller knows that there are at most ``rows`` rows: small files cost later
    stages tasks, and each costs its executor a process that sets permissions.
    With ``narrow`` (a map over the input, without a shuffle) a task takes eight
    splits at most, if there are more than four a core.
    """
    _shared_folder(df.sparkSession)
    wide = 2 * df.sparkSession.sparkContext.defaultParallelism
    if narrow:
        wide = max(2 * wide, df.rdd.getNumPartitions() // 8)
    return df.coalesce(wide if rows is None else max(1, min(wide, -(-rows // 50_000)))).checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set from its configuration if need be.

    Where ``spark.checkpoint.dir`` is unset, a session on one machine gets a
    temporary folder; on a cluster that would be another folder on each machine,
    so it is an error there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarn-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def table(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared checkpoint folder and reads it again.

    The files go where the session's checkpoints go and are as short-lived: whoever
    owns that folder empties it.
    """
    path = f"{_shared_folder(df.sparkSession)}/tarn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Holds the session's Arrow batches to so many rows, if they aren't held to fewer.

    For callers that own the session's settings, such as the registered queries:
    texts can be long, and executors keep two batches a task outside their heap.
    Operators leave the session as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def document_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the two columns an operator reads, under fixed internal names.

    Columns in ``carry`` come along as ``_c0``, ``_c1`` and so on; other columns,
    whatever their names, never reach the operator.
    """
    own = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    return df.select(*own, *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])


def carried(df: DataFrame, carry: tuple[str, ...], made: tuple[str, ...] = ("doc_id",)) -> tuple[list[str], str]:
    """Internal names of carried columns, and their part of a schema under their own names.

    A carried column can't have the name of one that the operator makes (``made``).
    """
    if clash := sorted({c.lower() for c in carry} & {m.lower() for m in made}) or sorted({c for c in carry if carry.count(c) > 1}):
        raise ValueError(f"can't carry columns that the result has already: {', '.join(clash)}")
    names = [f"_c{i}" for i in range(len(carry))]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return names, "".join(f", `{c}` {types[n]}" for c, n in zip(carry, names, strict=True))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, weight: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A few rows of a batch at a time: about ``weight`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            n = int(np.searchsorted(np.cumsum(sizes[at : at + rows]), weight, "right"))
            yield batch.slice(at, max(1, n))
            at += max(1, n)


def emit(rows, schema: pa.Schema, weight: Callable[[tuple], int] = lambda row: 64, limit: int = 8_000_000):
    """Record batches of at most about ``limit`` bytes from an iterator of rows.

    Batches bound what a worker and the JVM hold at once, whatever the length
    of the texts.
    """
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= limit or len(held) >= 16_384:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def pairs(batch: pa.RecordBatch, first: str = "doc_id", second: str = "text"):
    """(first, second) of each row, a few rows at a time as Python objects."""
    for part in slices([batch], column=second):
        yield from zip(part.column(first).to_pylist(), part.column(second).to_pylist(), strict=True)
