"""Helpers of the llm operators: table reads, scratch tables in the shared folder, byte-level word splitting."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

# Words of [0-9a-z] and non-ASCII characters after lower-casing A-Z: everything else becomes a blank.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
                    for c in range(256))
# The same words as a Java / RE2 separator class (the text may still hold capitals).
ALNUM_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, block_mb: int = 128) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.  A task buffers
    ``block_mb`` before it writes, and reads that much at once: less for rows of several MB."""
    path = scratch(df.sparkSession, name)
    df.write.option("parquet.block.size", block_mb << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound the Arrow batches that Python workers get from here on: texts and index segments are large rows, and a worker
    holds a batch with what it makes of it.  A smaller setting of the session stays."""
    name, size = "spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20
    now = int(spark.conf.get(name, str(64 << 20)).rstrip("b"))
    if not 0 < now <= size:
        spark.conf.set(name, str(size))


def parallelism(spark: SparkSession) -> int:
    """Tasks to give to a small table whose rows fan out (a stored table of few MB reads as one task)."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """64-bit hash that tells apart documents which share an id."""
    return F.xxhash64(text_or_empty(name))


def whole_rows(docs: DataFrame, name: str = "__row") -> Column:
    """All columns as one struct: operators that add columns of their own keep the input's apart, whatever their names."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias(name)


def columns_of(docs: DataFrame, name: str = "__row") -> list[Column]:
    """The columns of ``docs`` out of the struct that ``whole_rows`` made."""
    return [F.col(name).getField(c).alias(c) for c in docs.columns]


def blanks_split(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() cuts at exactly these six ASCII blanks."""
    return text.split()


def alnum_split(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text."""
    return text.translate(ALNUM_TABLE).split()


def blanked(table: bytes, blanks: bytes = b"\x09\x0a\x0b\x0c\x0d\x20") -> bytes:
    """A translation table that also turns every one of ``blanks`` into a space."""
    return bytes(32 if c in blanks else table[c] for c in range(256))


def token_codes(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of a batch of texts (binary, without nulls) after translation by ``table``, which turns all separators into
    spaces: (code of each word in order, number of words of each text, distinct words by code).  Works on the batch's
    buffer as a whole; no word becomes a Python object."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = bytes(memoryview(data)[offsets[0]:offsets[-1]]) if data is not None else b""
    offsets -= offsets[0]
    buf = np.frombuffer(raw.translate(table), np.uint8)
    word = buf != 32
    first = np.zeros(len(buf) + 1, bool)  # places where a text starts: words do not go on across them
    first[offsets[:-1]] = True
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(end) + 1 - start
    ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(buf[word])]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(np.searchsorted(start, offsets)), words.dictionary
