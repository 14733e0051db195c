"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: what lies between these ASCII blanks.
BLANK = r"[\x20\x09-\x0D]+"


#: White space of the tokenizer libraries' patterns; str.split() also splits at the controls 1C to 1F.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROLS = "\x1c\x1d\x1e\x1f"


def chunks_of(text: str) -> list[str]:
    """What lies between white space."""
    return [c for c in _SPACE.split(text) if c] if any(c in text for c in _CONTROLS) else text.split()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it's printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one on one
    machine (local masters), and an error on a cluster, whose executors wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            current = spark.sparkContext.getCheckpointDir()
        folder = current
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no recomputation and the lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and the path, for whoever removes it."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def apart(c: str | Column) -> Column:
    """A whole number by an expression, so that a join on it deals the rows out by itself: adaptive execution splits hot
    keys of such a join, but not where an aggregation by the key has dealt them out."""
    return F.bitwise_not(F.bitwise_not(F.col(c) if isinstance(c, str) else c))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % m


def some_at_a_time(texts: pd.Series, chars: int = 500_000) -> Iterator[slice]:
    """Slices of about so many characters, or of one text, so that memory doesn't follow the batch."""
    at = total = 0
    for i, n in enumerate(texts.str.len()):
        if total and total + n > chars:
            yield slice(at, i)
            at, total = i, 0
        total += int(n)
    if len(texts) > at:
        yield slice(at, len(texts))


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, a function of batches, that gives its memory back to the system when it ends. Python workers are used
    again by later tasks, and what one has freed would else stay with it beside the memory of the next."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        _map_large_arrays()
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:  # another C library
        return None


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


@functools.cache
def _map_large_arrays() -> None:
    """Arrays of a megabyte and more get pages of their own, which go back when they are freed."""
    if libc := _libc():
        libc.mallopt(-3, 1 << 20)
