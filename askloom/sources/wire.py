"""Reply streams as they came off the wire: files of raw NDJSON or SSE lines, no columns.

Spark reads a file in splits, in any store it reaches. The lines of a split come in order, so the
split's first byte plus the bytes of its lines before is a number that rises through the whole
file: a split holds the lines that begin behind its first byte and up to the next split's, and
the first of them may begin later than counted, but none is counted beyond the next split. A
file may hold replies end to end; the end marks before a line number its reply, by a running count in
each split and a scan over one row per split. Streams read files that are complete when they
appear; the checkpoint says which ones are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from askloom import fixed
from askloom.functions.text import strip

WIRE_SCHEMA = "path string, start long, seq long, line string"


def read_wire(spark: SparkSession, path: str) -> DataFrame:
    """``path, start, seq, line``: the lines of all files, ordered by ``seq`` within a file.

    ``start`` is the first byte of the split; other splits give other numbers in the same
    order. A carriage return before the line end is
    dropped; empty lines are lines; an empty file has none.
    """
    return _placed(spark.read.option("lineSep", "\n").text(path))


def stream_wire(spark: SparkSession, path: str) -> DataFrame:
    """The same for files as they arrive, to be appended to a table by ``jobs.append``."""
    return _placed(spark.readStream.option("lineSep", "\n").text(path))


def _placed(lines: DataFrame) -> DataFrame:
    named = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    return named.mapInArrow(_numbered, WIRE_SCHEMA).withColumn("line", F.regexp_replace("line", "\r$", ""))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, after = None, 0  # the split of the last line, and where its next line is counted
    for batch in batches:
        path, start, line = batch.columns
        starts = start.to_numpy()
        bytes_ = pc.binary_length(pc.fill_null(line, "")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        names = path.dictionary_encode().indices.to_numpy()
        fresh = np.concatenate(([True], (starts[1:] != starts[:-1]) | (names[1:] != names[:-1])))
        first = np.flatnonzero(fresh)
        before = np.cumsum(bytes_) - bytes_
        base = starts[first] - before[first]
        if held == (path[0].as_py(), start[0].as_py()):
            base[0] = after
        seq = before + np.repeat(base, np.diff(np.append(first, len(starts))))
        held, after = (path[-1].as_py(), start[-1].as_py()), int(seq[-1] + bytes_[-1])
        yield pa.RecordBatch.from_arrays([path, start, pa.array(seq), line], ["path", "start", "seq", "line"])


def ndjson_end(line: str = "line") -> Column:
    """Whether a line says that its reply is done."""
    return F.coalesce(F.get_json_object(line, "$.done") == "true", F.lit(False))


def sse_end(line: str = "line") -> Column:
    """Whether a line is the stop marker of an event stream."""
    prefix = fixed.SSE_PREFIX
    rest = F.substring(line, len(prefix) + 1, 2**31 - 1)
    return F.coalesce(F.col(line).startswith(prefix) & (strip(rest) == fixed.SSE_DONE), F.lit(False))


def part_replies(lines: DataFrame, ends: Column) -> DataFrame:
    """``path, reply, seq, line`` of files that hold replies end to end, the first one 0.

    A line for which ``ends`` is true is the last of its reply. Files of one reply need no
    such step: their name is the reply's.
    """
    marked = lines.withColumn("__end", ends.cast("long"))
    splits = marked.groupBy("path", "start").agg(F.sum("__end").alias("ended"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("path", "start", F.coalesce(F.sum("ended").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("path", "start").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # a split
    counted = marked.withColumn("own", F.coalesce(F.sum("__end").over(own), F.lit(0)))
    return counted.join(base, ["path", "start"]).select("path", (F.col("base") + F.col("own")).alias("reply"), "seq", "line")
