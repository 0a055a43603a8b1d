"""Paragraph chunks of text files of any size, read in byte ranges.

Spark cuts a file into splits at any byte and reads each as lines, so ``\\r``, ``\\n`` and
``\\r\\n`` are line ends everywhere and a line belongs to one split. Two line ends in a row
part two paragraphs; taken from the left, a third one belongs to the paragraph that follows,
which then is no heading. Three states say how the next line with text goes on: it joins the
paragraph, begins one, or begins one after a line end. An empty line leads from joining to
beginning, and from there to and fro between the last two; a line with text always leads
to joining. So of the splits before, a split must only know how many empty lines lie since the
last text: a scan over one row per split. Paragraphs that end inside a split are finished there,
only the pieces at its ends meet those of other splits. A paragraph is one string and has at most 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from askloom import fixed
from askloom.functions.text import strip
from askloom.plans import scratch
from askloom.plans.ordered import number_rows

PIECES = "path string, start long, no int, text string, bare boolean, lead long, trail long, blanks long, pieces int"
ROWS = 1024
JOINS = 0  # empty lines since the last text, so that the next one goes on with it


class _Split:
    """Lines of one split as pieces of paragraphs."""

    def __init__(self, path: str, start: int):
        self.place = path, start
        self.lead, self.empty = None, 0  # empty lines before the first text, and since the last
        self.pieces: list[list[str]] = []
        self.bare: list[bool] = []

    def add(self, line: str) -> None:
        if line == "":
            self.empty += 1
            return
        if self.lead is None:
            self.lead = self.empty
            self.pieces.append([line])
            self.bare.append(True)  # what comes before it is not known here
        elif self.empty == JOINS:
            self.pieces[-1].append(line)
        else:
            self.pieces.append([line])
            self.bare.append(self.empty % 2 == 1)
        self.empty = 0

    def rows(self) -> list[tuple]:
        if self.lead is None:
            return [(*self.place, 0, None, None, None, None, self.empty, 0)]
        n = len(self.pieces)
        facts = self.lead, self.empty, 0, n
        return [(*self.place, i, "\n".join(p), b, *facts) for i, (p, b) in enumerate(zip(self.pieces, self.bare))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for path, start, line in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or held.place != (path, start):
                if held is not None:
                    yield from _out(held)
                held = _Split(path, start)
            held.add(line)
    if held is not None:
        yield from _out(held)


def _out(split: _Split) -> Iterator[pa.RecordBatch]:
    rows = split.rows()
    for i in range(0, len(rows), ROWS):
        yield _batch(rows[i : i + ROWS])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch.new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def begins(before: Column, lead: Column) -> Column:
    """How the first text of a split goes on: 0 joins, 1 begins, 2 begins after a line end.

    ``before`` counts empty lines since the last text of earlier splits, NULL without any text.
    """
    first = F.when(lead % 2 == 0, 1).otherwise(2)  # a file begins like after a delimiter
    empty = before + lead
    later = F.when(empty == JOINS, 0).when(empty % 2 == 1, 1).otherwise(2)
    return F.when(before.isNull(), first).otherwise(later)


def large_file_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, chunk_index, text`` of text files, as ``chunk(read_documents(...))`` gives them.

    Files of any size, read in parts of ``spark.sql.files.maxPartitionBytes``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    pieces = _stored(lines.mapInArrow(split_pieces, PIECES), "file-pieces")
    splits = pieces.filter("no = 0").select("path", "start", "lead", "trail", "blanks", "pieces")
    order = Window.partitionBy("path").orderBy("start")  # a row per split
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = splits.withColumn("run", F.coalesce(F.sum(F.when(F.col("pieces") > 0, 1).otherwise(0)).over(earlier), F.lit(0)))
    within = Window.partitionBy("path", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # a run begins behind a split with text and holds the splits of empty lines after it
    seen = seen.withColumn("between", F.coalesce(F.sum("blanks").over(within), F.lit(0)))
    last = F.last(F.when(F.col("pieces") > 0, F.col("trail")), ignorenulls=True).over(earlier)
    seen = seen.withColumn("before", last + F.col("between"))
    lead = F.when(F.col("before").isNull(), F.col("between") + F.col("lead")).otherwise(F.col("lead"))
    seen = seen.filter("pieces > 0").withColumn("begins", begins(F.col("before"), lead))
    fresh = F.col("pieces") - F.when(F.col("begins") == 0, 1).otherwise(0)
    seen = seen.withColumn("base", F.coalesce(F.sum(fresh).over(earlier), F.lit(0)))
    joined = F.when(F.col("begins") == 0, 1).otherwise(0)
    places = seen.select("path", "start", "begins", (F.col("base") - joined).alias("base"))
    placed = pieces.filter("pieces > 0").join(_stored(places, "split-places"), ["path", "start"])
    placed = placed.withColumn("piece", F.col("base") + F.col("no"))
    bare = F.when(F.col("no") == 0, F.col("begins") == 1).otherwise(F.col("bare"))
    placed = placed.withColumn("bare", bare)
    ends = (F.col("no") == 0) | (F.col("no") == F.col("pieces") - 1)
    part = F.struct("start", "no", "text", "bare")
    met = placed.filter(ends).groupBy("path", "piece").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    met = met.select("path", "piece", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.col("parts")[0]["bare"].alias("bare"))
    whole = placed.filter(~ends).select("path", "piece", "text", "bare").unionByName(met)
    heading = F.col("bare") & F.col("text").startswith(fixed.HEADING_MARK)
    kept = whole.filter(~heading).withColumn("text", strip("text")).filter("text <> ''")
    numbered = number_rows(_stored(kept.select("path", "piece", "text"), "file-chunks"), ["path"], "piece", F.lit(False))
    return numbered.select(
        F.regexp_replace("path", "^file:/+", "/").alias("doc_id"), (F.col("row_no") - 1).cast("int").alias("chunk_index"), "text"
    )
