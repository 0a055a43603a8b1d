"""Streaming forms of the batch operators.

Every job keeps its progress in a checkpoint and can be stopped and restarted.
Chunks, tokens and session messages need no state: each input row maps to its output
rows, and readers order by the keys the rows carry. Batches that search write to a
folder of their own, so a repeated batch replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from askloom import fixed
from askloom.operators import search
from askloom.operators.sessions import lead_and_turn
from askloom.sources import changes
from askloom.sources.documents import chunk

LEAD, TURN = 0, 1


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    """Start a query that stops at the end of its input, or runs on if not ``once``."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stateless stream to a Parquet table."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer, checkpoint, once)


def ingest_chunks(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    *,
    keys: tuple[str, ...] = ("doc_id",),
    delimiter: str = fixed.PARAGRAPH_DELIMITER,
    once: bool = True,
) -> StreamingQuery:
    """Chunk new documents as they arrive; nothing already loaded is read again."""
    return append(chunk(documents, keys=keys, delimiter=delimiter), path, checkpoint, once)


def follow_documents(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    *,
    modified: str | None = None,
    delimiter: str = fixed.PARAGRAPH_DELIMITER,
    once: bool = True,
) -> StreamingQuery:
    """Log how arriving documents change the chunks in the log at ``path``, which must exist.

    A document that comes again replaces its chunks, one with a null text loses them. Of
    several in a batch the last by ``modified`` counts. Read the result by
    ``changes.current_chunks``.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        changes.log_load(batch.sparkSession, path, batch, batch_id, modified=modified, delimiter=delimiter)

    return _start(documents.writeStream.foreachBatch(load), checkpoint, once)


def ingest_tokens(
    lines: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    *,
    once: bool = True,
) -> StreamingQuery:
    """Parse reply lines into a token table, to be read by ``replies.reassemble``.

    Every line is stored, however late it comes. If lines can be delivered twice, read
    the table through ``replies.once_each``.
    """
    return append(parse(lines), path, checkpoint, once)


def search_stream(
    queries: DataFrame,
    points: DataFrame | Callable[[], DataFrame],
    path: str,
    checkpoint: str,
    once: bool = True,
    **options,
) -> StreamingQuery:
    """Run ``top_k`` with ``options`` on each batch of arriving queries.

    ``points`` may be a function that gives the collection as it is when a batch starts.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        hits = search.top_k(batch, points() if callable(points) else points, **options)
        hits.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(queries.writeStream.foreachBatch(answer), checkpoint, once)


def session_log(messages: DataFrame, order: str = "turn") -> DataFrame:
    """Rows that make up session memory, each from one message and without state.

    The list of a session is its rows ordered by ``part, at``: the system messages its
    runs prepended, then its turns. After a later message the list is the same rows plus
    new ones, so appending is enough.
    """
    return messages.select(
        "session_id",
        lead_and_turn(
            lead=[F.lit(LEAD).alias("part"), F.col(order).alias("at")],
            turn=[F.lit(TURN).alias("part"), F.col(order).alias("at")],
            facts=[f for f in messages.schema if f.name not in ("session_id", "role", "content", order)],
        ),
    )


def remember_sessions(
    messages: DataFrame, path: str, checkpoint: str, order: str = "turn", once: bool = True
) -> StreamingQuery:
    """Append arriving messages to the memory table."""
    return append(session_log(messages, order), path, checkpoint, once)


def session_totals(messages: DataFrame) -> DataFrame:
    """Runs and messages per session; in a stream the state is one row per session."""
    return messages.groupBy("session_id").agg(
        F.count(F.when(F.col("role") == "user", 1)).alias("n_runs"),
        F.count("*").alias("n_messages"),
    )
