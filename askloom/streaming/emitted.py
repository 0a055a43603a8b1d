"""Replies that leave a stream once, whole, when they end.

Each reply keeps its tokens as a list in the state store, many in an element, until its stop marker and all
lines before it have come, or nothing has come for a while. Then it is emitted and its
list goes; a mark that it was emitted stays some time longer, so that lines delivered
again don't start it anew. Lines may come in any order and any number of times.

The state lies in RocksDB and is kept by key, so a reply is put together in one task; it
is one string in the end anyway. Event time drives the timers: a silence is over once the
watermark has passed it, and lines later than the watermark are dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from askloom.streaming.jobs import append

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "response_id string, content string, ended string"
LATE, SILENCE, REMEMBER = "1 minute", "10 minutes", "1 hour"
PARTS = "seqs array<bigint>, tokens array<string>"
PART_TOKENS = 1024  # tokens that one element of a reply's list holds at most
PROGRESS = "seen array<bigint>, stop long, timer long, emitted boolean"


class Ranges:
    """A set of whole numbers as sorted, disjoint ``[low, high)`` ranges, flat in a list."""

    def __init__(self, flat: list[int] | None = None):
        self.flat = list(flat or ())

    def add(self, n: int) -> bool:
        """Whether ``n`` was not yet there."""
        at = bisect_right(self.flat, n)
        if at % 2:
            return False
        joins_left = at and self.flat[at - 1] == n
        joins_right = at < len(self.flat) and self.flat[at] == n + 1
        if joins_left and joins_right:
            del self.flat[at - 1 : at + 1]
        elif joins_left:
            self.flat[at - 1] = n + 1
        elif joins_right:
            self.flat[at] = n
        else:
            self.flat[at:at] = [n, n + 1]
        return True

    def covers(self, low: int, high: int) -> bool:
        at = bisect_right(self.flat, low)
        return bool(at % 2) and self.flat[at] >= high


class ReplyProcessor(StatefulProcessor):
    """State of one reply. ``first`` is the number of its first line; without one, lines are
    not numbered densely and only a silence after the stop marker tells that all have come."""

    def __init__(self, silence_ms: int, remember_ms: int, first: int | None):
        self.silence_ms, self.remember_ms, self.first = silence_ms, remember_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", PARTS)
        self.progress = handle.getValueState("progress", PROGRESS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.progress.get()
        if held is not None and held[3]:
            return
        seen, stop, timer = (Ranges(held[0]), held[1], held[2]) if held else (Ranges(), None, None)
        latest, fresh = 0, []
        for row in rows:
            if row.ms is not None:
                latest = max(latest, row.ms)
            if not seen.add(int(row.seq)):
                continue
            if row.done:
                stop = row.seq if stop is None else min(stop, row.seq)
            elif row.token is not None:
                fresh.append((row.seq, row.token))
        if stop is not None and self.first is not None and seen.covers(self.first, stop + 1):
            # what came before lies in the state, what has come now need not go there
            parts = fresh if held is None else self._waiting() + fresh
            yield self._emit(key, parts, stop, timer, latest, "stop")
            if held is not None:
                self.parts.clear()
            return
        for low in range(0, len(fresh), PART_TOKENS):
            seqs, tokens = zip(*fresh[low : low + PART_TOKENS])
            self.parts.appendValue((list(seqs), list(tokens)))
        wake = latest + self.silence_ms
        if timer is None or wake > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
            timer = wake
        self.progress.update((seen.flat, stop, timer, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.progress.get()
        if held is None:
            return
        _, stop, _, emitted = held
        if emitted:
            self.progress.clear()
            return
        yield self._emit(key, self._waiting(), stop, None, timerValues.getCurrentWatermarkInMs(), "silence")
        self.parts.clear()

    def _waiting(self) -> list[tuple]:
        return [pair for seqs, tokens in self.parts.get() for pair in zip(seqs, tokens)]

    def _emit(self, key, parts: list[tuple], stop, timer, now: int, ended: str) -> Row:
        content = "".join(token for seq, token in sorted(parts) if stop is None or seq < stop)
        if timer is not None:
            self.handle.deleteTimer(timer)
        forget = max(now, timer or 0) + self.remember_ms
        self.handle.registerTimer(forget)
        self.progress.update(([], stop, forget, True))
        return Row(response_id=key[0], content=content, ended=ended)

    def close(self) -> None:
        pass


def _milliseconds(spark: SparkSession, interval: str) -> int:
    seconds = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {interval}"))
    return spark.range(1).select(seconds).first()[0] // 1000


def whole_replies(
    tokens: DataFrame,
    *,
    late: str = LATE,
    silence: str = SILENCE,
    remember: str = REMEMBER,
    first: int | None = 0,
) -> DataFrame:
    """``response_id, content, ended`` of a token stream ``response_id, seq, token, done, at``.

    ``at`` is the time a line was logged. ``ended`` is "stop" or "silence". A reply without
    any token is empty; after the stop marker nothing counts, as in ``replies.reassemble``.
    """
    spark = tokens.sparkSession
    processor = ReplyProcessor(_milliseconds(spark, silence), _milliseconds(spark, remember), first)
    timed = tokens.select("response_id", F.col("seq").cast("long"), "token", "done", "at", F.unix_millis("at").alias("ms"))
    timed = timed.withWatermark("at", late)
    # Rows, as a pandas table of every reply costs more than the reply
    return timed.groupBy("response_id").transformWithState(
        statefulProcessor=processor, outputStructType=OUTPUT, outputMode="append", timeMode="eventTime"
    )


def emit_replies(tokens: DataFrame, path: str, checkpoint: str, *, once: bool = True, **options) -> StreamingQuery:
    """Append finished replies to a table; ``options`` are those of ``whole_replies``."""
    conf = tokens.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return append(whole_replies(tokens, **options), path, checkpoint, once)
    finally:
        conf.set(PROVIDER, before)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def waiting_tokens(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Tokens in the state of a stopped job, of replies not emitted yet, in the form that
    ``replies.reassemble`` takes."""
    parts = _state(spark, checkpoint, "parts").select(
        F.col("key.response_id").alias("response_id"),
        F.explode(F.arrays_zip("list_element.seqs", "list_element.tokens")).alias("part"),
    )
    parts = parts.select("response_id", F.col("part.seqs").alias("seq"), F.col("part.tokens").alias("token"))
    stops = _state(spark, checkpoint, "progress").select(
        F.col("key.response_id").alias("response_id"), F.col("value.stop").alias("stop")
    )
    before: Column = F.col("stop").isNull() | (F.col("seq") < F.col("stop"))
    kept = parts.join(stops, "response_id", "left").filter(before)
    return kept.select("response_id", "seq", "token", F.lit(False).alias("done"))


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``response_id, emitted`` of every reply that the state still knows."""
    return _state(spark, checkpoint, "progress").select(
        F.col("key.response_id").alias("response_id"), F.col("value.emitted").alias("emitted")
    )
