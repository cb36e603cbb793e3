"""State machines over ordered events: circuit breaker, token bucket, retries; and streams of log lines.

The breaker is a walk over a key's sorted rows in batch, and in streams a stateful
processor with the same step function. The token bucket is no walk: its requests
compose, so sums and maxima over ranges of time give it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import walked
from ..sources.audit_files import written

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


def breaker_step(state: tuple[str, int, int], at_ms: int, succeeded: bool, threshold: int, timeout_ms: int) -> tuple[tuple[str, int, int], bool]:
    """((state, failures, opened at), allowed): open until the timeout, then half open; half open lets all through; a success resets."""
    kind, failures, opened = state
    if kind == OPEN:
        if at_ms - opened < timeout_ms:
            return state, False
        kind = HALF_OPEN
    if succeeded:
        return (CLOSED, 0, opened), True
    failures += 1
    if kind == HALF_OPEN or failures >= threshold:
        return (OPEN, failures, at_ms), True
    return (kind, failures, opened), True


def circuit_breaker(events: DataFrame, threshold: int = 5, timeout_ms: int = 30_000, key: str = "endpoint") -> DataFrame:
    """Events (key, ordinal, at_ms, succeeded) with allowed and the state after each."""

    def step(state: tuple[str, int, int], r) -> tuple[tuple[str, int, int], list[tuple]]:
        state, ok = breaker_step(state, r.at_ms, bool(r.succeeded), threshold, timeout_ms)
        return state, [(r[0], r.ordinal, r.at_ms, ok, state[0])]

    kind = events.schema[key].dataType.simpleString()
    wanted = events.select(key, "ordinal", "at_ms", "succeeded")
    return walked(wanted, key, ("at_ms", "ordinal"), lambda: (CLOSED, 0, 0), step, f"`{key}` {kind}, ordinal long, at_ms long, allowed boolean, state string")


#: A processor keeps at most so many of a micro-batch's rows before they go to the state store.
FLUSH = 1000


class BreakerProcessor(StatefulProcessor):
    """The breaker of an endpoint. Events wait in the state store for the watermark, then are taken in the order of time.

    So micro-batches and arrival do not matter, and no micro-batch of a key is
    held in memory: events wait by ticks of time, and a timer at the end of a
    tick takes its own. A breaker that is closed without failures has no state.
    """

    def __init__(self, key: str, threshold: int, timeout_ms: int, tick_ms: int):
        self.key, self.threshold, self.timeout_ms, self.tick_ms = key, threshold, timeout_ms, tick_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breaker = handle.getValueState("breaker", "kind string, failures int, opened long")
        self.waiting = handle.getMapState("waiting", "tick long", "events array<struct<at_ms:long,ordinal:long,succeeded:boolean>>")

    def _keep(self, held: dict[int, list]) -> None:
        for tick, events in held.items():
            if self.waiting.containsKey((tick,)):
                events = [*map(tuple, self.waiting.getValue((tick,))[0]), *events]
            else:
                self.handle.registerTimer((tick + 1) * self.tick_ms)
            self.waiting.updateValue((tick,), (events,))
        held.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held: dict[int, list] = {}
        for n, r in enumerate(rows, 1):
            held.setdefault(r.at_ms // self.tick_ms, []).append((r.at_ms, r.ordinal, r.succeeded))
            if n % FLUSH == 0:
                self._keep(held)
        self._keep(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tick = (expiredTimerInfo.getExpiryTimeInMs() // self.tick_ms - 1,)
        state = tuple(self.breaker.get()) if self.breaker.exists() else (CLOSED, 0, 0)
        for at_ms, ordinal, succeeded in sorted((tuple(e) for e in self.waiting.getValue(tick)[0]), key=lambda e: e[:2]):
            state, ok = breaker_step(state, at_ms, bool(succeeded), self.threshold, self.timeout_ms)
            yield Row(**{self.key: key[0], "ordinal": ordinal, "at_ms": at_ms, "allowed": ok, "state": state[0]})
        self.waiting.removeKey(tick)
        if state[:2] == (CLOSED, 0):
            self.breaker.clear()
        else:
            self.breaker.update(state)

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def circuit_breaker_stream(events: DataFrame, threshold: int = 5, timeout_ms: int = 30_000, key: str = "endpoint", late: str = "0 seconds", tick_ms: int = 1000) -> DataFrame:
    """The breaker over a stream of events with times and outcomes: the rows of ``circuit_breaker`` in ticks that the watermark has passed.

    Events more than ``late`` behind are dropped; the others may come in any
    order. Times are positive, since a watermark begins at 0. The session's state store must be RocksDB's.
    """
    if "RocksDB" not in events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    kind = events.schema[key].dataType.simpleString()
    timed = events.select(key, "ordinal", "at_ms", "succeeded", F.timestamp_millis("at_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy(key).transformWithState(BreakerProcessor(key, threshold, timeout_ms, tick_ms), f"`{key}` {kind}, ordinal long, at_ms long, allowed boolean, state string", "Append", "EventTime")


def token_bucket(requests: DataFrame, rate: int, capacity: int = 1000, key: str = "stream") -> DataFrame:
    """Requests (key, ordinal, at_ms, bytes) with tokens asked and wait_ms, in the order of (at_ms, ordinal).

    1000 tokens come in a second; a token is worth max(rate / 1000, 1) bytes. Nothing sleeps: waits are computed.

    A request takes x tokens to min(capacity, x + time since the one before) -
    asked. Composed, what is left after request i is capacity + t_i - B_i - max
    over j up to i of (t_j - B_(j-1)), with times t and sums B of tokens asked.
    So a key's requests are sorted in ranges; a range needs the sum and the
    maximum of those before it, one row a range, and a hot key is many tasks' work.
    """
    worth = max(rate // 1000, 1)
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = F.ceil(F.col("bytes") / worth).cast("long") if worth > 1 else F.col("bytes").cast("long")
    rows = requests.select(key, "ordinal", "at_ms", asked.alias("tokens")).repartitionByRange(parts, key, "at_ms", "ordinal").withColumn("__part", F.spark_partition_id())
    held = written(rows, "bucket-ranges")
    within = W.partitionBy(key, "__part").orderBy("at_ms", "ordinal")
    sums = held.withColumn("__upto", F.sum("tokens").over(within.rowsBetween(W.unboundedPreceding, 0)))
    lead = F.col("at_ms") - F.col("__upto") + F.col("tokens")  # t_j - B_(j-1), in the range
    sums = sums.withColumn("__lead", F.max(lead).over(within.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ranges = sums.groupBy(key, "__part").agg(F.sum("tokens").alias("__sum"), F.max("__lead").alias("__lead_of"))
    ranges = ranges.withColumn("__ahead", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    ranges = ranges.withColumn("__most", F.max(F.col("__lead_of") - F.col("__ahead")).over(before))
    both = sums.withColumnRenamed(key, "__key").join(ranges.select(F.col(key).alias("__of"), F.col("__part").alias("__at"), "__ahead", "__most"), F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__at")))
    left = capacity + F.col("at_ms") - F.col("__ahead") - F.col("__upto") - F.greatest(F.col("__lead") - F.col("__ahead"), F.col("__most"))
    return both.select(F.col("__key").alias(key), "ordinal", "tokens", F.greatest(-left, F.lit(0)).cast("long").alias("wait_ms"))


def retry_outcomes(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """(op_id, made, outcome) from recorded attempts (op_id, attempt, error_kind or null, is_transient, mode).

    The first attempt that ends the loop decides: a success; a permanent error
    (failed, or skipped or partial by mode); a transient error in skip mode,
    which is not retried; or the attempt that reaches the limit.
    """
    ends = (
        F.when(F.col("error_kind").isNull(), "succeeded")
        .when(F.col("mode") == "skip", "skipped")
        .when(~F.col("is_transient"), F.when(F.col("mode") == "partial", "partial").otherwise("failed"))
        .when(F.col("attempt") >= limit + 1, F.when(F.col("mode") == "partial", "partial").otherwise("exhausted"))
    )
    rows = attempts.withColumn("end", ends)
    first = rows.where("end is not null").groupBy("op_id").agg(F.min(F.struct("attempt", "end")).alias("first"))
    seen = rows.groupBy("op_id").agg(F.max("attempt").alias("seen"))
    return seen.join(first, "op_id", "left").select("op_id", F.coalesce("first.attempt", "seen").cast("long").alias("made"), F.coalesce("first.end", F.lit("open")).alias("outcome"))


def tail_json(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON lines files as they arrive; the bound on files per batch is the backpressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("mode", "DROPMALFORMED").json(folder)


def rolling_counts(events: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """An extension: events counted and summed by tumbling window and type, with a watermark; batch or stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    timed = timed.withWatermark(at, late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n", "total")
