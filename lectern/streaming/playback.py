"""Playback events, in batches and as streams: latest progress and changes of the active paragraph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from lectern.operators.tasks import dealt
from lectern.operators.timeline import active_paragraph


def latest_progress(events: DataFrame, keys: tuple[str, ...] = ("user_id", "book_id")) -> DataFrame:
    """The event with the largest ts of each key, whatever order they come in; also on a stream, in update mode."""
    rest = [c for c in events.columns if c not in keys]
    last = F.max(F.struct("ts", *[c for c in rest if c != "ts"])).alias("s")
    return events.groupBy(*keys).agg(last).select(*keys, "s.*")


def chapter_progress(positions: DataFrame, chapters: DataFrame, keys: tuple[str, ...] = ("book_id", "chapter_no"), margin: float = 0.15) -> DataFrame:
    """Time in the chapter, its share in thousandths (halves go up, at most 1000), time in the book, and whether the player goes on to the next chapter.

    It does at a chapter's end if the next chapter is on the same audio. chapters: keys
    (the last one orders a book's chapters), start, duration, audio.
    """
    after = F.lead("audio").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]))
    on = chapters.select(*keys, "start", "duration", F.coalesce(after == F.col("audio"), F.lit(False)).alias("__on"))
    joined = positions.join(on, list(keys))
    local = F.greatest(F.lit(0.0), F.col("t"))
    share = F.when(F.col("duration") > 0, F.least(F.lit(1000), F.floor(1000 * local / F.col("duration") + 0.5))).otherwise(0)
    return joined.withColumn("local", local).withColumn("permille", share.cast("int")).withColumn("clock", F.col("start") + local).withColumn("advance", F.col("__on") & (F.col("t") >= F.col("duration") - margin)).drop("__on")


def paragraph_changes(positions: DataFrame, paragraphs: DataFrame, user: str = "user_id") -> DataFrame:
    """Batch form: the events of each user at which the active paragraph is another than before."""
    w = Window.partitionBy(user).orderBy("ts")
    now = dealt(active_paragraph(positions, paragraphs), user).withColumn("__before", F.lag("frag_idx").over(w)).withColumn("__n", F.row_number().over(w))
    return now.where("(__n = 1 and frag_idx is not null) or (__n > 1 and not frag_idx <=> __before)").drop("__before", "__n")


def active_paragraph_stream(events: DataFrame, paragraphs: DataFrame, user: str = "user_id", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Stream form of paragraph_changes; a user's state goes after `idle_ms` without events. events: user, position_id, ts, book_id, chapter_no, t; one event is at one place, so the join is with a static table of minutes."""
    spread = paragraphs.withColumn("__minute", F.explode(F.sequence(F.floor(F.col("begin") / 60), F.floor(F.greatest("begin", "end") / 60))))
    spread = spread.select("book_id", "chapter_no", "__minute", F.col("frag_idx").alias("__idx"), F.col("begin").alias("__b"), F.col("end").alias("__e"))
    at = events.withColumn("__minute", F.floor(F.col("t") / 60))
    inside = (F.col("t") >= F.col("__b")) & (F.col("t") < F.col("__e"))
    hit = at.join(spread, ["book_id", "chapter_no", "__minute"], "left").select(user, "position_id", "ts", F.when(inside, F.col("__idx")).cast("long").alias("frag_idx"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).groupby(["ts", "position_id"], as_index=False)["frag_idx"].max().sort_values(["ts", "position_id"])
        if state.hasTimedOut:  # idle for too long: the next event counts as the first
            state.remove()
            return
        last = state.get[0] if state.exists else -1
        out = []
        for ts, p, idx in zip(rows["ts"], rows["position_id"], rows["frag_idx"], strict=True):
            now = -1 if pd.isna(idx) else int(idx)
            if now != last:
                out.append((key[0], p, ts, None if now < 0 else now))
            last = now
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[user, "position_id", "ts", "frag_idx"]).astype({"frag_idx": "Int64"})

    kind = dict(events.dtypes)
    schema = f"`{user}` {kind[user]}, position_id {kind['position_id']}, ts {kind['ts']}, frag_idx bigint"
    return hit.groupBy(user).applyInPandasWithState(step, schema, "last bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _micros(duration: str) -> int:
    n, unit = duration.split()
    return int(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000)


class _Changes(StatefulProcessor):
    """Holds a user's events until the watermark has passed them, and then gives those at which the paragraph changes, by time."""

    def __init__(self, user: str, idle: int) -> None:
        self.user, self.idle = user, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, position_id bigint, frag_idx bigint")
        self.last = handle.getValueState("last", "us bigint, frag_idx bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        self.waiting.appendList([(int(us), int(p), -1 if pd.isna(i) else int(i)) for us, p, i in zip(new["us"], new["position_id"], new["frag_idx"], strict=True)])
        self.handle.registerTimer(int(new["us"].max()) // 1000 + 1)
        yield pd.DataFrame({self.user: [], "position_id": [], "us": [], "frag_idx": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] <= passed]
        at, last = self.last.get() if self.last.exists() else (0, -1)
        out, seen = [], {}
        for us, position, idx in due:  # of equal rows, as a join by minutes may give them, the highest paragraph
            seen[us, position] = max(idx, seen.get((us, position), -1))
        for (us, position), idx in sorted(seen.items()):
            if idx != last:
                out.append((key[0], position, us, idx))
            at, last = us, idx
        if len(due) < len(rows):
            self.waiting.put([r for r in rows if r[0] > passed])
        else:
            self.waiting.clear()
            if at + self.idle <= passed:  # idle for long: the next event counts as the first
                self.last.clear()
                yield pd.DataFrame(out, columns=[self.user, "position_id", "us", "frag_idx"])
                return
        if due:
            self.last.update((at, last))
            self.handle.registerTimer((at + self.idle) // 1000 + 1)
        yield pd.DataFrame(out, columns=[self.user, "position_id", "us", "frag_idx"])


def paragraph_changes_stream(events: DataFrame, paragraphs: DataFrame, user: str = "user_id", late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """paragraph_changes on a stream, in order of event time whatever micro-batch events come in, up to `late`; a user's state goes after `idle` of event time.

    events: user (long), position_id (long), ts (timestamp), book_id, chapter_no, t.
    Needs a state store that has timers: set spark.sql.streaming.stateStore.providerClass
    to the RocksDB provider.
    """
    spread = paragraphs.withColumn("__minute", F.explode(F.sequence(F.floor(F.col("begin") / 60), F.floor(F.greatest("begin", "end") / 60))))
    spread = spread.select("book_id", "chapter_no", "__minute", F.col("frag_idx").alias("__idx"), F.col("begin").alias("__b"), F.col("end").alias("__e"))
    at = events.withWatermark("ts", late).withColumn("__minute", F.floor(F.col("t") / 60))
    inside = (F.col("t") >= F.col("__b")) & (F.col("t") < F.col("__e"))
    hit = at.join(spread, ["book_id", "chapter_no", "__minute"], "left").select(user, F.col("position_id").cast("long").alias("position_id"), "ts", F.unix_micros("ts").alias("us"), F.when(inside, F.col("__idx")).cast("long").alias("frag_idx"))
    out = hit.groupBy(user).transformWithStateInPandas(_Changes(user, _micros(idle)), f"`{user}` bigint, position_id bigint, us bigint, frag_idx bigint", "append", "eventTime")
    return out.select(user, "position_id", F.timestamp_micros("us").alias("ts"), F.when(F.col("frag_idx") >= 0, F.col("frag_idx")).alias("frag_idx"))


class _Latest(StatefulProcessor):
    """The newest row of each key; gone when `idle` of event time has passed without a newer one."""

    def __init__(self, names: list[str], idle: int) -> None:
        self.names, self.idle = names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us bigint, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = max((int(us), p) for batch in rows for us, p in zip(batch["us"], batch["payload"], strict=True))
        out = []
        if not self.newest.exists() or best > tuple(self.newest.get()):
            self.newest.update(best)
            self.handle.registerTimer((best[0] + self.idle) // 1000 + 1)
            out.append((*key, *best))
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.newest.exists() and self.newest.get()[0] + self.idle <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.newest.clear()
        yield pd.DataFrame([], columns=self.names)


def latest_progress_stream(events: DataFrame, keys: tuple[str, ...] = ("user_id", "book_id"), late: str = "1 day", idle: str = "30 days") -> DataFrame:
    """The rows by which a key's latest progress changes: newer by ts than all before. Events older than the newest lose; a key's state goes after `idle` of event time. Needs the RocksDB state store, as above."""
    rest = [c for c in events.columns if c not in keys and c != "ts"]
    kinds = dict(events.dtypes)
    packed = events.withWatermark("ts", late).select(*keys, "ts", F.unix_micros("ts").alias("us"), F.to_json(F.struct(*rest)).alias("payload"))
    names = [*keys, "us", "payload"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", us bigint, payload string"
    newest = packed.groupBy(*keys).transformWithStateInPandas(_Latest(names, _micros(idle)), schema, "append", "eventTime")
    own = F.from_json("payload", ", ".join(f"`{c}` {kinds[c]}" for c in rest))
    return newest.select(*keys, F.timestamp_micros("us").alias("ts"), own.alias("__own")).select(*keys, "ts", "__own.*")


def write_latest(changes: DataFrame, path: str, checkpoint: str):
    """A writer of latest_progress_stream: a folder for each micro-batch, which a repeated batch writes again instead of twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_latest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("user_id", "book_id")) -> DataFrame:
    """What write_latest has written: of each key the row with the largest ts."""
    return latest_progress(spark.read.parquet(path).drop("batch"), keys)
