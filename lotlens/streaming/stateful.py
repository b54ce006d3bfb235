"""State that outlives micro-batches: what a sale's events amount to, what is buffered until it is done, which fingerprints are boilerplate.

State is kept by key in RocksDB, so the cost of a micro-batch follows from its own rows and not from the history.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class ProgressFold(StatefulProcessor):
    """The progress of one sale, whatever the order in which its events arrive.

    ``summary`` is what the events since the greatest start seen amount to; the events themselves are kept too, since a start that arrives late
    may part them.  Nothing older than the greatest start is kept, and nothing comes out before a start is known.
    """

    SHAPE = "sale_id string, status string, n_progress long, last_value double, oracle_requested boolean, last_seq long"
    NAMES = [c.split()[0] for c in SHAPE.split(", ")]
    STATUS = {"sale_done": "done", "sale_skip": "skipped"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "seq long, type string, value double")
        self.summary = handle.getValueState("summary", "start long, end_seq long, status string, n_progress long, last_value double, oracle_requested boolean, last_seq long")

    @classmethod
    def fold(cls, start: int | None, events: list[tuple]) -> tuple:
        """The summary of events (none older than ``start``)."""
        end = max((e for e in events if e[1] in cls.STATUS), key=lambda e: e[0], default=None)
        last = max(events, key=lambda e: e[0])
        status = "analyzing" if end is None else cls.STATUS[end[1]]
        return (start, None if end is None else end[0], status, sum(e[1] == "progress" for e in events), last[2], any(e[1] == "oracle_request" for e in events), last[0])

    @staticmethod
    def merge(a: tuple, b: tuple) -> tuple:
        end = a if (a[1] if a[1] is not None else -1) >= (b[1] if b[1] is not None else -1) else b
        last = a if a[6] >= b[6] else b
        return (a[0], end[1], end[2], a[3] + b[3], last[4], a[5] or b[5], last[6])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["seq"], r["type"], r["value"]) for r in rows if r["seq"] is not None]
        old = self.summary.get() if self.summary.exists() else None
        start = None if old is None else old[0]
        latest = max((e[0] for e in new if e[1] == "sale_start"), default=None)
        if latest is not None and (start is None or latest > start):
            # all that is held is looked at once more, and what is older goes
            start = latest
            new = [e for e in [*map(tuple, self.events.get()), *new] if e[0] >= start]
            self.events.put(new)
            summary = self.fold(start, new)
        else:
            new = new if start is None else [e for e in new if e[0] >= start]
            if not new:
                return
            self.events.appendList(new)
            if start is None:
                return
            summary = self.merge(tuple(old), self.fold(start, new))
        self.summary.update(summary)
        yield Row(**dict(zip(self.NAMES, (key[0], *summary[2:]), strict=True)))

    def close(self) -> None:
        pass


class SaleBuffer(StatefulProcessor):
    """Photos and findings of one sale, held until it is done and emptied when it starts anew.

    What lies between a start and the next end of the same sale, by seq, comes out when that end is known, in the order of seq.  Photos and findings may arrive
    late, starts and ends of one sale arrive in order: what a start follows without an end between them is dropped.  A skipped sale keeps its buffer.
    """

    SHAPE = "sale_id string, kind string, seq long, payload string"
    START, END = "sale_start", "sale_done"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "kind string, seq long, payload string")
        self.marks = handle.getListState("marks", "kind string, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["kind"], r["seq"], r["payload"]) for r in rows if r["kind"] is not None and r["seq"] is not None]
        came = [(kind, seq) for kind, seq, _ in new if kind in (self.START, self.END)]
        if came:
            self.marks.appendList(came)
        fresh = [e for e in new if e[0] not in (self.START, self.END)]
        marks = sorted(map(tuple, self.marks.get()), key=lambda m: m[1])
        places = [seq for _, seq in marks]
        if not came and not (marks and fresh and min(e[1] for e in fresh) < places[-1]):
            if fresh:
                self.held.appendList(fresh)
            return
        held = sorted([*map(tuple, self.held.get()), *fresh], key=lambda e: e[1])
        if not held:
            return
        ahead = [bisect_right(places, seq) for _, seq, _ in held]
        open_ = [e for e, k in zip(held, ahead, strict=True) if k == len(marks)]
        self.held.put(open_) if open_ else self.held.clear()
        for (kind, seq, payload), k in zip(held, ahead, strict=True):
            if k < len(marks) and marks[k][0] == self.END:
                yield Row(sale_id=key[0], kind=kind, seq=seq, payload=payload)

    def close(self) -> None:
        pass


class SalesOfFingerprint(StatefulProcessor):
    """In how many sales a fingerprint occurs, as photos come (change 1) and go (change -1); a row comes out when the number changes."""

    SHAPE = "phash string, n_sales long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.photos = handle.getMapState("photos", "sale_id string", "n long")
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changes = Counter()
        for r in rows:
            if r["sale_id"] is not None:
                changes[r["sale_id"]] += r["change"]
        known = self.total.exists()
        total = before = self.total.get()[0] if known else 0
        for sale, change in changes.items():
            was = self.photos.getValue((sale,))[0] if known and self.photos.containsKey((sale,)) else 0
            now = was + change
            total += (now > 0) - (was > 0)
            if now:
                self.photos.updateValue((sale,), (now,))
            elif was:
                self.photos.removeKey((sale,))
        if total != before or not known:
            self.total.update((total,))
            yield Row(phash=key[0], n_sales=total)

    def close(self) -> None:
        pass


def run_stateful(stream: DataFrame, key: str, processor: StatefulProcessor, write, checkpoint: str):
    """Start ``processor`` over ``stream`` by ``key``; ``write(batch, number)`` gets what comes out of each micro-batch."""
    spark = stream.sparkSession
    with rocksdb(spark):
        out = stream.groupBy(key).transformWithState(processor, processor.SHAPE, "Update", "None")
        return out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
