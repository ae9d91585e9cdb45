"""Sequenced change applier: numbered changes of a key, arriving late and with gaps, applied in order by a stateful stream.

Changes are numbered in their client and cut into batches by event day. The batches go, one at a time, into the folder that a
Structured Streaming query reads; the query is started anew for each on one checkpoint. Its event-time watermark is the largest
day so far less `wait` days. Per client, the state holds the next number, the values so far and the changes
held: first comers of their number that is not reached yet. A change whose number is next is applied, and so are the held ones behind it.
A timer stands at the earliest held day. It expires when the watermark reaches that day; then the client's next
number jumps over the gap to its smallest held one, as often as its earliest held day is expired.

A day's watermark is known to the batch after it, and Spark then runs a batch without data: that is the start of the
next batch, so what timers do there bears the number of the following batch. After the last batch a sentinel row
with a day beyond all others moves the watermark past all held days, and all timers expire in batch `batches` + 1.

Numbers are dense ranks, found without a window over a client: different (client, number) pairs are sorted by range
partitions, and a pair's rank is its place in its partition and client plus the client's pairs in partitions before. In the state, held changes
lie in pages of PAGE numbers, of which a task keeps at most CACHED in memory. A client's changes of one batch
do go through one task, as their order is what is computed.

Within a batch order matters only among changes with one number: of these the first by (day, change_id, values) is held
and the others are rejected, so a task doesn't sort. Days of a batch lie above those of the batches before, so Spark
never finds a row late.

Defined cases: rows that are the same in all columns of the contract are one; rows with a null change_id or valid_at vanish; a null client is
a client; a null seq comes after all others of its client; days before the first batch's belong to it; an op
other than I, U and D is applied and changes nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import materialize, shared_dir

FIRST_DAY, SPAN, BATCHES, WAIT = 19723, 160, 8, 5
PAGE, CACHED = 256, 64
DAY_MS = 86_400_000
#: Beyond all days of data (year 9000).
END_DAY = 2_567_000
_COLUMNS = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
_FED = "change_id long, client_id long, n long, day long, at timestamp, op string, city string, balance double"
_OUT = "change_id long, client_id long, n long, day long, op string, status string, batch int, missed long, city string, balance double"
_HEAD = "next long, city string, balance double, pages array<long>, days array<long>, timer long"
_PAGE = "n array<long>, change array<long>, day array<long>, op array<string>, city array<string>, balance array<double>, batch array<int>"
#: Many small state stores: nothing is allocated ahead, and a start needs the last version only.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}
_Done = Row(*[c.split()[0] for c in _OUT.split(", ")])


def dense_ranks(rows: DataFrame, key: str, by: str) -> DataFrame:
    """key, by, n: dense rank of each different `by` in its key, from 1; no task holds a key."""
    order = [F.col(key), F.col(by).asc_nulls_last()]
    pairs = rows.select(key, by).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = materialize(pairs.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "sequenced-pairs")
    # a key has one row for each partition that it reaches into
    spans = pairs.groupBy(F.col(key).alias("_k"), F.col("part").alias("_p")).agg(F.min("place").alias("_first"), F.count("*").alias("_size"))
    earlier = F.sum("_size").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_before", F.coalesce(earlier, F.lit(0)))
    found = pairs.join(spans, F.col(key).eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_p")))
    return found.select(key, by, (F.col("place") - F.col("_first") + F.col("_before") + 1).alias("n"))


def sequenced_changes(changes: DataFrame, batches: int = BATCHES, first_day: int = FIRST_DAY, span: int = SPAN) -> DataFrame:
    """change_id, client_id, n, day, op, city, balance, batch of the changes that are fed."""
    rows = materialize(changes.select(*_COLUMNS).distinct(), "sequenced-rows")
    ranks = dense_ranks(rows, "client_id", "seq").select(F.col("client_id").alias("c"), F.col("seq").alias("s"), "n")
    h = F.crc32(F.col("change_id").cast("string"))
    # the ranks are of all rows, so rows vanish behind them
    fed = rows.where("valid_at is not null and change_id is not null").where(h % 11 != 0)
    fed = fed.join(ranks, F.col("client_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("s")))
    day = (F.unix_date(F.to_date("valid_at")) + 2 * (h % 4)).cast("long")
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((day - first_day) * batches / span))).cast("int")
    return fed.select(F.col("change_id").cast("long").alias("change_id"), F.col("client_id").cast("long").alias("client_id"), "n", day.alias("day"), "op", "city", F.col("balance").cast("double").alias("balance"), batch.alias("batch"))


class _Held:
    """The held changes of the client at hand: page -> {n: (day, change_id, op, city, balance, batch)}."""

    def __init__(self, state, pages: list[int], days: list[int]):
        self.state, self.day = state, dict(zip(pages, days))
        self.cache: OrderedDict[int, dict] = OrderedDict()
        self.dirty: set[int] = set()

    def _page(self, number: int) -> dict:
        if number in self.cache:
            self.cache.move_to_end(number)
        else:
            if len(self.cache) >= CACHED:
                self._write(*self.cache.popitem(last=False))
            found = self.state.getValue((number,)) if number in self.day else None
            self.cache[number] = {n: tuple(rest) for n, *rest in zip(found[0], found[2], found[1], *found[3:])} if found else {}
        return self.cache[number]

    def _write(self, number: int, page: dict) -> None:
        if number not in self.dirty:
            return
        self.dirty.discard(number)
        if page:
            ns = sorted(page)
            day, change, op, city, balance, batch = (list(c) for c in zip(*(page[n] for n in ns)))
            self.state.updateValue((number,), (ns, change, day, op, city, balance, batch))
            self.day[number] = min(day)
        elif number in self.day:
            self.state.removeKey((number,))
            del self.day[number]

    def get(self, n: int):
        return self._page(n // PAGE).get(n)

    def put(self, n: int, change: tuple) -> None:
        self._page(n // PAGE)[n] = change
        self.dirty.add(n // PAGE)

    def take(self, n: int):
        number = n // PAGE
        if number not in self.day and number not in self.cache:
            return None
        page = self._page(number)
        if n in page:
            self.dirty.add(number)
        return page.pop(n, None)

    def flush(self) -> None:
        for number, page in self.cache.items():
            self._write(number, page)

    def smallest(self) -> int:
        """After flush, with something held."""
        return min(self._page(min(self.day)))


class Applier(StatefulProcessor):
    """Applies a client's changes in order. `batch`: what rows bear; `following`: what expired timers bear."""

    def __init__(self, batch: int, following: int):
        self.batch, self.following = batch, following

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.pages = handle.getMapState("held", "page long", _PAGE)

    def close(self) -> None:
        pass

    def _load(self) -> None:
        self.next, self.city, self.balance, pages, days, self.timer = self.head.get() or (1, None, None, [], [], None)
        self.held = _Held(self.pages, pages, days)

    def _store(self) -> None:
        """Writes the state, and sets the timer to the earliest held day."""
        self.held.flush()
        earliest = min(self.held.day.values()) * DAY_MS if self.held.day else None
        if earliest != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if earliest is not None:
                self.handle.registerTimer(earliest)
            self.timer = earliest
        self.head.update((self.next, self.city, self.balance, list(self.held.day), list(self.held.day.values()), self.timer))

    def _apply(self, batch: int, missed: int) -> Iterator[Row]:
        """Applies what is held from the next number on, without a gap."""
        while (found := self.held.take(self.next)) is not None:
            day, change, op, city, balance, _ = found
            if op == "I":
                self.city, self.balance = city, balance
            elif op == "U":
                self.city, self.balance = self.city if city is None else city, self.balance if balance is None else balance
            elif op == "D":
                self.city = self.balance = None
            yield _Done(change, self.client, self.next, day, op, "applied", batch, missed, self.city, self.balance)
            self.next, missed = self.next + 1, 0

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.client = key[0]
        self._load()
        first = lambda c: (c[0], c[1], c[2] or "", c[3] or "", c[4] is None, c[4] or 0.0)
        reject = lambda n, c: _Done(c[1], self.client, n, c[0], c[2], "rejected", self.batch, 0, None, None)
        for r in rows:
            if r.change_id is None:  # the sentinel
                continue
            change = (r.day, r.change_id, r.op, r.city, r.balance, self.batch)
            other = None if r.n < self.next else self.held.get(r.n)
            if r.n < self.next or (other is not None and other[5] < self.batch):
                yield reject(r.n, change)
            elif other is None:
                self.held.put(r.n, change)
            elif first(change) < first(other):
                self.held.put(r.n, change)
                yield reject(r.n, other)
            else:
                yield reject(r.n, change)
        yield from self._apply(self.batch, 0)
        self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.client = key[0]
        self._load()
        self.timer = None  # it is gone
        mark = timerValues.getCurrentWatermarkInMs()
        while self.held.day and min(self.held.day.values()) * DAY_MS <= mark:
            smallest = self.held.smallest()
            missed, self.next = smallest - self.next, smallest
            yield from self._apply(self.following, missed)
            self.held.flush()
        self._store()


def apply_sequenced(fed: DataFrame, batches: int = BATCHES, wait: int = WAIT) -> DataFrame:
    """What sequenced_changes gives, streamed batch by batch: per row change_id, client_id, n, day, op, status, batch, missed, and
    city and balance afterwards (null if rejected)."""
    spark = fed.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/sequenced-{uuid.uuid4().hex}"
    fed.write.partitionBy("batch").parquet(f"{folder}/staged")
    staged = spark.read.schema(fed.schema).parquet(f"{folder}/staged")
    columns = [c.split()[0] for c in _FED.split(", ")]
    at = lambda day: F.timestamp_seconds(F.col(day) * 86_400)
    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        for k in range(1, batches + 2):
            if k <= batches:
                rows = staged.where(F.col("batch") == k).withColumn("at", at("day"))
            else:
                rows = spark.range(1).select(F.lit(END_DAY).cast("long").alias("day")).withColumn("at", at("day"))
                rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns])
            kinds = dict(x.split() for x in _FED.split(", "))
            rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]).write.mode("append").parquet(f"{folder}/source")
            read = spark.readStream.schema(_FED).parquet(f"{folder}/source").withWatermark("at", f"{wait} days")
            applied = read.groupBy("client_id").transformWithState(Applier(k, min(k, batches) + 1), _OUT, "append", "eventTime")
            query = applied.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/applied")
            query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(_OUT).parquet(f"{folder}/applied")


def applied_changes(changes: DataFrame, batches: int = BATCHES, wait: int = WAIT, first_day: int = FIRST_DAY, span: int = SPAN) -> DataFrame:
    """change_id, client_id, status, batch, missed, city, cents, current, n of every change that is fed."""
    done = apply_sequenced(sequenced_changes(changes, batches, first_day, span), batches, wait)
    last = done.where("status = 'applied'").groupBy(F.col("client_id").alias("c")).agg(F.max("n").alias("last"))
    final = done.join(last, F.col("client_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("last")) & (F.col("status") == "applied"), "left")
    current = F.col("last").isNotNull() & ~F.col("op").eqNullSafe("D")
    return final.select("change_id", "client_id", "status", "batch", "missed", "city", F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents"), current.alias("current"), "n")
