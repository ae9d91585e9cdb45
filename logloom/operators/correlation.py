"""Asynchronous jobs: extraction, and joining parent logs with the logs of the jobs they start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_words, found

BEFORE_MS, WINDOW_MS, LEAST, MOST = 5_000, 60_000, 0.5, 10
# fixed values: weight of each kind of evidence
EVIDENCE_WEIGHTS = {"JOB_ID": 0.95, "CLASS_NAME": 0.70, "TIMING": 0.60, "USER": 0.40, "METHOD_NAME": 0.80, "BATCH": 0.65, "OPERATION": 0.75}
# fixed values: event types that are asynchronous boundaries
BOUNDARY_TYPES = ("ASYNC_JOB_ENQUEUED", "FUTURE_CALL", "QUEUEABLE_JOB", "BATCH_APEX_START")
# fixed values: calls that start a job
JOB_CALLS = {"QUEUEABLE": r"(?i)System\.enqueueJob", "BATCH": r"(?i)Database\.executeBatch", "SCHEDULABLE": r"(?i)System\.schedule", "FUTURE": r"(?i)@future"}


def extract_jobs(events: DataFrame, w_rows: int = 10) -> DataFrame:
    """(log_id, id, job_type, class_name, enqueued_at, line_number) of events that start jobs.

    The class is the first constructor or method within ten rows around; a job id in a debug message belongs to the job before it."""
    call = F.concat_ws(".", "class_name", "method_name")
    started = F.col("type").isin("METHOD_ENTRY", "ASYNC_JOB_ENQUEUED", "QUEUEABLE_JOB", "FUTURE_CALL", "BATCH_APEX_START")
    kind = F.when(F.col("type").isin("ASYNC_JOB_ENQUEUED", "QUEUEABLE_JOB"), "QUEUEABLE").when(F.col("type") == "FUTURE_CALL", "FUTURE").when(F.col("type") == "BATCH_APEX_START", "BATCH")
    for name, pattern in JOB_CALLS.items():
        kind = kind.when((F.col("type") == "METHOD_ENTRY") & call.rlike(pattern), name)
    around = Window.partitionBy("log_id").orderBy("id").rowsBetween(-w_rows, w_rows - 1)
    is_class = F.col("type").isin("CONSTRUCTOR_ENTRY", "METHOD_ENTRY") & F.col("class_name").rlike(r"(?i)(job|queueable|batch|schedul|async|future)")
    nearby = F.first(F.when(is_class, F.col("class_name")), ignorenulls=True).over(around)
    said = F.when(F.col("type") == "USER_DEBUG", found(F.col("message"), ascii_words(r"\b(707[a-zA-Z0-9]{12,15})\b")))
    marked = events.withColumns({"job_type": F.when(started, kind), "job_class": F.coalesce(F.when(F.col("type").isin("ASYNC_JOB_ENQUEUED", "QUEUEABLE_JOB", "FUTURE_CALL", "BATCH_APEX_START"), F.col("class_name")), nearby, F.lit("Unknown")), "said": said})
    after = Window.partitionBy("log_id", "_job").orderBy("id")
    number = F.sum(F.when(F.col("job_type").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("log_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    told = marked.withColumn("_job", number).withColumn("job_id", F.first("said", ignorenulls=True).over(after.rowsBetween(0, Window.unboundedFollowing)))
    return told.where("job_type is not null").select("log_id", "id", "job_type", F.col("job_class").alias("class_name"), F.col("timestamp").alias("enqueued_at"), "line_number", "job_id")


def dedupe_near(rows: DataFrame, keys: list[str], time: str, within: float, order: str = "id") -> DataFrame:
    """Rows that come `within` or more after the last kept row with the same keys (in order of time, then order).

    Which row is kept depends on which was kept before it, so a key's rows are folded in order; keys belong to one log, which bounds them."""
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("_t"), F.col(order).alias("_o"), F.struct(*rows.columns).alias("_row")))).alias("_all"))
    kept = F.aggregate("_all", F.filter("_all", lambda r: F.lit(False)), lambda k, r: F.when((F.size(k) == 0) | (r["_t"] - F.element_at(k, -1)["_t"] >= within), F.concat(k, F.array(r))).otherwise(k))
    return listed.select(F.explode(kept).alias("_r")).select("_r._row.*")


def context_first(events: DataFrame, value: Column, before: int = 10, after: int = 9, log: str = "log_id", order: str = "id") -> Column:
    """The first value that isn't null among the rows around each row."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(log).orderBy(order).rowsBetween(-before, after))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ms: str, right_ms: str, before: int = BEFORE_MS, after: int = WINDOW_MS, top: int | None = None, left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """Pairs with equal keys whose right time lies in [left - before, left + after]; of each left row at most `top` nearest.

    Both sides are dealt by keys and a time bucket as wide as the interval, the left one to the one or two buckets it
    reaches, so a key with many rows is many small joins."""
    size = max(1, before + after)
    lo, hi = F.floor((F.col(left_ms) - before) / size), F.floor((F.col(left_ms) + after) / size)
    a = left.withColumn("_b", F.explode(F.sequence(lo, hi)))
    b = right.withColumn("_b", F.floor(F.col(right_ms) / size))
    gap = F.col(right_ms) - F.col(left_ms)
    out = a.join(b, [*keys, "_b"]).where(gap.between(-before, after)).drop("_b").withColumn("gap_ms", gap)
    if top is None:
        return out
    w = Window.partitionBy(*keys, left_id).orderBy(F.abs("gap_ms"), right_id)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def left_join_dealt(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """A left join on the string column `key` of both sides. Rows of the left without a key match nothing; they are dealt out by `by`, where the null would take all of them to one task."""
    dealt = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.xxhash64(*by).cast("string")))
    found = left.withColumn("_dealt", dealt).join(right.where(F.col(key).isNotNull()).withColumnRenamed(key, "_dealt"), "_dealt", "left")
    return found.drop("_dealt")


def timing_confidence(gap_ms: Column, window: int = WINDOW_MS) -> Column:
    return F.greatest(F.lit(0.3), 1 - F.abs(gap_ms) / window)


def combined_confidence(evidence: DataFrame, keys: list[str], reason: str = "reason", confidence: str = "confidence") -> DataFrame:
    """Weighted mean of evidence, a little more for each further kind, less for timing alone."""
    weights = F.create_map(*[F.lit(x) for p in EVIDENCE_WEIGHTS.items() for x in p])
    w = F.coalesce(F.element_at(weights, F.col(reason)), F.lit(0.5))
    n = F.count("*")
    score = F.sum(F.col(confidence) * w) / F.sum(w) + F.least(F.lit(0.1), 0.03 * (n - 1)) - F.when((n == 1) & (F.max(reason) == "TIMING"), 0.15).otherwise(0.0)
    return evidence.groupBy(*keys).agg(n.alias("n_reasons"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"), F.bool_or(F.col(reason) == "JOB_ID").alias("has_job_id"))


def names_class(operation: Column, class_name: Column) -> Column:
    """Whether a log's operation names a class, with dots or slashes; the name Unknown names none."""
    op, name = F.lower(F.coalesce(operation, F.lit(""))), F.lower(class_name)
    return F.coalesce((class_name != "Unknown") & (F.contains(op, name) | F.contains(op, F.replace(name, F.lit("."), F.lit("/")))), F.lit(False))


def likely_child(enqueued_ms: Column, started_ms: Column, class_name: Column, operation: Column) -> Column:
    """A quick test: the class is named within an hour, or the log starts within a minute."""
    gap = started_ms - enqueued_ms
    named = (class_name != "Unknown") & F.contains(F.lower(operation), F.lower(class_name))
    return gap.between(-BEFORE_MS, 3_600_000) & (named | ((gap >= 0) & (gap < WINDOW_MS)))


def with_records(jobs: DataFrame, records: DataFrame | None) -> DataFrame:
    """jobs with record_id, created_ms and completed_ms of their record: that of their id, else the latest of their class.

    records: (record_id, record_class, created_ms, completed_ms); a job still running counts as one of an hour."""
    if records is None:
        return jobs.withColumns({"record_id": F.lit(None).cast("string"), "created_ms": F.lit(None).cast("long"), "completed_ms": F.lit(None).cast("long")})
    r = records.withColumn("completed_ms", F.coalesce("completed_ms", F.col("created_ms") + 3_600_000))
    whole = F.struct("record_id", "created_ms", "completed_ms")
    by_id = r.groupBy(F.col("record_id").alias("job_id")).agg(F.max_by(whole, "created_ms").alias("_i"))
    by_class = r.groupBy(F.lower("record_class").alias("_class")).agg(F.max_by(whole, F.struct("created_ms", "record_id")).alias("_c"))
    named = left_join_dealt(jobs, by_id, "job_id", jobs.columns).withColumn("_class", F.lower("class_name"))
    out = named.join(by_class, "_class", "left").withColumn("_r", F.coalesce("_i", "_c"))
    return out.select(*jobs.columns, "_r.record_id", "_r.created_ms", "_r.completed_ms")


def correlate(jobs: DataFrame, catalog: DataFrame, window_ms: int = WINDOW_MS, least: float = LEAST, most: int = MOST, records: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Logs of a job: (job_key, class_name, enqueued_ms[, job_id]) with (child_id, start_ms, operation); jobs without one get a row of confidence 0.3.

    A log matches in the job's time window if its operation names the class or it starts while the job's record runs; what
    both tables are dealt by is the window's time bucket and `keys` that they share (as an organisation or user)."""
    jobs = jobs if "job_id" in jobs.columns else jobs.withColumn("job_id", F.lit(None).cast("string"))
    asked = with_records(jobs, records).withColumn("_k", F.lit(1))
    pairs = interval_join(asked, catalog.withColumn("_k", F.lit(1)), [*keys, "_k"], "enqueued_ms", "start_ms", BEFORE_MS, window_ms)
    named = names_class(F.col("operation"), F.col("class_name"))
    running = F.coalesce(F.col("start_ms").between(F.col("created_ms") - BEFORE_MS, F.col("completed_ms") + BEFORE_MS), F.lit(False))
    proof = lambda when, reason, score: F.when(when, F.struct(F.lit(reason).alias("reason"), score.cast("double").alias("confidence")))
    reasons = F.array_compact(F.array(proof(named, "CLASS_NAME", F.lit(0.7)), proof(F.col("gap_ms") <= WINDOW_MS, "TIMING", timing_confidence(F.col("gap_ms"))), proof(F.col("job_id") == F.col("record_id"), "JOB_ID", F.lit(0.95))))
    evidence = pairs.where(named | running).select("job_key", "child_id", "gap_ms", F.explode(reasons).alias("r")).select("job_key", "child_id", "gap_ms", "r.*")
    scored = combined_confidence(evidence, ["job_key", "child_id", "gap_ms"]).where(F.col("confidence") >= least)
    place = F.row_number().over(Window.partitionBy("job_key").orderBy(F.desc("confidence"), F.desc("n_reasons"), F.desc("has_job_id"), "child_id"))
    kept = scored.withColumn("place", place).where(F.col("place") <= most)
    lone = jobs.select("job_key").join(kept.select("job_key"), "job_key", "left_anti").select("job_key", F.lit(None).cast("string").alias("child_id"), F.lit(0.3).alias("confidence"), F.lit(1).alias("place"))
    return kept.select("job_key", F.col("child_id").cast("string").alias("child_id"), "confidence", "place").unionByName(lone)


def score_candidate(job: dict[str, Column], log: dict[str, Column], record: dict[str, Column]) -> Column:
    """array<struct(reason, confidence)> of all that ties a job (class_name, method_name, job_type, job_id, enqueued_ms) to a log (operation, start_ms), with
    the job's record (id, class_name, created_ms, kind; null ids for none)."""
    op, name, method = F.lower(F.coalesce(log["operation"], F.lit(""))), F.lower(job["class_name"]), F.lower(job["method_name"])
    has = record["id"].isNotNull()
    gap, since = log["start_ms"] - job["enqueued_ms"], log["start_ms"] - record["created_ms"]
    by_class = F.when(F.contains(op, name), 0.8).when(F.contains(op, F.element_at(F.split(name, r"\."), -1)), 0.65).when(has & (F.lower(record["class_name"]) == name), 0.85)
    by_time = F.when(gap.between(-BEFORE_MS, WINDOW_MS), F.when(gap < 10_000, 0.8).when(gap < 30_000, 0.6).otherwise(0.4)).when(has & since.between(-BEFORE_MS, 120_000), F.when(since < 30_000, 0.7).otherwise(0.5))
    batch = op.rlike(r"batch|start\(\)|execute\(\)|finish\(\)")
    found_ = (
        ("JOB_ID", F.when(has & (job["job_id"] == record["id"]), 0.95)),
        ("CLASS_NAME", F.when(job["class_name"] != "Unknown", by_class)),
        ("TIMING", F.when(gap >= -BEFORE_MS, by_time)),
        ("METHOD_NAME", F.when((job["job_type"] == "FUTURE") & (method != "") & F.contains(op, method), 0.85)),
        ("BATCH", F.when((job["job_type"] == "BATCH") & has & record["kind"].isin("BatchApex", "BatchApexWorker") & batch, 0.75)),
    )
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("reason"), c.cast("double").alias("confidence"))) for n, c in found_]))


def extraction_confidence(jobs: Column, unknown: Column, without_id: Column, events: Column) -> Column:
    """From the numbers of jobs, of those without a class or an id, and of events."""
    n = F.greatest(jobs, F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.3 * unknown / n - 0.2 * without_id / n - F.when(events < 50, 0.1).otherwise(0.0)))


def starts_job() -> Column:
    """Whether an event is an asynchronous boundary: its type, or a method whose name starts a job."""
    calls = F.coalesce(F.col("method_name"), F.lit("")).rlike("|".join(JOB_CALLS[k] for k in ("QUEUEABLE", "BATCH", "SCHEDULABLE")))
    return F.col("type").isin(*BOUNDARY_TYPES) | ((F.col("type") == "METHOD_ENTRY") & calls)


def count_jobs(events: DataFrame) -> DataFrame:
    """(log_id, n_jobs, has_jobs) of every log, without extracting the jobs."""
    return events.groupBy("log_id").agg(F.count_if(starts_job()).alias("n_jobs")).withColumn("has_jobs", F.col("n_jobs") > 0)


def segments(events: DataFrame, boundary: Column, log: str = "log_id", order: str = "id") -> DataFrame:
    """events with segment: how many boundary events come up to each."""
    w = Window.partitionBy(log).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("segment", F.sum(F.when(boundary, 1).otherwise(0)).over(w))


def unified_timeline(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Events of a log and of its jobs' logs as one list: (log_id, source, id, ts)."""
    return parent.withColumn("source", F.lit("parent")).unionByName(child.withColumn("source", F.lit("child")))
