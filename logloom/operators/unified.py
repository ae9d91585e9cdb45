"""One view of a log and the logs of the jobs it starts, of the jobs that those start, and so on, for all logs at once.

Links (parent log, job, child log) make a forest: a child with several parents belongs to the one with the highest confidence. Roots and
depths come from pointer jumping: each round a log's pointer skips to its pointer's pointer, so rounds grow with the logarithm of the
depth. Links in a circle have no root; after as many steps as there are logs every pointer of such a log lies
on a circle, and its smallest log becomes a root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize

# fixed values: job states, and kinds of jobs with their words in a description
JOB_STATES = ("QUEUED", "PREPARING", "PROCESSING", "COMPLETED", "FAILED", "ABORTED", "HOLDING")
JOB_WORDS = {"QUEUEABLE": "Queueable job(s)", "BATCH": "Batch job(s)", "FUTURE": "@future method(s)", "SCHEDULABLE": "Scheduled job(s)"}
ROLES = ("PARENT", "CHILD", "GRANDCHILD")


def chosen_parents(links: DataFrame) -> DataFrame:
    """(child_id, parent_id): of several parents the one with the highest confidence, then the smallest; no log is its own."""
    found = links.where("child_id is not null and log_id is not null and child_id <> log_id")
    return found.groupBy("child_id").agg(F.min_by("log_id", F.struct(-F.coalesce("confidence", F.lit(0.0)), F.col("log_id"))).alias("parent_id"))


def _jumped(nodes: DataFrame, most: int) -> DataFrame:
    """node, up, depth, least after jumps until nothing moves or `most` steps are taken; least: smallest log on the way."""
    at, steps = materialize(nodes, "unified-up"), 1
    while True:
        moving = at.where("not done")
        if moving.isEmpty() or steps >= most:
            return at
        there = at.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        moved = moving.join(there, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))
        before, at, steps = at, materialize(at.where("done").unionByName(moved), "unified-up"), 2 * steps
        discard(before)


def forest(logs: DataFrame, links: DataFrame) -> DataFrame:
    """(log_id, root_id, parent_id, depth, role) of every log in logs or links; a root is its own, at depth 0."""
    parents = chosen_parents(links)
    nodes = logs.select("log_id").unionByName(links.select("log_id")).unionByName(links.select(F.col("child_id").alias("log_id"))).where("log_id is not null").distinct()
    tied = materialize(nodes.join(parents.withColumnRenamed("child_id", "log_id"), "log_id", "left"), "unified-nodes")

    def pointers(tied: DataFrame) -> DataFrame:
        # done: the pointer is a root
        first = tied.select(F.col("log_id").alias("node"), F.coalesce("parent_id", "log_id").alias("up"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.least("log_id", F.coalesce("parent_id", "log_id")).alias("least"))
        roots = tied.where("parent_id is null").select(F.col("log_id").alias("up"), F.lit(True).alias("root"))
        return first.join(roots, "up", "left").select("node", "up", "depth", "least", F.coalesce("root", F.lit(False)).alias("done"))

    at = _jumped(pointers(tied), tied.count())
    if not at.where("not done").isEmpty():
        circling = at.where("not done").select(F.col("up").alias("node")).distinct()
        cut = at.join(circling, "node", "left_semi").where("node = least").select(F.col("node").alias("log_id"), F.lit(True).alias("cut"))
        before, tied = tied, materialize(tied.join(cut, "log_id", "left").select("log_id", F.when(F.col("cut").isNull(), F.col("parent_id")).alias("parent_id")), "unified-nodes")
        discard(before)
        discard(at)
        at = _jumped(pointers(tied), 1 << 62)
    role = F.get(F.array(*map(F.lit, ROLES)), F.least("depth", F.lit(len(ROLES) - 1)).cast("int"))
    return at.join(tied.withColumnRenamed("log_id", "node"), "node").select(F.col("node").alias("log_id"), F.col("up").alias("root_id"), "parent_id", "depth", role.alias("role"))


def overall_status(failed: Column, jobs: Column) -> Column:
    return F.when(failed == 0, "SUCCESS").when(failed == jobs, "FAILURE").otherwise("PARTIAL_FAILURE")


def flow_description(kinds: dict[str, Column], correlated: Column, jobs: Column) -> Column:
    """Words for what a log started; kinds: number of jobs of each kind."""
    said = F.array_compact(F.array(*[F.when(kinds[k] > 0, F.concat(kinds[k].cast("string"), F.lit(f" {w}"))) for k, w in JOB_WORDS.items()]))
    started = F.when(F.size(said) > 0, F.concat(F.lit("enqueued "), F.array_join(said, ", ")))
    matched = F.when(correlated > 0, F.format_string("→ %d/%d correlated to child logs", correlated, jobs))
    return F.when(jobs == 0, "Synchronous execution (no async jobs)").otherwise(F.concat_ws(" ", F.lit("Parent execution"), started, matched))


def unified_summaries(logs: DataFrame, links: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Per root: n_logs, depth, total_ms, n_jobs, a column for each job state, errors, status, confidence and flow, rolled up over its tree.

    logs: (log_id, start_ns, end_ns, extraction: confidence of its job extraction); times are null for a log that isn't there.
    links: (log_id, job_type, job_status, child_id, queue_delay_ms, errors, confidence), a row for each job; child_id is null where no log was found. A child's
    own time counts once, in its chosen parent's tree; each job counts in the tree of the log that started it."""
    placed = materialize(forest(logs, links), "unified-forest") if placed is None else placed
    of = placed.select("log_id", "root_id", "depth")
    own = of.join(logs.dropDuplicates(["log_id"]), "log_id", "left").groupBy("root_id").agg(
        F.count("*").alias("n_logs"), F.max("depth").alias("depth"), F.coalesce(F.sum((F.col("end_ns") - F.col("start_ns")) / 1e6), F.lit(0.0)).alias("log_ms"), F.max(F.when(F.col("depth") == 0, F.col("extraction"))).alias("extraction")
    )
    failed = F.col("job_status").isin("FAILED", "ABORTED")
    jobs = links.join(of, "log_id").groupBy("root_id").agg(
        F.count("*").alias("n_jobs"), *[F.count_if(F.col("job_status") == s).alias(s.lower()) for s in JOB_STATES], F.count_if(failed).alias("n_failed"), F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.sum("queue_delay_ms"), F.lit(0)).cast("double").alias("delay_ms"), F.count("child_id").alias("n_found"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean"), *[F.count_if(F.col("job_type") == k).alias(f"n_{k.lower()}") for k in JOB_WORDS],
    )
    none = {c: 0 for c in ("n_jobs", *[s.lower() for s in JOB_STATES], "n_failed", "errors", "n_found", *[f"n_{k.lower()}" for k in JOB_WORDS])}
    both = own.join(jobs, "root_id", "left").fillna(none).fillna({"delay_ms": 0.0})
    base = F.coalesce("extraction", F.lit(1.0))
    score = F.when(F.col("n_jobs") > 0, (base + F.col("mean")) / 2).otherwise(base) - 0.1 * (F.col("n_jobs") - F.col("n_found"))
    flow = flow_description({k: F.col(f"n_{k.lower()}") for k in JOB_WORDS}, F.col("n_found"), F.col("n_jobs"))
    return both.select(
        "root_id", "n_logs", "depth", (F.col("log_ms") + F.col("delay_ms")).alias("total_ms"), "n_jobs", *[s.lower() for s in JOB_STATES], "errors",
        overall_status(F.col("n_failed"), F.col("n_jobs")).alias("status"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"), flow.alias("flow"),
    )
