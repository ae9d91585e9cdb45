from pyspark.sql import functions as F

from logloom.operators import memory, similar


def test_recall_counts_each_part_once(spark):
    """Words give ten facts at most, a code all of its own; no code, no words and nothing remembered give noughts."""
    sig = f"signature struct<issue_type:string,error_signature:string,{','.join(f'{n}:array<string>' for n in similar.LISTS)}>"
    of = lambda kind: (kind, None, ["acc"], [], [], [], [])
    requests = spark.createDataFrame([(1, "slow query here", "A", of("A")), (2, "Slow", None, of(None)), (3, "", "Z", ("Z", None, ["zz"], ["n"], ["m"], ["q"], ["l"])), (4, None, "A", of("A"))], f"query_id long, text string, code string, {sig}")
    facts = spark.createDataFrame([(i, "slow query, slow" if i < 14 else "other", "A" if i in (0, 13, 20) else "B") for i in range(21)] + [(99, None, None)], "fact_id long, text string, code string")
    entries = spark.createDataFrame([(7, of("A")), (8, of("B"))], f"entry_id long, {sig}")
    done = spark.createDataFrame([(["A", "A"],), (["B"],), ([],)], "issues array<string>")
    fixes = spark.createDataFrame([("A", 1, 1), ("A", 1, 0), ("A", 1, 4), ("B", 9, 0)], "issue_type string, success_count long, failure_count long")
    got = {r.query_id: tuple(r)[1:] for r in memory.recall_for(requests, facts, entries, done, fixes).collect()}
    # the ten facts with a word of request 1 are 0 to 9, of which 0 has its code too; 0, 13 and 20 have its code
    assert got == {1: (12, 2, 1, 1, 1.0), 2: (10, 2, 0, 0, 1.0), 3: (0, 0, 0, 0, 0.0), 4: (3, 2, 1, 1, 0.7)}
    none = memory.recall_for(requests, facts.where("1 = 0"), entries.where("1 = 0"), done.where("1 = 0"), fixes.where("1 = 0"))
    assert none.count() == 4 and none.where(F.col("confidence") > 0).count() == 0
