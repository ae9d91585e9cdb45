import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from logloom.llm.positive import TRAITS, class_prior, non_negative_risk, quality_scores, traits

DOCS = "doc_id long, text string, lang string, score string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=7, poor=0.2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 120))]
        good = rng.random() >= poor
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        docs.append((i, " ".join(words), "en", "x"))
        if rng.random() < 0.6:
            labels.append((i, int(good), 0))
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_traits_by_hand():
    rows = traits([b"", b"  \n ", "Ab cd cd,\nAb cd cd,\n12 é%%".encode(), b"one"])
    assert not rows[:2].any()
    t = dict(zip(TRAITS, rows[2]))
    assert np.isclose(t["words"], np.log1p(8)) and np.isclose(t["different words"], 5 / 8) and np.isclose(t["most frequent word"], 2 / 8)
    assert np.isclose(t["repeated lines"], 1 / 3) and np.isclose(t["words without a letter"], 1 / 8) and np.isclose(t["words that end in a symbol"], 1 / 8)
    assert np.isclose(t["upper"], 2 / 13) and np.isclose(t["digits"], 2 / 26) and np.isclose(t["symbols"], 2 / 26)
    assert np.isclose(t["different triples"], 5 / 6)


def test_non_negative_risk():
    # the bracket is 0.9 - 0.5 * 1.0, then 0.3 - 0.5 * 1.0, which counts as zero
    assert np.allclose(non_negative_risk(0.5, np.array([0.2, 0.2]), np.array([1.0, 1.0]), np.array([0.9, 0.3])), [0.5, 0.1])


def test_class_prior_of_mixed_scores():
    rng = np.random.default_rng(1)
    good, poor = rng.beta(6, 2, 40000), rng.beta(2, 8, 40000)
    bins = lambda s: np.histogram(s, 1000, (0, 1))[0].astype(float)
    for share in (0.3, 0.7, 0.9):
        n = int(40000 * share)
        assert abs(class_prior(bins(good[::2]), bins(np.concatenate((good[:n], poor[: 40000 - n])))) - share) < 0.05


def test_held_out_accuracy_and_blind_to_held_out_labels(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, DOCS).repartition(4)
    rows = quality_scores(d, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs) and all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    truth = {i: y for i, y, _ in labels}
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(judged) > 50 and sum(p == y for p, y in judged) / len(judged) > 0.95
    # no label of the held-out fold, and no negative label, changes a score
    other = [(i, 1 - y if held(i) else y, 1) for i, y, _ in labels if y == 1 or held(i)]
    again = {r.doc_id: r.score for r in quality_scores(d, spark.createDataFrame(other, LABELS)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


def test_odd_rows(spark):
    docs, labels = corpus(200)
    odd = [(None, "some text", "en", "x"), (900, None, None, None), (901, "", "en", "x"), (902, " \n\t", "en", "x"), (903, "word " * 200_000, "en", "x"), docs[0], (904, "İß �", "en", "x")]
    d = spark.createDataFrame(docs + odd, DOCS)
    l = spark.createDataFrame([*labels, (None, 1, 0), (903, None, 0), (5, 7, 0), (10**6, 1, 0)], LABELS)
    rows = quality_scores(d, l).collect()
    assert len(rows) == len(docs) + len(odd) and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (900, 901, 902)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({r.score for r in rows if r.doc_id == docs[0][0]}) == 1
    none = quality_scores(d, l.where("quality = 0")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(rows)
    assert quality_scores(d.where(F.lit(False)), l).count() == 0


def test_query(spark):
    from logloom.llm import queries as q

    sf = "/root/testdata/sf0.01"
    rows = q.queries()["op12_positive"](spark, sf)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    judged = rows.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert judged > 0.95
