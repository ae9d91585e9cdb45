import random
import zlib

import corpus_pipeline
import numpy as np
from logloom.llm.common import materialize
from pyspark.sql import functions as F

from .test_lines import brute as brute_lines
from .test_nearcopies import brute as brute_near
from .test_quality import brute as brute_quality


def corpus():
    rng = random.Random(12)
    good = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nü", "ra") for b in ("ta", "ru", "so", "vi")]
    line = lambda ws: " ".join(rng.choice(ws) for _ in range(25))
    passage = "\n".join(line(good) for _ in range(3))
    rows, labels = [], []
    for i in range(160):
        junk, toxic = i % 5 == 0, i % 11 == 0
        ws = [w + "##" for w in good] if junk else good + ["snarf", "grob", "zonk"] * 3 * toxic
        text = "\n".join(line(ws) for _ in range(rng.randint(2, 8)))
        if i % 6 == 1:
            text += "\n" + passage
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 0 if junk else 1, int(toxic)))
    rows += [(500 + i, rows[i][1] + " tail", "en", "s", 0) for i in range(1, 20)] + [(600 + i, rows[i][1], "en", "s", 0) for i in range(1, 20)]
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    return rows, labels


def test_stages_match_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, truth, out = docs.columns, {i: (q, t) for i, q, t in labels}, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        out.append(docs.collect())
        if name != "packing":
            assert docs.columns == columns
    kept = {r.doc_id for r in out[0]}
    for i, text, *_ in rows:
        failed = brute_quality(text)[5]
        assert not (failed and i in kept)
        if i in truth and not failed and truth[i] != (1, 1):
            assert (i in kept) == bool(truth[i][0]), i
    want = {i: t for i, _, _, t in brute_lines([(r.doc_id, r.text) for r in out[0]], 2)}
    assert {r.doc_id: r.text for r in out[1]} == want
    assert all(r.n_chars == len(r.text) for r in out[1])
    ids = sorted(r.doc_id for r in out[1])
    by_id = {r.doc_id: r.text for r in out[1]}
    groups = brute_near([by_id[i] for i in ids])  # five-word shingles at 0.8: the stage's contract, wider than the query's four bits
    assert {r.doc_id for r in out[2]} == {ids[g] for g in set(groups)} and len(out[2]) == len(set(groups))
    before, after = {r.doc_id for r in out[2]}, [r.doc_id for r in out[3]]
    assert set(after) <= before
    assert all(i in after for i in before if truth.get(i) == (1, 0) and len(by_id[i].split()) > 50)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    text_of = {r.doc_id: r.text for r in out[3]}
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in out[3])
    assert sum(r.length for r in out[4]) == total
    for r in out[4]:
        ids_ = [*tokenizer.encode(text_of[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids_, "<u4").tobytes())
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == total
