import hashlib
import random
import re

import numpy as np
from logloom.llm import substring
from logloom.llm.texthash import Joined

SCHEMA = "doc_id long, text string, block int, ids string"


def brute(rows, k):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, ws in split:
        for s in range(len(ws) - k + 1):
            key = tuple(ws[s : s + k])
            first[key] = min(first.get(key, (float("inf"), 1 << 60)), (order(i), s))
    out = []
    for i, ws in split:
        gone = set()
        for s in range(len(ws) - k + 1):
            if first[tuple(ws[s : s + k])] < (order(i), s):
                gone.update(range(s, s + k))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (order(r[0]), r))


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=lambda r: (float("inf") if r[0] is None else r[0], r))


def test_matches_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)] + ["é", "Ü x"]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(120):
        ws = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            at, a, n = rng.randint(0, len(ws)), rng.randint(0, 30), rng.randint(5, 30)
            ws[at:at] = passage[a : a + n]
        if i % 7 == 0:
            ws += ws
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += [(500, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (None, rows[6][1]), (600, None), (601, ""), (602, "  \n"), (603, "tick " * 4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    for args in ({}, {"block_bytes": 600, "shard_cells": 500}, {"cells_per_window": 1, "depth": 1, "block_bytes": 2000}):
        assert rows_of(substring.substring_dedup(df, window=20, **args)) == brute(rows, 20)


def test_shuffled_answers(spark, monkeypatch):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", 0)
    rows = [(i, " ".join(f"w{j % 40}" for j in range(i, i + 50))) for i in range(20)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    assert rows_of(substring.substring_dedup(df, window=5, block_bytes=100)) == brute(rows, 5)


def test_empty_and_kept_text(spark):
    assert substring.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b c d", 0, ""), (2, "x a b c y", 0, "")], SCHEMA)
    got = {r.doc_id: r.kept_text for r in substring.substring_dedup(df, window=3, with_text=True).collect()}
    assert got == {1: "a b c d", 2: "x y"}


def test_pack_round_trip():
    for a in (np.array([], np.uint64), np.array([0, 255, 256, 2**40], np.uint64)):
        assert (substring._unpack(substring._pack(a)) == a).all()


def test_windows_stay_inside_texts():
    j = Joined([b"a b c", b"", b"a b", b"a b c"])
    first, h = j.windows(2)
    assert first.tolist() == [0, 1, 3, 5, 6] and h[0] == h[2] == h[3] and h[1] == h[4] != h[0]
