import os
import random

import corpus_pipeline
import numpy as np
from logloom.llm import nearcopies

from .test_simhash import brute_components, brute_fp


def brute(texts, least=0.8):
    def grams(t):
        ws = (t or "").lower().split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= least * len(a | b)):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for i in range(60):
        ws = [word() for _ in range(rng.choice([60, 120, 400]))]
        out.append(" ".join(ws))
        for _ in range(i % 3):  # edits one after the other: chains at 0.8 to 0.95 and pairs under it
            for _ in range(max(1, len(ws) // rng.choice([50, 100, 200]))):
                ws[rng.randrange(len(ws))] = word()
            out.append(" ".join(ws))
    return out + [None, "", "a b", "A  b", "c d e"]


def test_components_match_brute_force(spark):
    rows = list(enumerate(texts()))
    want = brute([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in nearcopies.near_components(df).collect()} == dict(enumerate(want))
    assert len(set(want)) < len(set(brute_components([brute_fp(t) for _, t in rows], 4)))


def test_stage_drops_near_copies_at_080(spark, tmp_path):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())] + [(None, "a b", "en", "s", 0)]
    want = set(brute([r[1] for r in rows[:-1]])) | {None}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted((r.doc_id for r in got.collect()), key=str) == sorted(want, key=str)


def test_a_file_in_tiles_gives_the_links_of_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"b{j}" for j in range(300)]
    rows = []
    for i in range(220):  # each some 0.85 like the base, 0.6 to 0.95 like each other
        ws = list(base)
        for _ in range(rng.choice([1, 3, 5, 7])):
            ws[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    monkeypatch.setattr(nearcopies, "TILE_BYTES", 100_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute([t for _, t in rows])
    assert {r.doc_id: r.component_id for r in nearcopies.near_components(df).collect()} == dict(enumerate(want))


def test_rows_with_one_id(spark):
    a, b = "one two three four five six", "red green blue white black grey"
    rows = [(5, a), (5, b), (5, b), (6, a), (4, b + " pink"), (None, a)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = nearcopies.keep_one_near_copy(df)
    assert got.columns == df.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, a), (5, b), (4, b + " pink"), (None, a)], key=str)


def _node_rows(fps):
    return [(i, 50, *(int(x) for x in fp.view(np.int64))) for i, fp in enumerate(fps)]


def _flipped(rng, fp, rate):
    bits = np.packbits(rng.random((nearcopies.WORDS, 64)) < rate, axis=1).view(np.uint64).ravel()
    return fp ^ bits


def _components(fps):
    root = np.arange(len(fps))
    near = sum(np.bitwise_count(fps[:, None, w] ^ fps[None, :, w]).astype(int) for w in range(nearcopies.WORDS)) <= nearcopies.RADIUS
    while (root != (new := np.array([root[near[i]].min() for i in range(len(fps))]))).any():
        root = new
    return root.tolist()


def test_fingerprint_files_link_what_all_pairs_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    fps = list(rng.integers(0, 2**64, (300, nearcopies.WORDS), dtype=np.uint64))
    fps += [_flipped(rng, fp, 0.15) for fp in fps[:200]]
    fps += [_flipped(rng, fps[250], 0.08) for _ in range(200)]  # a group that fills files of every table
    fps = np.array([fps[i] for i in rng.permutation(len(fps))])
    want = _components(fps)
    nodes = spark.createDataFrame(_node_rows(fps), "node long, size long, " + ", ".join(f"{f} long" for f in nearcopies.FP)).repartition(3)
    for file, most in ((64, 8192), (16, 32), (4096, 8192), (4096, 32)):
        monkeypatch.setattr(nearcopies, "FILE", file)
        monkeypatch.setattr(nearcopies, "MAX_FILE", most)
        labels = {r.node: r.component for r in nearcopies.connected_components(nearcopies.links(nodes)).collect()}
        assert [labels.get(i, i) for i in range(len(fps))] == want, (file, most)


def test_pairs_at_080_share_a_file():
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    pairs = []
    for size in [9, 14, 18, 45, 90, 360] * 500:  # of equal sizes, 8 of 9 shared: 0.8
        both, rest = fresh(size * 8 // 9), size - size * 8 // 9
        pairs.append((np.concatenate((both, fresh(rest))), np.concatenate((both, fresh(rest)))))
    short = [(s[:4], s) for s in (fresh(5) for _ in range(3000))]
    for sets, rate in ((pairs, nearcopies.differing(0.8)[1]), (short, nearcopies.differing(0.8)[0])):
        a, b = (np.stack(nearcopies.fingerprint_words(list(side))) for side in zip(*sets))
        apart = sum(np.bitwise_count(a ^ b).astype(int))
        assert (apart <= nearcopies.RADIUS).all() and abs(apart.mean() / nearcopies.BITS - rate) < 0.03
        for bits in (2, 6):
            masks = np.array(nearcopies.block_masks(bits, nearcopies.tables_for(bits, rate)), np.int64).view(np.uint64)
            met = np.zeros(len(sets), bool)
            for m in masks:
                met |= (((a ^ b) & m[:, None]) == 0).all(axis=0)
            assert (~met).sum() <= 2


def test_parts_of_a_group_see_its_smallest_and_nothing_else_stays(spark, monkeypatch):
    rng = random.Random(8)
    base = [rng.choices([f"w{i}" for i in range(500)], k=120) for _ in range(4)]
    texts = []
    for i in range(120):
        t = list(base[i % 4])
        t[rng.randrange(len(t))] = f"x{i}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    tables, real = [], nearcopies.materialize
    monkeypatch.setattr(nearcopies, "materialize", lambda t, name: tables.append(real(t, name)) or tables[-1])
    monkeypatch.setattr(nearcopies, "TILE_ROWS", 3)
    out = nearcopies.keep_one_near_copy(df)
    assert {r.doc_id for r in out.collect()} == set(brute(texts))
    assert tables and not [t for t in tables if os.path.exists(t._scratch_path.removeprefix("file:"))]
