import random
import re

import numpy as np
import xxhash

from logloom.llm import simhash
from logloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, key int, fp int, component string"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, limit):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_documents_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["Alpha", "beta", "gamma", "delté", "x\ty"]) for _ in range(rng.choice([1, 3, 4, 60, 300]))) for _ in range(40)]
    texts = base + base[:10] + [t + " tail" for t in base[20:40]] + [None, "", " \n\t", "A b", "a B", "word " * 5000]
    rows = [(i, t, 1, 2, "z") for i, t in enumerate(texts)]
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want_fp = [brute_fp(t) for t in texts]
    want = brute_components(want_fp, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(want_fp, want))}


def test_empty_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(empty).collect() == []
    rows = [(None, "a b c d e", 0, 0, ""), (5, "a b c d e", 0, 0, ""), (5, "a b c d e", 0, 0, "")]
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and {r.component_id for r in got} == {5}


def _planted(rng, n, spread):
    centres = [rng.getrandbits(64) for _ in range(n // 10)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, spread)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def _check_links(spark, fps, limit):
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    found = connected_components(simhash.links(spark.createDataFrame(signed, "fp long"), limit))
    lab = {r.node: r.component for r in found.collect()}
    want = brute_components(fps, limit)
    groups = {}
    for (s,), w in zip(signed, want):
        groups.setdefault(lab.get(s, s), set()).add(w)
    assert all(len(v) == 1 for v in groups.values())
    assert len(groups) == len(set(want))


def test_links_complete(spark):
    _check_links(spark, _planted(random.Random(5), 600, 6), 4)


def test_overfull_files_are_filed_again(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(simhash, "MAX_FILE", 40)
    _check_links(spark, _planted(rng, 500, 5), 4)
    # one file takes everything at the first level, and most at the second
    shared = rng.getrandbits(44) << 20
    _check_links(spark, sorted({shared | rng.getrandbits(20) for _ in range(700)}), 4)


def test_longer_masks_keep_every_pair():
    rng = random.Random(2)
    for distance in (1, 3, 4):
        kept = simhash.file_masks(*simhash.blocks_for(1000, distance))[0]
        while 64 - kept.bit_count() > distance:
            longer = simhash.longer_masks(kept, distance)
            assert all(m & kept == kept and m.bit_count() > kept.bit_count() for m in longer)
            free = [b for b in range(64) if not kept >> b & 1]
            for _ in range(50):
                off = sum(1 << b for b in rng.sample(free, distance))
                assert any(not m & off for m in longer)
            kept = rng.choice(longer)


def _of_hot_file(n, rng):
    """n fingerprints that agree in 40 bits: clusters of four around far centres, so most of the file doesn't link."""
    shared, out = rng.getrandbits(40) << 24, set()
    while len(out) < n:
        x = shared | rng.getrandbits(24)
        out |= {x, x ^ 1 << rng.randrange(24), x ^ 3 << rng.randrange(23)}
    return np.array(sorted(out)[:n], np.uint64)


def _brute_labels(fps, limit):
    """Components by comparing each with all, a row at a time."""
    label = np.arange(len(fps))
    todo = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not todo[start]:
            continue
        todo[start], stack = False, [start]
        while stack:
            x = stack.pop()
            near = np.flatnonzero(todo & (np.bitwise_count(fps ^ fps[x]) <= limit))
            todo[near], label[near] = False, start
            stack.extend(near.tolist())
    return label


def test_file_of_twenty_thousand(spark):
    """Past the production bound: 20,000 members of one file, compared with brute force."""
    rng = random.Random(11)
    fps = np.concatenate((_of_hot_file(20_000, rng), np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)))
    fps = np.unique(fps)
    want = _brute_labels(fps, 4)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    lab = {r.node: r.component for r in connected_components(simhash.links(rows)).collect()}
    pairs = {(lab.get(int(x), int(x)), int(w)) for x, w in zip(fps.view(np.int64), want)}
    assert len(pairs) == len({p for p, _ in pairs}) == len(set(want.tolist()))


def test_files_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    fp = rng.integers(-(2**63), 2**63 - 1, 60)
    fp[1::2] = fp[::2] ^ 5
    key = np.sort(np.repeat(np.arange(4), 15))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 7]), pa.array(fp[i : i + 7])], names=["key", "fp"]) for i in range(0, 60, 7)]
    got = {(a, b) for t in simhash._verify_files(batches, 4) for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist())}
    want = {(int(fp[i]), int(fp[j])) for i in range(60) for j in range(i + 1, 60) if key[i] == key[j] and bin(int(fp[i] ^ fp[j]) & (2**64 - 1)).count("1") <= 4}
    assert {frozenset(x) for x in got} == {frozenset(x) for x in want}


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = ("one two three four five", "six seven eight nine ten eleven", "red green blue white black grey", "up down left right here there")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, d), (9, d), (None, a), (None, a), (11, None), (12, "")]
    df = spark.createDataFrame([(i, t, 0, 0, "k") for i, t in rows], "doc_id long, text string, _key int, h int, component string").repartition(3)
    want = [(3, a), (5, b), (7, c), (8, d), (11, None), (None, a), (None, a)]
    got = simhash.keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_majority_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "_AT_ONCE", 7)
    rng = np.random.default_rng(1)
    hashes = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 3, 20, 5, 0, 7, 2, 40)]
    assert simhash._majority(hashes).tolist() == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in x) > len(x)) for x in hashes]
