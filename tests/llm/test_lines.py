import hashlib
import os
import random
from collections import Counter

import pytest
from logloom.llm import lines

SCHEMA = "doc_id long, text string, starts int, rk string, n_chars long"


def brute(rows, k):
    order = lambda i: float("inf") if i is None else i
    split = [(i, (t or "").split("\n")) for i, t in rows]
    worded = [[p for p, x in enumerate(ls) if x.strip(" \t\n\x0b\x0c\r")] for _, ls in split]
    first = {}
    for (i, ls), w in zip(split, worded):
        for s in range(len(w) - k + 1):
            key = tuple(ls[p] for p in w[s : s + k])
            first[key] = min(first.get(key, (float("inf"), 10**9)), (order(i), s))
    out = []
    for (i, ls), w, (_, text) in zip(split, worded, rows):
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(ls[p] for p in w[s : s + k])] < (order(i), s):
                gone.update(range(s, s + k))
        drop = {w[p] for p in gone}
        kept = "\n".join(x for p, x in enumerate(ls) if p not in drop) if text else ""
        out.append((i, len(w), len(gone), kept))
    return out


def make(seed):
    rng = random.Random(seed)
    pool = [f"line {i} é" for i in range(25)]
    rows = []
    for i in range(150):
        n = rng.randint(0, 12)
        rows.append((i, "\n".join(rng.choice([*pool, "", "  ", f"own {i} {j}"]) for j in range(n))))
    rows += [(i + 200, rows[i][1]) for i in range(0, 30, 2)]
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "same\nsame\nsame\nsame\nsame"), (404, "x\n" * 3000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_matches_brute_force(spark, k):
    rows = make(k)
    df = spark.createDataFrame([(i, t, 7, "own", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)
    want = brute(rows, k)
    got = lines.line_runs(df, k).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in got) == Counter((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in want)
    assert all((r.n_runs > 0) == (r.n_removed > 0) and r.longest_run <= r.n_removed for r in got)


def brute_runs(rows, least):
    split = {}
    for i, t in rows:
        split[(i, t)] = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    suffixes = sorted((ls[s:], key, s) for key, ls in split.items() for s in range(len(ls)))
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])] + [0]
    longest = {(key, s): max(lcp[n], lcp[n + 1]) for n, (_, key, s) in enumerate(suffixes)}
    out = []
    for key, ls in split.items():
        reach = 0
        for s in range(len(ls)):
            n = longest[key, s]
            if n >= least and s + n > reach:
                out.append((key[0], s, n))
            reach = max(reach, s + n)
    return Counter(out)


@pytest.mark.parametrize("parts, least", [(1, 1), (5, 2)])
def test_maximal_runs_match_brute_force(spark, parts, least):
    rng = random.Random(parts)
    rows = [(i, t) for i, t in make(parts + 20) if not t or len(t) < 2000]
    for n in (2, 3, 7, 31, 64, 200):
        run = "\n".join(f"run {n} line {j}" for j in range(n))
        rows += [(1000 + 10 * n + c, f"a {c} {n}\n{run}\nb {rng.random()}") for c in range(3)]
    df = spark.createDataFrame([(i, t, 7, "own", 1) for i, t in rows], SCHEMA).repartition(parts)
    got = Counter((r.doc_id, r.start, r.n_lines) for r in lines.repeated_runs(df, least).collect())
    assert got == brute_runs(rows, least)


def test_texts_columns_and_shuffled_answers(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    rows = make(9) + [(None, "own a\nown b"), (None, "own a\nown b"), (7, "own a\nown b"), (7, "own a\nown b")]
    df = spark.createDataFrame([(i, t, 7, "own", 1) for i, t in rows], SCHEMA)
    out = lines.dedup_lines(df, 2)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter((r.doc_id, r.text or "") for r in got) == Counter((i, t) for i, _, _, t in brute(rows, 2))
    assert all(r.starts == 7 and r.rk == "own" and (r.text is None or r.n_chars == len(r.text)) for r in got)


def test_empty(spark):
    assert lines.line_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_single_lines_go_in_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    long, edge = " ".join(f"w{j}" for j in range(51)), " ".join(f"v{j}" for j in range(50))
    rows = [(i, f"own {i}\n{long}\nown too {i}\n{edge}\nend {i}", 1, "", 1) for i in range(6)] + [(9, f" {edge} \nq", 1, "", 1), (10, f" {edge} \nr", 1, "", 1)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert got == {r[0]: r[1].replace(f"\n{long}", "") if 0 < r[0] < 9 else r[1] for r in rows}


def test_dedup_leaves_only_what_its_result_reads(spark, monkeypatch):
    tables, real = [], lines.materialize
    monkeypatch.setattr(lines, "materialize", lambda t, name: tables.append((name, real(t, name))) or tables[-1][1])
    df = spark.createDataFrame([(i, "one two\nthree four\nfive six", 0) for i in range(20)], "doc_id long, text string, n_chars long")
    out = lines.dedup_lines(df)
    assert [n for n, t in tables if os.path.exists(t._scratch_path.removeprefix("file:"))] == ["lines-starts"]
    assert sorted(r.n_chars for r in out.collect()) == [0] * 19 + [27]
