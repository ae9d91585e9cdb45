import random
import re
from collections import Counter

from logloom.llm import quality

SCHEMA = "doc_id long, text string, w string, kept int, llr string, row int, n_words int"


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(tri)
    covered = {j for i, t in enumerate(tri) if n[t] > 1 for j in range(i, i + 3)}
    failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def make():
    rng = random.Random(5)
    clean = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nü") for b in ("ta", "ru", "so", "vi")]
    rows, labels = [], []
    for i in range(240):
        n = rng.choice([0, 2, 3, 10, 60, 120, 300])
        junk = i % 4 == 0
        ws = [rng.choice(clean) + ("###" if junk else "") for _ in range(n)]
        seps = [rng.choice([" ", "\n", "\t", "  ", " "]) for _ in ws]
        text = "".join(a + b for a, b in zip(ws, seps))
        rows.append((i, text + ("\n" + text if i % 9 == 0 else ""), "x", 7, "y", 1, 2))
        labels.append((i, 0 if junk else 1, 0))
    rows += [(900, None, "", 0, "", 0, 0), (901, "", "", 0, "", 0, 0), (902, "\n \n", "", 0, "", 0, 0), (903, "same " * 3000, "", 0, "", 0, 0), (None, "a b", "", 0, "", 0, 0), (904, "a b c a b c a", "", 0, "", 0, 0)]
    rows += [rows[5], (905, " ".join(f"w{i % 2900}" for i in range(3000)), "", 0, "", 0, 0)]
    return rows, labels


def test_base_counts_match_brute_force_and_verdicts_separate(spark):
    rows, labels = make()
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7000, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3), lab).collect()
    assert len(got) == len(rows)
    want = {i: brute(t) for i, t, *_ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r.doc_id
        assert not (r.base_failed and r.kept)
    truth = {i: q for i, q, _ in labels}
    judged = [r for r in got if r.doc_id in truth and not r.base_failed]
    assert judged and all(r.kept == bool(truth[r.doc_id]) for r in judged)


def test_filter_keeps_columns(spark):
    rows, labels = make()
    df = spark.createDataFrame(rows, SCHEMA)
    out = quality.filter_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == df.columns
    got = out.collect()
    assert got and {tuple(r) for r in got} <= set(rows)


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA), none).collect() == []
    r = quality.quality_rules(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)), "", 0, "", 0, 0)], SCHEMA), none).collect()[0]
    assert r.llr == 0 and r.kept
