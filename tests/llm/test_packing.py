import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from logloom.llm import packing
from logloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, start int, ids string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers(tokenizer):
    texts = ["Hello wOrld's 12 naïve café \t\r\n x", "", "é ́a <|endoftext|> it'll", "Σίσυφος ΣΑΣ   don't", "A" * 5000, "Élan vital, naïve. straße… x.. ÷ × µ ª", "a\ue000b c", "İstanbul ŉ don't. it's, e\u0301t", "...,. a.b a,b c.,"]
    got = packing.WordIds(tokenizer_path()).of([t.encode() for t in texts])
    for t, g in zip(texts, got):
        assert g.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_forgetting_words_changes_no_ids(tokenizer):
    rng = random.Random(2)
    store = packing.WordIds(tokenizer_path(), most=40)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 200)}x" for _ in range(30)) for _ in range(3)]
        for t, g in zip(texts, store.of([t.encode() for t in texts])):
            assert g.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        assert len(store.known) <= 40 + 90
    assert store.known


def check(rows, want_ids, window, with_ids):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want_ids)
    for d, ps in by_doc.items():
        ids, at = want_ids[d], 0
        for p in sorted(ps, key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert not with_ids or p.ids == part
            at += p.length
        assert at == len(ids)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    total = sum(map(len, want_ids.values()))
    return 1 - total / (len(by_seq) * window)


@pytest.mark.parametrize("with_ids", [False, True])
def test_round_trip(spark, tokenizer, with_ids):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gämma", "12", "..."]) for _ in range(int(rng.paretovariate(0.7) * 5) % 900)) for _ in range(400)]
    texts += [None, "", "   ", "one two " * 1500]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    got = packing.pack_documents(df, tokenizer_path(), window=256, with_ids=with_ids).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert check(got, want, 256, with_ids) < 0.05


def test_bounded_space():
    rng, windows, out = random.Random(1), packing.OpenWindows(4, 100), []
    for i in range(500):
        size = rng.randint(1, 100)
        out += windows.place(size, [(i, size)])
        assert len(windows.free) <= 4
    out += windows.rest()
    assert sorted(p[0] for w in out for p in w) == list(range(500))
    assert all(sum(p[1] for p in w) <= 100 for w in out)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path()).collect() == []


def test_merging_many_tasks_leaves_little_padding(spark, tokenizer):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "12"]) for _ in range(int(rng.lognormvariate(4.5, 0.8)))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    got = packing.pack_documents(df, tokenizer_path(), window=1024).collect()
    assert check(got, {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}, 1024, False) < 0.01


def test_a_full_piece_displaces_no_open_window():
    windows = packing.OpenWindows(2, 10)
    assert windows.place(9, ["a"]) == [] and windows.place(8, ["b"]) == []
    assert windows.place(10, ["c"]) == [["c"]] and windows.place(1, ["d"]) == [["a", "d"]]
