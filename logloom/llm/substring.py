"""Substring dedup: words inside repeated windows are removed, found through a count-min prefilter.

1. Documents are gathered into blocks (a few MB each), written once; a block's id and order never change.
2. Every block sketches its windows: `depth` count-min rows over all documents' cells, kept
   sparse (sorted cells, gap-coded, with a bit for "twice or more here"). Sketches are cut into cell ranges,
   sent to the task that owns the range and merged there by adding counts. Merged counts never
   underestimate, so a window with an estimate of one is unrepeated. A block gets back one bit per cell.
3. Only windows estimated repeated in every row are grouped exactly, by the 128-bit hash of their
   words; a block sends each such window once, with its earliest start, and gets back one bit: "this start is
   the earliest of all".
4. The block removes every word of every repeated window that isn't the earliest.

What a task receives is bounded by the number of blocks per window, not by copies: a passage
in a third of all documents is one entry per block. Nothing is dropped, and shuffled
bytes are in proportion to the input: sketches take about three bytes a window.

Defined cases: null or blank text has no words; texts are processed whole; texts shorter than a window keep all
words; rows with the same id and text are each other's copies at the same place, neither
earlier, so both stay; a null id sorts after all others; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .texthash import Joined, mix, text_batches

BLOCK_BYTES = 8 << 20
CELLS_PER_WINDOW = 16
DEPTH = 2
#: Cells or entries that one merging task receives, about.
SHARD_CELLS = 1 << 22
#: Answers (a bit for each cell) up to so many bytes are broadcast to the blocks; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20
_NULL_ID = np.iinfo(np.int64).max


def _pack(a: np.ndarray) -> bytes:
    """Byte planes of non-negative integers, compressed: high planes are nearly empty."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


_BLOCKS = pa.schema([("block", pa.int64()), ("n_windows", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])
_PARTS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_BITS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int32()), ("bits", pa.binary())])


def _to_blocks(batches, k: int, most: int):
    part, made = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0

    def block():
        windows = sum(max(0, len(t.split()) - k + 1) for t in texts)
        data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        return _record(_BLOCKS, [(part << 32) + made], [windows], [ids], [list(map(len, texts))], [data])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            t = t.as_py() or b""
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= most or len(ids) >= 100_000:
                yield block()
                made += 1
                ids, texts, held = [], [], 0
    if ids:
        yield block()


def _texts(sizes: list[int], data: bytes) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for n in sizes:
        out.append(raw[at : at + n])
        at += n
    return out


def _window_hashes(texts: list[bytes], k: int) -> np.ndarray:
    got = [Joined(some).windows(k)[1] for _, some in text_batches(texts)]
    return np.concatenate(got) if got else np.empty(0, np.uint64)


class Cells:
    """Geometry of the sketch: rows of `width` cells, each row cut into ranges of cells."""

    def __init__(self, windows: int, depth: int, per_window: int, shard_cells: int):
        self.depth = depth
        self.bits = max(10, int(per_window * windows).bit_length())
        self.range_bits = max(0, self.bits - max(0, (int(windows) // shard_cells).bit_length()))

    def row(self, h: np.ndarray, r: int) -> np.ndarray:
        h = mix(h + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) if r else h
        return h >> np.uint64(64 - self.bits)

    def shards(self, cells: np.ndarray, r: int):
        """(shard, slice) of sorted cells."""
        owner = cells >> np.uint64(self.range_bits)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(cells) else np.empty(0, np.int64)
        for a, b in zip(first, [*first[1:], len(cells)]):
            yield (r << 48) + int(owner[a]), slice(int(a), int(b))


def _sketch(batches, k: int, cells: Cells):
    for b in batches:
        for block, sizes, data in zip(*(b.column(i).to_pylist() for i in range(3))):
            h = _window_hashes(_texts(sizes, data), k)
            rows = []
            for r in range(cells.depth):
                own, count = np.unique(cells.row(h, r), return_counts=True)
                for shard, s in cells.shards(own, r):
                    part = own[s]
                    gaps = np.diff(part, prepend=part[0] >> np.uint64(cells.range_bits) << np.uint64(cells.range_bits))
                    rows.append((shard, block, len(part), _pack(gaps), np.packbits(count[s] > 1).tobytes()))
            if rows:
                yield _record(_PARTS, *zip(*rows))


def _merge_sketches(group: pa.Table) -> pa.Table:
    """Adds the counts of a range of cells; each sketch gets a bit per cell: counted twice or more."""
    n, blocks = group.column("n").to_pylist(), group.column("block").to_pylist()
    cells = np.concatenate([np.cumsum(_unpack(x)) for x in group.column("a").to_pylist()])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for x, c in zip(group.column("b").to_pylist(), n)]).astype(bool)
    order = np.argsort(cells, kind="stable")
    s = cells[order]
    same = s[1:] == s[:-1]
    many = np.zeros(len(s), bool)
    many[1:] |= same
    many[:-1] |= same
    twice[order] |= many
    ends = np.cumsum(n)
    bits = [np.packbits(twice[e - c : e]).tobytes() for e, c in zip(ends, n)]
    return pa.Table.from_batches([_record(_BITS, blocks, group.column("shard").to_pylist(), n, bits)])


def _answer(parts: list[dict] | None) -> dict[int, np.ndarray]:
    return {p["shard"]: np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]).astype(bool) for p in parts or []}


def _estimated_repeated(h: np.ndarray, cells: Cells, answer: dict[int, np.ndarray]) -> np.ndarray:
    """Which windows the merged sketch counts twice or more in every row."""
    keep = np.ones(len(h), bool)
    for r in range(cells.depth):
        own, where = np.unique(cells.row(h, r), return_inverse=True)
        flags = np.zeros(len(own), bool)
        for shard, s in cells.shards(own, r):
            flags[s] = answer[shard]
        keep &= flags[where]
    return keep


def _repeated_windows(texts: list[bytes], ids: np.ndarray, k: int, cells: Cells, answer):
    """For windows estimated repeated: text number, start in it, 128-bit hash (two words)."""
    parts = [(at, Joined(some)) for at, some in text_batches(texts)]
    got = [j.windows(k) for _, j in parts]
    h = np.concatenate([x[1] for x in got]) if got else np.empty(0, np.uint64)
    keep = _estimated_repeated(h, cells, answer)
    doc, start, digest, done = [], [], [], 0
    for (at, j), (first, _) in zip(parts, got):
        first = first[keep[done : done + len(first)]]
        done += len(_)
        number = np.searchsorted(j.doc_ends, first, side="right")
        doc.append(number + at)
        start.append(first - np.concatenate(([0], j.doc_ends))[number])
        data, f = j.data, xxhash.xxh3_128_digest
        digest.append(b"".join([f(data[a:b]) for a, b in zip(j.starts[first].tolist(), j.ends[first + k - 1].tolist())]))
    d = np.frombuffer(b"".join(digest), ">u8").reshape(-1, 2).astype(np.uint64)
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(doc), cat(start), d[:, 0], d[:, 1]


def _first_of_groups(hi, lo, doc_id, start):
    """Order by (hash, id, start), and where each hash's group begins in it."""
    order = np.lexsort((start, doc_id, lo, hi))
    a, b = hi[order], lo[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def _candidates(batches, k: int, cells: Cells, shards: int):
    """Each block's windows estimated repeated, once per hash with the earliest start in the block."""
    for b in batches:
        for block, raw_ids, sizes, data, parts in zip(*(b.column(i).to_pylist() for i in range(5))):
            ids = np.array([_NULL_ID if i is None else i for i in raw_ids], np.int64)
            doc, start, hi, lo = _repeated_windows(_texts(sizes, data), ids, k, cells, _answer(parts))
            order, new = _first_of_groups(hi, lo, ids[doc], start)
            own = order[new]
            owner = (hi[own] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(own) else np.empty(0, np.int64)
            rows = []
            for x, y in zip(first, [*first[1:], len(own)]):
                o = own[x:y]
                keys = np.stack((hi[o], lo[o]), axis=1).astype("<u8").tobytes()
                places = np.stack((ids[doc[o]], start[o]), axis=1).astype("<i8").tobytes()
                rows.append((int(owner[x]), block, len(o), keys, zstandard.ZstdCompressor(level=1).compress(places)))
            if rows:
                yield _record(_PARTS, *zip(*rows))


def _merge_candidates(group: pa.Table) -> pa.Table:
    n, blocks = group.column("n").to_pylist(), group.column("block").to_pylist()
    keys = np.frombuffer(b"".join(group.column("a").to_pylist()), "<u8").reshape(-1, 2)
    places = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in group.column("b").to_pylist()), "<i8").reshape(-1, 2)
    order, new = _first_of_groups(keys[:, 0], keys[:, 1], places[:, 0], places[:, 1])
    p = places[order]
    least = p[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = np.zeros(len(order), bool)
    first[order] = (p == least).all(axis=1)
    ends = np.cumsum(n)
    bits = [np.packbits(first[e - c : e]).tobytes() for e, c in zip(ends, n)]
    return pa.Table.from_batches([_record(_BITS, blocks, group.column("shard").to_pylist(), n, bits)])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _remove(batches, k: int, cells: Cells, with_text: bool):
    for b in batches:
        for raw_ids, sizes, data, parts, firsts in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
            texts = _texts(sizes, data)
            ids = np.array([_NULL_ID if i is None else i for i in raw_ids], np.int64)
            doc, start, hi, lo = _repeated_windows(texts, ids, k, cells, _answer(parts))
            order, new = _first_of_groups(hi, lo, ids[doc], start)
            # shards ascend with the hash, so answers follow one another in the order of the groups
            bits = [x for _, x in sorted(_answer(firsts).items())]
            group = np.cumsum(new) - 1
            lead = order[new][group] if len(order) else order
            is_first = (np.concatenate(bits)[group] if bits else np.empty(0, bool)) & (ids[doc[order]] == ids[doc[lead]]) & (start[order] == start[lead])
            later = order[~is_first]
            gone_doc, gone_start = doc[later], start[later]
            by = np.argsort(gone_doc, kind="stable")
            gone_doc, gone_start = gone_doc[by], gone_start[by]
            rows = []
            for i, t in enumerate(texts):
                ws = t.split()
                mine = gone_start[np.searchsorted(gone_doc, i) : np.searchsorted(gone_doc, i, side="right")] if len(gone_doc) else ()
                removed = 0
                if len(mine):
                    edge = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edge, mine, 1)
                    np.add.at(edge, mine + k, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    removed = int(gone.sum())
                    kept = b" ".join([w for w, g in zip(ws, gone.tolist()) if not g])
                else:
                    kept = b" ".join(ws)
                rows.append((raw_ids[i], len(ws), removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                if len(rows) >= 2000:
                    yield _record(_OUT, *zip(*rows))
                    rows = []
            if rows:
                yield _record(_OUT, *zip(*rows))


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} " + (f"array<{names[f.type.value_type]}>" if pa.types.is_list(f.type) else names[f.type]) for f in schema)


def _with_answer(blocks: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    per_block = bits.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "bits")).alias(name))
    size = bits.agg(F.sum(F.length("bits") + 24)).first()[0] or 0
    return blocks.join(F.broadcast(per_block) if size <= BROADCAST_BYTES else per_block, "block", "left")


def substring_dedup(docs: DataFrame, window: int = 20, depth: int = DEPTH, cells_per_window: int = CELLS_PER_WINDOW, block_bytes: int = BLOCK_BYTES, shard_cells: int = SHARD_CELLS, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, and with `with_text` the kept_text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(src.mapInArrow(lambda it: _to_blocks(it, window, block_bytes), _sql(_BLOCKS)), "substring-blocks")
    n = blocks.agg(F.sum("n_windows")).first()[0] or 0
    cells = Cells(n, depth, cells_per_window, shard_cells)
    sketches = blocks.select("block", "sizes", "texts").mapInArrow(lambda it: _sketch(it, window, cells), _sql(_PARTS))
    bits = materialize(sketches.groupBy("shard").applyInArrow(_merged(_merge_sketches), _sql(_BITS)), "substring-bits")
    one = _with_answer(blocks.select("block", "ids", "sizes", "texts"), bits, "cells")
    shards = max(1, int(n) // shard_cells)
    sent = one.select("block", "ids", "sizes", "texts", "cells").mapInArrow(lambda it: _candidates(it, window, cells, shards), _sql(_PARTS))
    firsts = materialize(sent.groupBy("shard").applyInArrow(_merged(_merge_candidates), _sql(_BITS)), "substring-firsts")
    two = _with_answer(one, firsts, "firsts").select("block", "ids", "sizes", "texts", "cells", "firsts")
    out = two.mapInArrow(lambda it: _remove(it, window, cells, with_text), _sql(_OUT))
    return out if with_text else out.drop("kept_text")


def _merged(f):
    def run(group):
        return f(group)

    return run
