"""Packing of tokenized documents into fixed windows: bounded-space online best fit.

Each task keeps a fixed number of open windows. A document is cut into full windows and one rest; the
rest goes into the open window that it fills best; when it fits none and no more may be opened, the fullest
window is emitted; a full window is written at once. When input ends, windows still open are written as leftovers, and the leftovers of a fixed
number of tasks are merged by best fit, largest first, over as many windows as those tasks left: the last step is distributed too and no group grows with the input.

Words are tokenized once per worker: the tokenizer never joins text across white space, so the ids
of a text are those of its words in order.

Defined cases: null and empty text is one piece holding the end id alone; a text of any length is
tokenized whole; repeated rows are packed as often as they come; an empty table gives no rows;
extra columns are ignored. A lost task re-reads its split and packs it in the same order.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize

WINDOW = 2048
END_ID = 1
OPEN_WINDOWS = 64
#: Leftover windows of so many tasks are merged by one task.
MERGE_TASKS = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, open boolean, ids array<int>"


#: Stands between words that are tokenized together; a word with a character of its kind is tokenized alone.
_BETWEEN = "\ue000"
_LIKE_BETWEEN = re.compile(b"\xee")
def split_words(texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text, in small letters; a full stop or comma after a letter (ASCII, or Latin-1 in UTF-8) and before white
    space is a word of its own, as the tokenizer has it: words repeat more often without it."""
    # the tokenizer lowers letters itself, but its special strings are only known as they are written
    low = [t if b"<|" in t else t.lower() for t in texts]
    a = np.frombuffer(b"\n".join(low) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in low])
    stop = np.flatnonzero((a == 46) | (a == 44))
    stop = stop[stop > 1]
    after, before, lead = a[stop + 1], a[stop - 1], a[stop - 2]
    letter = ((before >= 97) & (before <= 122)) | ((lead == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7))
    stop = stop[letter & ((after == 32) | (after == 10))]
    data = np.insert(a, stop, 32).tobytes()
    cuts = [0, *(ends + np.searchsorted(stop, ends)).tolist()]
    return [data[x:y].split() for x, y in zip(cuts, cuts[1:])]


#: Words of such letters alone have exactly one id that ends a word, their last.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class WordIds:
    """Ids of words. A word is kept per worker from the second time on (most are seen once); when about `most`
    are kept, all are forgotten."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.path, self.most = path, most
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self._ids(_BETWEEN)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.size, self.n_ids = np.empty(1 << 20, np.int32), np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64), 0
        self.met = bytearray(1 << 22)  # marks by hash; a collision keeps a word one time early

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _tokenize(self, words: list[bytes]) -> list:
        """The ids of each word; words of letters at once, others at once with something between them."""
        plain = [i for i, w in enumerate(words) if _LETTERS(w)]
        out = [None] * len(words)
        if plain:
            ids = np.array(self._ids(b" ".join([words[i] for i in plain]).decode()), np.int32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain):
                for i, a, b in zip(plain, [0, *ends[:-1].tolist()], ends.tolist()):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._tokenize_apart([words[i] for i in rest])):
            out[i] = x
        return out

    def _tokenize_apart(self, words: list[bytes]) -> list:
        if not words:
            return []
        alone = {i for i, w in enumerate(words) if _LIKE_BETWEEN.search(w)}
        together = [i for i in range(len(words)) if i not in alone]
        out = [None] * len(words)
        if together:
            ids = np.array(self._ids((b" \xee\x80\x80 ".join([words[i] for i in together]) + b" \xee\x80\x80").decode()), np.int32)
            ends = np.flatnonzero(ids == self.between[0])
            if len(ends) == len(together):
                for i, a, b in zip(together, [0, *(ends[:-1] + len(self.between)).tolist()], ends.tolist()):
                    out[i] = ids[a:b]
        return [np.array(self._ids(w.decode()), np.int32) if x is None else x for w, x in zip(words, out)]

    def _place(self, words: list[bytes]) -> dict[bytes, int]:
        """Tokenizes words behind those that are kept; the ones met before are kept from now on."""
        met, mask = self.met, len(self.met) - 1
        again = [w for w in words if met[hash(w) & mask]]
        new = [w for w in words if not met[hash(w) & mask]]
        for w in new:
            met[hash(w) & mask] = 1
        words, n, n_ids = again + new, len(self.known), self.n_ids
        places = dict(zip(words, range(n, n + len(words))))
        for i in range(0, len(words), 10_000):
            got = self._tokenize(words[i : i + 10_000])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.concatenate(got)
            while n_ids + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            while n + i + len(got) > len(self.first):
                self.first, self.size = np.concatenate((self.first, np.empty_like(self.first))), np.concatenate((self.size, np.empty_like(self.size)))
            self.ids[n_ids : n_ids + len(flat)] = flat
            self.first[n + i : n + i + len(got)] = n_ids + np.cumsum(sizes) - sizes
            self.size[n + i : n + i + len(got)] = sizes
            n_ids += len(flat)
        self.known.update(zip(again, range(n, n + len(again))))
        if again:
            self.n_ids = int(self.first[n + len(again) - 1] + self.size[n + len(again) - 1])
        return places

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, each followed by the end id."""
        split = split_words(texts)
        if len(self.known) > self.most:
            self.clear()
        words = [w for ws in split for w in ws]
        idx = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(idx < 0).tolist()
        if unknown:
            places = self._place(list({words[i] for i in unknown}))
            idx[unknown] = [places[words[i]] for i in unknown]
        sizes = self.size[idx]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.first[idx] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        ends = np.concatenate(([0], ends))[np.cumsum([0, *map(len, split)])]
        end = np.array([END_ID], np.int32)
        return [np.concatenate((flat[a:b], end)) for a, b in zip(ends[:-1], ends[1:])]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


class OpenWindows:
    """At most `most` open windows; a unit is (size, pieces) and never cut here."""

    def __init__(self, most: int, window: int):
        self.most, self.window, self.free, self.held = most, window, [], []

    def place(self, size: int, pieces: list):
        """Windows that had to be emitted, as lists of pieces."""
        if size == self.window:
            return [pieces]
        out = []
        fits = [(f, i) for i, f in enumerate(self.free) if f >= size]
        if fits:
            _, i = min(fits)
        else:
            if len(self.free) >= self.most:
                out.append(self._pop(min(range(len(self.free)), key=self.free.__getitem__)))
            i = len(self.free)
            self.free.append(self.window)
            self.held.append([])
        self.free[i] -= size
        self.held[i] += pieces
        if not self.free[i]:
            out.append(self._pop(i))
        return out

    def _pop(self, i: int):
        self.free.pop(i)
        return self.held.pop(i)

    def rest(self):
        """The windows still open, fullest first."""
        order = sorted(range(len(self.free)), key=lambda i: self.free[i])
        return [self.held[i] for i in order]


def _table(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 10
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.bool_(), pa.list_(pa.int32())]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "open", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


class _Writer:
    """Numbers emitted windows and lays their pieces out without gaps."""

    def __init__(self, base: int, part: int):
        self.next, self.part, self.rows = base << 32, part, []

    def window(self, pieces: list, open_: bool):
        at = 0
        for doc, start, length, crc, total, ids in pieces:
            self.rows.append((doc, start, length, crc, total, self.next, at, self.part, open_, ids))
            at += length
        self.next += 1


def pieces_of(doc_id, ids: np.ndarray, window: int, with_ids: bool) -> list[tuple]:
    le, n = ids.astype("<u4"), len(ids)
    return [(doc_id, a, min(window, n - a), zlib.crc32(le[a : a + window].tobytes()), n, ids[a : a + window].tolist() if with_ids else None) for a in range(0, n, window)]


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids."""

    def run(batches):
        part = TaskContext.get().partitionId()
        store, windows, out = word_ids(tokenizer_path), OpenWindows(open_windows, window), _Writer(part, part // MERGE_TASKS)
        for b in batches:
            ids_in, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            at = 0
            while at < len(texts):
                some, held = [], 0
                while at + len(some) < len(texts) and len(some) < 256 and held < 1_000_000:
                    t = texts[at + len(some)].as_py() or b""
                    some.append(t)
                    held += len(t)
                for doc, ids in zip(ids_in[at : at + len(some)], store.of(some)):
                    for p in pieces_of(doc, ids, window, with_ids):
                        for full in windows.place(p[2], [p]):
                            out.window(full, False)
                at += len(some)
                if len(out.rows) > 5000:
                    yield _table(out.rows)
                    out.rows = []
        for left in windows.rest():
            out.window(left, True)
        if out.rows:
            yield _table(out.rows)
        give_back()

    def merge(key, group):
        left: dict[int, list] = {}
        for r in sorted(group.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"])):
            left.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]))
        # every leftover of the group fits in as many windows as there were, so none is emitted before all are placed
        windows, out = OpenWindows(max(1, len(left)), window), _Writer((1 << 30) + key[0].as_py(), key[0].as_py())
        pieces = sorted((p for w in left.values() for p in w), key=lambda p: -p[2])
        for p in pieces:
            for full in windows.place(p[2], [p]):
                out.window(full, False)
        for w in windows.rest():
            out.window(w, False)
        return pa.Table.from_batches([_table(out.rows)])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = materialize(src.mapInArrow(run, SCHEMA), "packed")
    merged = first.where("open").groupBy("part").applyInArrow(merge, SCHEMA)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return first.where("not open").unionByName(merged).select(*cols)
