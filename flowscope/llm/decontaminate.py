"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit distance.

Texts are sequences of words (case and outer punctuation dropped). The CGK random walk writes a word sequence into a
longer one in which few edits become few differing places: at step t it emits the word it stands on and moves on if a
random bit of (step, word) says so. Every window of a document, as long as the item it is compared with, is embedded this
way and hashed at ``samples`` sampled steps; ``tables`` independent walks reach the target recall. The samples are
evaluated step by step for all windows at once, and a window whose sampled words so far begin no item's key is left:
that is the same table look-up, made early. Step 0, the window's first word, is always sampled; so each item is entered
from several places, the longest word of every ``STRIDE`` words.

Items of fewer than ``WALKED`` words have too few places to enter them from for the target recall. What their walks miss is
found by pieces: cut into one piece more than edits are allowed, at least one piece stands unedited in any leak. All that
collides, by walks or pieces, is verified by its edit distance.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import Memo, bounded, white_cut, written

STRIDE = 5
#: Items with fewer words are only found by their pieces.
LEAST_WALK = 8
#: Items with fewer words are found by their pieces too.
WALKED = 32
#: Steps of a walk: the largest of these that the rest of the item has words for.
STEPS = (4, 8, 16, 32)
#: Items are indexed and broadcast in blocks of so many items and characters at most.
ITEM_BLOCK, ITEM_CHARS = 20_000, 8_000_000
PUNCTUATION = string.punctuation + "«»“”„’‘¿¡…–—"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(48)


class Words(Memo):
    """raw word (bytes) -> 64-bit hash of the folded word, 0 if nothing is left of it."""

    def of_key(self, key: bytes) -> int:
        word = key.decode("utf8", "replace").lower().strip(PUNCTUATION)
        return xxhash.xxh64_intdigest(word) | 1 if word else 0

    def of(self, text: bytes | None) -> np.ndarray:
        out = [np.empty(0, np.uint64)]
        for part in white_cut(text or b""):
            raw = part.split()
            out.append(np.fromiter(map(self.__getitem__, raw), np.uint64, len(raw)))
        flat = np.concatenate(out)
        return flat[flat != 0]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) * _MIX
        x ^= x >> np.uint64(32)
        return x * _MIX


def tables_for(recall: float, agree: float, samples: int) -> int:
    """Walks needed so that a pair whose embeddings agree in that part of the steps collides with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**samples))


def distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of ``words``, and where that ends."""
    at = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for w in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (words != w), row[1:] + 1)
        row = np.minimum.accumulate(new - at) + at
    end = int(np.argmin(row))
    return int(row[end]), end


def _walk(words, starts, salt, sampled):
    """Keys of the walks from ``starts`` after each sampled step; yields as it goes, and takes back which walks to go on with.

    A walk stands still at the zero behind a document.
    """
    at = starts.copy()
    key = mixed(words[at], salt)
    going = yield key
    t = 0
    for s in sampled:
        if going is not None:
            at, key = at[going], key[going]
        while t < s:
            here = words[at]
            on = (mixed(here, salt + 7919 * t + 1) >> np.uint64(63)).astype(np.int64) * (here != 0)
            at = np.minimum(at + on, len(words) - 1)
            t += 1
        key = mixed(key ^ words[at], salt + s)
        going = yield key


def _run(words, starts, n):
    """Keys of the n words from ``starts`` after each word; takes back which to go on with."""
    key = words[starts]
    going = yield key
    for j in range(1, n):
        if going is not None:
            starts, key = starts[going], key[going]
        key = mixed(key ^ words[starts + j], j)
        going = yield key


class Table:
    """What the keys of one table stand for: sorted keys of each level, and (item, place) by the last."""

    def __init__(self, levels: list[np.ndarray], items: np.ndarray, places: np.ndarray):
        self.levels = [np.unique(x) for x in levels]
        order = np.argsort(levels[-1], kind="stable")
        self.keys, self.items, self.places = levels[-1][order], items[order].astype(np.int32), places[order].astype(np.int32)

    def search(self, starts: np.ndarray, keys_of) -> np.ndarray:
        """Rows (item, start of the item) of all that collides; ``keys_of`` generates keys level by level."""
        now, key = starts, next(keys_of)
        for level, known in enumerate(self.levels):
            going = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key)
            if not len(going):
                return np.empty((0, 2), np.int64)
            now = now[going]
            if level + 1 < len(self.levels):
                key = keys_of.send(going)
            else:
                key = key[going]
        lo, hi = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.column_stack([self.items[at].astype(np.int64), np.repeat(now, n) - self.places[at]])


class ItemIndex:
    """The hash tables of a block of items (id, text), as arrays; small enough to be broadcast. Items are known by their position."""

    def __init__(self, items, tolerance: float = 0.2, recall: float = 0.98, agree: float = 0.75, samples: int = 4, seed: int = 11):
        memo = Words()
        self.ids = [i for i, _ in items]
        self.words = [memo.of((t or "").encode()) for _, t in items]
        self.allowed = [int(tolerance * len(w) + 1e-9) for w in self.words]
        rng = np.random.default_rng(seed)
        self.plans = {}  # steps -> [(salt, sampled steps after 0)] for each table
        for n in STEPS:
            # one sample from each part of the walk, so that a key spans several words
            parts = np.array_split(np.arange(1, n), min(samples - 1, n - 1))
            self.plans[n] = [(int(rng.integers(1, 2**62)), [int(rng.choice(p)) for p in parts]) for _ in range(tables_for(recall, agree, samples - 1))]
        entries: dict[int, list] = {}
        cuts: dict[int, list] = {}
        for i, ((_, text), w) in enumerate(zip(items, self.words, strict=True)):
            if len(w) >= LEAST_WALK:
                for at in self._entries(text, len(w)):
                    entries.setdefault(max(s for s in STEPS if s <= len(w) - at), []).append((i, at))
            if 0 < len(w) < WALKED:
                ends = [len(w) * p // (self.allowed[i] + 1) for p in range(self.allowed[i] + 2)]
                for a, b in zip(ends, ends[1:], strict=False):
                    cuts.setdefault(b - a, []).append((i, a))
        starts = np.cumsum([0, *(len(w) + 1 for w in self.words)])
        flat = np.concatenate([np.append(w, np.uint64(0)) for w in self.words] or [np.zeros(0, np.uint64)])
        self.walks, self.pieces = {}, {}
        for n, rows in entries.items():
            item, place = np.array(rows, np.int64).T
            at = starts[item] + place
            self.walks[n] = (np.unique(flat[at]), [Table(list(_walk(flat, at, salt, sampled)), item, place) for salt, sampled in self.plans[n]])
        for n, rows in cuts.items():
            item, place = np.array(rows, np.int64).T
            self.pieces[n] = Table(list(_run(flat, starts[item] + place, n)), item, place)
        self.any_first, self.any_piece = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for heads, _ in self.walks.values():
            self.any_first[(heads >> _TOP).astype(np.int64)] = True
        for table in self.pieces.values():
            self.any_piece[(table.levels[0] >> _TOP).astype(np.int64)] = True

    @staticmethod
    def _entries(text: str, n: int):
        """Where walks enter an item: in every STRIDE words the longest, with enough words behind it."""
        size = [len(x) for x in (r.lower().strip(PUNCTUATION) for r in text.split()) if x]
        last = n - max(STEPS[0], min(16, n // 2))  # an entry without that many words after it would match by chance
        return [max(range(a, min(a + STRIDE, last + 1)), key=lambda p: (size[p], -p)) for a in range(0, last + 1, STRIDE)]

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Rows (item, start) of windows that collide with an item in some table."""
        out = [np.empty((0, 2), np.int64)]
        top = (words >> _TOP).astype(np.int64)
        hot = np.flatnonzero(self.any_first[top])
        for n, (heads, tables) in self.walks.items():
            starts = hot[np.isin(words[hot], heads)]
            if len(starts):
                out += [table.search(starts, _walk(words, starts, salt, sampled)) for table, (salt, sampled) in zip(tables, self.plans[n], strict=True)]
        hot = np.flatnonzero(self.any_piece[top])
        for n, table in self.pieces.items():
            starts = hot[hot <= len(words) - n]
            if len(starts):
                out.append(table.search(starts, _run(words, starts, n)))
        return np.unique(np.concatenate(out), axis=0)

    def leaks(self, words: np.ndarray, bounds: np.ndarray):
        """(document, item, distance, start, end) for the documents that ``bounds`` cuts ``words`` into: each item's best place."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen = set()
        for item, start in self.candidates(words).tolist():
            w, allowed = self.words[item], self.allowed[item]
            doc = int(np.searchsorted(bounds, min(max(start, 0) + len(w) // 2, len(words) - 1), "right")) - 1
            lo, hi = int(bounds[doc]), int(bounds[doc + 1]) - 1  # a document ends with a zero
            if best.get((doc, item), (1,))[0] == 0:
                continue
            if lo <= start and start + len(w) <= hi and np.array_equal(words[start : start + len(w)], w):
                best[doc, item] = (0, start - lo, start + len(w) - lo)
                continue
            place = (doc, item, start // max(1, len(w) // 8))
            if not allowed or place in seen:
                continue
            seen.add(place)
            a, b = max(lo, start - 2 * allowed), min(hi, start + len(w) + 2 * allowed)
            if np.isin(words[a:b], w).sum() < len(w) - allowed:  # so many of the item's words must be there
                continue
            d, end = distance(w, words[a:b])
            if d <= allowed and d < best.get((doc, item), (len(w),))[0]:
                back, length = distance(w[::-1], words[a : a + end][::-1])
                best[doc, item] = (d, a + end - length - lo, a + end - lo)
        return [(doc, item, *x) for (doc, item), x in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK, chars: int = ITEM_CHARS):
    """The items in blocks of about ``block`` items and ``chars`` characters at most, however many there are; null or blank texts match nothing."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("i"), "text").filter("text is not null")
    size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).head()
    n = max(1, -(-size[0] // block), -(-size[1] // chars))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "text"), F.lit(n)) == b)
        yield sorted(((r.i, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), n


def batch_words(texts: pa.Array, memo: Words):
    """All words of a batch of texts with a zero after each text, and where each begins."""
    parts = [memo.of(x.as_py()) for x in texts.cast(pa.binary())]
    zero = np.zeros(1, np.uint64)
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return np.concatenate([y for p in parts for y in (p, zero)]) if parts else np.zeros(0, np.uint64), bounds


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of each item found in a row's whole text.

    distance is in words, at most 0.2 of the item's (rounded down: items of fewer than five words must stand word for
    word); start and end count words; of several places of an item in a row the one with the least distance, then the first.
    Null, empty and blank texts hold nothing and are no items. Repeated rows, equal or null doc_ids are searched row by
    row; repeated items and items with equal or null ids are items of their own. No documents or no items: no rows.
    Other columns of either table don't matter.
    """
    spark, out = docs.sparkSession, None
    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    for block, blocks in item_blocks(benchmark):
        shipped = spark.sparkContext.broadcast(ItemIndex(block, **options))

        def run(batches, shipped=shipped):
            index, memo = shipped.value, Words()
            for batch in bounded(batches, 1):
                words, bounds = batch_words(batch.column(1), memo)
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], index.ids[i], *x) for d, i, *x in index.leaks(words, bounds)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["doc_id", "item_id", "distance", "start", "end"])

        found = cols.mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        if blocks > 1:  # one index at a time in memory
            found = written(found, "leaks")
            shipped.destroy()
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item.

    A null, empty or blank text holds nothing and stays; repeated rows are judged alike, so they stay or go together.
    No items: all rows stay; an empty table stays empty. A column of any name may stand beside the text.
    """
    at, spark = docs.columns.index(text), docs.sparkSession
    for block, blocks in item_blocks(benchmark):
        shipped = spark.sparkContext.broadcast(ItemIndex(block, **options))

        def run(batches, shipped=shipped):
            index, memo = shipped.value, Words()
            for batch in bounded(batches, at):
                words, bounds = batch_words(batch.column(at), memo)
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in index.leaks(words, bounds)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            docs = written(docs, "clean")
            shipped.destroy()
    return docs


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``leaks`` of all benchmark items in all documents."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items)
