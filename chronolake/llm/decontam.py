"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Words: letters A-Z folded, digits, and everything outside ASCII. An item of n words is
compared with all runs of n words of a document (a document with fewer words: its whole
text). Both sides are bags of ``K``-word shingles (fewer words: the whole sequence), and a
window matches if its weighted Jaccard likeness to the item, the sum of smaller counts over
the sum of larger counts, is at least ``THRESHOLD``.

Windows that can reach the threshold hold many shingles of some item; a count of those
along the document (exact, from one table look-up a shingle) leaves the windows to
fingerprint. A window's SimHash has 256 bits in ``BLOCKS`` blocks of 8. Two fingerprints
within ``RADIUS`` bits differ by at most ``BALL`` bits in at least ``AGREE`` blocks, whatever
the place of the bits; tables of those balls vote for the items, and a pair of unrelated
fingerprints gets that many votes about five times in 10,000. Whole distances and then
exact likeness verify. The radius is four standard deviations beyond the expected distance
at the threshold (39 and 5.7 bits), so one window in some 30,000 right at it is missed.

Items go to the executors in blocks of at most ``ITEMS`` rows, one pass over the documents a
block. Null or wordless documents and items match nothing; repeated items match each;
repeated documents are found each by itself. Of windows of equal likeness the first is named.
No documents or no items: no matches, and every document is clean. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronolake.llm.textbytes import LOWER_WORD, chunks, mix, shingle_hashes, word_bounds, word_hashes
from chronolake.runtime import ship

K = 5
THRESHOLD = 0.8
RADIUS = 62
BLOCKS = 32
BALL = 2
AGREE = BLOCKS - RADIUS // (BALL + 1)
ITEMS = 20_000
FILTER = 1 << 20


@dataclass
class Index:
    """Items of one block: by number of words, and the shingles of all of them."""

    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # shingle size: sorted hashes
    table: dict[int, np.ndarray] = field(default_factory=dict)  # shingle size: whether low bits occur
    items: dict[int, list[tuple[int, dict[int, int], np.ndarray]]] = field(default_factory=dict)  # words: id, counts, fingerprint
    balls: dict[int, np.ndarray] = field(default_factory=dict)  # words: block, byte, item


def simhash(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of the runs of ``hashes`` at ``starts``, one row of ``BLOCKS`` bytes each; equal sizes are worked on together."""
    out = np.zeros((len(starts), BLOCKS), np.uint8)
    salts = mix(np.arange(1, BLOCKS // 8 + 1, dtype=np.uint64))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, (1 << 22) // (int(size) * BLOCKS * 8))
        for a in range(0, len(at), step):
            some = at[a : a + step]
            runs = hashes[starts[some][:, None] + np.arange(size)]
            wide = mix(runs[:, :, None] ^ salts).astype("<u8").view(np.uint8).reshape(len(some), size, BLOCKS)
            bits = np.unpackbits(wide, axis=2, bitorder="little")
            out[some] = np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > size, axis=1, bitorder="little")
    return out


def text_shingles(text: str | None, k: int) -> tuple[np.ndarray, int]:
    """Shingle hashes of a text and its number of words."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    offsets = np.array([0, len(data)])
    data = LOWER_WORD[data]
    starts, ends, rows = word_bounds(data, offsets, None)
    hashes, _, _ = shingle_hashes(word_hashes(data, starts, ends), rows, 1, k)
    return hashes, len(starts)


def index(items: list[tuple[int, str | None]]) -> Index:
    out, pools = Index(), defaultdict(set)
    by_words = defaultdict(list)
    for item_id, text in items:
        hashes, n = text_shingles(text, K)
        if n:
            fp = simhash(hashes, np.zeros(1, np.int64), np.array([len(hashes)]))[0]
            by_words[n].append((item_id, dict(Counter(hashes.tolist())), fp))
            pools[min(n, K)].update(hashes.tolist())
    for k, pool in pools.items():
        out.shingles[k] = np.array(sorted(pool), np.uint64)
        out.table[k] = np.zeros(FILTER, bool)
        out.table[k][(out.shingles[k] & np.uint64(FILTER - 1)).astype(np.int64)] = True
    near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None]) <= BALL
    for n, group in by_words.items():
        fps = np.array([x[2] for x in group])
        out.items[n] = group
        out.balls[n] = np.stack([near[:, fps[:, b]] for b in range(BLOCKS)])
    return out


def likeness(window: np.ndarray, counts: dict[int, int]) -> float:
    """Weighted Jaccard likeness of a run of shingles and an item's counts."""
    mine = Counter(window.tolist())
    low = sum(min(n, counts.get(h, 0)) for h, n in mine.items())
    high = len(window) + sum(counts.values()) - low
    return low / high


def find(ix: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(row, item, likeness, first word) of the best window of each row and item that match."""
    n_rows = len(offsets) - 1
    data = LOWER_WORD[data]
    starts, ends, rows = word_bounds(data, offsets, None)
    words = word_hashes(data, starts, ends)
    n_words = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    first_word = np.cumsum(n_words) - n_words
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for k, pool in ix.shingles.items():
        hashes, of, at = shingle_hashes(words, rows, n_rows, k)
        if not len(hashes):
            continue
        maybe = np.flatnonzero(ix.table[k][(hashes & np.uint64(FILTER - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(pool, hashes[maybe]), len(pool) - 1)
        hits = maybe[pool[spot] == hashes[maybe]]
        if not len(hits):
            continue
        known = np.zeros(len(hashes) + 1, np.int64)
        known[hits + 1] = 1
        known = np.cumsum(known)
        per_row = np.bincount(of, minlength=n_rows)
        row_first = np.cumsum(per_row) - per_row
        for n, group in ix.items.items():
            if min(n, K) != k:
                continue
            size = max(1, n - K + 1)
            # a window's first shingle lies at most size - 1 before one of its hits
            begin = np.unique(np.concatenate([hits - j for j in range(size)])) if size < 64 else np.unique(np.concatenate([hits, *[hits - j for j in range(1, size)]]))
            begin = begin[begin >= 0]
            row = of[begin]
            whole = per_row[row] < size
            begin = np.where(whole, row_first[row], begin)
            length = np.where(whole, per_row[row], size)
            fits = begin + length <= row_first[row] + per_row[row]
            # the shared weight that the threshold needs at least
            need = THRESHOLD * (length + size) / (1 + THRESHOLD) - 1e-9
            end = np.minimum(begin + length, len(hashes))
            fits &= known[end] - known[begin] >= need
            if k < K:
                fits &= n_words[row] >= n
            if not fits.any():
                continue
            pair = np.unique(np.stack([begin[fits], length[fits]]), axis=1)
            begin, length = pair[0], pair[1]
            fp = simhash(hashes, begin, length)
            near = []
            for w in range(0, len(fp), 64):
                votes = np.zeros((len(fp[w : w + 64]), len(group)), np.uint8)
                for block in range(BLOCKS):
                    votes += ix.balls[n][block][fp[w : w + 64, block]]
                near += [(w + x, i) for x, i in np.argwhere(votes >= AGREE).tolist()]
            for w, i in near:
                item_id, counts, item_fp = group[i]
                if np.bitwise_count(fp[w] ^ item_fp).sum() > RADIUS:
                    continue
                like = likeness(hashes[begin[w] : begin[w] + length[w]], counts)
                if like >= THRESHOLD:
                    r = int(of[begin[w]])
                    found = (like, -int(at[begin[w]] - first_word[r]))
                    if best.get((r, item_id), (0.0, 0)) < found:
                        best[r, item_id] = found
    return [(r, item, like, -start) for (r, item), (like, start) in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def blocks_of(benchmark: DataFrame) -> Iterator[Index]:
    """The items in blocks of about ``ITEMS`` rows; a block is what the driver and a task hold at once."""
    slim = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n = slim.count()
    parts = -(-n // ITEMS) if n > ITEMS else 1
    for b in range(parts):
        rows = slim if parts == 1 else slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == b)
        yield index([(r[0], r[1]) for r in rows.collect()])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and first_word of the best window of each matching pair."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    schema = slim.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType).add("similarity", "double").add("first_word", "long")

    def finder(ix: Index):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in chunks(batch):
                    if found := find(ix, data, offsets):
                        row, item, like, start = zip(*found)
                        ids = part.column(0).take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(item), pa.array(like), pa.array(start, pa.int64())], names=schema.names)

        return each

    return reduce(DataFrame.union, [slim.mapInArrow(finder(ix), schema) for ix in blocks_of(benchmark)])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, unchanged; no shuffle."""
    ship(docs.sparkSession)
    cols = docs.columns
    for ix in blocks_of(benchmark):
        slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
        text = f"k{cols.index('text')}"

        def each(batches: Iterator[pa.RecordBatch], ix: Index = ix, text: str = text) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data, offsets in chunks(batch, text):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, _, _, _ in find(ix, data, offsets)]] = False
                    yield part.filter(pa.array(keep))

        docs = slim.mapInArrow(each, slim.schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(cols)])
    return docs
