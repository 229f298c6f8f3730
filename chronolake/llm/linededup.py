"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z folded). A line goes if an earlier line, in the order of
document id (null first), text hash and line number, has a Jaccard likeness of at least
``threshold``. Lines with equal sets are copies; among distinct sets the pairs come from a
join with

* an order of words by rarity: counts of ``SLOTS`` hashed slots over all lines of the
  corpus, in eighths of a power of two, ties by hash; any fixed order keeps the join exact,
  a rare-first one keeps it small;
* the prefix filter: two sets that reach the threshold share a word among their first
  ``n - ceil(threshold * n) + 1`` words in that order;
* keys of two words where the word is common (over ``COMMON`` lines): two such sets share two
  words among their first ``n - ceil(threshold * n) + 2``, so a common word counts only with
  one of the words after it. Sets of over ``LONG`` words keep the word alone, and those that
  may match either kind have both keys;
* length and positional filters on each meeting of two prefixes, and one on parity signatures;
* verification of the whole sets.

Postings travel as packed blocks, one a bucket of keys and flush, so that the shuffle moves
few rows; the number of buckets follows the number of words. Inside a key the earliest set
that no other one is likely to explain leads: the sets that pass the filters with it are
tried against it alone. A set that no leader explains meets the earlier sets of the key
until one passes the filters, and is tried against that one. So a group of near copies costs
a trial a set and key and not all its pairs. A key in which a set may have met only some of
the earlier ones hands its postings on, one row each. Sets whose trials all fail meet all
sets of those keys in a second round, a join of these rows by key and band of sizes, so no
match is lost and no text is read for it. A task reads its bucket in blocks and keeps at most
``HEAVY`` postings of a key; of a key with more it keeps a leader and hands on the rest.

Words are 42-bit hashes and sets 64-bit hashes. Lines without words stay. Null texts have no
lines and stay null. Of rows equal in id and text one is the earlier: the others lose every
line with words. Empty table: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W
from pyspark.sql.types import NumericType, StructType

from chronolake.llm.textbytes import BASE, LOWER_WORD, chunks, mix, word_bounds, word_hashes
from chronolake.operators.sieve import sieve, sifted
from chronolake.runtime import drop_materialized, materialize, ship

SLOTS = 1 << 22
BLOCK = 1 << 16  # slots a row of counts
CODE = 42  # bits of a word
LINES = 1 << (64 - CODE)  # lines that fit beside a word in 64 bits
RANKED = 1 << (56 - CODE)  # lines that fit beside a word and its rarity
HEAVY = 1 << 14
LEADS = 4  # leaders of a key
PIVOTS = 16  # groups of a key that are told apart when it is handed on
COMMON = 2048
LONG = 256
FLUSH = 1 << 19  # postings that a task gathers before it packs them
BUCKET = 1 << 19  # postings a bucket, about
BITS = 1 << 26  # of the filter for the lines that verification needs
SHORT = 64  # bytes of a word that is hashed eight bytes at a time
NARROW = 64  # words of a set that 64 bits tell from others; larger sets have 256
POSTING = (("w", "<u4"), ("n", "<u4"), ("at", "<u4"), ("d", "<f4"), ("id", "<i8"), ("sig", "<u8"))
WIDE = (("x0", "<u8"), ("x1", "<u8"), ("x2", "<u8"))  # of sets of over NARROW words
COLUMNS = POSTING + WIDE
FOLD = LOWER_WORD.tobytes()
WORDY = "[0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]"


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time up to ``SHORT``, else by running sums. No byte of a word is 0."""
    size = ends - starts
    at = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # eight bytes from each place
    left = (8 * np.minimum(size, 8)).astype(np.uint64)
    out = (at[starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left))) * BASE
    for done in range(8, SHORT, 8):
        more = np.flatnonzero((size > done) & (size <= SHORT))
        if not len(more):
            break
        left = (8 * np.minimum(size[more] - done, 8)).astype(np.uint64)
        out[more] = (mix(out[more]) ^ (at[starts[more] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left)))) * BASE
    out = mix(out)
    large = np.flatnonzero(size > SHORT)
    if len(large):
        out[large] = word_hashes(data, starts[large], ends[large])
    return out


def line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of every line of a chunk: codes and their lines (both ascending); row and number of each line."""
    breaks = np.flatnonzero(data == 10)
    lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + 1
    first = np.cumsum(lines) - lines
    rows = np.repeat(np.arange(len(lines)), lines)
    number = np.arange(len(rows)) - first[rows]
    folded = np.frombuffer(data.tobytes().translate(FOLD), np.uint8)
    starts, ends, word_row = word_bounds(folded, offsets, None)
    line = np.cumsum(np.bincount(np.searchsorted(starts, breaks), minlength=len(starts))[: len(starts)]) + word_row
    code = codes(folded, starts, ends) >> np.uint64(64 - CODE)
    if len(rows) <= LINES:
        key = (line.astype(np.uint64) << np.uint64(CODE)) | code
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        return key & np.uint64((1 << CODE) - 1), (key >> np.uint64(CODE)).astype(np.int64), rows, number
    order = np.lexsort((code, line))
    code, line = code[order], line[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (line[1:] != line[:-1])
    return code[new], line[new].astype(np.int64), rows, number


def set_ids(words: np.ndarray, line: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """An id of each line's set (equal sets, equal ids) and its size."""
    size = np.bincount(line, minlength=n_lines)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + np.uint64(0x51ED)))])
    end = np.cumsum(size)
    return mix((total[end] - total[end - size]) ^ mix(size.astype(np.uint64))).view(np.int64), size


def slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SLOTS - 1)).astype(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def scanned(docs: DataFrame) -> DataFrame:
    """One pass over the texts: (doc_id, th, line, id, head) of every line with words, and rows (block, counts) of word counts a task. ``head``: the text's first such line."""
    slim = keyed(docs)
    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType).add("th", "long").add("line", "integer").add("id", "long").add("head", "boolean").add("block", "integer").add("counts", "binary")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, of = np.zeros(SLOTS, np.int64), None
        for batch in batches:
            of = batch.schema.field(0).type
            for part, data, offsets in chunks(batch):
                words, line, rows, number = line_sets(data, offsets)
                if not len(words):
                    continue
                np.add.at(total, slot(words), 1)  # no array of SLOTS a chunk
                ids, size = set_ids(words, line, len(rows))
                some = np.flatnonzero(size)
                at, none = pa.array(rows[some]), len(some)
                head = np.zeros(none, bool)
                head[starts_of(rows[some])] = True
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(number[some].astype(np.int32)), pa.array(ids[some]), pa.array(head), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names=schema.names)
        if total.any():
            parts = [(b // BLOCK, zlib.compress(total[b : b + BLOCK].astype("<i8").tobytes(), 1)) for b in range(0, SLOTS, BLOCK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, of), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=schema.names)

    return slim.mapInArrow(each, schema)


def rarity(counts: DataFrame) -> tuple[np.ndarray, int]:
    """A byte for each slot, ascending with its count over the corpus (up to 8: one line or none), and the sum of all counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[b] = sums.get(b, 0) + np.frombuffer(zlib.decompress(c), "<i8")
        if sums:
            ranks = [ranked(x).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], names=["block", "ranks", "n"])

    out, total = np.zeros(SLOTS, np.uint8), 0
    # one partition has all rows of a block, so its counts are whole; SLOTS bytes come back, whatever the input
    for block, part, n in counts.select("block", "counts").repartition(SLOTS // BLOCK, "block").mapInArrow(add, "block int, ranks binary, n long").collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(part, np.uint8)
        total += n
    return out, total


def ranked(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(counts + 1.0)).astype(np.uint8)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def signatures(words: np.ndarray, line: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Parities of the words' bits of each line: two signatures differ in no more bits than the sets differ in words.

    The first is of all words. Three more, of sets of over ``NARROW`` words, are of the words of
    three of four classes; the fourth class is what they leave of the first.
    """
    out = [np.zeros(len(size), np.uint64) for _ in range(1 + len(WIDE))]
    mixed = mix(words ^ np.uint64(0x5163))
    bit, kind = np.uint64(1) << (mixed & np.uint64(63)), (mixed >> np.uint64(6)) & np.uint64(3)
    if len(words):
        first = starts_of(line)
        out[0][line[first]] = np.bitwise_xor.reduceat(bit, first)
    large = size[line] > NARROW
    if large.any():
        bit, kind, line = bit[large], kind[large], line[large]
        first = starts_of(line)
        for i in range(len(WIDE)):
            out[1 + i][line[first]] = np.bitwise_xor.reduceat(np.where(kind == i, bit, np.uint64(0)), first)
    return out


def rare_first(words: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words ordered by line, rarity and code; words and lines."""
    out = []
    for base in range(0, int(line[-1]) + 1 if len(line) else 0, RANKED):
        a, b = np.searchsorted(line, [base, base + RANKED])
        w = words[a:b]
        key = (line[a:b] - base).astype(np.uint64) << np.uint64(CODE + 8)
        key |= (rank[slot(w)].astype(np.uint64) << np.uint64(CODE)) | w
        key.sort()
        out.append((key & np.uint64((1 << CODE) - 1), (key >> np.uint64(CODE + 8)).astype(np.int64) + base))
    if not out:
        return words, line
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def packed(found: dict[str, np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    """The postings of each bucket as one block: a column after the other, ordered by word."""
    bucket = found["w"] % np.uint32(buckets)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | found["w"])
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    cols = [found[name].astype(kind)[order] for name, kind in COLUMNS]
    large = cols[1] > NARROW
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        head = np.array([b - a], "<i8").tobytes()
        rest = [c[a:b][large[a:b]].tobytes() for c in cols[len(POSTING) :]]
        yield int(bucket[order[a]]), b"".join([head, *[c[a:b].tobytes() for c in cols[: len(POSTING)]], *rest])


def unpacked(block: bytes) -> list[np.ndarray]:
    n, out, at = int(np.frombuffer(block, "<i8", 1)[0]), [], 8
    for _, kind in POSTING:
        out.append(np.frombuffer(block, kind, n, at))
        at += out[-1].nbytes
    large = np.flatnonzero(out[1] > NARROW)
    for _, kind in WIDE:
        out.append(np.zeros(n, kind))
        out[-1][large] = np.frombuffer(block, kind, len(large), at)
        at += out[-1].itemsize * len(large)
    return out


def prefix_postings(docs: DataFrame, rank: np.ndarray, buckets: int, threshold: float) -> DataFrame:
    """(bucket, block): packed postings of the prefixes of all distinct sets of each chunk."""
    slim = keyed(docs)
    numeric = isinstance(docs.schema["doc_id"].dataType, NumericType)
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # SLOTS bytes, whatever the input

    def of_chunk(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> dict[str, np.ndarray]:
        words, line, rows, _ = line_sets(data, offsets)
        ids, size = set_ids(words, line, len(rows))
        order = np.zeros(part.num_rows, np.float32)
        if numeric:
            order = part.column(0).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False).astype(np.float32)
            order = np.where(np.isnan(order), np.float32(np.inf), order)
        # the earliest line of the chunk stands for its set; sets too small to have a partner but themselves are out
        by = np.arange(len(rows)) if (order[1:] >= order[:-1]).all() else np.argsort(order[rows], kind="stable")
        _, lead = np.unique(ids[by], return_index=True)
        use = np.zeros(len(rows), bool)
        use[by[lead]] = True
        use &= size >= math.ceil(1 / (1 - threshold) - 1e-9) - 1
        pick = use[line]
        words, line = words[pick], line[pick]
        whole = words, line
        words, line = rare_first(words, line, rank)
        start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        at = np.arange(len(line)) - np.repeat(start, np.diff(np.append(start, len(line))))
        few, rare = prefix_length(size[line], threshold), rank[slot(words)]
        inside, common = at < few, rare >= ranked(np.array(COMMON))
        # a slot with one line holds no shared word
        alone = np.flatnonzero(inside & (rare > 8) & (~common | (size[line] >= LONG * threshold - 1e-9)))
        keys, spots = [words[alone] & np.uint64(0xFFFFFFFF)], [alone]
        first, step = np.flatnonzero(inside & common & (size[line] <= LONG)), 0
        while len(first):
            step += 1
            first = first[(at[first] + step <= few[first]) & (at[first] + step < size[line[first]])]
            keys.append(mix(words[first] * np.uint64(0x9E3779B97F4A7C15) ^ words[first + step]) >> np.uint64(32))
            spots.append(first)
        keys, spots = np.concatenate(keys), np.concatenate(spots)
        line, at = line[spots], at[spots]
        use[:] = False
        use[line] = True
        pick = use[whole[1]]
        sigs = signatures(whole[0][pick], whole[1][pick], size)
        return {"w": keys.astype(np.uint32), "n": size[line], "at": at, "d": order[rows[line]], "id": ids[line]} | {name: sig[line] for (name, _), sig in zip(COLUMNS[5:], sigs)}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def flush() -> pa.RecordBatch:
            rows = list(packed({name: np.concatenate([x[name] for x in waiting]) for name, _ in COLUMNS}, buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for part, data, offsets in chunks(batch):
                found = of_chunk(part, data, offsets, shared.value)
                waiting.append(found)
                n += len(found["w"])
                if n >= FLUSH:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()

    return slim.mapInArrow(each, "bucket int, block binary")


def fits(x: list[np.ndarray], a: np.ndarray, y: list[np.ndarray], b: np.ndarray, threshold: float) -> np.ndarray:
    """Length, positional and signature filters of meetings of two prefixes (postings ``x`` at ``a``, ``y`` at ``b``); none drops a pair that reaches the threshold."""
    na, ia, nb, ib = (c.astype(np.int64) for c in (x[1][a], x[2][a], y[1][b], y[2][b]))
    need = np.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
    most = na + nb - 2 * need
    ok = (np.minimum(na, nb) >= np.maximum(na, nb) * threshold - 1e-9) & (1 + np.minimum(na - ia - 1, nb - ib - 1) >= need)
    ok &= np.bitwise_count(x[5][a] ^ y[5][b]) <= most
    large = np.flatnonzero(ok & (np.minimum(na, nb) > NARROW))
    if len(large):
        p, q = a[large], b[large]
        rest, apart = x[5][p] ^ y[5][q], np.zeros(len(large), np.int64)
        for i in range(len(POSTING), len(COLUMNS)):
            differ = x[i][p] ^ y[i][q]
            rest ^= differ
            apart += np.bitwise_count(differ)
        ok[large] = apart + np.bitwise_count(rest) <= most[large]
    return ok


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the numbers are in a packed filter."""
    at = (mix(keys.astype(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def spot(text: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number of each line: of its text's hash and its own number."""
    return mix(text.view(np.uint64) ^ mix(line.astype(np.uint64) + np.uint64(1)))


def filter_of(lines: DataFrame) -> np.ndarray:
    """A packed filter of fixed size of (hash of the text, number of the line); it holds all of them, and others by chance."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(BITS // 8, np.uint8)
        for batch in batches:
            text, line = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = (mix(spot(text, line)) & np.uint64(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(packed, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        for b in range(0, len(packed), 1 << 16):
            some = packed[b : b + (1 << 16)]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([b >> 16], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], names=["block", "bits"])

    found = np.zeros(BITS // 8, np.uint8)
    marks = lines.coalesce(8).mapInArrow(mark, "block int, bits binary")
    for block, piece in marks.toLocalIterator():  # eight tasks at most, a filter each
        found[block << 16 : (block + 1) << 16] |= np.frombuffer(zlib.decompress(piece), np.uint8)
    return found


MET = "early long, late long, word long, n int, at int, d float, sig long, asks boolean"
NAMES = [x.split()[0] for x in MET.split(", ")]


def pair_rows(early: np.ndarray, late: np.ndarray) -> pa.RecordBatch:
    """Rows of candidate pairs."""
    rest = [pa.nulls(len(late), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.float32(), pa.int64(), pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(early), pa.array(late), *rest], names=NAMES)


def posting_rows(cols: list[np.ndarray], asks: np.ndarray) -> pa.RecordBatch:
    """Rows of postings, and whether they ask."""
    cast = [cols[4], cols[0].astype(np.int64), cols[1].astype(np.int32), cols[2].astype(np.int32), cols[3], cols[5].view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.nulls(len(asks), pa.int64()), *map(pa.array, cast), pa.array(asks)], names=NAMES)


def starts_of(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def lead(cols: list[np.ndarray], threshold: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which postings a leader of their key is likely to explain, and the pairs (leader, posting) that say so. ``cols`` are ordered by key."""
    word, order = cols[0], cols[3]
    explained, led, pairs = np.zeros(len(word), bool), np.zeros(len(word), bool), []
    run = np.diff(np.append(starts_of(word), len(word)))
    key = np.repeat(np.arange(len(run)), run)
    open_ = np.flatnonzero((run > 2)[key])
    bits = order.view(np.uint32)
    early = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)  # ascends with ``order``
    early |= np.arange(len(order), dtype=np.uint64)
    for _ in range(LEADS):
        open_ = open_[~(explained[open_] | led[open_])]
        if not len(open_):
            break
        first = (np.minimum.reduceat(early[open_], starts_of(key[open_])) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        of_key = np.full(len(run), -1)
        of_key[key[first]] = first
        led[first] = True
        open_ = open_[~led[open_]]
        a = of_key[key[open_]]
        ok = fits(cols, a, cols, open_, threshold)
        explained[open_[ok]] = True
        pairs.append((a[ok], open_[ok]))
    return explained, pairs


def partners(cols: list[np.ndarray], tried: np.ndarray, threshold: float) -> np.ndarray:
    """The postings ``tried`` and, of their keys, all that may pass the filters with one of them and are no later; others by chance. ``cols`` are ordered by key.

    Signatures have the triangle inequality: what is near a tried set is not far from a pivot near that set.
    """
    start = starts_of(cols[0])
    of = np.flatnonzero(np.repeat(np.logical_or.reduceat(tried, start), np.diff(np.append(start, len(tried))))) if len(start) else start
    keep = np.zeros(len(tried), bool)
    left, share = tried.copy(), (1 - threshold) / (1 + threshold)
    for _ in range(PIVOTS):
        if not len(of):
            break
        start = starts_of(cols[0][of])
        run = np.diff(np.append(start, len(of)))
        spread = lambda x: np.repeat(x, run)  # noqa: B023, E731
        n, d, mine = cols[1][of].astype(np.int64), cols[3][of], left[of]
        pivot = of[spread(np.minimum.reduceat(np.where(mine, np.arange(len(of)), len(of)), start))]
        far = np.bitwise_count(cols[5][of] ^ cols[5][pivot]).astype(np.int64)
        # all that fits a set of this size is over NARROW
        wide = cols[1][pivot] * threshold > NARROW
        large = np.flatnonzero(wide & (n > NARROW))
        if len(large):
            a, b = of[large], pivot[large]
            rest, apart = cols[5][a] ^ cols[5][b], np.zeros(len(large), np.int64)
            for i in range(len(POSTING), len(COLUMNS)):
                differ = cols[i][a] ^ cols[i][b]
                rest ^= differ
                apart += np.bitwise_count(differ)
            far[large] = apart + np.bitwise_count(rest)
        near = mine & (far <= (n + cols[1][pivot]) * share) & (~wide | (n * threshold > NARROW))
        radius, most = np.maximum.reduceat(np.where(near, far, 0), start), np.maximum.reduceat(np.where(near, n, 0), start)
        least, last = np.minimum.reduceat(np.where(near, n, 1 << 40), start), np.maximum.reduceat(np.where(near, d, np.float32(-np.inf)), start)
        ok = (far <= (n + spread(most)) * share + spread(radius) + 1e-6) & (d <= spread(last))
        ok &= (n >= spread(least) * threshold - 1e-6) & (n * threshold <= spread(most) + 1e-6) & (~wide | (n > NARROW))
        keep[of[ok]] = True
        left[of[near]] = False
        of = of[spread(np.logical_or.reduceat(left[of], start))]
    keep[of] = True  # too many groups in a key: all of it
    return np.flatnonzero(keep | tried)


def meetings(blocks: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """Candidate pairs (early, late) of each key, ``early`` being the earlier set or one as early.

    Rows with a ``word`` are the postings (``late``) of keys in which some set has not met all
    earlier ones; those sets ask.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light = [np.zeros(0, kind) for _, kind in COLUMNS]
        leads = [np.zeros(0, kind) for _, kind in COLUMNS]  # one posting of each heavy key
        waiting, n = [], 0

        def fold() -> Iterator[pa.RecordBatch]:
            nonlocal light, leads
            cols = [np.concatenate([light[i], *[x[i] for x in waiting]]) for i in range(len(COLUMNS))]
            light = []
            waiting.clear()
            half = (cols[0].astype(np.uint64) << np.uint64(32)) | (cols[4].view(np.uint64) >> np.uint64(32))
            order = np.argsort(half)
            same = half[order[1:]] == half[order[:-1]]
            tie = np.flatnonzero(np.append(same, False) | np.append(False, same))
            some = order[tie]
            order[tie] = some[np.lexsort((cols[2][some], cols[3][some], cols[4][some], half[some]))]
            # of a set's equal keys the earliest and foremost stays
            w, ids = cols[0][order], cols[4][order]
            order = order[np.concatenate([[True], (w[1:] != w[:-1]) | (ids[1:] != ids[:-1])])]
            for i in range(len(COLUMNS)):  # one column at a time, for memory
                cols[i] = cols[i][order]
            start = starts_of(cols[0])
            run = np.diff(np.append(start, len(cols[0])))
            many = np.repeat((run > HEAVY) | np.isin(cols[0][start], leads[0]), run)
            if not many.any():
                light = cols
                return
            light = [c[~many] for c in cols]
            cols = [c[many] for c in cols]
            first = np.lexsort((cols[3], cols[0]))[starts_of(cols[0])]
            first = first[~np.isin(cols[0][first], leads[0])]
            leads = [np.concatenate([x, c[first]]) for x, c in zip(leads, cols)]
            by = np.argsort(leads[0], kind="stable")
            leads = [x[by] for x in leads]
            head = np.searchsorted(leads[0], cols[0])
            ok = fits(leads, head, cols, np.arange(len(head)), threshold) & (leads[4][head] != cols[4])
            yield pair_rows(leads[4][head[ok]], cols[4][ok])
            yield posting_rows(cols, np.ones(len(head), bool))

        for batch in batches:
            for block in batch.column(1):
                waiting.append(unpacked(block.as_py()))
                n += len(waiting[-1][0])
                if n >= 2 * BUCKET:
                    yield from fold()
                    n = 0
        if n:
            yield from fold()
        # a key of one set has no pair
        run = np.diff(np.append(starts_of(light[0]), len(light[0])))
        some = np.flatnonzero(np.repeat(run > 1, run))
        if not len(some):
            return
        # postings of a key by size: each meets the larger ones until they are too large
        some = some[np.argsort((light[0][some].astype(np.uint64) << np.uint64(32)) | light[1][some])]
        for i in range(len(COLUMNS)):
            light[i] = light[i][some]
        explained, pairs = lead(light, threshold)
        for a, b in pairs:
            yield pair_rows(light[4][a], light[4][b])
        asks, tried = ~explained, explained.copy()
        # keys in which some set but the earliest asks
        start = starts_of(light[0])
        run = np.diff(np.append(start, len(some)))
        least = np.minimum.reduceat(light[3], start)
        # a set as early as the earliest may have to meet it: ties ask too
        alone = np.repeat(np.add.reduceat(light[3] == np.repeat(least, run), start) == 1, run)
        later_asks = asks & ~(alone & (light[3] == np.repeat(least, run)))
        alive = np.repeat(np.logical_or.reduceat(later_asks, start), run)
        need = np.ceil(light[1] * (2 * threshold / (1 + threshold)) - 1e-9)
        near, step = np.flatnonzero(alive & (light[2] < light[1] - need + 1)), 0
        early, late = [], []
        while len(near):
            step += 1
            near = near[near + step < len(some)]
            near = near[(light[0][near] == light[0][near + step]) & (light[1][near] >= light[1][near + step] * threshold - 1e-9)]
            if step % 8 == 0 and len(near):
                near = near[np.repeat(np.logical_or.reduceat(asks, start), run)[near]]
            for part in range(0, len(near), 1 << 20):
                a = near[part : part + (1 << 20)]
                b = a + step
                a_asks = asks[a] & (light[3][a] >= light[3][b])
                ask = a_asks | (asks[b] & (light[3][b] >= light[3][a]))
                a, b, a_asks = a[ask], b[ask], a_asks[ask]
                ok = fits(light, a, light, b, threshold)
                early.append(np.where(a_asks, b, a)[ok])
                late.append(np.where(a_asks, a, b)[ok])
                asks[late[-1]] = False  # one trial a set and key; those that fail ask again
                tried[late[-1]] = True
            if sum(map(len, late)) > 1 << 20:
                yield pair_rows(light[4][np.concatenate(early)], light[4][np.concatenate(late)])
                early, late = [], []
        if late:
            yield pair_rows(light[4][np.concatenate(early)], light[4][np.concatenate(late)])
        # a set that was tried against one of several has not met all; what it may still have to meet goes on
        tried &= np.repeat(run > 2, run)
        rest = partners(light, tried, threshold)
        if len(rest):
            yield posting_rows([c[rest] for c in light], tried[rest])

    return blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(each, MET)


def needed_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, words): the whole sets whose first places are ``places``, read from those lines alone; filters of fixed size keep most others out."""
    bits = sieve(places, F.col("first.th"))
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(places.select("first.th", "first.line")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch):
                breaks = np.flatnonzero(data == 10)
                of = np.searchsorted(offsets, breaks, "right") - 1
                lines = np.bincount(of, minlength=len(offsets) - 1) + 1
                first = np.cumsum(lines) - lines
                rows = np.repeat(np.arange(len(lines)), lines)
                start, end = offsets[rows], offsets[rows + 1]
                after = np.arange(len(breaks)) + of + 1  # the line after each break
                start[after], end[after - 1] = breaks + 1, breaks
                want = np.flatnonzero(marked(wanted, spot(part.column(0).to_numpy()[rows], np.arange(len(rows)) - first[rows])) & (end > start))
                if not len(want):
                    continue
                some = np.frombuffer(b"\n".join([data[a:b] for a, b in zip(start[want].tolist(), end[want].tolist())]), np.uint8)
                words, line, rows, _ = line_sets(some, np.array([0, len(some)]))
                got, size = set_ids(words, line, len(rows))
                keep = size > 0
                ends = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(got[keep]), pa.ListArray.from_arrays(pa.array(ends), pa.array(words.view(np.int64)))], names=["id", "words"])

    texts = docs.select(F.xxhash64("text").alias("th"), "text")
    sets = sifted(texts, bits, F.col("th")).where("may").select("th", "text").mapInArrow(each, "id long, words array<long>")
    return sets.groupBy("id").agg(F.first("words").alias("words"))


def verified(docs: DataFrame, pairs: DataFrame, first: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The distinct ``pairs`` (early, late) whose whole sets reach the threshold, and the rows of ``first`` that pairs name."""
    pairs = pairs.select(F.least("early", "late").alias("early"), F.greatest("early", "late").alias("late"))
    pairs = materialize(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("early").alias("id")).union(pairs.select("late")).distinct()
    places = materialize(first.join(ids, "id").select("id", "first"), "places")
    sets = materialize(needed_sets(docs, places), "sets")
    a = sets.select(F.col("id").alias("early"), F.col("words").alias("wa"))
    b = sets.select(F.col("id").alias("late"), F.col("words").alias("wb"))
    both = pairs.join(a, "early").join(b, "late")
    common = F.size(F.array_intersect("wa", "wb"))
    out = materialize(both.where(common >= (F.size("wa") + F.size("wb") - common) * threshold - 1e-9).select("early", "late"), "near")
    drop_materialized(pairs)
    drop_materialized(sets)
    return out, places


def later(links: DataFrame, first: DataFrame) -> DataFrame:
    """(id): of each link (early, late) the set whose first place in the corpus is the later one."""
    a = first.select(F.col("id").alias("early"), F.col("first").alias("fa"))
    b = first.select(F.col("id").alias("late"), F.col("first").alias("fb"))
    both = links.join(a, "early").join(b, "late")
    return both.select(F.when(F.col("fa") < F.col("fb"), F.col("late")).otherwise(F.col("early")).alias("id")).distinct()


def passes(threshold: float) -> Column:
    """``fits`` for columns with the prefixes a_ and b_."""
    na, nb, ia, ib = (F.col(x) for x in ("a_n", "b_n", "a_at", "b_at"))
    need = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)
    apart = F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig")))
    return (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9) & (1 + F.least(na - ia - 1, nb - ib - 1) >= need) & (apart <= na + nb - 2 * need)


def near_repeats(docs: DataFrame, met: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """(id): the distinct sets that repeat an earlier set without being equal to it. ``first``: (id, first), the places of all sets that ``met`` names."""
    done = materialize(later(*verified(docs, met.where("early IS NOT NULL").select("early", "late"), first, threshold)), "done")
    posts = met.where("word IS NOT NULL").withColumnRenamed("late", "id")
    asks = materialize(posts.where("asks").join(done, "id", "left_anti"), "asks")
    if not asks.limit(1).count():
        return done
    # sizes that reach the threshold lie in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)

    def named(side: str) -> list[Column]:
        return [F.col(x).alias(f"{side}_{x}") for x in ("id", "n", "at", "d", "sig")]

    # only postings that may be of a key in question are shuffled
    a = sifted(posts, sieve(asks, F.xxhash64("word")), F.xxhash64("word")).where("may").select("word", band.alias("band"), *named("a"))
    b = asks.select("word", F.explode(F.array(band - 1, band, band + 1)).alias("band"), *named("b"))
    more = a.join(b, ["word", "band"]).where((F.col("a_id") != F.col("b_id")) & (F.col("a_d") <= F.col("b_d")) & passes(threshold))
    more = more.select(F.col("a_id").alias("early"), F.col("b_id").alias("late"))
    return materialize(done.union(later(*verified(docs, more, first, threshold))).distinct(), "repeats")


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, lines): sorted numbers of the lines that go, for each document that loses any; (doc_id, th) of the rows with words that are there more than once."""
    scan = materialize(scanned(docs), "lines")
    rank, words = rarity(scan.where("block IS NOT NULL"))
    lines = scan.where("block IS NULL").select("doc_id", "th", "line", "id")
    again = materialize(scan.where("head").groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"), "again")
    twice = materialize(lines.groupBy("id").count().where("count > 1").select("id"), "twice")
    buckets = max(1, math.ceil(words * (1 - threshold) / BUCKET))
    met = materialize(meetings(prefix_postings(docs, rank, buckets, threshold), buckets, threshold), "met")
    # sets of one line that met no other are of no concern any more
    ids = met.where("early IS NOT NULL").select(F.col("early").alias("id")).union(met.select("late")).union(twice).distinct()
    some = materialize(sifted(lines, sieve(ids, F.xxhash64("id")), F.xxhash64("id")).where("may").drop("may"), "some")
    drop_materialized(scan)
    place = F.struct("doc_id", "th", "line")
    first = materialize(some.groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")), "first")
    near = near_repeats(docs, met, first, threshold)
    drop_materialized(met)
    # all lines of a set that repeats another go, and all but the first of any other
    fate = first.where("c > 1").select("id", "first").union(near.select("id", F.lit(None).cast(first.schema["first"].dataType)))
    gone = some.join(fate, "id").where(F.col("first").isNull() | (place != F.col("first")))
    out = materialize(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("lines")), "gone")
    drop_materialized(some)
    drop_materialized(first)
    return out, again


def copies(docs: DataFrame, twice: DataFrame) -> DataFrame:
    """doc_id, th, text and ``again``: whether the row repeats another one, equal in id and text, that counts as the earlier. ``twice``: (doc_id, th) of such rows."""
    slim = keyed(docs)
    if not twice.limit(1).count():
        return slim.withColumn("again", F.lit(False))
    twice = twice.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"))
    slim = sifted(slim, sieve(twice, F.xxhash64("__d", "__t")), F.xxhash64("doc_id", "th"))
    some, rest = slim.where("may").drop("may"), slim.where("NOT may").drop("may")
    same = some["doc_id"].eqNullSafe(twice["__d"]) & (some["th"] == twice["__t"])
    ranked = some.join(twice, same, "left_semi").withColumn("again", F.row_number().over(W.partitionBy("doc_id", "th").orderBy("th")) > 1)
    return rest.union(some.join(twice, same, "left_anti")).withColumn("again", F.lit(False)).union(ranked)


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, text without repeated lines, n_lines and n_removed of every document."""
    ship(docs.sparkSession)
    gone, twice = removed_lines(docs, threshold)
    # only texts that may lose a line are shuffled to meet their lines
    of = F.xxhash64("doc_id", "th")
    slim = sifted(copies(docs, twice), sieve(gone, of), of)
    some = slim.where("may").drop("may")
    gone = gone.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "lines").hint("shuffle_hash")  # texts need no order
    met = some.join(gone, some["doc_id"].eqNullSafe(gone["__d"]) & (some["th"] == gone["__t"]), "left")
    whole = slim.where("NOT may").withColumn("lines", F.lit(None).cast("array<int>"))
    both = met.select("doc_id", "text", "again", "lines").union(whole.select("doc_id", "text", "again", "lines"))
    parts = F.split("text", "\n", -1)
    wordy = f"filter(sequence(0, size(parts) - 1), i -> parts[i] RLIKE '{WORDY}')"
    both = both.withColumn("parts", F.when(F.col("again") | F.col("lines").isNotNull(), parts))
    both = both.withColumn("lines", F.expr(f"CASE WHEN again AND text IS NOT NULL THEN {wordy} ELSE lines END"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(parts) - 1), lines), i -> parts[i]), '\\n')")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return both.select(
        "doc_id",
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
    )
