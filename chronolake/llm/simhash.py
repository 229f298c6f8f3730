"""Near-duplicate groups by SimHash, with multi-index hashing for the links.

Fingerprints: text lower-cased in A-Z, words between ASCII blanks, shingles of
``k`` words (repeats count; fewer words: the whole sequence), XXH64 with seed 42 of each;
a bit is 1 if it is set in over half the hashes. Null or blank text: fingerprint zero,
linked like any other. Links: at most ``radius`` differing bits. Components: transitive.

Links are found among distinct fingerprints only. The 64 bits are cut in segments; two
fingerprints within the radius agree, but for ``radius // segments`` bits, in one of
them. So each fingerprint enumerates the Hamming ball of that size around each segment,
fetches the matches and verifies whole distances. Of two fingerprints that differ in one
bit of a segment just the one without the bit enumerates it, so no link is met twice on
that account. In each segment bucket the fingerprint with most documents is the leader:
those within the radius of it are linked to it, and pairs that share a leader need no
link of their own, so that a dense group gives a star and not all its pairs.

Ties, repeated rows and repeated ids are grouped like other rows. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from chronolake.llm.textbytes import chunks
from chronolake.operators.graph import connected_components
from chronolake.operators.sieve import sieve, sifted
from chronolake.runtime import materialize, ship

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length


def fingerprint_words(words: list[bytes], k: int) -> list[int]:
    """XXH64 of each shingle of ``k`` words."""
    if not words:
        return []
    text = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(text, SEED)]
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = [0, *(blanks[: len(words) - k] + 1).tolist()]
    ends = [*blanks[k - 1 :].tolist(), len(text)]
    digest = xxhash.xxh64_intdigest
    return [digest(text[a:b], SEED) for a, b in zip(starts, ends)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of consecutive hashes the number whose bits are set in over half of them; 0 for empty groups."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    first = (np.cumsum(counts) - counts)[full]
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    on = sums * 2 > counts[full][:, None]
    out[full] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, k: int = 4, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` and ``fp``, the 64-bit fingerprint of the text as a long."""
    ship(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    schema = slim.drop("text").schema.add("fp", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch):
                raw = data.tobytes().lower()
                hashes, counts = [], np.zeros(part.num_rows, np.int64)
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    found = fingerprint_words(raw[a:b].split(), k)
                    counts[i] = len(found)
                    hashes += found
                fp = majority(np.array(hashes, np.uint64), counts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], names=[*part.schema.names[:-1], "fp"])

    done = slim.mapInArrow(each, schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def in_segment(keys: Column, seg: int) -> Column:
    return F.transform(keys, lambda v: F.struct(F.lit(seg).alias("seg"), v.alias("key")))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints ``fp`` (with ``n`` documents each).

    Their transitive closure is that of all pairs within the radius; edges inside a ball
    around a common leader are left out.
    """
    if radius // len(SEGMENTS) > 1:
        raise ValueError("the segments guarantee radii up to 5")
    cut = lambda x, i: F.shiftright(x, SEGMENTS[i][0]).bitwiseAND(F.lit((1 << SEGMENTS[i][1]) - 1))
    far = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    keyed = fps.select("fp", "n", F.posexplode(F.array(*[cut(F.col("fp"), i) for i in range(len(SEGMENTS))])).alias("seg", "key"))
    best = keyed.groupBy("seg", "key").agg(F.max_by("fp", F.struct("n", "fp")).alias("lead"))
    led = keyed.join(best, ["seg", "key"]).withColumn("lead", F.when(far("fp", "lead") <= radius, F.col("lead")))
    table = materialize(led.groupBy("fp").agg(*[F.max(F.when(F.col("seg") == i, F.col("lead"))).alias(f"l{i}") for i in range(len(SEGMENTS))]), "led")
    leads = [f"l{i}" for i in range(len(SEGMENTS))]
    stars = table.select("fp", F.explode(F.array(*leads)).alias("dst")).where("dst <> fp").select(F.col("fp").alias("src"), "dst")

    index = table.select(F.col("fp").alias("b"), *[F.col(x).alias(f"b{x}") for x in leads], F.posexplode(F.array(*[cut(F.col("fp"), i) for i in range(len(SEGMENTS))])).alias("seg", "key"))
    balls = []
    for i, (_, bits) in enumerate(SEGMENTS):
        ones = F.array(*[F.lit(1 << j).cast("long") for j in range(bits)])
        key = cut(F.col("fp"), i)
        ball = F.transform(F.filter(ones, lambda b: key.bitwiseAND(b) == 0), lambda b: key.bitwiseOR(b))
        # what a bucket's leader links needs no pair inside the bucket: only the others ask there
        here = F.when(F.col(f"l{i}").isNull(), F.array(key)).otherwise(F.array().cast("array<long>"))
        balls.append(in_segment(F.concat(here, ball), i))
    probe = table.select("fp", *leads, F.explode(F.concat(*balls)).alias("p")).select("fp", *leads, F.col("p.seg").alias("seg"), F.col("p.key").alias("key"))
    met = probe.join(index, ["seg", "key"]).where(far("fp", "b") <= radius)
    shares = F.lit(False)
    for x in leads:
        shares = shares | F.coalesce(F.col(x) == F.col(f"b{x}"), F.lit(False))
    # equal segments meet from both sides
    met = met.where(~shares & (F.col("fp") != F.col("b")))
    return stars.union(met.select(F.least("fp", "b").alias("src"), F.greatest("fp", "b").alias("dst"))).distinct()


def groups(prints: DataFrame, ids: str = "doc_id", radius: int = 4) -> DataFrame:
    """(fp, group, component_id): the group of each distinct fingerprint and its smallest id (null: no id known)."""
    fps = materialize(prints.groupBy("fp").agg(F.min(ids).alias("rep"), F.count(F.lit(1)).alias("n")), "fps")
    found = connected_components(links(fps, radius))
    least = found.join(fps, found["node"] == fps["fp"]).groupBy("component").agg(F.min("rep").alias("least"))
    of = found.join(least, "component").select(F.col("node").alias("fp"), F.col("component").alias("group"), "least")
    joined = fps.join(of, "fp", "left")
    return joined.select("fp", F.coalesce("group", "fp").alias("group"), F.when(F.col("group").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = materialize(fingerprints(docs, k), "prints")
    # written first, so that a fingerprint of very many documents can be split in the join
    labelled = prints.join(materialize(groups(prints, "doc_id", radius), "groups"), "fp")
    return labelled.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, nulls last.

    Of several rows with that id the smallest text hash decides; of rows equal in both one
    stays. The choice is made on ids and hashes; only texts that may have to go are shuffled.
    """
    inner = apart(docs)
    prints = materialize(fingerprints(inner.withColumn("__h", F.xxhash64("text")), k, keep=["doc_id", "__h"]), "prints")
    return one_of_each(inner, prints.join(materialize(groups(prints, "doc_id", radius).select("fp", "group"), "groups"), "fp")).toDF(*docs.columns)


def apart(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``docs`` with other names for all columns but ``needed``, so that none clashes with an operator's own."""
    return docs.select(*[F.col(c).alias(c if c in needed else f"__k{i}") for i, c in enumerate(docs.columns)])


def one_of_each(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """``docs`` with the row of each group that ``keep_one`` names; ``whole`` has doc_id, __h (hash of the text) and group of every row.

    Only texts that may have to go, or that may be a repeated row, are shuffled.
    """
    cols = docs.columns
    chosen = whole.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h")).alias("c"))
    chosen = materialize(chosen.select(F.col("c.doc_id").alias("__id"), F.col("c.__h").alias("__c")), "chosen")
    rows = whole.groupBy("doc_id", "__h").count()
    named = lambda x: x["doc_id"].eqNullSafe(chosen["__id"]) & (x["__h"] == chosen["__c"])
    key = F.xxhash64("doc_id", "__h")
    marks = rows.join(chosen, named(rows), "left_anti").select("doc_id", "__h").union(rows.where("count > 1").select("doc_id", "__h"))
    hashed = sifted(docs.withColumn("__h", F.xxhash64("text")), sieve(marks, key), key)
    some = hashed.where("may")
    some = some.join(chosen, named(some), "left_semi")
    if rows.where("count > 1").limit(1).count():
        some = some.dropDuplicates(["doc_id", "__h"])
    return hashed.where("NOT may").select(*cols).union(some.select(*cols))
