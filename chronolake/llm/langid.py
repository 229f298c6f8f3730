"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text becomes the mean of the embeddings of its byte n-grams (2 to 4 bytes, letters
folded in A-Z, everything that is no letter a blank); a linear layer and a softmax give
the language. Embeddings and layer are fitted by stochastic gradient descent in numpy on
a bounded sample of labelled rows; prediction reads every whole text.

Beside the languages the softmax has a class of texts in none of them, learned from sample
texts whose letters are replaced by a random substitution each. A prediction names the best
language; its score is that language's probability among all classes, so foreign and junk
texts score low.

The sample: documents whose crc32 of the id, as text, leaves a remainder other than 1 on
division by 3, with a language, and at most ``max_chars`` long; from each language about
``per_lang`` rows, or an equal part of ``max_rows`` if those are too many, by a hash of id and text. A part of it is kept from the
descent to calibrate: the temperature that gives the smallest loss, and the score below
which a prediction is rejected: the ``reject`` quantile (0.001) of the scores of right
predictions on whole texts and short pieces, the share of them that the rejection costs (no
right prediction: 0).

A prediction depends on the row's text alone: equal texts get equal rows, whatever stands
beside them; repeated rows and ids are predicted one by one.

Null text and text without a letter: ``und``, score 0, rejected. Null id: not held out and
not in the sample. Without any labelled row every text is ``und``. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from chronolake.llm.textbytes import chunks
from chronolake.runtime import ship

UND = "und"
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
FACTOR = np.uint32(2_654_435_761)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # per n-gram bucket the logits of its embedding
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of folded bytes, and their first bytes; runs of blanks give none."""
    b = FOLD[data].astype(np.uint32)
    live = b != 32
    ids, at = [], []
    for n in ORDERS:
        if len(b) < n:
            continue
        code = b[: len(b) - n + 1].copy()
        some = live[: len(b) - n + 1].copy()
        for j in range(1, n):
            code = (code << np.uint32(8)) | b[j : len(b) - n + 1 + j]
            if j < 2:
                some |= live[j : len(b) - n + 1 + j]
        where = np.flatnonzero(some)
        ids.append((((code[where] + np.uint32(n)) * FACTOR) >> np.uint32(16)).astype(np.int64))
        at.append(where)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(at)


def padded(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a blank before and three after each, so that no n-gram holds letters of two; and where each begins with its blank."""
    blanks = np.full(len(rows), 4)
    blanks[0], blanks[-1] = 1, 3
    return np.insert(data, np.repeat(rows, blanks), 32), rows[:-1] + 4 * np.arange(len(rows) - 1)


def bag(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    ids, _ = grams(padded(data, np.array([0, len(data)]))[0])
    found, n = np.unique(ids, return_counts=True)
    return found, (n / max(1, len(ids))).astype(np.float32)


def disguised(data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A text of no language: letters a-z and bytes outside ASCII replaced by a random substitution."""
    table = np.arange(256, dtype=np.uint8)
    table[97:123] = rng.permutation(table[97:123])
    table[128:192] = rng.permutation(table[128:192])
    return table[FOLD[data]]


def fit(texts: list[str], labels: list[str], dim: int = 16, epochs: int = 5, rate: float = 8.0, reject: float = 0.001, seed: int = 5) -> Model:
    """Fits embeddings, layer, temperature and threshold. Texts without n-grams are left out."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    index = {x: i for i, x in enumerate(langs)}
    classes = len(langs) + 1
    rng = np.random.default_rng(seed)
    rows = []
    for text, label in zip(texts, labels):
        data = np.frombuffer(text.encode(), np.uint8)
        whole = bag(data)
        if not len(whole[0]):
            continue
        # a short piece as well, so that short texts are met in training
        start = int(rng.integers(0, max(1, len(data) - 80)))
        piece = data[start : start + int(rng.integers(20, 80))]
        rows.append((index[label], whole, bag(piece)))
        if rng.random() < 1 / len(langs):
            rows.append((len(langs), bag(disguised(data, rng)), bag(disguised(piece, rng))))
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0)
    order = rng.permutation(len(rows))
    held = max(1, len(rows) // 5) if len(rows) > 4 else 0
    check, train = [rows[i] for i in order[:held]], [rows[i] for i in order[held:]]
    share = np.bincount([r[0] for r in train], minlength=classes).astype(np.float32)
    weight = np.minimum(4.0, share.sum() / np.maximum(share, 1) / classes).astype(np.float32)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.3, (dim, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    steps, done = epochs * len(train) * 2, 0
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            y, whole, piece = train[i]
            for ids, f in (whole, piece):
                done += 1
                if not len(ids):
                    continue
                step = np.float32(rate * (1 - done / (steps + 1)))
                mean = f @ emb[ids]
                z = mean @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                p *= weight[y]
                back = layer @ p
                layer -= step * 0.1 * np.outer(mean, p)
                bias -= step * 0.01 * p
                emb[ids] -= step * f[:, None] * back[None]
    table = (emb @ layer).astype(np.float32)
    logits, truth = [], []
    for y, whole, piece in check or train:
        for ids, f in (whole, piece):
            if len(ids):
                logits.append(f @ table[ids] + bias)
                truth.append(y)
    z, y = np.array(logits), np.array(truth)
    loss = {}
    for t in np.geomspace(0.05, 20, 61):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        loss[float(t)] = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))
    temperature = min(loss, key=lambda t: (round(loss[t], 9), t))
    best, pick = scores(z, temperature)
    right = best[pick == y]
    return Model(langs, table, bias, temperature, float(np.quantile(right, reject)) if len(right) else 0.0)


def scores(z: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the best language, and which it is; the last class is no language."""
    s = z / temperature
    s = np.exp(s - s.max(axis=1, keepdims=True))
    s /= s.sum(axis=1, keepdims=True)
    return s[:, :-1].max(axis=1), s[:, :-1].argmax(axis=1)


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: whether crc32 of the id, as text, leaves 1 on division by 3."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))


def quota(counts: list[int], per_lang: int, max_rows: int) -> int:
    """Rows of each language in the sample: what small ones leave over goes to the others; at most ``per_lang``."""
    left, most = max_rows, per_lang
    for i, n in enumerate(sorted(counts)):
        most = left // (len(counts) - i)
        if n > most:
            break
        left -= n
        most = per_lang
    return max(1, min(most, per_lang))


def train(docs: DataFrame, per_lang: int = 500, max_rows: int = 4000, max_chars: int = 20_000, max_langs: int = 500) -> Model:
    """Fits the model on a bounded sample of the rows that may be learned from."""
    rows = held_out(docs.select("doc_id", "text", "lang")).where("NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.where(F.length("text") <= max_chars)
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    most = quota([n for _, n in counts], int(1.2 * per_lang), max_rows)
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_007))
    share = F.lit(0.0)
    for lang, n in counts:
        # six deviations more than needed, so that a large language fills its places
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, (most + 6 * most**0.5 + 6) / n))).otherwise(share)
    chosen = rows.withColumn("mark", mark).where(F.col("mark") < share * 1_000_000_007)
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id"))).where(F.col("place") <= most)
    sample = chosen.orderBy("place", "lang").limit(max_rows).select("text", "lang").collect()
    return fit([r[0] for r in sample], [r[1] for r in sample])


def predict_chunk(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and language index of each row of a chunk; index -1: no letter or nothing learned."""
    n = len(offsets) - 1
    best, pick = np.zeros(n), np.full(n, -1)
    if not model.langs or not n:
        return best, pick
    total = np.zeros((n, len(model.bias)))
    seen = np.zeros(n)
    for a in range(0, n, 256):
        b = min(n, a + 256)
        spaced, first = padded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ids, at = grams(spaced)
        row = np.searchsorted(first, at, "right") - 1
        for j in range(len(model.bias)):
            total[a:b, j] += np.bincount(row, weights=model.table[:, j][ids], minlength=b - a)
        seen[a:b] += np.bincount(row, minlength=b - a)
    letter = np.zeros(n, bool)
    ascii_letter = np.concatenate([[0], np.cumsum((FOLD[data] != 32) & (data < 128))])
    letter |= ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~letter & (offsets[1:] > offsets[:-1])):
        letter[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    use = np.flatnonzero(letter)
    if len(use):
        z = total[use] / np.maximum(1, seen[use])[:, None] + model.bias
        best[use], pick[use] = scores(z, model.temperature)
    return best, pick


def predict(docs: DataFrame, model: Model, keep: list[str], kept_only: bool = False) -> DataFrame:
    """``keep`` columns with lang_pred, score and rejected for every row of ``docs``; or ``keep`` alone of the rows that are not rejected."""
    ship(docs.sparkSession)
    own = ["lang_pred", "score", "rejected"]
    slim = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))
    schema = slim.drop("text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UND], dtype=object)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                best, pick = predict_chunk(model, data, offsets)
                no = (pick < 0) | (best < model.threshold)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names[pick], pa.string()), pa.array(best), pa.array(no)], names=schema.names)

    out = slim.mapInArrow(each, schema)
    if kept_only:
        return out.where("NOT rejected").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *own)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document, learned from the rest."""
    model = train(docs)
    return predict(held_out(docs.select("doc_id", "text")), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language the model does not reject, unchanged; columns may have any names, repeated rows stay."""
    return predict(docs, train(docs), docs.columns, kept_only=True)
