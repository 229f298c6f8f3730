"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them.

Candidates are spans that wide regexes find: mail-like, number-like and name-like text.
Six labelers vote on each (for, against, or not at all): the kind's strict regex, a checksum
or range test, a gazetteer, cue words before the span, cue words against it, and its shape.
How reliable each labeler is for each kind is estimated by expectation-maximisation over
the counts of all vote patterns of the corpus; the posteriors are the soft labels on which a
logistic classifier over votes, kind and shape is trained. Its probability decides which
candidates become spans.

The base kinds are regex matches, leftmost and without overlap inside a kind; failing
matches are dropped and not retried. They are spans always; the method adds others.

Positions are code points, ends exclusive. Texts are read in linear time, however long. Null and empty texts have no spans; repeated
rows are scanned alike. Patterns are counted over all documents; their number is bounded by
the labelers and kinds. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chronolake.runtime import drop_materialized, materialize, ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "phone_local", "email_masked", "ssn", "iban", "mac", "person")

# a whole run of local characters or digits is read once, with its rest if there is one: a start inside
# the run needs the same rest, so these find the leftmost matches in linear time
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

WIDE = {
    "phone_local": re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
}
AT = re.compile(r"[\[(]\s{0,3}at\s{0,3}[\])]", re.I)
MASKED = re.compile(r"[A-Za-z0-9._%+-]{2,40}\s{0,3}[\[(]\s{0,3}at\s{0,3}[\])]\s{0,3}[A-Za-z0-9-]{2,40}(?:\s{0,3}[\[(]\s{0,3}dot\s{0,3}[\])]\s{0,3}|\.)[A-Za-z]{2,10}", re.I)
#: Given names of the gazetteer.
NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Hans Peter Klaus Sabine Monika Petra Jean Pierre "
    "Marie Sophie Camille Luc Carlos Maria Jose Ana Luis Carmen Juan Lucia Pedro Elena"
).split()
PERSON = re.compile(r"\b(?:" + "|".join(NAMES) + r")\x20[A-Z][a-z]{2,20}\b")
TITLE = re.compile(r"(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20*$")
CUES = {
    "email": r"mail|contact|write|address|courriel|correo|kontakt",
    "email_masked": r"mail|contact|write|address|courriel|correo|kontakt",
    "ip": r"\bip\b|address|host|server|from|adresse|direcci",
    "card": r"card|visa|master|credit|account|amex|karte|carte|tarjeta|pay",
    "phone": r"phone|call|tel\b|tel\.|mobile|fax|telefon|tél|teléfono|whatsapp",
    "phone_local": r"phone|call|tel\b|tel\.|mobile|fax|telefon|tél|teléfono|whatsapp",
    "ssn": r"ssn|social|security|insurance|sozial",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "mac": r"mac|device|hardware|address|interface",
    "person": r"name|dear|by|from|contact|author|signed|regards",
}
AGAINST = re.compile(r"version|isbn|issn|page|order|invoice|figure|chapter|release|build|part\s+no|serial|http|section|\bv$", re.I)
CUE = {k: re.compile(v, re.I) for k, v in CUES.items()}
TLDS = frozenset("com org net edu gov de fr es uk io eu info it nl ch at".split())
NEAR = 40  # code points before a span in which cues are looked for


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def good_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in text.split("."))


def good_card(text: str) -> bool:
    d = only_digits(text)
    return 13 <= len(d) <= 19 and luhn(d)


def good_phone(text: str) -> bool:
    return 9 <= len(only_digits(text)) <= 15


def good_iban(text: str) -> bool:
    s = text.replace(" ", "")
    s = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The matches of the base kinds."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = [m.span() for m in EMAIL.finditer(text) if m[1]]
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if m[1] and good_ip(m[0])]
        out["card"] = [m.span() for m in CARD.finditer(text) if good_card(m[0])]
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if good_phone(m[0])]
    return out


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of every candidate; the pattern is the votes and shape on which all further steps work."""
    found = [(k, a, b) for k in BASE for a, b in base[k]]
    if DIGIT.search(text):
        for kind, rx in WIDE.items():
            found += [(kind, *m.span()) for m in rx.finditer(text)]
        # numbers of a card's or an address's form that fail the strict test
        found += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(only_digits(m[0])) <= 19 and not good_card(m[0])]
        found += [("ip", *m.span()) for m in IP.finditer(text) if m[1] and not good_ip(m[0])]
    if AT.search(text):
        found += [("email_masked", *m.span()) for m in MASKED.finditer(text)]
    found += [("person", *m.span()) for m in PERSON.finditer(text)]
    sure = {(k, *s) for k in BASE for s in base[k]}
    starts = sorted((a, b) for _, a, b in sure)
    reach = list(accumulate((b for _, b in starts), max))

    def inside(a: int, b: int) -> bool:
        i = bisect_right(starts, (a, len(text)))
        return i > 0 and reach[i - 1] >= b

    # what lies inside a base span is that span
    return [(k, a, b, pattern(text, k, a, b, (k, a, b) in sure)) for k, a, b in found if (k, a, b) in sure or not inside(a, b)]


def pattern(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """The six votes (+, -, 0) and the shape (length and digit classes) of a candidate."""
    span, before = text[start:end], text[max(0, start - NEAR) : start]
    digits = only_digits(span)
    mark = lambda yes, no=False: "+" if yes else "-" if no else "0"
    if kind == "card":
        test = mark(luhn(digits), True)
    elif kind == "ip":
        test = mark(good_ip(span), True)
    elif kind == "iban":
        test = mark(good_iban(span), True)
    elif kind == "ssn":
        test = mark(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000", True)
    elif kind == "phone_local":
        test = mark(digits[0] not in "01" and digits[3] not in "01", True)
    else:
        test = "0"
    if kind in ("email", "email_masked"):
        names = mark(re.split(r"[^a-z]+", span.lower().rstrip(")] "))[-1] in TLDS)
    elif kind == "person":
        names = "+"
    elif kind == "card":
        names = mark(digits[:1] in ("3", "4", "5", "6"), digits[:1] in ("0", "7", "8", "9"))
    elif kind == "phone":
        names = mark(digits[:1] != "0", True)
    else:
        names = "0"
    cue = mark(CUE[kind].search(before) or kind == "person" and TITLE.search(before))
    against = "-" if AGAINST.search(before) else "0"
    if kind == "ip":
        shape = mark(not (span.startswith("0") or digits in ("0000", "1000")), True)
    elif kind in ("card", "phone", "phone_local"):
        shape = mark(len(set(digits)) > 3, True)
    elif kind == "person":
        shape = "0" if len(span.split()) == 2 else "-"
    else:
        shape = mark(len(span) >= 8)
    return f"{kind}|{mark(strict)}{test}{names}{cue}{against}{shape}|{min(len(span) // 8, 4)}{min(len(digits) // 4, 4)}"


def estimate(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Posterior of each pattern being personal data, and each kind's labeler reliabilities (2 classes x 6 labelers x 3 votes)."""
    posterior: dict[str, float] = {}
    table: dict[str, np.ndarray] = {}
    for kind in KINDS:
        keys = sorted(k for k in counts if k.startswith(kind + "|"))
        if not keys:
            continue
        votes = np.array([["-0+".index(c) for c in k.split("|")[1]] for k in keys])
        n = np.array([counts[k] for k in keys], float)
        balance = (votes == 2).sum(axis=1) - 1.5 * (votes == 0).sum(axis=1)
        q = np.clip(0.5 + 0.2 * balance, 0.05, 0.95)
        for _ in range(rounds):
            prior = (q @ n + 2) / (n.sum() + 4)
            rel = np.empty((2, votes.shape[1], 3))
            for c, w in ((0, (1 - q) * n), (1, q * n)):
                for v in range(3):
                    # pseudo-counts: a labeler is more often right than wrong
                    pull = {(1, 2): 4.0, (0, 0): 4.0}.get((c, v), 1.0)
                    rel[c, :, v] = ((votes == v) * w[:, None]).sum(axis=0) + pull
            rel /= rel.sum(axis=2, keepdims=True)
            cols = np.arange(votes.shape[1])
            logit = np.log(prior / (1 - prior)) + (np.log(rel[1][cols, votes]) - np.log(rel[0][cols, votes])).sum(axis=1)
            q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        posterior |= dict(zip(keys, q.tolist()))
        table[kind] = rel
    return posterior, table


def features(key: str) -> np.ndarray:
    kind, votes, shape = key.split("|")
    out = [1.0, *[float(kind == k) for k in KINDS]]
    for c in votes:
        out += [float(c == "+"), float(c == "-")]
    for c in shape:
        out += [float(int(c) == i) for i in range(5)]
    return np.array(out)


def classify(counts: dict[str, int], soft: dict[str, float], steps: int = 400, rate: float = 0.5) -> dict[str, float]:
    """Probability of each pattern by a logistic classifier fitted to the soft labels of all candidates."""
    keys = sorted(counts)
    if not keys:
        return {}
    x = np.stack([features(k) for k in keys])
    y = np.array([soft[k] for k in keys])
    w = np.array([counts[k] for k in keys], float)
    w /= w.sum()
    weight = np.sqrt(w)
    weight /= weight.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta -= rate * (x.T @ (weight * (p - y)) * 4 + 1e-4 * beta)
    return dict(zip(keys, (1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))).tolist()))


def written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (order[s[0]], s[1], s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base spans as text, candidates that are no base spans, all patterns."""
    slim = docs.select("doc_id", "text")
    schema = slim.select("doc_id").schema
    schema = schema.add("counts", T.ArrayType(T.LongType())).add("base", "string").add("more", T.ArrayType(T.StringType())).add("patterns", T.ArrayType(T.StringType()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, more, patterns = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = base_spans(text)
                cands = candidates(text, found)
                counts.append([len(found[k]) for k in BASE])
                base.append(written([(k, a, b) for k in BASE for a, b in found[k]]))
                more.append([f"{p};{a};{b}" for k, a, b, p in cands if k not in BASE or (a, b) not in found[k]])
                patterns.append([p for _, _, _, p in cands])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64())), pa.array(base, pa.string()), pa.array(more, pa.list_(pa.string())), pa.array(patterns, pa.list_(pa.string()))], names=schema.names)

    return slim.mapInArrow(each, schema)


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts and digest of the base kinds, all spans, and how many the method added, for each row of ``docs``."""
    ship(docs.sparkSession)
    scanned = materialize(scan(docs), "pii")
    rows = scanned.select(F.explode("patterns").alias("p")).groupBy("p").count().collect()  # bounded by kinds, votes and shapes
    counts = {r[0]: r[1] for r in rows}
    soft, _ = estimate(counts)
    chance = classify(counts, soft)
    schema = scanned.select("doc_id").schema
    for k in BASE:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array(batch.column(1).to_pylist(), np.int64).reshape(-1, len(BASE))
            sha, spans, added = [], [], []
            for base, more in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sha.append(hashlib.sha256(base.encode()).hexdigest())
                extra = [x.split(";") for x in more]
                extra = [(p.split("|")[0], int(a), int(b)) for p, a, b in extra if chance[p] >= least]
                mine = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                spans.append(written(mine + extra))
                added.append(len(set(extra)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(numbers[:, i]) for i in range(len(BASE))], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=schema.names)

    return scanned.select("doc_id", "counts", "base", "more").mapInArrow(each, schema)
