"""The training-data operators against brute force, round trips and held-out accuracy, with the awkward cases."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from chronolake.llm import decontam, fingerprint, langid, licenses, linededup, mixing, neardup, pii, queries, secrets, sharding, simhash, textbytes
from chronolake.operators import sieve

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i} of the long text." for i in range(6000))
EN = "The quick reader was in the house and then went to the other side of the river with a friend. "
DE = "Der schnelle Leser war im Haus und ging dann mit einem Freund auf die andere Seite des Flusses. "
ODD = [
    (1, "", "en", "a", 0), (2, None, "en", None, None), (3, "   \n\n ", None, "a", 5), (4, "12345 -- !!", "en", "a", 11), (5, LONG, "en", "b", len(LONG)),
    (6, EN * 3, "en", "a", 0), (6, EN * 3, "en", "a", 0), (7, EN * 3 + "More.", "en", "b", 0), (None, DE * 2, "de", "a", 0), (None, "x", "de", "c", 0),
    (8, "ÄÖÜ ß 日本語 😀 text. Another one. But no.", "de", "a", 3), (9, DE * 5, "de", "b", 9), (10, "a\nb\na\nThe same line stands here twice today\nThe same line stands here twice today", "en", "c", 1),
]
ALL = ["fingerprint", "licenses", "secrets", "mixing", "pii", "linededup", "langid", "sharding", "simhash"]


def apply(name, docs):
    return {
        "fingerprint": fingerprint.compare, "licenses": licenses.scan, "secrets": secrets.report, "mixing": mixing.mix, "pii": pii.find,
        "linededup": linededup.dedup, "langid": langid.identify, "sharding": sharding.shard, "simhash": simhash.near_duplicates,
    }[name](docs)


@pytest.fixture(scope="module")
def odd(spark):
    # extra columns with names that the operators use themselves
    return spark.createDataFrame([(*r, "x", 7, 1.0) for r in ODD], SCHEMA + ", fp string, row int, score double")


@pytest.mark.parametrize("name", ALL)
def test_awkward_rows_and_empty_tables(spark, odd, name):
    rows = apply(name, odd).collect()
    if name != "mixing":
        assert len(rows) == len(ODD)
    assert apply(name, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", [n for n in ALL if n not in ("mixing", "sharding", "fingerprint", "linededup", "simhash")])
def test_equal_texts_get_equal_results(odd, name):
    rows = [tuple(r)[1:] for r in apply(name, odd.where("doc_id = 6")).collect()]
    assert rows[0] == rows[1]


# ---- fingerprints


def paragraphs(text):
    return {p for p in re.split(r"\n|(?<=[.!?])\s+", text or "") if p}


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_are_exact(spark):
    rng = np.random.default_rng(1)
    vocab = ["alpha", "beta", "gamma", "delta", "echo", "fox"]
    texts = ["".join(f"{rng.choice(vocab)} {rng.choice(vocab)} {i % 9}. And " for i in range(int(rng.integers(0, 80)))) for _ in range(60)] + ["", "", "one", LONG]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1] if i else texts[-1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert got[i].near_edited == pytest.approx(likeness(text, edited)) and got[i].near_next == pytest.approx(likeness(text, after))
    assert got[60].fingerprint == got[61].fingerprint
    assert sum(r.n_exact for r in got.values()) == 0
    # ids that fill several ranges
    twins = [(7, f"text {i}. And more {i % 3}.") for i in range(40)] + [(None, f"none {i}") for i in range(20)] + [(9, "last"), (1, "first")]
    halves = fingerprint.with_next(spark.createDataFrame(twins, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in halves) == sorted((d or 0, t) for d, t in twins)
    assert sorted(r.next for r in halves) == sorted(t for _, t in twins)


def test_peeling_recovers_both_sides(spark):
    rows = [(list(range(a, b)), list(range(c, d))) for a, b, c, d in ((0, 0, 0, 0), (0, 40, 0, 42), (0, 3, 100, 400), (5, 900, 0, 5), (0, 2000, 1000, 3000))]
    hashed = spark.createDataFrame(rows, "a array<long>, b array<long>").select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"])
    for r in fingerprint.changed(hashed, "a", "b").collect():
        assert sorted(r.removed) == sorted(set(r.a) - set(r.b)) and sorted(r.added) == sorted(set(r.b) - set(r.a))


# ---- licenses


def test_license_base_and_suppression(spark):
    texts = [
        "Released under the MIT License. Under the MIT license!", "Apache License, Version 2.0; cc-BY nc", "cc by nc cc by nc", "accby nc", "no word of it",
        "Licensed under the GNU Lesser General Public License, version 2.1", "Copyright (c) 2020. All rights reserved.", None, "underTHE mit license",
    ]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows[:5]] == [(2, 1, 5, "mit"), (2, 0, 5, "apache-2,cc-by-nc"), (2, 0, 3, "cc-by-nc"), (0, None, None, ""), (0, None, None, "")]
    assert rows[5].labels == "lgpl-2.1" and rows[6].labels == "copyright,proprietary" and rows[7].n_words == 0 and rows[8].n_base == 0
    assert len(licenses.rules()) > 200 and all(re.compile(r[3]) for r in licenses.rules())


def test_every_license_rule_passes_the_gates(spark):
    def example(parsed):
        out = ""
        for op, arg in parsed:
            op = str(op)
            if op == "LITERAL":
                out += chr(arg)
            elif op == "IN":
                out += chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0]) if str(arg[0][0]) != "CATEGORY" else "a"
            elif op == "ANY":
                out += "x"
            elif op.endswith("_REPEAT"):
                out += example(arg[2]) * arg[0]
            elif op == "SUBPATTERN":
                out += example(arg[3])
            elif op == "BRANCH":
                out += example(arg[1][0])
        return out

    found = licenses.rules()
    texts = [example(re._parser.parse(regex)) for _, _, _, regex in found]
    assert all(re.search(r[3], f" {t} ") and r[2] in t for r, t in zip(found, texts))
    rows = [(i, t.upper().replace(" ", "\n- ")) for i, t in enumerate(texts)]
    rows += [(-1, "BSD 3-Clause"), (-2, "MPL-2.0"), (-3, "It is in the public\n  domain"), (-4, "All  rights reserved"), (-5, "MIT No Attribution")]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any(got[i]) for i in range(len(texts)))
    assert [got[i] for i in range(-1, -6, -1)] == [["bsd-3"], ["mpl-2"], ["public-domain"], ["proprietary"], ["mit-0"]]


def license_labels(text):
    words = re.findall(licenses.WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), p, i, label) for i, (label, p, _, rx) in enumerate(licenses.rules()) for m in re.finditer(rx, norm, re.A)]
    kept = [x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or y[:2] == x[:2] and y[3] < x[3])) for y in found)]
    places = {label: [norm[: m.start() + 1].count(" ") - 1 for m in re.finditer(f"(?= {phrase} )", norm)] for phrase, label in licenses.BASE}
    at = sorted(p for ps in places.values() for p in ps)
    labels = {x[4] for x in kept} | {k for k, ps in places.items() if ps}
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(k for k, ps in places.items() if ps)), ",".join(sorted(labels))


def test_licenses_are_a_plain_scan(spark):
    rng = np.random.default_rng(12)
    parts = [x for line in licenses.SIGNATURES.strip().splitlines() for x in re.sub(r"\\b|[()?\\]", " ", line.split("; ", 3)[3]).split(" ;; ")]
    parts += [p for p, _ in licenses.BASE] * 8 + ["of", "the", "license", "version 2", "é", "mit", "gpl"] * 5
    texts = [rng.choice(["{} {}", "{}. {}", "{}\n{}"]).format(*rng.choice(parts, 2)).title() + " " + " ".join(rng.choice(parts, int(rng.integers(0, 5)))) for _ in range(250)] + [None, "", "--"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == license_labels(texts[r.doc_id]), texts[r.doc_id]


# ---- secrets


def secret_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_secrets_match_a_plain_scan(spark):
    pieces = ['token = "', "secret:", "PassWord=", "api_key: '", "apikey=", "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "é😀", " ", "x", "ab12cd34", "passwd", "=", "ghp_" + "a1" * 18]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 14)))) for _ in range(300)] + ["", None, "secret=token = abcdefghij"]
    docs = spark.createDataFrame([(i % 290, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = Counter((i % 290, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(secret_spans(t or ""))).encode()).hexdigest()) for i, t in enumerate(texts))
    assert Counter((r.doc_id, r.base_sha256) for r in secrets.report(docs).collect()) == want
    red = secrets.redact(docs.where("doc_id = 0"), "#")
    assert red.count() == docs.where("doc_id = 0").count()


def test_trigram_queries_are_necessary(spark):
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.regex)
        assert (rule.kind == "hex") == (not query)
    sample = {"github": "ghp_" + "A" * 36, "stripe": "sk_live_" + "a" * 16, "jwt": "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3", "bearer": "Authorization: Bearer abcdefghijklmnop1", "pem": "-----BEGIN RSA PRIVATE KEY-----"}
    for kind, text in sample.items():
        rule = next(r for r in secrets.RULES if r.kind == kind)
        assert re.search(rule.regex, text, re.I if rule.fold else 0)
        assert all(any(a <= secrets.trigrams(text.lower()) for a in group) for group in secrets.trigram_query(rule.regex))
    docs = spark.createDataFrame([(1, " ".join(sample.values()))], "doc_id long, text string")
    assert {s.split(":")[0] for s in secrets.report(docs).first().spans.split(",")} >= set(sample)


# ---- mixing


def test_mix_is_its_sql_and_hits_the_rates(spark, odd):
    con = duckdb.connect()
    con.register("d", odd.select("doc_id", "text", "lang", "source", "n_chars").toPandas())
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source, n_chars::BIGINT AS n_chars FROM d")
    want = Counter(tuple(r[:1]) + tuple(r[5:]) for r in con.execute(mixing.ORACLE_MIX).fetchall())
    got = Counter((r.doc_id, r.copy, r.position) for r in mixing.mix(odd.select("doc_id", "text", "lang", "source", "n_chars")).collect())
    assert got == want
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r.n for r in mixing.mix(big, {"a": 3.0, "b": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] / 15000 - 1) < 0.05 and abs(n["b"] / 5000 - 1) < 0.05
    high = spark.range(50).select(mixing.draws(F.col("id"), F.lit(1700.0), "s").alias("n")).collect()
    assert abs(np.mean([r.n for r in high]) - 1700) < 40
    # the join for many sources gives the same rates
    few, mixing.SOURCES = mixing.SOURCES, 1
    try:
        assert {r.source: r.n for r in mixing.mix(big, {"a": 3.0, "b": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()} == n
    finally:
        mixing.SOURCES = few


# ---- personal data


def test_base_spans_and_added_kinds(spark):
    texts = [
        "Mail a.b+c@mail.example.com or x@y now", "ip 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 bad 4111 1111 1111 1112", "call +1 (689) 555-4072 please", "",
        "phone: 689-555-4072 call us", "My ssn is 123-45-6789", "write to joe [at] mail [dot] com", None,
    ]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts * 4)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].spans == "email:5:27" and rows[1].n_ip == 2 and rows[2].n_card == 1 and rows[3].spans == "phone:5:22"
    assert rows[0].base_sha256 == hashlib.sha256(b"email:5:27").hexdigest() and rows[4].spans == ""
    assert rows[5].spans.startswith("phone_local") and rows[6].spans.startswith("ssn") and rows[7].spans.startswith("email_masked")


def personal_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_are_a_plain_scan(spark):
    rng = np.random.default_rng(9)
    pieces = ["a", "b_c", "@", "x.y", ".", "-", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4111-1111", "+1 ", "(689) 555-4072", " ", "é😀", "+", "%", "00", "@m.de", "%q@z.org", "5500000000000004"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 16)))) for _ in range(1500)] + [None, ""]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = personal_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in pii.BASE]


def test_long_runs_take_linear_time():
    start = time.time()
    for text in ("7" * 1_000_000, "a" * 1_000_000 + "@", "1." * 300_000, "+1" + "(" * 500_000, "a@" * 200_000, "x (at) " * 50_000):
        pii.candidates(text, pii.base_spans(text))
    assert time.time() - start < 60


def test_added_kinds_are_caught(spark):
    rng = np.random.default_rng(10)
    fill = lambda: " ".join(rng.choice(EN.split(), 12))
    made = {
        "phone_local": lambda: f"call us: 6{rng.integers(10, 99)}-5{rng.integers(10, 99)}-{rng.integers(1000, 9999)}",
        "ssn": lambda: f"social security {rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}",
        "email_masked": lambda: f"write to joe{rng.integers(0, 99)} [at ] mail [dot] com",
        "mac": lambda: "device " + ":".join(f"{x:02x}" for x in rng.integers(0, 256, 6)),
    }
    rows = [(i, f"{fill()} {made[k]()} {fill()}", k) for i in range(80) for k in [list(made)[i % 4]]] + [(100 + i, f"order page 555-12{i:02d} of {fill()}", None) for i in range(20)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert np.mean([k in got[i] for i, _, k in rows if k]) >= 0.9 and not any(got[i] for i, _, k in rows if not k)


def test_em_prefers_the_reliable_labeler():
    counts = {"phone_local|0+0+0+|21": 500, "phone_local|0-000-|21": 500, "phone_local|0+000+|21": 100}
    soft, rel = pii.estimate(counts)
    assert soft["phone_local|0+0+0+|21"] > 0.9 > 0.2 > soft["phone_local|0-000-|21"]
    assert (rel["phone_local"].sum(axis=2) == pytest.approx(1)) and all(0 <= p <= 1 for p in pii.classify(counts, soft).values())


# ---- line dedup


def words_of(line):
    return frozenset(re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def dedup_plainly(docs, threshold=0.8):
    seen, out = [], {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            s = words_of(line)
            if not s or not any(len(s & t) / len(s | t) >= threshold - 1e-12 for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("heavy, common, long", [(2, 2, 256), (1024, 2, 8), (1024, 2048, 256), (3, 30, 6), (12, 9999, 9)])
def test_line_dedup_is_exact(spark, monkeypatch, heavy, common, long):
    for name, value in (("HEAVY", heavy), ("COMMON", common), ("LONG", long)):
        monkeypatch.setattr(linededup, name, value)
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(40)]
    lines = [" ".join(rng.choice(vocab, int(rng.integers(1, 14)))) for _ in range(150)]
    docs = []
    for i in range(120):
        mine = []
        for _ in range(int(rng.integers(1, 6))):
            ws = str(rng.choice(lines)).split()
            if rng.random() < 0.5:
                ws[int(rng.integers(0, len(ws)))] = str(rng.choice(vocab))
            mine.append(" ".join(ws) + ("." if rng.random() < 0.3 else ""))
        docs.append((i, "\n".join([*mine, ""])))
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dedup_plainly(docs)


def test_second_round_reads_no_text_and_order_of_rows_is_free(spark, monkeypatch):
    monkeypatch.setattr(linededup, "COMMON", 2)
    calls, postings = [], linededup.prefix_postings
    monkeypatch.setattr(linededup, "prefix_postings", lambda *a: calls.append(1) or postings(*a))
    rng = np.random.default_rng(6)
    lines = [list(rng.choice([f"w{i}" for i in range(60)], 11, replace=False)) for _ in range(12)]
    docs = []
    for i in range(160):
        line = list(lines[int(rng.integers(0, 12))])
        for j in rng.choice(11, int(rng.integers(0, 4)), replace=False):
            line[j] = f"w{int(rng.integers(0, 60))}"
        docs.append((i, " ".join(line)))
    rows = spark.createDataFrame([docs[i] for i in rng.permutation(160)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.text, r.n_lines) for r in linededup.dedup(rows).collect()}
    assert got == {i: (text, 1) for i, text in dedup_plainly(docs).items()}
    assert len(calls) == 1


def test_partners_of_a_tried_set_are_all_handed_on(monkeypatch):
    rng = np.random.default_rng(1)
    for narrow, pivots in ((8, 1), (8, 5), (64, 1), (64, 3)) * 20:
        monkeypatch.setattr(linededup, "NARROW", narrow)
        monkeypatch.setattr(linededup, "PIVOTS", pivots)
        base = [rng.integers(0, 1 << 40, int(rng.integers(5, 25))).astype(np.uint64) for _ in range(6)]
        sets = [base[int(rng.integers(0, 6))].copy() for _ in range(50)]
        for x in sets:
            x[rng.integers(0, len(x), 2)] = rng.integers(0, 1 << 40, 2).astype(np.uint64)
        size = np.array([len(x) for x in sets])
        sigs = linededup.signatures(np.concatenate(sets), np.repeat(np.arange(50), size), size)
        key = np.sort(rng.integers(0, 4, 50)).astype(np.uint32)
        cols = [key, size.astype(np.uint32), np.zeros(50, np.uint32), rng.integers(0, 20, 50).astype(np.float32), np.arange(50), *sigs]
        tried = rng.random(50) < 0.3
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(tried), np.arange(50)))
        need = b[linededup.fits(cols, a, cols, b, 0.8) & (key[a] == key[b]) & (cols[3][b] <= cols[3][a])]
        assert {*need, *np.flatnonzero(tried)} <= {*linededup.partners(cols, tried, 0.8)}


def test_equal_rows_lose_their_lines_but_once(spark):
    rows = [(None, "one line\n--\ntwo lines"), (None, "one line\n--\ntwo lines"), (1, None), (1, None)]
    got = sorted((r.text or "", r.n_lines, r.n_removed) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("", 0, 0), ("", 0, 0), ("--", 3, 2), ("one line\n--\ntwo lines", 3, 0)]


# ---- language


def test_language_accuracy_and_rejection(spark):
    rng = np.random.default_rng(5)
    parts = {"en": EN.split(), "de": DE.split(), "xx": "loro mabi suto kelima ranu tesi vopa dilu".split()}
    rows = [(i, " ".join(rng.choice(parts[k], 30)), k) for i in range(900) for k in [("en", "de", "xx")[i % 3]]] + [(901, None, "en"), (902, "12 34", "en"), (903, "Ω", "en")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(r, got[r[0]]) for r in rows[:900] if got[r[0]].held_out]
    assert 200 < len(held) < 400 and np.mean([r[2] == g.lang_pred for r, g in held]) > 0.97
    assert got[901].lang_pred == got[902].lang_pred == "und" and got[903].lang_pred != "und" and got[901].rejected
    foreign = ["Szybki czytelnik był w domu i poszedł na drugą stronę rzeki z przyjacielem", "qxzv wkjq zzxk vvqp jxkw qqzx kkvj xwqz pqxv zkjw", "Nopea lukija oli talossa ja meni sitten joen toiselle puolelle ystävän kanssa"]
    model = langid.fit([r[1] for r in rows[:600]], [r[2] for r in rows[:600]])
    flags = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(foreign + [EN, DE] * 3)], "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.rejected for r in flags] == [True] * 3 + [False] * 6
    wrongly = [langid.predict_chunk(model, np.frombuffer(r[1].encode(), np.uint8), np.array([0, len(r[1].encode())]))[0][0] < model.threshold for r in rows[600:900]]
    assert np.mean(wrongly) < 0.02
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert none.lang_pred == "und"


def test_a_prediction_depends_on_its_text_alone():
    texts = ["ab", "  x", "Der Haus", "", "The ab", "ab", "é", "12", "ab c"] * 40
    model = langid.fit([EN, DE] * 20, ["en", "de"] * 20)

    def run(ts):
        raw = [t.encode() for t in ts]
        return list(zip(ts, *[x.tolist() for x in langid.predict_chunk(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))]))

    assert run(texts) == run(texts[::-1])[::-1] and len(set(run(texts))) == len(set(texts))
    assert [run([t])[0] for t in texts[:9]] == run(texts)[:9]


def test_rare_languages_are_sampled(spark, monkeypatch):
    sizes = {f"l{i}": 2000 for i in range(7)} | {"rare": 60}
    rows = [(i, f"{lang} text {i}", lang) for i, lang in enumerate(x for x, n in sizes.items() for _ in range(n))]
    monkeypatch.setattr(langid, "fit", lambda texts, labels: Counter(labels))
    free = sum(lang == "rare" and zlib.crc32(str(i).encode()) % 3 != 1 for i, _, lang in rows)
    got = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=700)
    assert got["rare"] == free and {got[f"l{i}"] for i in range(7)} == {(700 - free) // 7}


# ---- decontamination


def contaminated(docs, items):
    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    tokens = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for d, t in docs:
        w = tokens(t)
        for i, text in items:
            iw = tokens(text)
            if not iw or not w or len(iw) < 5 and len(w) < len(iw):
                continue
            s, n, best = shingles(iw), len(iw), 0.0
            for a in range(max(1, len(w) - n + 1)):
                window = w[a : a + n]
                c = shingles(window) if n >= 5 else Counter([tuple(window)])
                low = sum((c & s).values())
                best = max(best, low / (sum(c.values()) + sum(s.values()) - low))
            if best >= 0.8:
                out[d, i] = best
    return out


def test_decontamination_is_brute_force(spark):
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([3, 5, 14, 20, 30, 30, 57])] + [(7, None), (8, "")]
    docs = []
    for i in range(80):
        w = list(rng.choice(vocab, int(rng.integers(0, 90))))
        if i % 2:
            passage = items[int(rng.integers(0, 7))][1].split()
            if i % 4 == 1 and len(passage) > 10:
                passage[int(rng.integers(0, 2)) * (len(passage) - 1)] = "changed"
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = passage
        docs.append((i, " ".join(w).capitalize() + "."))
    docs += [(100, None), (101, ""), (102, " ".join(items[4][1].split()[:27]))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(frame, bench).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    clean = {r.doc_id for r in decontam.keep_clean(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    size, decontam.ITEMS = decontam.ITEMS, 3
    try:
        assert {(r.doc_id, r.item_id) for r in decontam.matches(frame, bench).collect()} == want.keys()
    finally:
        decontam.ITEMS = size


# ---- sharding


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 40, 1000, 4097):
        assert sorted(sharding.permute_int(i, n, 7) for i in range(n)) == list(range(n))


def test_shards_are_even_and_computable(spark, odd):
    docs = spark.range(997).select((F.col("id") * 3).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(docs, 40).collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sharding.permute_int(r.row, 997, 7) == r.shard + 40 * r.slot for r in rows)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.row)] == sorted(r.doc_id for r in rows)


# ---- near duplicates


def fp_plainly(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    bits = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        bits += np.array([h >> j & 1 for j in range(64)])
    return sum(1 << j for j in range(64) if bits[j] * 2 > len(shingles))


def test_groups_are_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(vocab, 120))
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            w[int(rng.integers(0, 120))] = str(rng.choice(vocab))
            texts.append(" ".join(w))
    texts += ["", None, "a b", "A  b"]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    fps = [fp_plainly(t) for t in texts]
    assert [f"{f:016x}" for f in fps] == [got.fingerprint[i] for i in range(len(texts))]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert label == [got.component_id[i] for i in range(len(texts))]


def test_links_find_every_close_pair(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 63), 1 << 63, 60)
    fps = set(base.tolist())
    for b in base[:30].tolist():
        x = b & ((1 << 64) - 1)
        for j in rng.choice(64, 4, replace=False):
            x ^= 1 << int(j)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f, 1) for f in fps], "fp long, n long")).collect()
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert ((e.src ^ e.dst) & ((1 << 64) - 1)).bit_count() <= 4
        root[find(e.src)] = find(e.dst)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                assert find(a) == find(b)


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.keep_one(odd).collect()
    assert Counter(r.doc_id for r in kept)[6] == 1 and len(kept[0]) == len(odd.columns)
    groups = {r.fingerprint for r in simhash.near_duplicates(odd).collect()}
    assert len(kept) <= len(groups)


def likeness_of_shingles(a, b, k=5):
    def shingles(t):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("heavy", [False, True])
def test_pipeline_groups_by_shingle_likeness(spark, heavy):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(2 if heavy else 25):
        base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
        for edits in [0, 0, *([3] * 40 if heavy else [1, 2, 3, 4, 5])]:
            words = list(base)
            for at in rng.choice(150, edits, replace=False):
                words[at] = f"x{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(words))
    texts += ["one two", "One, two!", "", "  ", "--", "??", "--"]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    likes = []
    for i in range(len(texts) - 5):
        for j in range(i):
            like = likeness_of_shingles(texts[i], texts[j])
            if like >= 0.8:
                likes.append(like)
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert heavy or sum(0.8 <= x < 0.95 for x in likes) > 50
    want = {find(i) for i in range(len(texts) - 5)} | {len(texts) - 5, len(texts) - 3, len(texts) - 2}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == want


@pytest.mark.parametrize("block", [1 << 23, 40])
def test_groups_of_a_dense_block_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 140)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.choice(140, rng.integers(0, 9), replace=False):
            words[at] = f"x{rng.integers(0, 1 << 30)}"
        texts.append(" ".join(words))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "a b c", ""]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if likeness_of_shingles(texts[i], texts[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    assert 10 < len(set(label)) < 110
    want = {min(i for i, x in enumerate(label) if x == y) for y in set(label)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in neardup.keep_one(docs).collect()} == want


def test_a_block_is_classed_without_its_pairs(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1 :]) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__h", F.xxhash64("text"))
    sets = neardup.sets_of(docs).withColumn("block", F.lit(7))
    got = neardup.classes_of(sets).collect()
    assert len({r.fp for r in got}) == len(got) == 90 and len({r.group for r in got}) == 1


# ---- what is shuffled


def shuffled_bytes(spark, run):
    """Bytes that the stages of ``run`` write to shuffles, with no join broadcast but by a hint."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = max(stages(), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for i, n in stages().items() if i > before)


def large_texts(n):
    """Texts of long words: many bytes, but few words and lines."""
    rng = np.random.default_rng(8)
    return [" ".join(rng.bytes(1500).hex() for _ in range(7)) for _ in range(n)]


def test_a_sieve_keeps_all_keys(spark):
    ids = spark.range(4000)
    bits = sieve.sieve(spark.range(0, 4000, 10), F.xxhash64("id"))
    got = {r.id for r in sieve.sifted(ids, bits, F.xxhash64("id")).where("may").collect()}
    assert got >= set(range(0, 4000, 10)) and len(got) < 420
    none = sieve.sieve(spark.range(0), F.xxhash64("id"))
    assert sieve.sifted(ids, none, F.xxhash64("id")).where("NOT may").count() == 4000


def test_texts_without_a_copy_are_not_shuffled(spark):
    texts = large_texts(150)
    docs = spark.createDataFrame([*enumerate(texts), (200, texts[3]), (201, texts[5] + " end"), (7, texts[7])], "doc_id long, text string")
    got = []
    moved = shuffled_bytes(spark, lambda: got.extend(neardup.keep_one(docs).collect()))
    assert sorted(r.doc_id for r in got) == sorted({*range(150), 201})
    assert moved < sum(map(len, texts)) / 4


def test_texts_that_lose_no_line_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST", 0, raising=False)  # as with many removed lines
    texts = large_texts(150)
    docs = spark.createDataFrame([*enumerate(texts), (200, texts[3] + "\nof its own"), (7, texts[7]), (None, None)], "doc_id long, text string")
    got = []
    moved = shuffled_bytes(spark, lambda: got.extend(linededup.dedup(docs).collect()))
    removed = Counter({(r.doc_id, r.text): r.n_removed for r in got if r.n_removed})
    assert len(got) == 153 and removed == {(200, "of its own"): 1, (7, ""): 1}
    assert moved < sum(map(len, texts)) / 4


# ---- words and the pipeline


def test_word_hashes_do_not_depend_on_the_place():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["one two", None, "two  three-one", "", "oné"]})
    for limit in (3, 1 << 20):
        found = []
        for part, data, offsets in textbytes.chunks(batch, "text", limit):
            low = textbytes.LOWER[data]
            a, b, rows = textbytes.word_bounds(low, offsets)
            found += list(zip([low[x:y].tobytes().decode() for x, y in zip(a, b)], textbytes.word_hashes(low, a, b).tolist()))
        assert [w for w, _ in found] == ["one", "two", "two", "three", "one", "oné"] and len({h for _, h in found}) == 4


def test_pipeline_stages(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, "ÄÖÜ ß 日本語 😀 text. Another one. But no.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "poisson_mixing", "feistel_sharding"]
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, got, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "benchmark_decontamination":
            assert 8 not in {r.doc_id for r in got.collect()}
        if name != "feistel_sharding":
            assert got.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == got.count()


def test_pipeline_keeps_clashing_columns_and_empty_tables(spark, odd, tmp_path):
    names = ["score", "lang_pred", "rejected", "size", "row", "shard", "slot", "copy", "position", "__h", "fp", "group", "key", "k0"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    spark.createDataFrame([(1, "no such passage in here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        got = frame
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, str(tmp_path))
            rows = got.collect()
            if name != "feistel_sharding":
                assert got.columns == docs.columns and all(r[n] == i for r in rows for i, n in enumerate(names))
            assert bool(rows) == (frame is docs)
            got = spark.createDataFrame(rows, got.schema)


def test_registered_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
