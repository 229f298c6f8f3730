"""Secret scans by a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: groups that must all hold, each
an alternative of trigram sets that must all occur. The index has the postings (document,
trigram) of the trigrams that any query names, over lower-cased texts. Postings are
intersected per alternative and per rule; what is left are candidates, and only their
texts are verified with the regex. Rules without a mandatory trigram scan all texts.

Matches are leftmost and do not overlap inside a kind; matches shorter than the rule's least
length are dropped and not retried. Spans are in code points, ends exclusive. Null and
empty texts have no spans. Rows equal in id and text share their postings and are verified
one by one, so each row gets its own result. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

# the public name of the parser moved; both have the same parse()
from re import _constants as C, _parser as P  # type: ignore[attr-defined]


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    fold: bool = False  # letters in either case
    least: int = 0  # least length, of the whole match or of a group
    group: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 16, 0, True),
    Rule("hex", r"[0-9a-f]{32,}", False, 32, 0, True),  # the runs of [0-9a-f]+ that are long enough
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"(sk|rk)_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"authorization\x20*[:=]\x20*(bearer|basic)\x20+[A-Za-z0-9+/_.=-]{16,}", True),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,12}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
    Rule("aws_secret", r"aws_secret_access_key\x20*[:=]\x20*[A-Za-z0-9/+=]{40}", True),
    Rule("account_key", r"AccountKey=[A-Za-z0-9+/=]{40,}"),
)


class Literal(str):
    """A string that prints as a SQL literal."""

    def __repr__(self) -> str:
        return "'" + self.replace("\\", "\\\\").replace("'", "\\'") + "'"


EXACT = 64  # strings kept while a run of literals grows

Query = list[list[frozenset[str]]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def flush(strings: set[str]) -> Query:
    """The group that a run of literals stands for; none if one of its strings is too short."""
    found = [trigrams(s) for s in sorted(strings)]
    if not found or not all(found):
        return []
    # an alternative that holds another one adds nothing
    return [[a for i, a in enumerate(found) if not any(b < a or b == a and j < i for j, b in enumerate(found))]]


def walk(nodes) -> tuple[set[str] | None, Query]:
    """The strings that a pattern matches, if they are few, else none and its mandatory groups."""
    run: set[str] = {""}
    query: Query = []
    whole = True

    def cut() -> None:
        nonlocal run, query, whole
        query += flush(run)
        run, whole = {""}, False

    for op, arg in nodes:
        strings: set[str] | None = None
        inner: Query = []
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            strings = {chr(a).lower() for _, a in arg}
        elif op is C.SUBPATTERN:
            strings, inner = walk(arg[-1])
        elif op is C.BRANCH:
            each = [walk(b) for b in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*[s for s, _ in each])
            elif all(len(q) == 1 or s is not None and flush(s) for s, q in each):
                inner = [[alt for s, q in each for alt in (q or flush(s))[0]]]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            s, q = walk(body)
            if s is not None and high == 1:
                strings = s | {""} if low == 0 else s
            elif s is not None and low == high and low * len(s) <= EXACT:
                strings = {"".join(x) for x in product(*[sorted(s)] * low)} if len(s) ** low <= EXACT else None
            if strings is None and low > 0:
                inner = q if s is None else flush(s)
        elif op is C.AT:
            strings = {""}
        if strings is not None and len(run) * len(strings) <= EXACT:
            run = {a + b for a, b in product(run, strings)}
            continue
        cut()
        if strings is not None and len(strings) <= EXACT:
            run = set(strings)
        query += inner
    if whole:
        return run, []
    return None, query + flush(run)


def trigram_query(regex: str) -> Query:
    """The groups of trigram sets that a match of ``regex`` needs, letters lower-cased. Empty: none are needed."""
    strings, query = walk(P.parse(regex))
    return flush(strings) if strings is not None else query


def index_terms(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for group in trigram_query(r.regex) for alt in group for t in alt})


def doc_key() -> Column:
    """A hash of id and text: only rows equal in both share a key for sure; sharing costs verification, never a result."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(key, trigram): which documents hold which of ``terms``."""
    # the one-element array binds the lower-cased text, which is made once and not for each term
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)))[0]
    return docs.select(doc_key().alias("key"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, mask): bit i is set if document ``key`` may match ``rules[i]``, by intersection of postings."""
    needs, whole = [], []
    for i, r in enumerate(rules):
        query = trigram_query(r.regex)
        if query:
            whole.append((i, len(query)))
        needs += [(t, i, g, a, len(alt)) for g, group in enumerate(query) for a, alt in enumerate(group) for t in sorted(alt)]
    values = lambda rows, names: index.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({names})")
    # both tables grow with the rules only
    need = F.broadcast(values([(Literal(t), *x) for t, *x in needs], "trigram, rule, grp, alt, size"))
    groups = F.broadcast(values(whole, "rule, groups"))
    # a map-side combine first: each document's postings come from one task
    alt = index.join(need, "trigram").groupBy("key", "rule", "grp", "alt", "size").agg(F.countDistinct("trigram").alias("n")).where("n = size")
    rule = alt.groupBy("key", "rule").agg(F.countDistinct("grp").alias("n")).join(groups, "rule").where("n = groups")
    return rule.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask"))


def spans(text: str, rule: Rule, order: int) -> str:
    """SQL of the array of (start, order, kind, end) of a rule's matches in a text column."""
    regex = ("(?i)" if rule.fold else "") + rule.regex
    lit = "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"
    empty = "CAST(array() AS array<struct<start:int,ord:int,kind:string,end:int>>)"
    long = f"length(element_at(m.val, i)) >= {rule.least}" if rule.least else "true"
    here = "s.at + length(element_at(m.gap, i))"
    one = f"array(named_struct('start', {here}, 'ord', {order}, 'kind', '{rule.kind}', 'end', {here} + length(element_at(m.hit, i))))"
    fold = (
        f"aggregate(sequence(1, size(m.hit)), named_struct('at', 0, 'out', {empty}), "
        f"(s, i) -> named_struct('at', {here} + length(element_at(m.hit, i)), 'out', IF({long}, concat(s.out, {one}), s.out)), s -> s.out)"
    )
    found = f"named_struct('gap', split({text}, {lit}, -1), 'hit', regexp_extract_all({text}, {lit}, 0), 'val', regexp_extract_all({text}, {lit}, {rule.group}))"
    return f"CASE WHEN {text} RLIKE {lit} THEN transform(array({found}), m -> {fold})[0] ELSE {empty} END"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_text: bool = False) -> DataFrame:
    """doc_id and ``found``, the sorted spans (start, ord, kind, end) of every rule in each row of ``docs``."""
    slim = docs.select("doc_id", "text")
    maybe = candidates(postings(slim, index_terms(rules)), rules)
    both = slim.withColumn("key", doc_key()).join(maybe.hint("shuffle_hash"), "key", "left")
    parts = []
    for i, r in enumerate(rules):
        sql = spans("text", r, i)
        parts.append(sql if not trigram_query(r.regex) else f"CASE WHEN (mask & {1 << i}L) <> 0 THEN {sql} ELSE CAST(array() AS array<struct<start:int,ord:int,kind:string,end:int>>) END")
    return both.select("doc_id", *["text"] * keep_text, F.expr(f"array_sort(flatten(array({', '.join(parts)})))").alias("found"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the base kinds, and all spans, for each row of ``docs``."""
    base = [i for i, r in enumerate(rules) if r.base]
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("found", lambda x: x["ord"] == i)).cast("long").alias(f"n_{rules[i].kind}")
    return scan(docs, rules).select(
        "doc_id", *[count(i) for i in base],
        F.sha2(joined(F.filter("found", lambda x: x["ord"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the text with the spans replaced by ``mask``; spans that overlap become one mask."""
    found = scan(docs.select("doc_id", F.col("text")), rules, keep_text=True)
    lit = "'" + mask.replace("\\", "\\\\").replace("'", "\\'") + "'"
    step = f"IF(x.end <= s.at, s, named_struct('at', x.end, 'out', concat(s.out, IF(x.start >= s.at, concat(substring(text, s.at + 1, x.start - s.at), {lit}), ''))))"
    sql = f"aggregate(found, named_struct('at', 0, 'out', ''), (s, x) -> {step}, s -> concat(s.out, substring(text, s.at + 1)))"
    return found.select("doc_id", F.expr(sql).alias("text"))
