"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut as well after every sentence end, so that cuts depend
on content and long lines have several digests; its digests are the distinct 64-bit hashes
of the paragraphs. A sketch has three parts of cells; each digest goes to one cell of each
part, and a cell keeps a count, the exclusive-or of its digests and that of their checks.
Sketches of two versions subtract cell by cell; peeling takes the cells with one digest
left, recovers those, removes them from their other cells, and goes on until nothing is left
or no such cell is found.

If cells remain, the versions are sketched again, larger: the digests are dealt to groups by
their bits, about ``PER_GROUP`` of both sides a group, and each group of each version has a
sketch. A group that leaves cells is sketched again, four times as large and with other hashes,
up to the last of ``LEVELS``. Two digests that share all cells even there are compared
directly, so the result is exact always; ``exact`` counts such groups.

Likeness: digests in common over all digests of both (two texts without any: 1).

The fingerprint printed for a text is its first, smallest sketch with the number of digests.
Null text counts as empty. Repeated ids are ordered by their text's hash, rows equal in
both are interchangeable; a null id comes last in descending order. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from chronolake.operators.order import range_bucket
from chronolake.runtime import materialize, width

BASE_CELLS = 4  # of each of the three parts
LEVELS = (4, 16, 64)  # cells of each part of a group's sketches, one try after the other
PER_GROUP = 6
ROUNDS = 16
LONGS = "CAST(array() AS array<bigint>)"
END = r"\\n|(?<=[.!?])\\s+"


def digests(text: str) -> str:
    """SQL of a text's distinct digests."""
    return f"array_distinct(transform(filter(split({text}, '{END}', -1), x -> x <> ''), x -> xxhash64(x)))"


def cell_of(key: str, j: int, part: int, level: int) -> str:
    """SQL of the cell of part ``j`` that a digest goes to: other bits of it for each part and level."""
    bits = f"xxhash64({key}, {level})" if level else key
    return f"CAST(pmod(shiftright({bits}, {7 + 18 * j}), {part}) AS INT)"


def placed(key: str, part: int, level: int, n: str = "1") -> str:
    cells = ", ".join(cell_of(key, j, part, level) for j in range(3))
    return f"named_struct('key', {key}, 'n', {n}, 'chk', xxhash64({key}), 'at', array({cells}))"


def summed(entries: str) -> str:
    xor = lambda x: f"aggregate({entries}, 0L, (s, e) -> s ^ e.{x})"
    return f"named_struct('n', aggregate({entries}, 0, (s, e) -> s + e.n), 'key', {xor('key')}, 'chk', {xor('chk')})"


def sketch(keys: str, part: int, level: int) -> str:
    """SQL of the cells (n, key, chk) of a digest array, part after part; ``part`` is the number of cells of a part."""
    empty = "named_struct('n', 0, 'key', 0L, 'chk', 0L)"
    one = lambda j: f"transform(sequence(0, {part - 1}), i -> transform(array(filter(es, e -> e.at[{j}] = i)), fs -> IF(size(fs) = 0, {empty}, {summed('fs')}))[0])"
    return f"transform(array(transform({keys}, k -> {placed('k', part, level)})), es -> concat({one(0)}, {one(1)}, {one(2)}))[0]"


def subtract(mine: str, theirs: str) -> str:
    """SQL of one sketch less another, cell by cell."""
    return f"zip_with({mine}, {theirs}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'chk', x.chk ^ y.chk))"


def peel(left: str, part: int, level: int) -> str:
    """SQL of (ok, mine, theirs): whether no cell remains, and the digests recovered on either side.

    Where the pure cells add up to a whole part, nothing else is in the sketch and it is done.
    """
    pure = f"array_distinct(transform(filter(s.left, c -> (c.n = 1 OR c.n = -1) AND c.chk = xxhash64(c.key)), c -> {placed('c.key', part, level, 'c.n')}))"
    away = f"transform(array(filter(p, e -> e.at[CAST(i DIV {part} AS INT)] = i % {part})), h -> IF(size(h) = 0, c, {subtract('array(c)', 'array(' + summed('h') + ')')}[0]))[0]"
    rest = f"IF({summed('p')} = {summed(f'slice(s.left, 1, {part})')}, slice(s.left, 1, 0), transform(s.left, (c, i) -> {away}))"
    found = lambda n: f"transform(filter(p, e -> e.n = {n}), e -> e.key)"
    going = f"named_struct('left', {rest}, 'mine', concat(s.mine, {found(1)}), 'theirs', concat(s.theirs, {found(-1)}), 'on', true)"
    stop = "named_struct('left', {x}, 'mine', s.mine, 'theirs', s.theirs, 'on', false)"
    none = "NOT exists(s.left, c -> c.n <> 0 OR c.key <> 0 OR c.chk <> 0)"
    step = f"IF(NOT s.on, s, IF({none}, {stop.format(x='slice(s.left, 1, 0)')}, transform(array({pure}), p -> IF(size(p) = 0, {stop.format(x='s.left')}, {going}))[0]))"
    start = f"named_struct('left', {left}, 'mine', {LONGS}, 'theirs', {LONGS}, 'on', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> named_struct('ok', size(s.left) = 0, 'mine', s.mine, 'theirs', s.theirs))"


def dealt(keys: str, groups: str) -> str:
    """SQL of the digests in groups by their bits: first to square-root many parts, then inside each."""
    wide = f"CAST(ceil(sqrt({groups})) AS INT)"
    entries = f"transform({keys}, k -> named_struct('g', CAST(pmod(k, {groups}) AS INT), 'k', k))"
    parts = f"transform(sequence(0, {wide} - 1), a -> filter(es, e -> e.g DIV {wide} = a))"
    inner = f"transform(sequence(0, {wide} - 1), b -> transform(filter(part, e -> e.g = a * {wide} + b), e -> e.k))"
    return f"transform(array({entries}), es -> flatten(transform({parts}, (part, a) -> {inner})))[0]"


def differing(df: DataFrame, a: str, b: str, small_a: str, small_b: str, out: str) -> DataFrame:
    """``df`` with ``out``: (mine, theirs, exact), the digests that one digest column has and the other has not.

    ``small_``: the smallest sketches of both sides. Each further try is a column of its own
    that is filled only where the tries before left cells.
    """
    df = df.withColumn("__r", F.expr(peel(subtract(small_a, small_b), BASE_CELLS, 0)))
    df = df.withColumn("__g", F.expr(f"CASE WHEN NOT __r.ok THEN CAST((size({a}) + size({b})) DIV {PER_GROUP} + 1 AS INT) END"))
    for side, keys in (("__a", a), ("__b", b)):
        df = df.withColumn(side, F.expr(f"CASE WHEN __g IS NOT NULL THEN {dealt(keys, '__g')} END"))
    for level, part in enumerate(LEVELS, 1):
        again = peel(subtract(sketch("__a[i]", part, level), sketch("__b[i]", part, level)), part, level)
        if level == 1:
            df = df.withColumn("__p", F.expr(f"transform(__a, (u, i) -> {again})"))
        else:
            df = df.withColumn("__p", F.expr(f"CASE WHEN exists(__p, x -> NOT x.ok) THEN transform(__p, (x, i) -> IF(x.ok, x, {again})) ELSE __p END"))
    df = df.withColumn("__x", F.expr("CASE WHEN __p IS NULL THEN 0 ELSE size(filter(__p, x -> NOT x.ok)) END"))
    exact = "named_struct('ok', true, 'mine', array_except(__a[i], __b[i]), 'theirs', array_except(__b[i], __a[i]))"
    df = df.withColumn("__p", F.expr(f"CASE WHEN __x > 0 THEN transform(__p, (x, i) -> IF(x.ok, x, {exact})) ELSE __p END"))
    side = lambda x: f"IF(__r.ok, __r.{x}, flatten(transform(__p, q -> q.{x})))"
    df = df.withColumn(out, F.expr(f"named_struct('mine', {side('mine')}, 'theirs', {side('theirs')}, 'exact', __x)"))
    return df.drop("__r", "__g", "__a", "__b", "__p", "__x")


def printed(keys: str, cells: str) -> str:
    """SQL of a fingerprint: number of digests, then count, digests and checks of each cell in hex."""
    return f"concat(hex(size({keys})), ':', array_join(transform({cells}, c -> concat(hex(c.n), '.', lower(hex(c.key)), '.', lower(hex(c.chk)))), ','))"


def likeness(a: str, b: str, d: str) -> str:
    """SQL: digests in common over all, from the sizes of both sides and the recovered differences."""
    common = f"((size({a}) + size({b}) - size({d}.mine) - size({d}.theirs)) / 2)"
    return f"CASE WHEN size({a}) + size({b}) = 0 THEN 1.0D ELSE CAST({common} / ({common} + size({d}.mine) + size({d}.theirs)) AS DOUBLE) END"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``next``, the text of the next document in descending order of id; the first follows the last.

    Documents go to even ranges of ids, each sorted by itself; the first row of a range is
    sent to the range before as well. An id that fills several ranges is split by the hash
    of its texts. Texts are shuffled once.
    """
    spark = docs.sparkSession
    # nulls sort last in descending order: below all ids
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    n = width(spark)
    cuts = slim.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("c")).first()[0] or []
    hot = {k: cuts.count(k) for k in set(cuts) if cuts.count(k) > 1}
    bounds = sorted(set(cuts) | {k + 1 for k in hot})
    slim = slim.withColumn("bucket", range_bucket(F.col("key"), bounds).cast("long") * (n + 1))
    for k, parts in hot.items():  # such ids are fewer than the ranges
        inside = F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * parts)
        slim = slim.withColumn("bucket", F.col("bucket") + F.when(F.col("key") == k, F.least(inside, F.lit(parts - 1))).otherwise(0))
    heads = materialize(slim.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head")), "heads")  # one row a range
    # the head of a range is the next document of the last one of the range above; that of the highest follows the lowest
    order = W.orderBy("bucket")
    lowest = F.min("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ways = heads.select("head.key", "head.tie", F.coalesce(F.lead("bucket").over(order), lowest).alias("to"))
    at_home = F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("sent")))
    there = F.when(F.col("to").isNotNull(), F.array(F.struct("to", F.lit(True).alias("sent"))))
    both = slim.join(F.broadcast(ways), ["key", "tie"], "left")
    both = both.withColumn("copy", F.explode(F.concat(at_home, F.coalesce(there, F.slice(at_home, 1, 0))))).drop("to", "bucket")
    rows = W.partitionBy("copy.to").orderBy(F.col("copy.sent"), F.desc("key"), F.desc("tie"))
    return both.withColumn("next", F.lead("text").over(rows)).where("NOT copy.sent").select("doc_id", "text", "next")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see the module for the rules."""
    both = with_next(docs)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, CAST(length(text) - length(text) DIV 2 AS INT))"), F.expr("substring(next, 1, CAST(length(text) DIV 2 AS INT))"))
    step = both.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next")
    step = step.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[F.expr(digests(x)).alias(y) for x, y in (("text", "a"), ("edited", "b"), ("next", "c"))])
    step = step.select("*", *[F.expr(sketch(x, BASE_CELLS, 0)).alias(f"s{x}") for x in "abc"])
    step = differing(differing(step, "a", "b", "sa", "sb", "db"), "a", "c", "sa", "sc", "dc")
    return step.select(
        "doc_id", "n_chars", "edited_sha256",
        F.expr(printed("a", "sa")).alias("fingerprint"), F.expr(printed("b", "sb")).alias("edited_fingerprint"),
        F.expr(likeness("a", "b", "db")).alias("near_edited"), F.expr(likeness("a", "c", "dc")).alias("near_next"),
        F.size("db.mine").cast("long").alias("n_removed"), F.size("db.theirs").cast("long").alias("n_added"),
        (F.col("db.exact") + F.col("dc.exact")).cast("long").alias("n_exact"),
    )


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of a text column and its digests."""
    keyed = docs.withColumn("digests", F.expr(digests(f"coalesce({text}, '')")))
    cells = keyed.withColumn("__s", F.expr(sketch("digests", BASE_CELLS, 0)))
    return cells.withColumn("fingerprint", F.expr(printed("digests", "__s"))).drop("__s")


def changed(pairs: DataFrame, mine: str, theirs: str) -> DataFrame:
    """``pairs`` with ``removed`` and ``added``: the digests recovered from two digest columns of each row."""
    named = pairs.withColumn("__m", F.col(mine)).withColumn("__t", F.col(theirs))
    named = named.withColumn("__sm", F.expr(sketch("__m", BASE_CELLS, 0))).withColumn("__st", F.expr(sketch("__t", BASE_CELLS, 0)))
    named = differing(named, "__m", "__t", "__sm", "__st", "__d")
    return named.withColumn("removed", F.col("__d.mine")).withColumn("added", F.col("__d.theirs")).drop("__m", "__t", "__sm", "__st", "__d")
