"""Report remarks, clocks, presence, perspectives, calendar profiles, families of targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronolake.functions.physics import haversine

#: Share of the sky in percent, by cover code.
SKY = {"CLR": 0.0, "SKC": 0.0, "NCD": 0.0, "NSC": 0.0, "CAVOK": 0.0, "FEW": 18.75, "SCT": 43.75, "BKN": 75.0, "OVC": 100.0, "VV": 100.0}
PEAK = r"PK WND ([0-9]{3})([0-9]{2,3})/([0-9]{4}|[0-9]{2})(?![0-9])"


def peak_wind(report: Column, time: Column) -> dict[str, Column]:
    """Direction, speed and time of a peak-wind remark; null without one.

    Two digits of time are minutes of the report's hour, four are a time of its day; a peak
    that would lie after the report is an hour or a day earlier.
    """
    part = lambda i: F.when(F.regexp_extract(report, PEAK, i) != "", F.regexp_extract(report, PEAK, i))
    clock = part(3)
    whole = F.length(clock) == 4
    day = F.date_trunc("day", time) + F.make_dt_interval(F.lit(0), F.substring(clock, 1, 2).cast("int"), F.substring(clock, 3, 2).cast("int"))
    hour = F.date_trunc("hour", time) + F.make_dt_interval(F.lit(0), F.lit(0), clock.cast("int"))
    back = F.make_dt_interval(F.lit(0), F.when(whole, 24).otherwise(1))
    at = F.when(whole, day).otherwise(hour)
    return {"direction": part(1).cast("double"), "speed": part(2).cast("double"), "at": F.when(at > time, at - back).otherwise(at)}


def ice(report: Column, hours: int) -> Column:
    """Ice of the last ``hours`` in inches from a remark in hundredths; the last remark counts."""
    found = F.regexp_extract_all(report, F.lit(rf"\bI{hours}([0-9]{{3}})\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1).cast("double") / 100)


def snow_depth(report: Column) -> Column:
    return F.regexp_extract(report, r"\b4/([0-9]{3})\b", 1).try_cast("double")


def sky_percent(*codes: Column) -> Column:
    """The largest cover of several layers; null if no layer has a known code."""
    table = F.create_map(*[F.lit(x) for pair in SKY.items() for x in pair])
    covers = [F.element_at(table, F.upper(F.trim(c))) for c in codes]
    return F.greatest(*covers) if len(covers) > 1 else covers[0]


def decision_offset(df: DataFrame, key: str, order: Sequence[str], clocks: Sequence[Column], start: Column, least: int, most: int, name: str = "offset") -> DataFrame:
    """Whole hours from ``start`` to the first known clock, carried forward inside ``key``, 0 before the first, held in least..most."""
    hours = F.floor((F.unix_micros(F.coalesce(*clocks).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3_600_000_000)
    known = F.last(F.col("__h"), ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("__h", hours).withColumn(name, F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(known, F.lit(0))))).drop("__h")


def edge_ratio(estimate: Column, line: Column, deviation: Column) -> Column:
    """Distance from the line in deviations of the model's error; null without a positive deviation."""
    return F.when(deviation > 0, F.abs(estimate - line) / deviation)


def availability(df: DataFrame, columns: Mapping[str, Sequence[object]]) -> Column:
    """A struct of booleans: whether each column is there: not null, not blank, none of its stand-ins."""
    kinds = dict(df.dtypes)

    def there(name: str, empty: Sequence[object]) -> Column:
        c = F.col(name)
        ok = c.isNotNull() & ~c.isin(*empty) if empty else c.isNotNull()
        return (ok & (F.trim(c) != "")) if kinds[name] == "string" else ok

    return F.struct(*[F.coalesce(there(n, e), F.lit(False)).alias(n) for n, e in columns.items()])


def perspective(df: DataFrame, rules: Mapping[str, tuple[str, str | None]], at_home: Column) -> DataFrame:
    """Columns as the side of interest sees them: away rows swap with another column, are negated, or give one less the value; unknown is 0."""

    def away(name: str, rule: str, other: str | None) -> Column:
        return {"same": F.col(name), "swap": F.col(other or name), "negate": -F.col(name), "complement": 1 - F.col(name)}[rule]

    return df.withColumns({n: F.coalesce(F.when(at_home, F.col(n)).otherwise(away(n, *r)), F.lit(0.0)) for n, r in rules.items()})


def settlement_agreement(df: DataFrame, key: str, order: str, ours: str, theirs: str) -> DataFrame:
    """Keys with a settled result and the share that agrees with it, one comparison a key: its first row."""
    first = df.groupBy(key).agg(F.min_by(F.struct(ours, theirs), order).alias("f")).select(F.col(f"f.{ours}").alias("y"), F.lower(f"f.{theirs}").alias("r"))
    return first.where(F.col("r").isin("yes", "no")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == (F.col("r") == "yes").cast("double")).cast("double")).alias("agreement"))


def trailing_profile(df: DataFrame, key: str, day: str, ratios: Mapping[str, tuple[str, str, float]], loads: Sequence[int] = (3, 7, 14), days: int = 30) -> DataFrame:
    """Ratios of sums over the ``days`` before a row's day and contests a day over shorter spans; the row's own day never counts."""
    by = W.partitionBy(key).orderBy(F.unix_date(F.to_date(day)))
    span = by.rangeBetween(-days, -1)
    total = lambda c: F.sum(c).over(span)
    out = {n: F.when(total(b) > 0, total(a) * f / total(b)) for n, (a, b, f) in ratios.items()}
    return df.withColumns(out | {f"load_{d}": F.count(F.lit(1)).over(by.rangeBetween(-d, -1)) / d for d in loads})


def family_hint(df: DataFrame, key: str, value: str) -> DataFrame:
    """A family of distributions for each key from one pass: unknown, bernoulli, negative_binomial, poisson or gaussian."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    a = df.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(F.when(v.isin(0.0, 1.0), 1).when(v.isNotNull(), 0)).alias("b"), F.min(v).alias("low"), F.max(F.abs(v - F.round(v))).alias("frac"))
    count = (F.col("frac") <= 1e-8) & (F.col("low") >= 0)
    family = F.when(F.col("n") == 0, "unknown").when(F.col("b") == 1, "bernoulli").when(count & (F.col("var") > F.col("mean") * 1.25), "negative_binomial").when(count, "poisson").otherwise("gaussian")
    return a.select(key, "n", family.alias("family"))


def season_dates(seasons: DataFrame, year: str, opens: tuple[int, int], closes: tuple[int, int], step: int = 1) -> DataFrame:
    """One row for every ``step``-th date of a season, from its opening day on."""
    ends = [F.make_date(F.col(year), F.lit(m), F.lit(d)) for m, d in (opens, closes)]
    return seasons.select(year, F.explode(F.sequence(*ends, F.make_dt_interval(F.lit(step)))).alias("day"))


def negbin_cdf(mu: Column, alpha: Column, y: Column) -> Column:
    """Chance of at most ``y`` of a negative binomial (size ``alpha``, mean ``mu``), for counts of any size."""
    miss = mu / (alpha + mu)
    none = F.pow(alpha / (alpha + mu), alpha)
    term = lambda s, k: s["t"] * (k - 1 + alpha) / k * miss
    step = lambda s, k: F.struct(term(s, k).alias("t"), (s["s"] + term(s, k)).alias("s"))
    some = F.aggregate(F.sequence(F.lit(1), F.greatest(y, F.lit(1)).cast("int")), F.struct(none.alias("t"), none.alias("s")), step, lambda s: s["s"])
    return F.when(y < 0, 0.0).when(y == 0, none).when(y > 0, F.least(F.lit(1.0), some))


def pit_histogram(df: DataFrame, mu: Column, alpha: Column, y: Column, bins: int = 10) -> DataFrame:
    """How many outcomes fall into each equal bin of their predicted distribution's chance; flat if calibrated. Unknown rows are left out."""
    at = F.least(F.floor(negbin_cdf(mu, alpha, y) * bins), F.lit(bins - 1)).cast("int")
    return df.select(at.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def station_pair(venues: DataFrame, stations: DataFrame, near: int = 20, apart_km: float = 1.0, bound: int = 20_000) -> DataFrame:
    """``venues`` (lat, lon) with the nearest station and the next one that lies at least ``apart_km`` from it.

    Both come from the ``near`` nearest (ties by id); without a second one the first stands in
    for it. ``stations`` (id, lat, lon) travel as one array and may be ``bound`` rows at most.
    Stations without a position are no candidates; a venue without one gets nulls.
    """
    known = stations.select("id", "lat", "lon").where("id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    if known.count() > bound:
        raise ValueError(f"more than {bound} stations")
    every = F.broadcast(known.agg(F.collect_list(F.struct("id", "lat", "lon")).alias("__all")))  # one row
    km = lambda s: F.round(haversine(F.col("lat"), F.col("lon"), s["lat"], s["lon"]), 6)
    ranked = F.slice(F.array_sort(F.transform("__all", lambda s: F.struct(km(s).alias("km"), s["id"].alias("id"), s["lat"].alias("lat"), s["lon"].alias("lon")))), 1, near)
    first = F.get(F.col("__near"), F.lit(0))
    others = F.filter(F.col("__near"), lambda s: haversine(first["lat"], first["lon"], s["lat"], s["lon"]) >= apart_km)
    out = venues.crossJoin(every).withColumn("__near", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), ranked)).drop("__all")
    out = out.withColumns({"__a": first, "__b": F.coalesce(F.get(others, F.lit(0)), first)})
    return out.withColumns({"primary": F.col("__a.id"), "primary_km": F.col("__a.km"), "backup": F.col("__b.id"), "backup_km": F.col("__b.km")}).drop("__near", "__a", "__b")
