"""Time axes of climate files: units, values, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units and their singulars, calendars that agree with the Gregorian one for timestamps, and
# durations by unit and interval.
UNITS = {"second": "seconds", "minute": "minutes", "hour": "hours", "day": "days", "month": "months", "year": "years"}
GREGORIAN = ("standard", "gregorian", "proleptic_gregorian")
#: Reference dates: a day with or without a time, or eight digits.
REFERENCES = (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?$", r"^(\d{4})(\d{2})(\d{2})$")
SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
DURATIONS = {
    "minutes": {1: "PT1M", 60: "PT1H", 1440: "P1D", 43200: "P1M", 44640: "P1M"},
    "hours": {1: "PT1H", 24: "P1D", 720: "P1M", 744: "P1M"},
    "days": {1: "P1D", 30: "P1M", 31: "P1M", 365: "P1Y", 366: "P1Y"},
    "months": {1: "P1M", 12: "P1Y"},
    "years": {1: "P1Y"},
}


def is_gregorian(calendar: Column) -> Column:
    return F.lower(F.coalesce(calendar, F.lit("standard"))).isin(*GREGORIAN)


def parse_units(units: Column) -> Column:
    """A struct of unit (plural) and reference (a timestamp without zone) of "<unit> since <date>"; null where
    either is not understood."""
    text = F.trim(units)
    unit = F.lower(F.regexp_extract(text, r"^(\w+)\s+(?i:since)\s+(.+)$", 1))
    date = F.trim(F.regexp_replace(F.regexp_extract(text, r"^(\w+)\s+(?i:since)\s+(.+)$", 2), r"(\.\d+)?\s*(Z|UTC)?$", ""))
    plural = F.coalesce(*(F.when(unit.isin(one, many), F.lit(many)) for one, many in UNITS.items()))
    stamps = []
    for form, parts in zip(REFERENCES, (6, 3), strict=True):
        part = [F.regexp_extract(date, form, i + 1).try_cast("int") for i in range(parts)]
        clock = [F.coalesce(c, F.lit(0)) for c in (part[3:] or [F.lit(0)] * 3)]
        stamps.append(F.when(date.rlike(form), F.try_make_timestamp_ntz(*part[:3], *clock)))
    reference = F.coalesce(*stamps)
    return F.when(plural.isNotNull() & reference.isNotNull(), F.struct(plural.alias("unit"), reference.alias("reference")))


def axis_of(items: Column) -> Column:
    """A struct of units, calendar and values of the time axis among the metadata items (a map of texts) of a data
    set; null without units. Of several axes that of "time" counts, else the first whose name has "time" in it."""
    named = F.filter(F.map_keys(items), lambda k: k.endswith("#units") & F.contains(F.lower(k), F.lit("time")))
    units = F.coalesce(F.try_element_at(items, F.lit("time#units")), F.try_element_at(items, F.try_element_at(named, F.lit(1))))
    calendar = F.coalesce(F.try_element_at(items, F.lit("time#calendar")), F.lit("standard"))
    listed = F.split(F.btrim(F.try_element_at(items, F.lit("NETCDF_DIM_time_VALUES")), F.lit("{}")), ",")
    values = F.transform(listed, lambda v: F.trim(v).try_cast("double"))
    good = F.when(~F.exists(values, lambda v: v.isNull()), values)
    return F.when(units.isNotNull(), F.struct(units.alias("units"), calendar.alias("calendar"), F.coalesce(good, F.array().cast("array<double>")).alias("values")))


def band_time(items: Column) -> Column:
    """The place of a band on the time axis, from its metadata items; null where it has none."""
    return F.try_element_at(items, F.lit("NETCDF_DIM_time")).try_cast("double")


def to_timestamp(value: Column, unit: Column, reference: Column, calendar: Column | None = None) -> Column:
    """The time of a value on an axis. Seconds to days are added exactly, to the microsecond; months and years
    by the calendar with the day of the month kept. Null for an unknown unit, another calendar than the
    Gregorian, and a day that the month lacks. Everything is without a zone, so the session's zone has no say."""
    factor = F.coalesce(*(F.when(unit == u, F.lit(s)) for u, s in SECONDS.items()))
    micros = F.round(value * factor * 1_000_000).try_cast("long")
    exact = reference + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(20,0)") / 1_000_000).try_cast("decimal(18,6)"))
    whole = F.when(unit == "years", value.try_cast("int") * 12).otherwise(value.try_cast("int"))
    total = F.year(reference) * 12 + F.month(reference) - 1 + whole
    moved = F.add_months(F.to_date(reference), whole)
    stamp = moved.cast("timestamp_ntz") + (reference - F.to_date(reference).cast("timestamp_ntz"))
    known = F.day(moved) == F.day(reference)
    out = F.when(unit.isin(*SECONDS), exact).when(unit.isin("months", "years") & known & (total >= 12), stamp)
    return out if calendar is None else F.when(is_gregorian(calendar), out)


def iso_duration(unit: Column, interval: Column) -> Column:
    """The ISO 8601 duration of a mean interval, rounded; null where there is no name for it."""
    n = F.bround(interval).cast("long")
    return F.coalesce(*(F.when((unit == u) & (n == k), F.lit(d)) for u, names in DURATIONS.items() for k, d in names.items()))


def axis_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each axis (groups of ``by``) steps, interval (the mean) and regular: whether every interval is within
    one percent of the mean, or the mean is 0; null with fewer than two values."""
    w = Window.partitionBy(*by).orderBy(value)
    steps = df.select(*by, (F.col(value) - F.lag(value).over(w)).alias("_step"))
    means = steps.groupBy(*by).agg(F.count("*").alias("steps"), F.avg("_step").alias("interval"), F.min("_step").alias("_low"), F.max("_step").alias("_high"))
    mean = F.col("interval")
    even = (mean == 0) | (F.greatest(F.abs(F.col("_low") - mean), F.abs(F.col("_high") - mean)) <= F.abs(mean) * 0.01)
    return means.select(*by, "steps", "interval", F.when(F.col("steps") >= 2, even).alias("regular"))


def band_times(df: DataFrame, bands: list[str], times: list[float], keep: list[str]) -> DataFrame:
    """Bands side by side as rows: the kept columns, time_cf and band_1."""
    pairs = F.array(*(F.struct(F.lit(float(t)).alias("time_cf"), F.col(b).alias("band_1")) for b, t in zip(bands, times, strict=True)))
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.time_cf", "_p.band_1")
