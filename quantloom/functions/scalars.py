"""Scalar column expressions: dates, ids, specifications, clamps and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tenors of the yield curve by the least number of days.
TENORS = {0: "0S", 30: "1M", 60: "2M", 90: "3M", 180: "6M", 270: "9M", 365: "1Y", 730: "2Y", 1095: "3Y", 1460: "4Y", 1825: "5Y", 2190: "6Y", 2555: "7Y", 2920: "8Y", 3285: "9Y", 3650: "10Y", 5475: "15Y", 7300: "20Y", 10950: "30Y", 14600: "40Y", 18250: "50Y"}
# Least score of each grade.
GRADES = {60: "E", 30: "M+", 0: "M", -20: "M-"}
# Names of asset types and of order sides.
ASSET_TYPES = {"etf": ("etf", "fund", "index_fund"), "stock": ("stock", "cs", "equity", "common_stock", "", "nan", "none", "null", "<na>")}
SIDES = {"buy": ("buy", "b", "long", "open", "f"), "sell": ("sell", "s", "short", "close", "o")}


def date_int(date: Column) -> Column:
    """A date as the number yyyymmdd."""
    return F.date_format(date, "yyyyMMdd").cast("int")


def time_int(ts: Column) -> Column:
    """A timestamp as the number yyyymmddhhmmss."""
    return F.date_format(ts, "yyyyMMddHHmmss").cast("long")


def int_date(n: Column) -> Column:
    """The date of a number of 8, 14 or 17 digits; null for others."""
    text = n.cast("string")
    return F.when(F.length(text).isin(8, 14, 17), F.to_date(F.substring(text, 1, 8), "yyyyMMdd"))


def ladder(x: Column, steps: dict[float, str], below: str | None = None) -> Column:
    """The label of the highest step at or below x."""
    out = None
    for least in sorted(steps, reverse=True):
        out = F.when(x >= least, steps[least]) if out is None else out.when(x >= least, steps[least])
    return out.otherwise(F.lit(below))


def tenor_for(days: Column) -> Column:
    return ladder(days, TENORS)


def grade(score: Column) -> Column:
    return F.when(score.isNotNull(), ladder(score, GRADES, "I"))


def quarter_number(text: Column) -> Column:
    """Ordinal of a quarter such as 2024q3: year x 4 + quarter - 1; null for other texts."""
    year, q = F.regexp_extract(text, r"^(\d{4})[qQ]([1-4])$", 1), F.regexp_extract(text, r"^(\d{4})[qQ]([1-4])$", 2)
    return F.when(q != "", F.expr("0") + F.nullif(year, F.lit("")).cast("int") * 4 + F.nullif(q, F.lit("")).cast("int") - 1)


def quarter_text(number: Column) -> Column:
    return F.concat(F.floor(number / 4).cast("string"), F.lit("q"), (F.pmod(number, F.lit(4)) + 1).cast("string"))


def months_end(date: Column, months: int) -> Column:
    """The day before the same day `months` later."""
    return F.date_sub(F.add_months(date, months), 1)


def named(x: Column, names: dict[str, tuple[str, ...]], otherwise: Column | None = None) -> Column:
    """The name under whose synonyms the trimmed lower-case text stands."""
    text = F.lower(F.trim(x))
    out = None
    for name, words in names.items():
        out = F.when(text.isin(*words), name) if out is None else out.when(text.isin(*words), name)
    return out.otherwise(text if otherwise is None else otherwise)


def asset_type(x: Column) -> Column:
    """Canonical asset type; null and empty texts are stock."""
    return F.when(x.isNull(), "stock").otherwise(named(x, ASSET_TYPES))


def order_side(x: Column) -> Column:
    return named(x, SIDES, F.lit("unknown"))


def order_value(value: Column, price: Column, quantity: Column) -> Column:
    return F.abs(F.coalesce(value, price * quantity))


def round_lot(x: Column, lot: int) -> Column:
    """To whole lots, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) / lot + 0.5) * lot).cast("long")


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def scaled(x: Column, lo: float, hi: float) -> Column:
    """0 at `lo`, 1 at `hi`, clamped."""
    return clamp((x - lo) / (hi - lo))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points, flat beyond."""
    points = sorted(points)
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, ya), (b, yb) in zip(points[:-1], points[1:], strict=True):
        out = out.when(x <= b, ya + (x - a) * ((yb - ya) / (b - a)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(points[-1][1])))


def horizon_of(name: Column) -> Column:
    """Days in a column name such as label_return_10d; null without any."""
    return F.nullif(F.regexp_extract(name, r"_(\d+)d$", 1), F.lit("")).cast("int")


def window_numbers(spec: Column) -> Column:
    """Distinct numbers of a list such as 35-37,1, sorted."""
    def numbers(part: Column) -> Column:
        ends = F.split(F.trim(part), "-")
        return F.sequence(ends[0].cast("int"), F.coalesce(F.get(ends, 1).cast("int"), ends[0].cast("int")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), numbers))))


def blend_spec(spec: Column) -> Column:
    """Map of id to weight from a text such as a:0.6,b:0.4; a missing weight is 1."""
    pairs = F.transform(F.split(spec, ","), lambda p: F.struct(F.trim(F.split(p, ":")[0]).alias("key"), F.coalesce(F.get(F.split(p, ":"), 1).cast("double"), F.lit(1.0)).alias("value")))
    return F.map_from_entries(pairs)


def merged_payload(old: Column, new: Column) -> Column:
    """JSON objects of numbers, field by field: what is new wins, nulls keep the old value."""
    kind = "map<string,double>"
    a, b = (F.coalesce(F.from_json(x, kind), F.create_map().cast(kind)) for x in (old, new))
    keep = F.map_filter(b, lambda k, v: v.isNotNull())
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(keep, k)), keep))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# Prefixes of exchange-traded funds, endings of continuous futures, exchanges of shares.
FUND_PREFIXES, CONTINUOUS, EXCHANGES = ("51", "159", "58"), ("88", "99", "888", "889"), ("XSHE", "XSHG", "BJSE")


def exchange_of(name: Column) -> Column:
    """What follows the first point of an id such as 510880.XSHG, in capitals; null without one."""
    return F.nullif(F.upper(F.substring_index(F.substring(name, F.nullif(F.instr(name, "."), F.lit(0)) + 1, F.length(name)), ".", 1)), F.lit(""))


def is_fund(name: Column) -> Column:
    """Whether the code before the point is that of an exchange-traded fund; false for an empty id."""
    code = F.coalesce(F.substring_index(name, ".", 1), F.lit(""))
    out = code.startswith(FUND_PREFIXES[0])
    for p in FUND_PREFIXES[1:]:
        out = out | code.startswith(p)
    return out


def is_equity(name: Column) -> Column:
    """Six digits and the exchange of shares, funds and indices."""
    return F.coalesce(name.rlike(r"^[0-9]{6}\.(" + "|".join(EXCHANGES) + ")$"), F.lit(False))


def is_continuous(name: Column) -> Column:
    """A future's letters followed by the ending of a continuous contract, and a letter and number for its kind, if any."""
    return F.coalesce(name.rlike(r"^[A-Z]+(" + "|".join(CONTINUOUS) + ")([A-Z][0-9]+)?$"), F.lit(False))


def code_of(name: Column) -> Column:
    """The first six digits in a row; null without any."""
    return F.nullif(F.regexp_extract(name, "[0-9]{6}", 0), F.lit(""))


def listed_id(code: Column) -> Column:
    """A bare code with its leading zeros and its exchange: Shanghai for 5, 6 and 9, Beijing for 4 and 8, else Shenzhen."""
    six = F.lpad(code.cast("string"), 6, "0")
    first = F.substring(six, 1, 1)
    return F.concat(six, F.lit("."), F.when(first.isin("5", "6", "9"), "XSHG").when(first.isin("4", "8"), "BJSE").otherwise("XSHE"))
