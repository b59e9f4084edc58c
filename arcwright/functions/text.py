"""Scalar functions on text and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

# Which accented Latin letters count as which plain ones in a search for names.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"

#: A number as an edge list may hold it; casts alone would take "5d", "nan" and blanks.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def fold(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def matches(name: Column, query: str) -> Column:
    """All words of the query occur in the name, accents and case aside."""
    words = F.filter(F.split(fold(F.lit(query)), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(fold(name), w))


def plain_double(x: Column) -> Column:
    """A double without exponent or needless zeros, whatever its size: 1, 0.1, 0.0000001; inf, -inf and NaN."""
    short = x.cast("string")
    part = lambda i: F.regexp_extract(short, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)
    behind = F.when(part(3) == "0", "").otherwise(part(3))
    exponent = part(4).try_cast("int")
    small = F.concat(part(1), F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), part(2), behind)
    whole = F.concat(part(1), part(2), behind, F.repeat(F.lit("0"), exponent - F.length(behind)))
    split = F.concat(part(1), part(2), F.substring(behind, F.lit(1), exponent), F.lit("."), F.substring(behind, exponent + 1, F.length(behind)))
    return (
        F.when(F.contains(short, F.lit("E")), F.when(exponent < 0, small).when(F.length(behind) <= exponent, whole).otherwise(split))
        .when(F.endswith(short, F.lit(".0")), F.regexp_replace(short, r"\.0$", ""))
        .when(short == "Infinity", "inf")
        .when(short == "-Infinity", "-inf")
        .otherwise(short)
    )


def fixed(x: Column, places: int) -> Column:
    """Always so many decimals; a tie goes to the even digit."""
    exact = F.bround(x.cast("decimal(38,18)"), places).cast("string")
    return F.when(F.abs(x) < 1e15, exact).otherwise(F.format_string(f"%.{places}f", x.cast("double")))


def fifteen_digits(x: Column) -> Column:
    """Fifteen significant digits, without trailing zeros; whole numbers below 1e15 bare."""
    places = F.greatest(F.lit(0), 14 - F.floor(F.log10(F.abs(x)))).cast("int")
    shown = F.format_string("%s", F.round(x.cast("decimal(38,18)"), 18).cast("string"))
    rounded = F.transform(F.array(x), lambda y: y)[0]
    text = F.expr("null")
    for p in range(0, 19):
        text = F.when(places == p, F.format_string(f"%.{p}f", rounded)).otherwise(text)
    text = F.coalesce(text, shown)
    cut = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(x == 0, "0").when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(cut)


def digits(v: Column) -> Column:
    return F.length(v.cast("string"))


def date_of(seconds: Column) -> Column:
    """The day in UTC of seconds since 1970, whatever the session's time zone."""
    return F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86_400).cast("int")).cast("string")


def as_json(*columns: Column | str) -> Column:
    """One JSON object of the columns; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def register(spark: SparkSession) -> None:
    """fold_name(x), name_matches(name, query) and digits(v) for SQL of this session, as expressions and no code of Python."""
    word = "filter(split(fold_name(query), '[ \\t\\n]+'), w -> w <> '')"
    for signature, body in (
        ("fold_name(x STRING) RETURNS STRING", f"translate(lower(x), '{ACCENTED}', '{PLAIN}')"),
        ("name_matches(name STRING, query STRING) RETURNS BOOLEAN", f"size({word}) > 0 AND forall({word}, w -> contains(fold_name(name), w))"),
        ("digits(v BIGINT) RETURNS INT", "length(cast(v AS STRING))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


# For people, on the driver: formats are fixed values.


def human_bytes(n: int) -> str:
    value, units = float(n), ["B", "kB", "MB", "GB", "TB"]
    at = 0
    while value >= 1000 and at + 1 < len(units):
        value, at = value / 1000, at + 1
    return f"{value:.2f} {units[at]}" if at else f"{n} B"


def human_duration(seconds: float) -> str:
    for below, factor, shown in ((1e-3, 1e6, "{:.1f} µs"), (1.0, 1e3, "{:.2f} ms"), (60.0, 1.0, "{:.2f} s")):
        if seconds < below:
            return shown.format(seconds * factor)
    return f"{seconds / 60:.1f} min"


def human_weight(x: float | None) -> str:
    """At most six decimals; nothing is infinitely far."""
    if x is None or x == float("inf"):
        return "∞"
    shown = f"{x:.6f}".rstrip("0").rstrip(".")
    return "0" if shown == "-0" else shown


def plain(x: float) -> str:
    """What plain_double gives, of one number on the driver."""
    from decimal import Decimal

    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[str(x)]
    shown = format(Decimal(repr(x)), "f")
    return shown.rstrip("0").rstrip(".") if "." in shown else shown


#: Sizes of what a graph is held in are fixed values: reports state them as other engines do.
def representation_bytes(kind: str, n: int, m: int, directed: bool, weighted: bool) -> int:
    """Bytes of a graph held as rows of lists, as a bit matrix, or as offsets and targets."""
    e = m if directed else 2 * m
    if kind == "list":
        return 24 * (n + 1) + 4 * e + (24 * (n + 1) + 8 * e if weighted else 0)
    if kind == "matrix":
        return (n + 1) * -(-(n + 1) // 64) * 8 + 4 * (n + 1) + (8 * (n + 1) ** 2 if weighted else 0)
    if kind == "csr":
        return 4 * (n + 2) + e * (12 if weighted else 4)
    raise ValueError(f"unknown representation {kind!r}")
