"""Text sources: edge lists, names, strengths, bibliographic XML, random graphs."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession, functions as F

from arcwright.functions.text import NUMBER
from arcwright.model import Graph, GraphError, ParseError
from arcwright.operators import normalize
from arcwright.plans.loops import cut
from arcwright.plans.order import numbered


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) from 1, of one text file, numbered over all its splits."""
    return numbered(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at")), ["at"], "line").select("line", "value")


def edge_list(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    return parse_edges(lines(spark, path), directed)


def parse_edges(numbered_lines: DataFrame, directed: bool = False) -> Graph:
    """The first line that is not blank is n; every other is `u v` or `u v w`, all alike. Raises the first error in file order."""
    rows = numbered_lines.select("line", F.regexp_replace("value", r"^[ \t\r\f\x0b]+|[ \t\r\f\x0b]+$", "").alias("value")).where("value <> ''")
    head = rows.orderBy("line").limit(2).collect()
    if not head:
        raise ParseError(1, "Empty")
    first = head[0]
    if not (first.value.isascii() and first.value.isdigit() and len(first.value) <= 19 and int(first.value) >= 1):
        raise ParseError(first.line, "InvalidVertexCount", first.value)
    n = int(first.value)
    width = len(head[1].value.split()) if len(head) > 1 else 2
    t = F.col("t")
    whole = lambda c: F.regexp_like(c, F.lit(r"^\d{1,18}$"))
    part = rows.where(F.col("line") > first.line).select("line", F.split("value", r"[ \t\r\f\x0b]+").alias("t"))
    part = part.select("line", F.size("t").alias("k"), *(F.get(t, F.lit(i)).alias(c) for i, c in enumerate("uvw")))
    number = F.when(F.regexp_like("w", F.lit(NUMBER)), F.col("w").try_cast("double") if hasattr(F.col("w"), "try_cast") else F.col("w").cast("double"))
    error = (
        F.when(~F.col("k").isin(2, 3) | ~whole(F.col("u")) | ~whole(F.col("v")), "InvalidEdge")
        .when((F.col("u").cast("long") < 1) | (F.col("u").cast("long") > n) | (F.col("v").cast("long") < 1) | (F.col("v").cast("long") > n), "VertexOutOfRange")
        .when(F.col("k") != width, "InconsistentColumns")
        .when((F.col("k") == 3) & (number.isNull() | (F.abs(number) == float("inf"))), "InvalidWeight")
    )
    parsed = cut(part.select("line", F.when(whole(F.col("u")), F.col("u")).cast("long").alias("u"), F.when(whole(F.col("v")), F.col("v")).cast("long").alias("v"), number.alias("weight"), error.alias("error")))
    bad = parsed.where("error is not null").orderBy("line").first()
    if bad:
        raise ParseError(bad.line, bad.error)
    g = Graph.of(parsed.select("u", "v", *(["weight"] if width == 3 else [])), n, directed)
    if width == 3 and normalize.overflows(normalize.oriented(normalize.with_weight(parsed), directed)):
        raise ParseError(first.line, "WeightsOverflow")
    return g


def names(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, name): `id<sep>name` lines, sep of comma, semicolon, tab or blank; UTF-8 with or without mark, else Latin-1.

    Lines are split and numbered over all splits of the file. Its bytes are taken for Latin-1 where any line is not UTF-8.
    """
    each = cut(numbered(spark.read.text(path).select(F.col("value").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("at")), ["at"], "line"))
    latin = not each.where(~F.expr("is_valid_utf8(cast(raw as string))")).isEmpty()
    return parse_names(each.select("line", F.decode("raw", "ISO-8859-1" if latin else "UTF-8").alias("value")))


def parse_names(each: DataFrame) -> DataFrame:
    """each: (line, value) from line 1. The first line that is not blank may be a header, without a number in front or with nothing after it.

    Raises the first line that names no vertex, and the first that names one again.
    """
    value = F.regexp_replace(F.regexp_replace("value", "^\ufeff+", ""), r"^\s+|\s+$", "")
    rows = cut(each.select("line", value.alias("value")).where("value <> ''"))
    digits = F.regexp_extract("value", r"^(\d*)", 1)
    rest = F.regexp_extract("value", r"^\d*[,;\t ]*(.*)$", 1)
    got = rows.select("line", "value", digits.alias("digits"), rest.alias("name"))
    first = got.orderBy("line").first()
    if first and (not first.digits or not first.name):
        got = got.where(F.col("line") > first.line)
    vertex = F.when(F.length("digits").between(1, 18), F.col("digits")).try_cast("long")
    got = got.select("line", "value", vertex.alias("vertex"), "name")
    bad = got.where("vertex is null or vertex < 1 or name = ''").orderBy("line").first()
    if bad:
        raise ParseError(bad.line, "InvalidLine", bad.value)
    return _once(got)


def _once(got: DataFrame) -> DataFrame:
    """got: (line, vertex, name). Refuses a vertex that is named twice."""
    twice = got.groupBy("vertex").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("line")), 2, 1).alias("line")).where("n > 1").orderBy("vertex").first()
    if twice:
        raise ParseError(twice.line[0], "DuplicateVertex", str(twice.vertex))
    return got.select("vertex", "name")


def names_of(pairs: DataFrame) -> DataFrame:
    """(vertex, name) from any table of these; refuses vertex 0, empty names and a vertex named twice, by place in the table."""
    got = cut(numbered(pairs.select(F.col("vertex").cast("long").alias("vertex"), "name", F.monotonically_increasing_id().alias("at")), ["at"], "line").select("line", "vertex", "name"))
    bad = got.where("vertex is null or vertex < 1 or name is null or name = ''").orderBy("line").first()
    if bad:
        raise ParseError(bad.line, "InvalidLine", f"{bad.vertex} {bad.name!r}")
    return _once(got)


def looks_like_names(head: str) -> bool:
    """Whether the beginning of a file is one of names: one of the five lines after the first has a field that is no number."""
    import re

    def number(x: str) -> bool:
        try:
            float(x)
            return True
        except ValueError:
            return False

    body = [x.strip() for x in head[:4096].splitlines() if x.strip()][1:6]
    return any(not number(f) for x in body for f in re.split(r"[\s,;]+", x) if f)


def named(df: DataFrame, names_: DataFrame, column: str = "v", name: str = "name") -> DataFrame:
    """df with the name of the vertex in a column, null where it has none."""
    return df.join(names_.select(F.col("vertex").alias(column), F.col("name").alias(name)), column, "left")


def named_path(names_: DataFrame, vertices: list[int]) -> list[str]:
    """A path's names in order; the number where a vertex has none."""
    steps = names_.sparkSession.createDataFrame(list(enumerate(vertices)), "at int, v long")
    return [r.name or str(r.v) for r in named(steps, names_).orderBy("at").collect()]


def search_names(names_: DataFrame, query: str, limit: int = 5) -> DataFrame:
    from arcwright.functions.text import matches

    return names_.where(matches(F.col("name"), query)).orderBy("name", "vertex").limit(limit)


def resolve(names_: DataFrame, text: str, n: int) -> int:
    """An id, or an exact name (its smallest id); otherwise an error with five suggestions."""
    if text.isdigit():
        if 1 <= int(text) <= n:
            return int(text)
        raise GraphError(f"vertex {text} is outside 1..={n}")
    found = names_.where(F.col("name") == text).agg(F.min("vertex")).first()[0]
    if found is None:
        near = [r.name for r in search_names(names_, text).collect()]
        raise GraphError(f"no vertex is named {text!r}" + (f"; perhaps {', '.join(near)}" if near else ""))
    return found


def strengths(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, year, papers) from files strengths_<year>.txt of `u v strength` lines; raises a line that is none, with its file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    rows = cut(raw.select("value", "file", F.regexp_extract("file", r"(\d{4})", 1).alias("year"), strength_of("value").alias("s")).where("value <> ''"))
    bad = rows.where("s is null").orderBy("file", "value").first()
    if bad:
        raise ParseError(_line_of(spark, path, bad.file, bad.value), "InvalidStrength", f"{bad.file}: {bad.value}")
    return rows.select("s.u", "s.v", F.when(F.col("year") != "", F.col("year")).cast("short").alias("year"), "s.papers")


def strength_of(column: str):
    """(u, v, papers) of a line of three parts with one blank between; null where it is none, or the strength not above zero."""
    t = F.split(F.regexp_replace(column, "\r$", ""), " ")
    ok = (F.size(t) == 3) & F.forall(F.slice(t, 1, 2), lambda x: F.regexp_like(x, F.lit(r"^\d{1,18}$"))) & F.regexp_like(F.get(t, F.lit(2)), F.lit(NUMBER))
    papers = F.get(t, F.lit(2)).try_cast("double")
    made = F.struct(F.get(t, F.lit(0)).try_cast("long").alias("u"), F.get(t, F.lit(1)).try_cast("long").alias("v"), papers.alias("papers"))
    return F.when(ok & (papers > 0) & (papers < float("inf")) & (made["u"] > 0) & (made["v"] > 0), made)


def _line_of(spark: SparkSession, path: str, file: str, value: str) -> int:
    """Number of the first line of a file that reads so."""
    own = spark.read.text(path).where(F.col("_metadata.file_name") == file)
    rows = numbered(own.select("value", F.monotonically_increasing_id().alias("at")), ["at"], "line")
    return rows.where(F.col("value") == value).agg(F.min("line")).first()[0]


#: Elements under the root that are publications.
RECORDS = ["article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis", "data"]


def bibliography(spark: SparkSession, path: str, formal_only: bool = False, latin1: bool | None = None, records: list[str] = RECORDS) -> DataFrame:
    """(paper_id, year, authors) from bibliographic XML; gzip by the file's ending, one scan a kind of record.

    Bytes are Latin-1 where the XML declaration says so (or `latin1` does), else UTF-8. Home pages and persons are no papers;
    with formal_only neither are informal publications.
    """
    latin1 = declares_latin1(spark, path) if latin1 is None else latin1
    out = None
    for tag in records:
        # a record is what stands before its closing tag; the bytes are decoded here, since text is taken for UTF-8
        raw = spark.read.option("lineSep", f"</{tag}>").text(path)
        text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if latin1 else F.col("value")
        rows = raw.select(F.regexp_extract(text, rf"(?s)^.*<{tag}\b([^>]*)>(.*)$", 1).alias("head"), F.regexp_extract(text, rf"(?s)^.*<{tag}\b([^>]*)>(.*)$", 2).alias("body"), F.contains(text, F.lit(f"<{tag}")).alias("is"))
        attribute = lambda a: F.regexp_extract("head", rf"""\b{a}\s*=\s*["']([^"']*)["']""", 1)
        rows = rows.where("is").select(F.lit(tag).alias("tag"), attribute("key").alias("_key"), attribute("publtype").alias("_publtype"), F.regexp_extract_all("body", F.lit(r"(?s)<author\b[^>]*>(.*?)</author>"), 1).alias("authors"), F.regexp_extract("body", r"(?s)<year\b[^>]*>(.*?)</year>", 1).alias("year"))
        out = rows if out is None else out.union(rows)
    return papers_of(out, formal_only)


def declares_latin1(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with an XML declaration of ISO-8859-1."""
    head = spark.read.option("lineSep", ">").text(path).limit(1).collect()
    return bool(head) and "<?xml" in head[0].value and "iso-8859-1" in head[0].value.lower()


def papers_of(records: DataFrame, formal_only: bool = False) -> DataFrame:
    """records: (tag, _key, _publtype, authors, year as text)."""
    keep = ~F.col("tag").isin("www", "person")
    if formal_only:
        keep &= ~F.startswith(F.coalesce("_publtype", F.lit("")), F.lit("informal"))
    return records.where(keep).select(F.monotonically_increasing_id().alias("paper_id"), year_of("year").alias("year"), F.transform("authors", unescape).alias("authors"))


def year_of(column: str):
    """Exactly four digits in front, else unknown."""
    lead = F.regexp_extract(F.trim(F.col(column)), r"^(\d+)", 1)
    return F.when(F.length(lead) == 4, lead).cast("short")


def unescape(x):
    """Named and numbered characters of HTML; unknown names stay as written. Entities are the standard library's."""
    known = {f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";") and len(v) == 1 and ord(v) < 256}
    parts = F.regexp_extract_all(x, F.lit(r"(&#?\w+;|[^&]+|&)"), 1)
    table = F.create_map(*[F.lit(s) for kv in sorted(known.items()) for s in kv])
    number = lambda p: F.when(F.startswith(p, F.lit("&#x")), F.conv(F.regexp_extract(p, r"&#x([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(p, r"&#(\d+);", 1))
    one = lambda p: F.when(F.regexp_like(p, F.lit(r"^&#(\d+|x[0-9a-fA-F]+);$")), F.decode(F.encode(F.char(number(p).cast("long")), "UTF-8"), "UTF-8")).otherwise(F.coalesce(F.try_element_at(table, p), p))
    return F.array_join(F.transform(parts, one), "")


class SplitMix64:
    """The public generator of that name: a reproducible stream of 64-bit numbers, on the driver."""

    # The generator's increment and factors.
    STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def __init__(self, seed: int):
        self.state = seed

    def next(self) -> int:
        mask = (1 << 64) - 1
        self.state = z = (self.state + self.STEP) & mask
        for shift, factor in ((30, self.FIRST), (27, self.SECOND)):
            z = ((z ^ (z >> shift)) * factor) & mask
        return z ^ (z >> 31)

    def vertices(self, n: int, count: int) -> list[int]:
        """So many different vertices of 1..n (all, if there are no more), in the order drawn."""
        drawn: dict[int, None] = {}
        while len(drawn) < min(n, count):
            drawn.setdefault(self.next() % n + 1)
        return list(drawn)


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 1, low: float | None = None, high: float | None = None, directed: bool = False) -> Graph:
    """m uniform pairs over 1..n, weights uniform in [low, high) to three places where given."""
    pick = lambda k, top: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(top))
    rows = spark.range(m).select((1 + pick(1, n)).alias("u"), (1 + pick(2, n)).alias("v"), *([] if low is None else [F.round(low + pick(3, 1_000_000) / 1e6 * (high - low), 3).alias("weight")]))
    return Graph.of(rows, n, directed)


def potential_graph(spark: SparkSession, n: int, m: int, seed: int = 1, cycle: list[int] | None = None) -> Graph:
    """Directed, with negative arcs and whole-number weights but no negative cycle, unless one of arcs of -1 is asked for."""
    g = random_graph(spark, n, m, seed, directed=True)
    h = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(20))
    rows = g.edges.select("u", "v", (F.pmod(F.xxhash64("u", "v", F.lit(seed)), F.lit(9)) + h("u") - h("v")).cast("double").alias("weight"))
    if cycle:
        rows = rows.union(spark.createDataFrame([(a, b, -1.0) for a, b in zip(cycle, cycle[1:] + cycle[:1])], "u long, v long, weight double"))
    return Graph.of(rows, n, True)
