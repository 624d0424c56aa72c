"""Secret scans by multipart credential linking, with DataFrame functions only.

Strong spans (assigned secrets, access identifiers, long hexadecimal strings) are reported as
such. Weak parts are common in harmless text: an opaque string, a named identifier, an
endpoint. They are reported only when complementary parts stand near them in the same
document: an opaque string near an identifier or an endpoint, an identifier near a secret, an
endpoint near both.

Near is an interval join by a sweep: two parts meet where the gap between their intervals is at
most the distance. Parts of a document enter at their starts and ask at their ends plus the
distance; the furthest end of each role that has entered so far decides, so that no pairs are
made and a document of many parts is only sorted. The same sweep drops the weak parts that
overlap a base span: at a part's end, the furthest end of the base spans that began before it
tells.

Matches are placed in one pass: the text between matches, from a split by the same pattern,
gives each match's offset; offsets are summed in blocks, so that a text with very many matches
is not copied for each of them. Defined cases: a null text counts as empty; offsets are code
points, ends exclusive; each row gives one row, repeated rows and rows without an id too; very
long texts are read whole and parts have any length; at equal gaps every part counts; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest_columns, materialize

KINDS = ("assign", "access", "hex")
DISTANCE = 200
#: Matches whose offsets are summed together.
BLOCK = 256
#: kind -> (pattern, group that must be long, its least length): whole matches of the base kinds, then of the weak ones.
ASSIGN = r"""(?:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short fails whichever way it is begun, so the lengths stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENTIFIER = r"""(?i:access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"(?:https?|ftp|ssh|jdbc|postgres|mysql|mongodb|redis)://[A-Za-z0-9.:@/_-]{4,}"
#: A run of any length, after = too, with base64 padding; what has = and more after it is a name, not a value.
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
ROLES = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"


def located(text: Column, pattern: str, kind: str, base: bool, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches; those whose `group` is shorter than `least` are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if least else whole
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), tested, lambda p, t: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), F.length(t).alias("tested")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + p["size"]).alias("end"), F.lit(base).alias("base"))
        spans = F.when(p["tested"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]) if least else F.concat(acc["spans"], F.array(span))
        return F.struct((begin + p["size"]).alias("at"), spans.alias("spans"))

    def in_blocks(p: Column) -> Column:
        block = lambda i: F.aggregate(F.slice(p, i * BLOCK + 1, BLOCK), start, add)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), block)
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("lists"))
        moved = lambda acc, s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["base"].alias("base"))
        join = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["lists"], F.array(F.transform(x["spans"], lambda s: moved(acc, s)))).alias("lists"))
        return F.flatten(F.aggregate(blocks, none, join, lambda acc: acc["lists"]))

    found = F.transform(F.array(F.filter(pieces, lambda p: p["size"].isNotNull())), in_blocks)[0]  # bound once, used twice
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, base, weak) of each row: one narrow pass."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        located(F.col("t"), ASSIGN, "assign", True, 2, 8),
        F.when(F.col("t").contains("AKIA"), located(F.col("t"), ACCESS, "access", True)).otherwise(F.array().cast(f"array<{SPAN}>")),
        located(F.col("t"), HEX, "hex", True),
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).withColumn("base", base)
    none = F.array().cast(f"array<{SPAN}>")
    schemed = F.when(F.col("t").contains("://"), located(F.col("t"), ENDPOINT, "endpoint", False)).otherwise(none)
    weak = F.concat(located(F.col("t"), IDENTIFIER, "identifier", False), schemed, located(F.col("t"), OPAQUE, "opaque", False))
    return found.withColumn("weak", weak).select("doc_id", "base", "weak")


def link(found: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, spans): the base spans, and the weak parts that complementary parts support."""
    rows = materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", "weak"), "parts")
    some = rows.filter(F.size("weak") > 0)
    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    every = some.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", "p", role[F.col("p.kind")].alias("role"))
    enters = every.select("row", F.col("p.start").alias("at"), F.lit(0).alias("turn"), "role", "p")
    weak = every.filter(~F.col("p.base"))
    asks = weak.select("row", (F.col("p.end") + distance).alias("at"), F.lit(1).alias("turn"), "role", "p")
    closes = weak.select("row", F.col("p.end").alias("at"), F.lit(-1).alias("turn"), "role", "p")
    so_far = Window.partitionBy("row").orderBy("at", "turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    furthest = lambda which: F.max(F.when((F.col("turn") == 0) & which, F.col("p.end"))).over(so_far)
    met = lambda r: F.coalesce(furthest(F.col("role") == r) >= F.col("p.start") - distance, F.lit(False)).alias(r)
    covered = F.coalesce(furthest(F.col("p.base")) > F.col("p.start"), F.lit(False)).alias("covered")
    swept = enters.unionByName(asks).unionByName(closes).select("row", "turn", "role", "p", met("identifier"), met("secret"), met("endpoint"), covered).filter("turn <> 0")
    complete = (
        ((F.col("role") == "secret") & (F.col("identifier") | F.col("endpoint")))
        | ((F.col("role") == "identifier") & F.col("secret"))
        | ((F.col("role") == "endpoint") & F.col("identifier") & F.col("secret"))
    )
    by_part = swept.groupBy("row", "p").agg(F.bool_or((F.col("turn") == 1) & complete).alias("complete"), F.bool_or((F.col("turn") == -1) & F.col("covered")).alias("covered"))
    linked = by_part.filter("complete AND NOT covered").groupBy("row").agg(F.collect_list("p").alias("linked"))
    out = some.join(linked, "row", "left").select("doc_id", F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked")).alias("spans"))
    return rows.filter(F.size("weak") == 0).select("doc_id", F.col("base").alias("spans")).unionByName(out)


def secrets_query(docs: DataFrame) -> DataFrame:
    return digest_columns(link(parts(docs)), KINDS)
