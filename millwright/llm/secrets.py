"""Operator 9: secret scans with multipart credential linking, in DataFrame functions only.

Base spans come from three patterns.  Weak parts (access identifiers of any length, bare 40-character
keys, service endpoints) say little alone; they are linked when complementary parts stand within
``scope`` characters of each other in one document: an identifier with a key, an endpoint with both.
The parts meet by an interval sweep: sorted by start in their document, each looks at the nearest end
before it and the nearest start behind it of the kinds it needs, so no pairs are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwright.llm.common import staged

# The contract's base patterns, with the group that must reach the length, and the length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that are long enough
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
# What a text must hold to be scanned at all; each is implied by its pattern.
HINTS = {"assign": r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]""", "access": r"AKIA[A-Z0-9]", "hex": r"[0-9a-f]{24}"}
# A host has at most eight labels of at most 63 characters before the last two, and no match begins inside a
# label: a place is given up after a bounded number of characters, and the matcher's stack is bounded too.
HOST = r"(?<![a-z0-9-])[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,7}\.amazonaws\.com"
# Weak parts: kind, role, pattern.
WEAK = (("weak_id", "id", r"(?:AKIA|ASIA)[A-Z0-9]{4,}"), ("weak_key", "key", r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
        ("endpoint", "end", r"https?://[A-Za-z0-9./_-]+|" + HOST))
ROLES = {"assign": "key", "access": "id", "hex": "key"} | {k: r for k, r, _ in WEAK}
_SPAN = "array<struct<lo:int,hi:int>>"
BLOCK = 256  # matches


def match_spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans (code points, end exclusive) of all matches whose ``group`` has ``least`` characters.

    The pieces between the matches and the matches themselves tile the text, so positions are sums
    of their lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gap = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    rows = F.zip_with(gap, F.arrays_zip(whole.alias("m"), part.alias("p")), lambda g, x: F.struct(F.length(g).alias("g"), F.length(x["m"]).alias("m"), F.length(x["p"]).alias("p")))
    none = F.array().cast(_SPAN)

    def step(acc, x):
        lo = acc["at"] + x["g"]
        hi = lo + x["m"]
        new = F.when(x["p"] >= least, F.array(F.struct(lo.alias("lo"), hi.alias("hi")))).otherwise(none)
        return F.struct(hi.alias("at"), F.concat(acc["out"], new).alias("out"))

    def block(acc, part):
        # an array grows within a block only, so many matches in one text do not cost their square
        return F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    def tiled(r):
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(r) / BLOCK).cast("int")), lambda i: F.slice(r, i * BLOCK + 1, BLOCK))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])

    return F.element_at(F.transform(F.array(rows), tiled), 1)  # a lambda's argument is computed once


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(_SPAN)
    return {kind: F.when(text.rlike(HINTS[kind]), match_spans(text, pattern, group, least)).otherwise(none) for kind, pattern, group, least in BASE}


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    order = F.array_sort(spans)
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")


_ORDER = {k: i for i, k in enumerate(["assign", "access", "hex", *(k for k, _, _ in WEAK)])}


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), F.lit(_ORDER[kind]).alias("rank"), s["hi"].alias("hi"), F.lit(kind).alias("kind")))


def find_secrets(docs: DataFrame, scope: int = 256) -> DataFrame:
    """Per row: doc_id, tag (hash of the text), base and all (arrays of lo, rank, hi, kind).  Null text counts as empty.

    Rows that repeat both id and text come out as often as they came in, with the same spans.
    ``all`` holds the base spans and the weak parts whose complement is within ``scope`` characters.  An
    empty table gives an empty one, very long texts are searched whole in linear time, and columns besides
    doc_id and text are left out.  A host has ten labels at most: of a longer name the last ten are the span.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = base_spans(text)
    tagged = {k: _tagged(v, k) for k, v in base.items()}
    none = F.array().cast(_SPAN)
    likely = text.rlike(r"AKIA|ASIA")  # every link needs an identifier
    weak = F.concat(*[_tagged(F.when(likely, match_spans(text, p)).otherwise(none), k) for k, _, p in WEAK])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.concat(*tagged.values()).alias("base"), weak.alias("weak"))
    rows = staged(rows, "secret-spans")

    part = rows.where(F.size("weak") > 0).select("doc_id", "tag", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    part = part.select("doc_id", "tag", "s", role[F.col("s.kind")].alias("role"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    # both frames grow row by row; one that shrinks towards the end would be summed up anew for every row
    before, behind = (W.partitionBy("doc_id", "tag").orderBy(*[f(c) for c in ("lo", "hi", "role")]).rowsBetween(W.unboundedPreceding, -1) for f in (F.asc, F.desc))

    def near(kind: str) -> Column:
        end = F.max(F.when(F.col("role") == kind, F.col("hi"))).over(before)
        start = F.min(F.when(F.col("role") == kind, F.col("lo"))).over(behind)
        return F.coalesce(F.col("lo") - end <= scope, F.lit(False)) | F.coalesce(start - F.col("hi") <= scope, F.lit(False))

    part = part.withColumn("id_near", near("id")).withColumn("key_near", near("key"))
    linked = F.expr("case role when 'id' then key_near when 'key' then id_near else id_near and key_near end")
    # a weak part that only repeats a base span adds nothing
    weak = F.col("s.kind").isin([k for k, _, _ in WEAK])
    repeats = F.max(~weak).over(W.partitionBy("doc_id", "tag", "lo", "hi"))
    part = part.withColumn("repeats", repeats).where(weak & linked & ~F.col("repeats"))
    links = part.groupBy("doc_id", "tag").agg(F.collect_set("s").alias("linked"))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.tag") == F.col("b.tag")]
    out = rows.alias("a").join(links.alias("b"), same, "left")
    return out.select("a.doc_id", "a.tag", "a.base", F.array_sort(F.coalesce(F.concat("a.base", "b.linked"), "a.base")).alias("all"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = 256) -> DataFrame:
    """``docs`` with every span that ``find_secrets`` reports replaced by ``mark``; a column n_chars
    follows the text, all other columns stay.  Rows without a span come back as they are."""
    found = find_secrets(docs, scope).where(F.size("all") > 0)
    found = found.select("doc_id", "tag", "all").dropDuplicates(["doc_id", "tag"])
    same = [F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")), F.xxhash64("a.text") == F.col("b.tag")]
    joined = docs.alias("a").join(found.alias("b"), same, "left")
    text = F.col("a.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["lo"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["hi"]).alias("at"), F.concat(acc["out"], gap, F.when(s["hi"] > acc["at"], mark).otherwise("")).alias("out"))

    clean = F.when(F.col("b.all").isNotNull(), F.aggregate("b.all", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))).otherwise(text)
    cols = {c: F.col(f"a.`{c}`") for c in docs.columns} | {"text": clean}
    if "n_chars" in cols:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(F.col("b.all").isNotNull(), F.length(clean).cast(kind)).otherwise(F.col("a.n_chars"))
    return joined.select(*[v.alias(k) for k, v in cols.items()])
