"""Secret scanning with multipart credential linking, in DataFrame functions only.

Base findings are assignments to secret-like names, access keys and long hexadecimal runs. Beside them a text may
hold parts that mean little alone: short access identifiers, bare 40-character tokens, short assigned values and
service addresses. Such a weak part is reported only if a complementary part starts within SCOPE code points:

  id        a short access identifier        beside a secret
  key       a bare token or a short value    beside an identifier or an address
  endpoint  a service address                beside both an identifier and a secret

Base findings count as parts too: access as an identifier, assign and hex as secrets. Texts that cannot have a link
pass straight through. In the others the interval join goes by blocks of SCOPE code points: the least and greatest
start of each kind of part in a block say whether one lies within reach, so no pairs of parts are made.

Cases: a null text counts as empty; a text without findings has zero counts and empty strings' digests. Null ids are
carried. Repeated rows get equal results, one row each. An empty table gives an empty result. A weak part that
overlaps a base finding is not reported again. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settle

SCOPE = 256
#: Matches whose places are summed together.
STRIDE = 1024
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are greedy, so the least length can stand in the pattern where a failing run holds no other match.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
WEAK_ID = r"(?<![A-Z0-9])AKIA[A-Z0-9]{8,13}(?![A-Z0-9])"
BARE = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com"
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
LEAST_ASSIGNED, LEAST_WEAK = 12, 6
SPAN = "array<struct<start:bigint,kind:int,end:bigint,size:bigint>>"


def running(values: Column) -> Column:
    """Running sums of an array, by slices of STRIDE: an array that grows by an element is copied each time, so whole
    arrays would take quadratic time."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")
    sums = lambda x, start: F.aggregate(x, F.struct(start.alias("at"), none.alias("out")), lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out")), lambda s: s["out"])
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE)), lambda k: F.slice(values, (k * STRIDE + 1).cast("int"), F.lit(STRIDE)))
    ends = sums(F.transform(parts, lambda x: F.aggregate(x, zero, lambda s, v: s + v)), zero)
    starts = F.concat(F.array(zero), ends)
    return F.flatten(F.transform(parts, lambda x, k: sums(x, F.get(starts, k))))


def spans(text: Column, found: Column, pattern: str, kind: str, size: Column | None = None) -> Column:
    """Spans of a pattern's matches, given what they matched: lengths of the text between them give the places."""
    number = KINDS.index(kind)
    between = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda x: F.length(x).cast("long"))
    lengths = F.transform(found, lambda x: F.length(x).cast("long"))
    ends = running(F.zip_with(between, lengths, lambda g, n: g + n))
    sizes = lengths if size is None else F.transform(found, lambda x: size(x).cast("long"))
    placed = F.transform(F.arrays_zip(ends.alias("end"), lengths.alias("n"), sizes.alias("size")), lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["size"].alias("size")))
    return F.when(F.size(found) > 0, placed).otherwise(F.from_json(F.lit("[]"), SPAN))


def _assigned(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 1))


def findings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (of equal rows), base spans and weak spans of each row."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast("array<string>")

    def all_of(pattern: str, where: Column | None = None) -> Column:
        out = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return out if where is None else F.when(where, out).otherwise(none)

    rows = rows.withColumns({
        "m_assign": all_of(ASSIGN), "m_hex": all_of(HEX),
        "m_access": all_of(ACCESS, text.contains("AKIA")), "m_id": all_of(WEAK_ID, text.contains("AKIA")),
        "m_bare": all_of(BARE), "m_endpoint": all_of(ENDPOINT, text.contains("://") | text.contains(".amazonaws.com")),
    })
    assigned = spans(text, F.col("m_assign"), ASSIGN, "assign", _assigned)
    rows = rows.withColumns({
        "assigned": assigned, "access": spans(text, F.col("m_access"), ACCESS, "access"), "hex": spans(text, F.col("m_hex"), HEX, "hex"),
        "ids": spans(text, F.col("m_id"), WEAK_ID, "id"), "bare": spans(text, F.col("m_bare"), BARE, "key"), "ends": spans(text, F.col("m_endpoint"), ENDPOINT, "endpoint"),
    })
    short = F.transform(F.filter("assigned", lambda s: (s["size"] >= LEAST_WEAK) & (s["size"] < LEAST_ASSIGNED)), lambda s: s.withField("kind", F.lit(KINDS.index("key"))))
    rows = rows.withColumn("base", F.array_sort(F.concat(F.filter("assigned", lambda s: s["size"] >= LEAST_ASSIGNED), "access", "hex")))
    weak = F.when(F.size("ids") + F.size("bare") + F.size("ends") + F.size(short) > 0, F.concat("ids", "bare", short, "ends")).otherwise(F.from_json(F.lit("[]"), SPAN))
    # Equal rows share their links; the key need only be made where there are parts to link.
    key = F.when(F.size("weak") > 0, F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("text")), 256))
    return rows.withColumn("weak", weak).select("id", "base", "weak", key.alias("key"))


def links(found: DataFrame) -> DataFrame:
    """key, extra: the weak spans that have their complement within SCOPE, by row key. found: rows of `findings`."""
    kind = {k: n for n, k in enumerate(KINDS)}
    is_id, is_secret, is_end = F.col("p.kind").isin(kind["access"], kind["id"]), F.col("p.kind").isin(kind["assign"], kind["hex"], kind["key"]), F.col("p.kind") == kind["endpoint"]
    parts = found.dropDuplicates(["key"]).select("key", "base", F.explode(F.array_distinct(F.concat("base", "weak"))).alias("p"))
    parts = parts.withColumn("role", F.when(is_id, 0).when(is_secret, 1).when(is_end, 2)).withColumn("block", F.floor(F.col("p.start") / SCOPE))
    reach = parts.groupBy("key", "block", "role").agg(F.min("p.start").alias("first"), F.max("p.start").alias("last"))
    weak = parts.where(F.col("p.kind") >= kind["id"]).where(~F.exists("base", lambda b: (b["start"] < F.col("p.end")) & (F.col("p.start") < b["end"])))
    asked = weak.select("key", "p", F.col("role").alias("own"), F.explode(F.array(*[F.col("block") + n for n in (-1, 0, 1)])).alias("block"))
    near = asked.join(reach, ["key", "block"]).where((F.col("role") != F.col("own")) & (F.col("last") >= F.col("p.start") - SCOPE) & (F.col("first") <= F.col("p.start") + SCOPE))
    roles = near.groupBy("key", "p", "own").agg(F.collect_set("role").alias("roles"))  # three at most
    has = lambda n: F.array_contains("roles", n)
    complete = ((F.col("own") == 0) & has(1)) | ((F.col("own") == 1) & (has(0) | has(2))) | ((F.col("own") == 2) & has(0) & has(1))
    return roles.where(complete).groupBy("key").agg(F.collect_list("p").alias("extra"))


def listed(of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = settle(findings(df, id_col, text_col))
    may_link = F.size("weak") > 0
    alone = found.where(~may_link).withColumn("extra", F.from_json(F.lit("[]"), SPAN))
    linked = found.where(may_link).join(links(found.where(may_link)), "key", "left")
    out = alone.unionByName(linked.withColumn("extra", F.coalesce("extra", F.from_json(F.lit("[]"), SPAN))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return out.select(F.col("id").alias(id_col), *[count(k) for k in KINDS[:3]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "extra"))).alias("spans"))
