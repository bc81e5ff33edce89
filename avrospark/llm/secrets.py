"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans: ``assign`` (a keyword, a separator, a value), ``access`` (an access identifier
with its fixed prefix) and ``hex`` (a long hexadecimal run). Weak candidates mean nothing
alone: ``key`` (40 characters of base64 shape), ``user`` (a named account or key id) and
``endpoint`` (a URL or a host with a port). Their scopes are joined as intervals: a weak candidate is
reported only if a complementary part lies within ``scope`` code points of it:

* key: beside an identifier (access or user) or an endpoint,
* user: beside a secret (assign, hex or key),
* endpoint: beside a secret (assign, hex or key).

How positions are found without a UDF: Java's ``split`` and ``regexp_extract_all`` walk the
same leftmost non-overlapping matches, so the lengths of the pieces between matches and of
the matches, summed in order, are the positions, in code points. The parts of a document are
written once with a number for the row, exploded to rows, shuffled by that number, and a sorted sweep (window) over the row's parts
finds for each weak candidate the nearest end before and the nearest start behind of every
complementary kind: an interval join that never makes pairs. Only parts travel, and the text
only if it is asked for; one row is one key, so that no key is hot.

Defined results: null text counts as empty and has no spans; documents without spans keep a row
with an empty list; repeated rows are scanned as often as they occur; an empty table gives an
empty result; columns of the input come back unchanged, whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the greedy runs of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # the greedy runs of 24 or more characters
KEY = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
USER = r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""(?:https?|jdbc|postgres|mysql|mongodb|redis|s3|ftp)(?::[a-z]++)?://[A-Za-z0-9._:@-]++|(?<![a-z0-9.-])[a-z0-9.-]++:[0-9]{2,5}\b"""

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "key", "user", "endpoint")
RULES = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "key": KEY, "user": USER, "endpoint": ENDPOINT}
BASE = KINDS[:3]
#: Kinds of which one must lie within the scope.
COMPLEMENTS = {"key": ("access", "user", "endpoint"), "user": ("assign", "hex", "key"), "endpoint": ("assign", "hex", "key")}
SPAN = "struct<kind:string,start:long,end:long>"
SCOPE = 200


def _host(m: Column) -> Column:
    """Whether a found endpoint is a URL, or a host of two names at least: dots between names only."""
    return m.contains("://") | (m.contains(".") & ~m.startswith(".") & ~m.contains("..") & ~m.contains(".:"))


def _parts(text: Column, k: int) -> Column:
    """Of kind ``k``: for each match the characters since the last one, its length, and whether it counts."""
    rule = F.lit(RULES[KINDS[k]])
    between, found = F.split(text, RULES[KINDS[k]], -1), F.regexp_extract_all(text, rule, F.lit(0))
    value = F.regexp_extract_all(text, rule, F.lit(2)) if k == 0 else found
    pieces = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.greatest(F.size(found), F.lit(1))).alias("b"), value.alias("v")),
        lambda x: F.struct(F.lit(k).alias("kind"), F.length(x["b"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("size"), (_host(x["v"]) if KINDS[k] == "endpoint" else F.length(x["v"]) >= 6).alias("ok")),
    )
    none = F.array().cast("array<struct<kind:int,gap:bigint,size:bigint,ok:boolean>>")
    return F.when(text.rlike(RULES[KINDS[k]]), pieces).otherwise(none)


def scan(df: DataFrame, *, text_col: str = "text", scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """The columns of ``df`` in a struct ``row`` (without the text unless ``keep_text``) and ``spans``, an array of
    (kind, start, end) by start, then kind; code points, end exclusive."""
    names = [c for c in df.columns if keep_text or c != text_col]
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in names]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.struct(*quoted).alias("row"), F.monotonically_increasing_id().alias("rid"), F.concat(*(_parts(text, k) for k in range(len(KINDS)))).alias("parts"))
    docs = written(docs, "secret-parts")
    one = docs.select("row", "rid", F.posexplode_outer("parts").alias("at", "part"))
    one = one.select(F.when(F.coalesce("at", F.lit(0)) == 0, F.col("row")).alias("row"), "rid", "at", "part.*").repartition(F.col("rid"))
    # positions: sums of the lengths up to here, kind by kind
    so_far = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    at = one.select("row", "rid", "kind", "ok", (end - F.col("size")).alias("start"), end.alias("end"))
    # the sweep: nearest complementary part on either side, by kind
    before = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    good, linked = F.coalesce("ok", F.lit(False)), F.lit(False)
    sides = {}
    for name, kinds in {"secret": ("assign", "hex", "key"), "holder": ("access", "user", "endpoint")}.items():
        of = good & F.col("kind").isin([KINDS.index(x) for x in kinds])
        sides[name] = F.coalesce(F.col("start") - F.max(F.when(of, F.col("end"))).over(before) <= scope, F.lit(False)) | F.coalesce(F.min(F.when(of, F.col("start"))).over(behind) - F.col("end") <= scope, F.lit(False))
    for weak in KINDS[3:]:
        linked |= (F.col("kind") == KINDS.index(weak)) & sides["holder" if weak == "key" else "secret"]
    kept = at.withColumn("told", good & (F.col("kind").isin(0, 1, 2) | linked))
    span = F.when(F.col("told"), F.struct("start", "kind", "end"))
    whole = kept.groupBy("rid").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(span)).alias("spans"))
    kinds = F.array(*map(F.lit, KINDS))
    return whole.select("row", F.transform("spans", lambda s: F.struct(F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans become one mark."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
