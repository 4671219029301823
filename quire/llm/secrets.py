"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns count by themselves. Weak ones (an identifier, a random-looking string,
an endpoint) say nothing alone; an interval join within a scope of code points looks
for their complementary parts, and only then are they reported.

Positions: a text splits at a pattern into the pieces between the matches, so running
sums of piece and match lengths are the matches' offsets in code points. Texts are
scanned once; what follows works on the lengths of matches, one row per match.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, table

#: Code points between two parts of one credential at most.
SCOPE = 200
NAMES = r"(password|passwd|secret|token|api_?key)"
#: kind: (pattern, group whose length counts, least length of it). The order is the order of ties.
BASE = {
    "assign": (rf"(?i:{NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"(AKIA[A-Z0-9]{16,})", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: Kinds that need a partner. ``blob``: 32 or more characters with a digit, a capital and a small letter.
WEAK = {
    "ident": (r"(?i:(access_?key_?id|client_?id|user_?name|login|account_?id))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]+)", 2, 3),
    "blob": (r"([A-Za-z0-9+/]{32,}={0,2})", 1, 32),
    "endpoint": (r"((?:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@-]+)", 1, 8),
}
KINDS = tuple(BASE | WEAK)
#: What a part can be in a credential.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "blob": "secret", "endpoint": "endpoint"}
#: Roles of which a weak kind needs one in its scope: each entry is a list of alternatives, all entries must hold.
NEEDS = {"ident": (("secret",),), "blob": (("identifier", "endpoint"),), "endpoint": (("identifier",), ("secret",))}


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap before the match, its length, whether it counts); null without a match."""
    pattern, group, least = (BASE | WEAK)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    rich = (lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")) if kind == "blob" else (lambda v: F.lit(True))
    lengths = F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("size"), ((F.length(v) >= least) & rich(v)).alias("ok")))
    gaps = F.transform(pieces, lambda p: F.length(p))
    both = F.zip_with(gaps, lengths, lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["ok"].alias("ok")))
    return F.when(text.rlike(pattern), both)


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without their text, as ``own``, staged: matches by kind, and ``__text``, a digest that stands for the text where it has any match.

    The only pass over the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("own"), text.alias("text"), *(_matches(text, k).alias(f"__{k}") for k in KINDS))
    matched = reduce(or_, (F.col(f"__{k}").isNotNull() for k in KINDS))
    return stage(out.withColumn("__text", F.when(matched, F.sha2(F.col("text").cast("binary"), 256))).drop("text"))


def parts(scanned: DataFrame) -> DataFrame:
    """``(__text, kind, start, end)`` of all matches that count, weak ones too; once for each different text."""
    texts = scanned.where(F.col("__text").isNotNull()).groupBy("__text").agg(*(F.first(f"__{k}").alias(f"__{k}") for k in KINDS))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"__{k}").alias("found")) for k in KINDS))
    rows = texts.select("__text", F.explode(kinds).alias("k")).select("__text", "k.kind", F.posexplode("k.found").alias("pos", "m"))
    rows = rows.where(F.col("m.size").isNotNull())  # the piece after the last match
    so_far = W.partitionBy("__text", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(so_far)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.size"))
    return rows.where("m.ok").select("__text", "kind", "start", "end")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Parts plus ``partners``, the nearest part of each role within the scope, and ``reported``.

    The interval join: parts lie in order of their starts. A part of a role that starts
    no later is within the scope when the farthest end among those does not lie more
    than ``scope`` before; one that starts later, when the first start does not lie more
    than ``scope`` behind. So each part meets its nearest partners in one sweep, and a
    text with many parts costs a sort, not its pairs. Only the nearest part of each role
    is kept: others within the scope are in no ``partners`` of this part, though whether
    a weak part is reported does not depend on them.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv)), F.col("kind"))
    rows = found.withColumn("__role", role).withColumn("__rank", rank)
    order = W.partitionBy("__text").orderBy("start", "__rank", "end")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    partners = []
    for r in ("identifier", "secret", "endpoint"):
        own = F.col("__role") == r
        last = F.max(F.when(own, F.struct("end", "start", "kind"))).over(before)
        rows = rows.withColumn(f"__last_{r}", last).withColumn(f"__next_{r}", F.min(F.when(own, F.struct("start", "end", "kind"))).over(after))
        near = lambda x: F.struct(F.lit(r).alias("role"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        a, b = F.col(f"__last_{r}"), F.col(f"__next_{r}")
        gap_a, gap_b = F.greatest(F.col("start") - a["end"], F.lit(0)), F.greatest(b["start"] - F.col("end"), F.lit(0))
        close_a, close_b = a.isNotNull() & (gap_a <= scope), b.isNotNull() & (gap_b <= scope)
        partners.append(F.when(close_a & (~close_b | (gap_a <= gap_b)), near(a)).when(close_b, near(b)))
    rows = rows.withColumn("partners", F.filter(F.array(*partners), lambda x: x.isNotNull()))
    has = lambda roles: F.exists("partners", lambda p: p["role"].isin(*roles))
    weak = F.lit(None)
    for kind, needs in NEEDS.items():
        every = F.lit(True)
        for roles in needs:
            every = every & has(roles)
        weak = F.when(F.col("kind") == kind, every).otherwise(weak)
    return rows.withColumn("reported", F.coalesce(weak, F.lit(True))).select("__text", "kind", "start", "end", "__rank", "partners", "reported")


def find_secrets(df: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The rows without ``text_col`` and with ``secrets``: an array of (start, rank, end, kind, partners), in order.

    All base matches, and the weak ones whose complementary parts lie within the scope.
    Null and empty texts, and texts without a match, have an empty array. Equal texts are
    searched once, and their rows, however many, get the result by a join that splits hot
    keys. An existing column ``secrets`` is replaced.
    """
    df = df.drop("secrets")
    scanned = scan(df, text_col)
    linked = link(parts(scanned), scope).where("reported")
    item = F.struct("start", F.col("__rank").alias("rank"), "end", "kind", "partners")
    by_text = linked.groupBy(F.col("__text").alias("__t")).agg(F.sort_array(F.collect_list(item)).alias("secrets"))
    kind = by_text.schema["secrets"].dataType
    hit = scanned.where(F.col("__text").isNotNull()).select("own", "__text")
    hit = hit.join(by_text, F.col("__text") == F.col("__t"), "left").select("own.*", F.coalesce("secrets", F.array().cast(kind)).alias("secrets"))
    return hit.unionByName(scanned.where(F.col("__text").isNull()).select("own.*", F.array().cast(kind).alias("secrets")))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda s: s["rank"] <= len(BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
