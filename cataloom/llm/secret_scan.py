"""Secret scans with linking of multipart credentials.

Base spans are found by three patterns and always reported: ``assign`` (a named value of 6 characters or more), ``access``
(access identifiers) and ``hex`` (24 hexadecimal digits or more). Three weak kinds are candidates only: ``ident`` (a user or
client name given to a field), ``secret`` (a run of 20 to 200 letters and digits with both cases and a digit) and ``endpoint``
(a web address or host with a port). A part plays a role: identifier (access, ident), secret (assign, hex, secret) or endpoint. A weak
candidate is reported only if a part of another role lies within ``SCOPE`` code points of it: an interval join of the parts
by document and stretch of ``SCOPE`` code points.

Offsets are code points, ends exclusive. Null and empty texts have no spans: counts 0, the digest of the empty string, spans
empty. Rows equal in doc_id and text get equal results. Only ``doc_id`` and ``text`` are read. Texts never leave their scan;
parts are narrow rows, and a stretch of a text holds a bounded number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.llm.common import keyed, on_key, written

SCOPE = 200


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_FIELDS = "|".join(map(_any_case, ("username", "user", "login", "client_id", "account")))
#: kind -> (pattern, role); the order is the order of kinds at the same start
KINDS = {
    "assign": (rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", "identifier"),
    "hex": (r"[0-9a-f]{24,}", "secret"),
    "ident": (rf"(?:{_FIELDS})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]+", "identifier"),
    "secret": (r"[A-Za-z0-9+/]{20,200}", "secret"),
    "endpoint": (r"https?://[^\x00-\x20\"'<>]+|[A-Za-z0-9][A-Za-z0-9.-]*:[0-9]{2,5}/", "endpoint"),
}
BASE = ("assign", "access", "hex")


def _found(kind: str) -> Column:
    """Array of ``(kind, i, gap, size, good)``: the matches of a kind with the lengths of what stands before each."""
    pattern = KINDS[kind][0]
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    gaps = F.split("text", pattern, -1)
    good = {
        "assign": lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= 6,
        "secret": lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"),
    }.get(kind, lambda m: F.lit(True))
    pairs = F.transform(
        F.arrays_zip(gaps.alias("g"), whole.alias("m")),
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(list(KINDS).index(kind)).alias("k"), i.alias("i"), F.length(p["g"]).alias("gap"),
            F.length(p["m"]).alias("size"), good(p["m"]).alias("good"),
        ),
    )
    # the last gap has no match after it
    return F.when(F.col("text").rlike(pattern), F.filter(pairs, lambda p: p["size"].isNotNull())).otherwise(F.array())


def parts(docs: DataFrame) -> DataFrame:
    """``doc_id, th, kind, k, start, end`` of all parts, weak ones included."""
    every = F.explode(F.concat(*map(_found, KINDS))).alias("p")
    rows = keyed(docs).where("text is not null").select("doc_id", "th", every).select("doc_id", "th", "p.*").distinct()
    upto = Window.partitionBy("doc_id", "th", "k").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    return rows.withColumn("end", end).where("good").select("doc_id", "th", "kind", "k", (F.col("end") - F.col("size")).alias("start"), "end")


def _linked(found: DataFrame) -> DataFrame:
    """The weak parts that have a part of another role within SCOPE."""
    roles = F.create_map(*[x for kind, (_, role) in KINDS.items() for x in (F.lit(kind), F.lit(role))])
    found = found.withColumn("role", roles[F.col("kind")])
    reach = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    weak = found.where(~F.col("kind").isin(*BASE)).withColumn("stretch", reach(F.col("start"), F.col("end")))
    near = found.select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("role").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"),
        reach(F.col("start") - SCOPE, F.col("end") + SCOPE).alias("x"),
    )
    close = (
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("stretch") == F.col("x"))
        & (F.col("role") != F.col("r")) & (F.col("start") <= F.col("e") + SCOPE) & (F.col("s") <= F.col("end") + SCOPE)
    )
    return weak.join(near, close, "leftsemi").select("doc_id", "th", "kind", "k", "start", "end").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``."""
    found = written(parts(docs), "parts")
    kept = found.where(F.col("kind").isin(*BASE)).unionByName(_linked(found))
    spans = F.sort_array(F.collect_list(F.struct("start", "k", "end", "kind")))
    per_doc = kept.groupBy("doc_id", "th").agg(spans.alias("found"))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["k"] < len(BASE))
    number = lambda i: F.coalesce(F.size(F.filter("found", lambda s: s["k"] == i)), F.lit(0)).cast("bigint")
    rows = on_key(keyed(docs).drop("text"), per_doc, "left")
    rows = rows.withColumn("found", F.coalesce("found", F.array().cast(per_doc.schema["found"].dataType)))
    return rows.select(
        "doc_id", *(number(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"),
    )
