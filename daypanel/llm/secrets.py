"""Secret scan with multipart credential linking.

Strong spans are found by pattern alone: ``assign`` (a named value of 12 characters or more), ``access`` (an
access identifier of 18 or more) and ``hex`` (16 or more hex digits). Weak spans mean little by themselves and
are reported when their complement stands within ``SCOPE`` code points: ``short`` (a cut-off access identifier)
needs a secret, ``bare`` (a long token of mixed letters and digits) needs an access identifier, and ``endpoint``
(scheme and host of an address) needs both. Identifiers are access and short, secrets assign, hex and bare.

Positions are code points, end exclusive. They come from the pieces between matches: the text is split at the
pattern and the lengths of pieces and matches are added up. Linking is an interval join: parts are filed under
every cell of ``SCOPE`` code points they touch, summed up per document, cell and role (first start, last end),
and each weak span meets the cells that its reach touches, so no pairs of parts are made.

Null texts have no spans, like empty ones. Rows that repeat are scanned one by one. Empty tables give empty
results. Only doc_id and text are read, and only DataFrame functions are used; what one document holds is
bounded by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut

SCOPE = 300

# Fixed values of the scan. Letters of the names stand in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.:-]+"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

KINDS = ("assign", "access", "hex", "short", "bare", "endpoint")
BASE = KINDS[:3]
IDENTIFIERS, SECRETS = ("access", "short"), ("assign", "hex", "bare")


def _found(text: Column, gate: Column, pattern: str, ok) -> Column:
    """Per match in order: code points since the last match, length, and whether it counts; null without a match."""
    pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        whole,
        lambda m, i: F.struct(F.char_length(pieces[i]).alias("gap"), F.char_length(m).alias("len"), ok(m, i).alias("ok")),
    )
    return F.when(gate, rows)


def _kinds(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    named = F.lit(False)
    for name in NAMES:
        named = named | low.contains(name)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    keyed = text.contains("AKIA")
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    always = lambda m, i: F.lit(True)
    return {
        "assign": _found(text, named, ASSIGN, lambda m, i: F.char_length(values[i]) >= 12),
        "access": _found(text, keyed, ACCESS, lambda m, i: F.char_length(m) >= 18),
        "hex": _found(text, text.rlike(HEX), HEX, always),
        "short": _found(text, keyed, ACCESS, lambda m, i: F.char_length(m).between(8, 17)),
        # A bare secret needs an identifier and an endpoint needs both, so other texts need not be searched.
        "bare": _found(text, keyed, BARE, lambda m, i: mixed(m) & ~m.contains("AKIA")),
        "endpoint": _found(text, keyed & text.contains("://"), ENDPOINT, always),
    }


def parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and (row, kind, start, end) of all strong and weak matches."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", *[c.alias(k) for k, c in _kinds(text).items()])
    read = cut(read.withColumn("row", F.monotonically_increasing_id()))
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in KINDS])
    each = read.select("row", F.explode(listed).alias("l")).select("row", "l.kind", F.posexplode("l.found").alias("i", "m"))
    sofar = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = each.select("row", "kind", F.sum(F.col("m.gap") + F.col("m.len")).over(sofar).alias("end"), "m.len", "m.ok")
    return read.select("row", "doc_id"), spans.filter("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong spans, and the weak ones whose complement is in reach."""
    kind = F.col("kind")
    role = F.when(kind.isin(*IDENTIFIERS), "identifier").when(kind.isin(*SECRETS), "secret")
    cells = F.sequence(F.expr(f"start div {scope}"), F.expr(f"(end - 1) div {scope}"))
    filed = spans.withColumn("role", role).filter("role is not null").withColumn("cell", F.explode(cells))
    filed = filed.groupBy("row", "cell", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    low, high = F.col("start") - scope, F.col("end") + scope
    weak = spans.filter(~kind.isin(*BASE)).select("row", "kind", "start", "end", low.alias("low"), high.alias("high"))
    reach = F.sequence(F.expr(f"floor(low / {scope})"), F.expr(f"floor(high / {scope})"))
    near = weak.withColumn("cell", F.explode(reach)).join(filed, ["row", "cell"])
    near = near.filter((F.col("last") >= F.col("low")) & (F.col("first") <= F.col("high")))
    roles = near.groupBy("row", "kind", "start", "end").agg(
        F.max(F.col("role") == "identifier").alias("has_identifier"), F.max(F.col("role") == "secret").alias("has_secret")
    )
    complete = (
        F.when(kind == "short", F.col("has_secret"))
        .when(kind == "bare", F.col("has_identifier"))
        .otherwise(F.col("has_secret") & F.col("has_identifier"))
    )
    return spans.filter(kind.isin(*BASE)).unionByName(roles.filter(complete).select("row", "kind", "start", "end"))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per row of ``docs``: (start, kind number, end) structs in order."""
    rows, found = parts(docs)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    listed = linked(cut(found)).select("row", F.struct("start", number.alias("kind"), "end").alias("s"))
    gathered = listed.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(gathered, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
