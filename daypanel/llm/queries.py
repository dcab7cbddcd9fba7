"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as D
from . import language, line_dedup, manifest, mixing, near_docs, near_vectors, repair, secrets, sharding, tokens, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT DISTINCT r.doc_id, r.i, r.n, win.item_id FROM runs r JOIN win ON r.words = win.words AND r.n = win.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM occ)) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""


@query("op5_benchmark_decontamination", DECONTAMINATION)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = D.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return judged.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        D.contaminated().alias("contaminated"),
    )


@query("op8_order_minhash")
def order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_docs.classes(table(spark, folder, "documents")).select("doc_id", "class_id", "kept", "n_shingles")


LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
e AS (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM l),
k AS (SELECT doc_id, i, a[i] AS line,
             {LOWER.format("trim(a[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM e),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c USING (key) GROUP BY doc_id
"""


@query("op3_levelled_line_dedup", LINE_DEDUP)
def levelled_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.without_common_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_bounded_ring_shards")
def bounded_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


MIXING = """
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(source, '') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS p FROM documents),
n AS (SELECT source, count(*) AS n FROM r GROUP BY source),
w AS (SELECT source, n, round(1000 * sqrt(n))::BIGINT AS w, count(*) OVER () AS s FROM n),
f AS (SELECT *, greatest(1000, 2 * s) - s AS free, greatest(sum(w) OVER (), 1)::BIGINT AS whole FROM w),
b AS (SELECT *, (free * w) // whole AS base, (free * w) % whole AS rest FROM f),
q AS (SELECT source, n, s, (1 + base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= free - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS q FROM b),
l AS (SELECT list(q ORDER BY source) AS qs, list(source ORDER BY source) AS names, sum(q)::BIGINT AS d FROM q),
step(t, done, pick) AS (
  SELECT -1::BIGINT, [0::BIGINT for x in qs], 0::BIGINT FROM l
  UNION ALL
  SELECT t + 1, [CASE WHEN i = v THEN done[i] + 1 ELSE done[i] END for i in generate_series(1, len(qs))], v
  FROM (
    SELECT t, done, qs, list_min([CASE WHEN done[i] * d // qs[i] <= t + 1
      THEN ((done[i] + 1) * d + qs[i] - 1) // qs[i] * 1000000 + i END for i in generate_series(1, len(qs))]) % 1000000 AS v
    FROM step, l WHERE t + 1 < d)),
plan AS (SELECT names[pick] AS source, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM step, l WHERE t >= 0),
dry AS (
  SELECT min((ceil(n / 16)::BIGINT // q) * d + t) AS horizon
  FROM q JOIN plan USING (source), l WHERE plan.k = ceil(n / 16)::BIGINT % q)
SELECT doc_id, source, p // 16 AS block, (p // 16 // q) * d + t AS slot, ((p // 16 // q) * d + t) * 16 + p % 16 AS position,
       (p // 16 // q) * d + t < horizon AS on_target
FROM r JOIN q USING (source) JOIN plan USING (source), l, dry WHERE plan.k = (p // 16) % q
"""


@query("op6_pfair_mixing", MIXING)
def pfair_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mixed(table(spark, folder, "documents"))
    return mix.select("doc_id", "source", "block", "slot", "position", "on_target")


@query("op2_string_kernel_toxicity")
def string_kernel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _matches(kind: str, pattern: str, ok: str) -> str:
    """SQL: (doc_id, kind, start, end) of the matches of a pattern that pass a test on the match ``m`` or its group 2, ``v``."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT doc_id, ms[i] AS m, vs[i] AS v,
           list_sum([length(x) for x in ps[1:i]])::BIGINT + list_sum([length(x) for x in ms[1:i]])::BIGINT AS e
    FROM (SELECT doc_id, ps, ms, vs, unnest(generate_series(1, len(ms))) AS i FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS ps, regexp_extract_all(text, '{pattern}') AS ms,
             regexp_extract_all(text, '{pattern}', {2 if kind == "assign" else 0}) AS vs FROM documents)))
  WHERE {ok}"""


SECRET_SCAN = f"""
WITH f AS ({" UNION ALL ".join([
    _matches("assign", secrets.ASSIGN, "length(v) >= 12"),
    _matches("access", secrets.ACCESS, "length(m) >= 18"),
    _matches("hex", secrets.HEX, "true"),
    _matches("short", secrets.ACCESS, "length(m) BETWEEN 8 AND 17"),
    _matches("bare", secrets.BARE, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND NOT contains(m, 'AKIA')"),
    _matches("endpoint", secrets.ENDPOINT, "true"),
])}),
p AS (SELECT *, CASE WHEN kind IN ('access', 'short') THEN 'i' WHEN kind IN ('assign', 'hex', 'bare') THEN 's' END AS role,
             list_position(['assign', 'access', 'hex', 'short', 'bare', 'endpoint'], kind) AS k FROM f),
w AS (
  SELECT p.doc_id, p.kind, p.s, p.e, p.k, bool_or(q.role = 'i') AS i, bool_or(q.role = 's') AS c
  FROM p JOIN p q ON p.doc_id = q.doc_id AND q.role IS NOT NULL AND q.e >= p.s - 300 AND q.s <= p.e + 300
  WHERE p.k > 3 GROUP BY ALL),
a AS (
  SELECT doc_id, kind, s, e, k FROM p WHERE k <= 3 UNION ALL
  SELECT doc_id, kind, s, e, k FROM w WHERE CASE kind WHEN 'short' THEN c WHEN 'bare' THEN i ELSE i AND c END),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k <= 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


@query("op7_linked_secrets", SECRET_SCAN)
def linked_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = secrets.written(F.filter("spans", lambda s: s["kind"] < len(secrets.BASE)))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


@query("op4_host_trust_filter")
def host_trust_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op9_fused_language")
def fused_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "pages"), table(spark, folder, "documents"))


NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, root) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.root = l.a),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id,
       vec_id <= coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.id LEFT JOIN n ON vec_id = n.id
"""


@query("op1_multi_index_vectors", NEAR_VECTORS)
def multi_index_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.linked(table(spark, folder, "embeddings"))


@query("op13_transducer_token_counts")
def transducer_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


# CRC-32 over the bytes of an ASCII string ``s``, with the table of its 256 one-byte remainders in column ``crc``.
CRC_TABLE = "(SELECT [list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) FOR x IN range(256)] AS crc)"
CRC = "xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split({s}, '')]), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _climb(name: str, rows: str) -> str:
    """SQL: the levels of binary trees (g, lvl, i, h), and how many there are in each."""
    return f"""
{name} AS (
  SELECT g, 0 AS lvl, i, h FROM {rows} UNION ALL
  SELECT g, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}) WHERE c > 1 GROUP BY g, lvl, i // 2),
{name}_top AS (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS h FROM {name} GROUP BY g)"""


def _path(name: str, tree: str, rows: str) -> str:
    """SQL: siblings and folded digests of rows (id, g, i, sibs, fold), a level per step."""
    return f"""
{name} AS (
  SELECT id, g, 0 AS lvl, i, sibs, fold FROM {rows} UNION ALL
  SELECT p.id, p.g, p.lvl + 1, p.i // 2, p.sibs || coalesce(s.h, ''),
         sha256(CASE WHEN p.i % 2 = 1 THEN s.h || p.fold ELSE p.fold || coalesce(s.h, '') END)
  FROM {name} p JOIN {tree}_top t ON t.g = p.g AND p.lvl < t.top LEFT JOIN {tree} s ON s.g = p.g AND s.lvl = p.lvl AND s.i = xor(p.i, 1))"""


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS leaf,
         CASE WHEN {CRC.format(s="doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS given
  FROM documents, {CRC_TABLE}),
r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_climb("low", "(SELECT g, i, leaf AS h FROM r)")},
sub AS (SELECT g AS lang, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM low_top),
{_climb("high", "sub")},
{_path("up", "low", "(SELECT id, g, i, '' AS sibs, given AS fold FROM r)")},
mid AS (SELECT up.id, sub.g, sub.i, up.sibs, up.fold FROM up JOIN low_top t ON t.g = up.g AND t.top = up.lvl JOIN sub ON sub.lang = up.g),
{_path("out", "high", "mid")}
SELECT r.doc_id, r.leaf, low_top.h AS subroot, high_top.h AS root, sha256(o.sibs) AS proof_sha256, o.fold AS folded_root, o.fold = high_top.h AS verified
FROM r JOIN low_top ON low_top.g = r.g JOIN out o ON o.id = r.id JOIN high_top ON o.lvl = high_top.top
"""


@query("op12_nested_merkle_manifest", MANIFEST)
def nested_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    given = F.when(touched, manifest.leaf(n_chars=F.col("n_chars") + 1)).otherwise(manifest.leaf())
    rows = manifest.manifest(table(spark, folder, "documents"), given=given)
    rows = rows.withColumn("folded_root", manifest.folded("given", "steps"))
    proof = F.sha2(F.array_join(manifest.siblings("steps"), ""), 256)
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _edit(label: str, cost: str, to: str, line: str | None = None) -> str:
    """SQL: a repair that goes on as ``to``, a struct of cost, audit and lines."""
    return f"{{c: {cost} + {to}.c, a: '{label}' || {to}.a, t: {f'list_prepend({line}, {to}.t)' if line else f'{to}.t'}}}"


def _row_edits(state: str, turns: dict[str, str]) -> str:
    """SQL: the best repair from a state that handles the row; ``turns`` maps the kinds it may be kept as to states."""
    keeps = [f"CASE WHEN stays AND kind = '{k}' THEN {_edit('K', 'extra', to, 'line')} END" for k, to in turns.items()]
    to, role = ("p", "assistant") if state == "u" else ("u", "user")
    given = f"CASE WHEN stays THEN {_edit('R', '(2 + extra)', to, f"('{role}:' || text)")} END"
    return f"list_min([{', '.join([_edit('D', '3', state), *keeps, given])}])"


REPAIR = f"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {CRC.format(s="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations, {CRC_TABLE}),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END))
  FROM h WHERE k <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS i FROM d),
f AS (
  SELECT *, left(role, 1) AS kind, role || ':' || text AS line,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM p),
g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM f),
t AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
go(conv_id, i, z, s, u, p) AS (
  SELECT conv_id, n, {{c: 0::BIGINT, a: '', t: []::VARCHAR[]}}, {{c: 4::BIGINT, a: 'II', t: ['user:', 'assistant:']}},
         {{c: 2::BIGINT, a: 'I', t: ['assistant:']}}, {{c: 0::BIGINT, a: '', t: []::VARCHAR[]}} FROM t
  UNION ALL
  SELECT conv_id, i, list_min([z, {_edit("I", "2", "u", "'user:'")}]), list_min([s, {_edit("I", "2", "u", "'user:'")}]), u, p
  FROM (
    SELECT conv_id, i, z, s, list_min([u, {_edit("I", "2", "p", "'assistant:'")}]) AS u, list_min([p, {_edit("I", "2", "u", "'user:'")}]) AS p
    FROM (
      SELECT g.conv_id, g.i, {_row_edits("z", {"s": "s", "u": "u"})} AS z, {_row_edits("s", {"u": "u"})} AS s,
             {_row_edits("u", {"a": "p"})} AS u, {_row_edits("p", {"u": "u"})} AS p
      FROM go JOIN g ON g.conv_id IS NOT DISTINCT FROM go.conv_id AND g.i = go.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0)::BIGINT AS cost, coalesce(z.a, '') AS audit,
       sha256(coalesce(array_to_string(z.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN go ON go.conv_id IS NOT DISTINCT FROM o.conv_id AND go.i = 0
"""


@query("op11_doubling_repair", REPAIR)
def doubling_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repair.repaired(conversations, repair.damaged(conversations))
