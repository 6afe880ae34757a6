"""The operators bound to the test tables: name -> builder, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrix.llm import (byte_bpe, chat_repair, decontaminate, host_rules, license_scan, line_dedup, mixing, near_dedup,
                          quality_classifier, spelling, substring_dedup, suffix_dedup, token_count)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Windows by their first place; bytes as hexadecimal digits, two a byte.
_OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, base, least(256, length(x) // 2 - 99 - base) AS n, substr(x, 2 * base + 1, 710) AS y
      FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 99, 0), 256)) AS base FROM d)),
w AS (SELECT doc_id, base + j AS i, hash(substr(y, 2 * j + 1, 200)) AS s
      FROM (SELECT doc_id, base, y, unnest(range(n)) AS j FROM c)),
f AS (SELECT s, min(doc_id * 1000000000 + i) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.i FROM w JOIN f ON w.s = f.s WHERE w.doc_id * 1000000000 + w.i <> f.first),
e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
p AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM p),
k AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
             string_agg(substr(d.x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head
      FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN d.x ELSE head || substr(d.x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@register("op1_suffix_dedup", _OP1_SQL)
def op1(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


_UP, _LOW = line_dedup._UPPER, line_dedup._LOWER
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_OP3_SQL = f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS n,
                  translate(trim(ls[i], {_STRIP}), '{_UP}', '{_LOW}') AS key
           FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
                 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, any_value(n)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.key = f.key GROUP BY doc_id
"""


@register("op3_line_dedup", _OP3_SQL)
def op3(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register("op4_decontaminate")
def op4(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WS, _H, _W = r"[\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]", r"[^\x20\x09-\x0D]"
# A sentence: words of a line up to one that ends in . ! or ?, with the white space before it.
_SENTENCE = rf"{_WS}*(?:{_W}*[^\x20\x09-\x0D.!?]{_H}+)*{_W}+"
_OP5_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SENTENCE}') AS ss FROM documents),
s AS (SELECT doc_id, j, ss[j] AS x, regexp_extract_all(ss[j], '{_W}+') AS ws,
             j = len(ss) OR regexp_matches(ss[j + 1], '^{_WS}*\x0A') AS closed
      FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS j FROM t)),
n AS (SELECT *, coalesce(sum((closed OR len(ws) >= {substring_dedup.SHORT_WORDS})::INT)
                         OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS u FROM s),
g AS (SELECT doc_id, u, string_agg(x, '' ORDER BY j) AS x, sum(len(ws)) AS words,
             translate(string_agg(array_to_string(ws, ' '), ' ' ORDER BY j), '{_UP}', '{_LOW}') AS key FROM n GROUP BY doc_id, u),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, u) > 1 AS again,
             coalesce(sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM g),
i AS (SELECT *, u - row_number() OVER (PARTITION BY doc_id, again ORDER BY u) AS island FROM f),
m AS (SELECT *, again AND sum(words) OVER (PARTITION BY doc_id, again, island) >= {substring_dedup.MIN_WORDS} AS gone FROM i),
r AS (SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed
      FROM (SELECT doc_id, min(a) AS lo, max(a + strlen(x)) AS hi FROM m WHERE gone GROUP BY doc_id, island) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_units, count_if(gone) AS n_removed,
             coalesce(string_agg(x, '' ORDER BY u) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '') || regexp_extract(t.t, '{_WS}*$')) AS kept_sha256, coalesce(removed, '') AS removed
FROM t LEFT JOIN k ON t.doc_id = k.doc_id LEFT JOIN r ON t.doc_id = r.doc_id
"""


@register("op5_substring_dedup", _OP5_SQL)
def op5(spark, sf_dir):
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_units", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), spans.alias("removed"))


@register("op6_quality_classifier")
def op6(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.learn(docs, labels)
    return quality_classifier.score(docs, model).select(
        "doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


_SPACE = r"[^\x20\x09-\x0D]+"
_OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, regexp_extract_all(t, '{_SPACE}') AS ws FROM d),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
        FROM (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
              FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n > 1) GROUP BY r),
ln AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w)
       WHERE regexp_matches(line, '{_SPACE}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
m AS (SELECT d.r, d.doc_id, d.host, len(w.ws) AS n_words,
             length(array_to_string(w.ws, '')) AS word_chars,
             length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN w ON d.r = w.r LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY host),
p AS (SELECT sum(f) / sum(n) AS mean, var_pop(f / n) AS v FROM h),
s AS (SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 0), 1e6) ELSE 1e6 END AS k FROM p),
v AS (SELECT host, (f + mean * k) / (n + k) > 0.75 AS host_failed FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM b JOIN v ON b.host IS NOT DISTINCT FROM v.host
"""


@register("op7_host_rules", _OP7_SQL)
def op7(spark, sf_dir):
    return host_rules.host_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op8_byte_bpe")
def op8(spark, sf_dir):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op9_token_count")
def op9(spark, sf_dir):
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)
      UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT w.doc_id, coalesce(c.n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) c
      ON w.doc_id = c.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a)
SELECT doc_id, any_value(n.n)::BIGINT AS n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY doc_id
"""


@register("op10_minhash", _OP10_SQL)
def op10(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


# CRC-32: table of 256 entries by the reflected polynomial, then a byte a step.
_CRC_TABLE = """
tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
               lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc)"""


def _crc_state(start: str, hexed: str) -> str:
    """State after the bytes of ``hexed`` (hexadecimal digits, two a byte)."""
    octets = f"list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    return f"list_reduce(list_prepend({start}, {octets}), lambda c, b: xor(c // 256, crc[(xor(c, b) % 256) + 1]))"


# Row by row: at most two insertions, then one edit; the least cost and audit of
# every state stay. A state is written as its cost in eight digits and its audit.
_OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
h AS (SELECT r.*, xor({_crc_state('4294967295', 'x')}, 4294967295) % 20 AS h FROM r, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             substr(role, 1, 1) AS c FROM dmg),
f0 AS (SELECT *, NOT regexp_matches(text, '{_W}') AS blank,
              row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
              substr(rtrim(text, {_STRIP}), -1) NOT IN ('.', '!', '?') AS open_end,
              lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS odd FROM o),
f AS (SELECT *, blank OR seen AS gone, NOT blank AND NOT seen AND open_end AS cut FROM f0),
e AS (SELECT conv_id, i, 'D' AS letter, NULL AS reads, 2 AS cost FROM f
      UNION ALL SELECT conv_id, i, 'K', c, 5 * cut::INT FROM f WHERE NOT gone AND c IN ('s', 'u', 'a')
      UNION ALL SELECT conv_id, i, 'R', w.c, 1 + 5 * cut::INT FROM f, (VALUES ('u'), ('a')) AS w(c) WHERE NOT gone),
step(q, reads, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, k, q2) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2),
                         (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, '00000000' AS best FROM (SELECT DISTINCT conv_id FROM conversations)
       UNION ALL
       SELECT conv_id, i, q, min(best) AS best FROM (
         SELECT dp.conv_id, e.i, coalesce(step.q2, ins.q2) AS q,
                printf('%08d', left(best, 8)::INT + 5 * k + cost) || substr(best, 9) || repeat('I', k) || letter AS best
         FROM dp JOIN ins ON ins.q = dp.q JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1
              LEFT JOIN step ON step.q = ins.q2 AND step.reads = e.reads
         WHERE e.reads IS NULL OR step.q2 IS NOT NULL) GROUP BY conv_id, i, q),
done AS (SELECT dp.conv_id, min(printf('%08d', left(best, 8)::INT + 5 * k) || substr(best, 9) || repeat('I', k)) AS best
         FROM dp JOIN ins ON ins.q = dp.q LEFT JOIN (SELECT conv_id, max(i) AS n FROM o GROUP BY conv_id) z
              ON z.conv_id IS NOT DISTINCT FROM dp.conv_id
         WHERE dp.i = coalesce(z.n, 0) AND ins.q2 IN (0, 3) GROUP BY dp.conv_id),
a AS (SELECT conv_id, left(best, 8)::BIGINT AS cost, substr(best, 9) AS audit FROM done),
l AS (SELECT conv_id, p, substr(audit, p, 1) AS letter, length(replace(left(audit, p), 'I', '')) AS i,
             length(replace(left(audit, p), 'D', '')) AS place
      FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM a)),
m AS (SELECT l.conv_id, p, letter, place, o.role, o.text,
             bool_or(letter = 'K' AND o.c = 's') OVER (PARTITION BY l.conv_id) AS leads
      FROM l LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM l.conv_id AND o.i = l.i WHERE letter <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - leads::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                 || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired
      FROM m GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
             count_if(seen AND NOT blank) AS duplicate, count_if(cut) AS truncated, count_if(odd) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


# Words one code point apart agree after one deletion: of both at one place
# (replaced), or of the longer one (inserted, deleted).
_OP13_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, hex(encode(coalesce(doc_id::VARCHAR, '') || ':')) AS x,
             translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
p AS (SELECT r, t, {_crc_state('4294967295', 'x')} AS start FROM d, tab),
w AS (SELECT r, start, run, hex(encode(run)) AS x, count(*) AS n
      FROM (SELECT r, start, unnest(regexp_extract_all(t, '[a-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run FROM p) GROUP BY r, start, run),
c AS (SELECT run, n, xor({_crc_state('start', 'x')}, 4294967295) AS h FROM w, tab),
v AS (SELECT word, sum(n)::BIGINT AS n
      FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                        ELSE run END AS word, n FROM c)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, length(word) AS m, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.m = b.m AND a.word <> b.word
         UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.less
         UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.less),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'other': other}}) AS top FROM near GROUP BY word),
k AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 5 * v.n THEN top.other END AS form,
             CASE WHEN -top.less >= 5 * v.n THEN -top.less END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk AS (SELECT word, word AS at, form AS next FROM k
         UNION ALL SELECT walk.word, k.word, k.form FROM walk JOIN k ON k.word = walk.next)
SELECT k.word, form, walk.at AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM k JOIN walk ON walk.word = k.word AND walk.next IS NULL
"""


@register("op11_chat_repair", _OP11_SQL)
def op11(spark, sf_dir):
    rows = chat_repair.damaged(table(spark, sf_dir, "conversations"))
    return chat_repair.repair(rows, copies_col="copies")


@register("op12_source_mix")
def op12(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op13_spelling_forms", _OP13_SQL)
def op13(spark, sf_dir):
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))
