"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_digests

    said = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return format_digests(turns.unionByName(hard)).drop("rewritten")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runtime import ensure_checkpoint_dir
    from .secret_scan import secret_digests_over_history

    return secret_digests_over_history(_table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_digests

    return quality_digests(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup_digests

    return line_dedup_digests(_table(spark, sf_dir, "documents")).drop("keep_bitmap")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_digests

    return bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages

    return identify_languages(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digests

    return mix_digests(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup_digests

    return substring_dedup_digests(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup_digests

    return near_dedup_digests(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_interactions

    return filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_digests

    return fingerprint_digests(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resampled

    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_fingerprints": op12_fingerprints,
    "op13_importance_resampling": op13_importance_resampling,
    "pipeline": pipeline,
}

#: Spaces that the contracts strip from the ends of lines.
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op1_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)""",
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r)),
s AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) AS n_escaped,
  CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) END AS n_role FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + n_role + 2 + n_escaped + 9) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id""",
    "op3_secret_scan": """
WITH rules(kind, place, pattern, least) AS (VALUES
  ('assign', 0, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+', 1),
  ('access', 1, 'AKIA[A-Z0-9]+', 20), ('hex', 2, '[0-9a-f]+', 24)),
cut AS (SELECT doc_id, kind, place, least, regexp_extract_all(coalesce(text, ''), pattern) AS m, string_split_regex(coalesce(text, ''), pattern) AS g FROM documents, rules
  WHERE kind <> 'hex' OR regexp_matches(coalesce(text, ''), '[0-9a-f]{24}')),
placed AS (SELECT doc_id, kind, place, least, m[i] AS s, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM cut)),
found AS (SELECT *, stop - length(s) AS begin FROM placed WHERE CASE WHEN kind = 'assign'
  THEN length(regexp_extract(s, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6 ELSE length(s) >= least END),
each AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS h,
  string_agg(kind || ':' || CAST(begin AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY begin, place) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN each e ON d.doc_id = e.doc_id""",
    "op5_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, pos, line, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
hot AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM hot)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM hot)), '')) AS kept_sha256
FROM lines GROUP BY doc_id""",
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.i FROM win JOIN low ON win.s = low.s WHERE low.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM hit),
each AS (SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM w)),
kept AS (SELECT e.doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS t
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op10_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept FROM documents d JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op11_filter_audit": r"""
WITH letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, k AS step, filter_order[k] AS f, substr(filter_order, 1, k - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN min(t.doc_id) OVER (PARTITION BY x) < t.doc_id THEN 'E' ELSE '' END AS fails FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, fails),
ran AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS alone, length(translate(fails, before, '')) < length(fails) AS gone FROM cells, steps),
r AS (SELECT part, filter_order, step, any_value(f) AS f, sum(n) FILTER (WHERE NOT gone AND NOT hit) AS kept, sum(n) FILTER (WHERE NOT gone AND hit) AS removed,
  sum(n) FILTER (WHERE gone AND hit) AS redundant, sum(n) FILTER (WHERE alone) AS unique_fails, sum(good) FILTER (WHERE NOT gone AND hit) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND hit) AS toxic_lost
  FROM ran GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
    "op13_importance_resampling": r"""
WITH table_of AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS MATERIALIZED (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
e AS MATERIALIZED (SELECT doc_id, unnest(words) AS word FROM w), f AS MATERIALIZED (SELECT unnest(words) AS word FROM b),
each AS (SELECT DISTINCT word FROM (SELECT word FROM e UNION ALL SELECT word FROM f)),
coded AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(word))), lambda k: (instr('0123456789ABCDEF', hex(encode(word))[2 * k + 1]) * 16 + instr('0123456789ABCDEF', hex(encode(word))[2 * k + 2]) - 17)::BIGINT)),
  lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS bucket FROM each, table_of),
s AS (SELECT bucket, count(*) AS s FROM e JOIN coded USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM f JOIN coded USING (word) GROUP BY bucket),
g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
n AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM e JOIN coded USING (word) JOIN g USING (bucket) GROUP BY doc_id),
scored AS (SELECT w.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || w.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM placed) // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id""",
}
