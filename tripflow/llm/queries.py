"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_completion, cuckoo_index, decontaminate, fill_in_middle, license_scan, line_dedup, pairwise_quality, ppm_language, prefix_trie, quality_rules, rendezvous, simhash, suffix_dedup
from ._spark import Tables, small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), windows=True, texts=license_scan.TEXTS)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.rule_table(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", ppm_language.held_out(F.col("doc_id")))
    model = pairwise_quality.train(docs.where("not held_out"), _table(spark, sf_dir, "labels"))
    scored = pairwise_quality.predict(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(_table(spark, sf_dir, "documents"))


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = rendezvous.assign(_table(spark, sf_dir, "documents"), [1.0] * 24, 1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", ppm_language.held_out(F.col("doc_id")))
    trees = ppm_language.train(docs.where("not held_out"))
    return ppm_language.predict(docs.select("doc_id", "held_out", "text"), trees).select("doc_id", "held_out", "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo_index.duplicates(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "trie")
    turns, convs = prefix_trie.grafted(prefix_trie.numbered(_table(spark, sf_dir, "conversations"), tables), tables)
    nodes, ends = prefix_trie.trie(turns, convs, tables)
    found = nodes.join(prefix_trie.id_digests(ends), prefix_trie.NODE, "left").drop("a", "b")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fill_in_middle.restored(), 256)}
    return made.withColumns(digests).drop("output")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_quality_rules, op3_line_dedup, op4_pairwise_quality, op5_suffix_dedup, op6_rendezvous_shards, op7_bin_completion, op8_decontaminate, op9_ppm_language, op10_simhash, op11_cuckoo_dedup, op12_prefix_trie, op13_fill_in_middle)
}


def _op1_sql() -> str:
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def normal(c: str) -> str:
        return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"

    def grams(w: str) -> str:
        return f"list_distinct(CASE WHEN len({w}) > 1 THEN [x[1] || ' ' || x[2] FOR x IN list_zip({w}[1:len({w}) - 1], {w}[2:len({w})])] ELSE {w} END)"

    known = ", ".join(f"({text(k)}, {text(t)})" for each in (license_scan.TEMPLATES, license_scan.TEXTS) for k, ts in each.items() for t in ts)
    dice = "2.0::DOUBLE * len(list_intersect(u, t)) / (len(u) + len(t))"
    return f"""
WITH known AS (SELECT license, row_number() OVER () AS id, {grams("w")} AS t FROM (SELECT license, string_split({normal("template")}, ' ') AS w FROM (VALUES {known}) v(license, template))),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT r, doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS body,
    unnest(range(CASE WHEN contains(text, chr(10)) THEN len(string_split(text, chr(10))) + 1 ELSE 1 END)) AS unit FROM docs),
split AS MATERIALIZED (SELECT r, doc_id, unit, string_split(w, ' ') AS w FROM (SELECT r, doc_id, unit, {normal("body")} AS w FROM units) WHERE w <> ''),
sets AS MATERIALIZED (SELECT r, doc_id, unit, {grams("w")} AS u FROM split),
hits AS (SELECT r, doc_id, unit, license, {dice} AS dice FROM sets JOIN known ON len(u) * 3 >= len(t) * 2 AND len(u) * 2 <= len(t) * 3),
best AS (SELECT *, row_number() OVER (PARTITION BY r, unit ORDER BY dice DESC, license) AS n FROM hits WHERE dice >= 0.8),
whole AS MATERIALIZED (SELECT r, doc_id, string_split(w, ' ') AS w FROM (SELECT r, doc_id, {normal("text")} AS w FROM docs)),
pairs AS MATERIALIZED (SELECT r, p, g, coalesce(lag(p) OVER (PARTITION BY r, g ORDER BY p), -1) AS before FROM (SELECT r, p, w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT r, w, unnest(range(len(w) - 1)) AS p FROM whole))),
hits_of AS (SELECT r, id, license, p, before, n FROM pairs JOIN (SELECT id, license, len(t) AS n, unnest(t) AS g FROM known) USING (g)),
near AS MATERIALIZED (SELECT * FROM hits_of SEMI JOIN (SELECT r, id FROM hits_of WHERE before < 0 GROUP BY r, id, n HAVING count(*) * 3 >= n * 2) USING (r, id)),
ends AS (SELECT a.r, a.id, a.license, a.n, a.p AS s, b.p AS e FROM near a JOIN near b ON a.r = b.r AND a.id = b.id AND b.p >= a.p AND (b.p - a.p + 1) * 2 <= a.n * 3),
counted AS (SELECT r, id, license, n, s, e, (SELECT count(*) FROM near h WHERE h.r = ends.r AND h.id = ends.id AND h.p BETWEEN s AND e AND h.before < s) AS h,
  (SELECT count(*) FROM pairs u WHERE u.r = ends.r AND u.p BETWEEN s AND e AND u.before < s) AS u FROM ends),
firsts AS (SELECT r, id, license, s, e + 2 AS e, 2.0::DOUBLE * h / (u + n) AS dice, row_number() OVER (PARTITION BY r, id, s ORDER BY 2.0::DOUBLE * h / (u + n) DESC, e) AS k FROM counted),
run_hits AS MATERIALIZED (SELECT DISTINCT r, license, s, e, dice FROM firsts WHERE k = 1 AND dice >= 0.8),
run_best AS (SELECT * FROM run_hits x ANTI JOIN run_hits y ON x.r = y.r AND y.s < x.e AND x.s < y.e AND (-y.dice, y.s - y.e, y.license, y.s) < (-x.dice, x.s - x.e, x.license, x.s)),
found AS (
  SELECT doc_id, license, dice, 1 AS n_units, NULL AS window_dice, 0 AS n_windows FROM best WHERE n = 1
  UNION ALL SELECT doc_id, license, NULL, 0, dice, 1 FROM run_best JOIN whole USING (r))
SELECT doc_id, license, max(dice) AS dice, CAST(sum(n_units) AS BIGINT) AS n_units, max(window_dice) AS window_dice, CAST(sum(n_windows) AS BIGINT) AS n_windows
FROM found GROUP BY doc_id, license"""


def _op8_sql() -> str:
    def words(c: str) -> str:
        low = f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words("text")}, []::VARCHAR[]) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM starts),
hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
hit_words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)"""


def _op6_sql() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295)"
    return f"""
WITH steps AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
body AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
bytes AS MATERIALIZED (SELECT doc_id, octet_length(b) + 8 AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM body),
rows AS MATERIALIZED (
  SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({crc} AS BIGINT) AS text_crc32,
    list_transform(range(25), lambda i: ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || i), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS d
  FROM bytes, steps),
placed AS (SELECT *, CAST(list_position(d, list_max(d[1:24])) - 1 AS INT) AS shard, CAST(list_position(d, list_max(d)) - 1 AS INT) AS grown_shard FROM rows)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || text_crc32), 1, 8), doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed"""


_OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""

_OP12_SQL = r"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
said AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
turns AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) - 1 AS pos, d, words FROM said),
lengths AS (SELECT c, count(*) AS own FROM turns GROUP BY c),
drawn AS (SELECT c, own, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda s, x: xor(s >> 8, t[CAST((xor(s, x) & 255) + 1 AS BIGINT)])), 4294967295) % 4 AS h FROM lengths, steps),
convs AS MATERIALIZED (SELECT drawn.c, h, base, least(h, coalesce(b.own, 0)) AS given FROM drawn LEFT JOIN lengths b ON b.c = base),
rebuilt AS (
  SELECT convs.c, pos - h + given AS pos, d, words FROM turns JOIN convs USING (c) WHERE pos >= h
  UNION ALL SELECT convs.c, pos, d, words FROM turns JOIN convs ON turns.c = base WHERE pos < h),
whole AS (SELECT c, list(d ORDER BY pos) AS ds, list(words ORDER BY pos) AS ws FROM rebuilt GROUP BY c),
paths AS MATERIALIZED (
  SELECT c, i AS depth, array_to_string(ds[1:i], ',') AS k, array_to_string(ds[1:i - 1], ',') AS up, ws[i] AS words, i = len(ds) AS ends FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM whole)
  UNION ALL SELECT c, 0, '', NULL, 0, c NOT IN (SELECT c FROM whole) FROM convs),
nodes AS MATERIALIZED (SELECT depth, k, up, words, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY depth, k, up, words),
children AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, k)),
below AS (SELECT p.depth, p.k, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens FROM full_nodes u JOIN paths p ON p.c = u.conv_id AND p.depth <= u.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (depth, k) LEFT JOIN nodes q ON q.depth = f.depth - 1 AND q.k = f.up"""

_OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM documents),
drawn AS (SELECT doc_id, t, string_split(t, chr(10)) AS parts, [CAST('0x' || x[8 * i + 1:8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM d),
sized AS (SELECT *, CAST(len(parts) - CAST(ends_with('x' || t, chr(10)) OR t = '' AS INT) AS BIGINT) AS n FROM drawn),
cuts AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM sized),
pieces AS (
  SELECT doc_id, t, n, form, CASE WHEN a = n THEN t WHEN a = 0 THEN '' ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS p,
    CASE WHEN b = n THEN t WHEN b = 0 THEN '' ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS pm FROM cuts),
made AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM pieces)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM made"""

ORACLE_SQL: dict[str, str] = {"op11_cuckoo_dedup": _OP11_SQL, "op12_prefix_trie": _OP12_SQL, "op13_fill_in_middle": _OP13_SQL, "op1_license_scan": _op1_sql(), "op6_rendezvous_shards": _op6_sql(), "op8_decontaminate": _op8_sql()}
