"""Queries of the data-processing operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import changefeed, compaction, orphans, rejects, skew, topn
from weft.sources.tables import table

VERTEX_KEYS = {"person": "personId", "message": "id", "tag": "id", "place": "id", "forum": "id"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.bad_lines(rejects.parse_snapshot(table(spark, sf_dir, "raw_records")))


def p1_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = rejects.vertices(rejects.parse_snapshot(table(spark, sf_dir, "raw_records")))
    return good.select("file_name", "line_no", "vid", F.array_join("labels", ",").alias("labels"), F.col("props")["creationDate"].cast("bigint").alias("creationDate"))


def _orphans(spark: SparkSession, sf_dir: str) -> orphans.OrphanCheck:
    return orphans.OrphanCheck(table(spark, sf_dir, "edges"), {t: (table(spark, sf_dir, t), k) for t, k in VERTEX_KEYS.items()})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).rows().select("edge_id", "endpoint", "reason")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).counts()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "message").filter(F.col("deleted_at").isNull())
    return topn.top_n(live, "personId", "creationDate", "id", 10).select("personId", "id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.apply_changes(table(spark, sf_dir, "edge_log")).select("src", "dst", "edge_label", "seq")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.consolidated(table(spark, sf_dir, "part_files")).select("entity", "id")


def _chunks(spark: SparkSession, sf_dir: str, end: str) -> skew.KeyChunks:
    return skew.KeyChunks(table(spark, sf_dir, "edges"), end, "loaded_at", "label")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [_chunks(spark, sf_dir, e).heavy().select(F.lit(e).alias("endpoint"), F.col("key").alias("id")) for e in ("src", "dst")]
    return ends[0].unionByName(ends[1])


def p6_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = [_chunks(spark, sf_dir, e).results().select(F.lit(e).alias("endpoint"), F.col("key").alias("id"), F.col("n").alias("degree"), "max_gap_s", "label_changes") for e in ("src", "dst")]
    return ends[0].unionByName(ends[1])


QUERIES = {f.__name__: f for f in (p1_found, p1_vertices, p2_found, p2_counts, p3_found, p4_found, p5_found, p6_found, p6_profiles)}

_ORPHAN_ENDS = f"""
ends(label, src_t, dst_t) AS (VALUES {", ".join(f"('{k.lower()}', '{a}', '{b}')" for k, (a, b) in orphans.ENDS.items())}),
refs AS (
  SELECT e.edge_id, e.loaded_at, 'src' AS endpoint, src_t AS tab, e.src AS id FROM edges e JOIN ends ON lower(e.label) = ends.label WHERE e.src IS NOT NULL
  UNION ALL
  SELECT e.edge_id, e.loaded_at, 'dst', dst_t, e.dst FROM edges e JOIN ends ON lower(e.label) = ends.label WHERE e.dst IS NOT NULL),
vs AS ({" UNION ALL ".join(f"SELECT '{t}' AS tab, {k} AS id, loaded_at, deleted_at FROM {t}" for t, k in VERTEX_KEYS.items())}),
st AS (SELECT tab, id, min(loaded_at) AS first_loaded, bool_and(deleted_at IS NOT NULL) AS gone FROM vs GROUP BY ALL),
found AS (
  SELECT r.edge_id, r.endpoint, r.tab, strftime(r.loaded_at, '%Y-%m') AS period,
    CASE WHEN st.id IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_loaded > r.loaded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN st ON r.tab = st.tab AND r.id = st.id)"""

_LINES = f"""
layout(entity, n, d, header) AS (VALUES {", ".join(f"('{k}', {len(v)}, {v.index('creationDate') + 1}, '{'|'.join(v)}')" for k, v in rejects.ENTITY_COLUMNS.items())}),
lines AS (
  SELECT file_name, line_no, split_part(file_name, '/', 3) AS entity,
    regexp_replace(regexp_replace(line, '^\\x{{FEFF}}', ''), '\\r$', '') AS s FROM raw_records),
split AS (SELECT l.*, layout.n, layout.d, string_split(s, chr(34)) AS p FROM lines l JOIN layout USING (entity) WHERE trim(s) <> '' AND s <> header),
-- parts in odd places stand outside quotes: between two fields they begin and end with the separator, or are empty where a quote is doubled
quoted AS (
  SELECT *, len(p) = 1 OR (len(p) % 2 = 1 AND (p[1] = '' OR right(p[1], 1) = '|') AND (p[-1] = '' OR left(p[-1], 1) = '|')
      AND len(list_filter(p, lambda x, i: i % 2 = 1 AND i > 1 AND i < len(p) AND x <> '' AND NOT (left(x, 1) = '|' AND right(x, 1) = '|'))) = 0) AS quoted_well,
    string_split(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, '|', chr(1)) WHEN x = '' AND i > 1 AND i < len(p) THEN chr(2) ELSE x END), ''), '|') AS f
  FROM split),
judged AS (SELECT *, f[1] AS id_text, f[d] AS date_text FROM quoted),
typed AS (
  SELECT *, CASE WHEN regexp_full_match(id_text, '0*[0-9]{{1,19}}') THEN TRY_CAST(id_text AS BIGINT) END AS vid,
    CASE WHEN regexp_full_match(date_text, '0*[0-9]{{1,19}}') THEN TRY_CAST(date_text AS BIGINT) END AS created FROM judged),
reasons AS (
  SELECT *, CASE WHEN NOT quoted_well THEN 'quoting' WHEN len(f) <> n THEN 'columns'
    WHEN vid IS NULL OR created IS NULL OR created < {rejects.MIN_DATE} OR created >= {rejects.END_DATE} THEN 'value' END AS reason FROM typed)"""

_BODIES = f"""
layout(entity, names) AS (VALUES {", ".join(f"('{k}', {[c.lower() for c in v]})" for k, v in rejects.ENTITY_COLUMNS.items())}),
records AS (
  SELECT entity, names, regexp_extract_all(body, '(?:"(?:[^"]|"")*"|[^"\\r\\n\\x{{FEFF}}])+') AS r FROM (SELECT split_part(path, '/', 3) AS entity, body FROM part_files) JOIN layout USING (entity)),
headed AS (SELECT *, coalesce(list_sort(string_split(lower(r[1]), '|')) = list_sort(names), false) AS has FROM records),
parts AS (SELECT entity, list_position(CASE WHEN has THEN string_split(lower(r[1]), '|') ELSE names END, 'id') AS i, len(names) AS n, unnest(CASE WHEN has THEN r[2:] ELSE r END) AS s FROM headed),
cells AS (SELECT entity, n, i, regexp_extract_all('|' || s, '\\|("(?:[^"]|"")*"|[^|]*)', 1) AS f FROM parts)"""

ORACLE = {
    "p5_found": f"WITH {_BODIES} SELECT DISTINCT entity, TRY_CAST(trim(f[i], chr(34)) AS BIGINT) AS id FROM cells WHERE len(f) = n AND TRY_CAST(trim(f[i], chr(34)) AS BIGINT) IS NOT NULL",
    "p1_found": f"WITH {_LINES} SELECT DISTINCT file_name, line_no, reason FROM reasons WHERE reason IS NOT NULL",
    "p1_vertices": f"""WITH {_LINES} SELECT file_name, line_no, vid, CASE WHEN entity IN ('Post', 'Comment') THEN entity || ',Message' ELSE entity END AS labels, created AS "creationDate" FROM reasons WHERE reason IS NULL""",
    "p2_found": f"WITH {_ORPHAN_ENDS} SELECT edge_id, endpoint, reason FROM found WHERE reason IS NOT NULL",
    "p2_counts": f"WITH {_ORPHAN_ENDS} SELECT tab, period, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p3_found": """WITH live AS (SELECT DISTINCT "personId", "creationDate", id FROM message WHERE deleted_at IS NULL AND "personId" IS NOT NULL AND "creationDate" IS NOT NULL)
        SELECT "personId", id FROM live QUALIFY row_number() OVER (PARTITION BY "personId" ORDER BY "creationDate" DESC, id) <= 10""",
    "p4_found": """WITH done AS (SELECT DISTINCT seq, src, dst, edge_label, remove FROM edge_log WHERE committed = 1),
        swept AS (SELECT src, dst, max(seq) AS s FROM done WHERE remove = 1 AND edge_label IS NULL GROUP BY ALL),
        one AS (SELECT src, dst, edge_label, max(seq) FILTER (remove = 0) AS a, max(seq) FILTER (remove = 1) AS r FROM done WHERE edge_label IS NOT NULL GROUP BY ALL)
        SELECT src, dst, edge_label, a AS seq FROM one LEFT JOIN swept USING (src, dst) WHERE a IS NOT NULL AND a > coalesce(r, -1) AND a > coalesce(s, -1)""",
    "p6_found": """WITH t AS (SELECT count(*) AS n FROM edges), c AS (
          SELECT 'src' AS endpoint, src AS id, count(*) AS n FROM edges GROUP BY ALL UNION ALL SELECT 'dst', dst, count(*) FROM edges GROUP BY ALL)
        SELECT endpoint, id FROM c WHERE id IS NOT NULL AND n >= 0.02 * (SELECT n FROM t)""",
    # rows in the order of the table's one file
    "p6_profiles": """WITH r AS (SELECT src, dst, loaded_at, label, row_number() OVER () AS pos FROM edges),
        x AS (SELECT 'src' AS endpoint, src AS id, loaded_at, label, pos FROM r WHERE src IS NOT NULL UNION ALL SELECT 'dst', dst, loaded_at, label, pos FROM r WHERE dst IS NOT NULL),
        g AS (SELECT *, row_number() OVER w AS k, epoch_us(loaded_at) - epoch_us(lag(loaded_at) OVER w) AS gap, label IS DISTINCT FROM lag(label) OVER w AS turned FROM x WINDOW w AS (PARTITION BY endpoint, id ORDER BY pos))
        SELECT endpoint, id, count(*) AS degree, max(gap) / 1e6 AS max_gap_s, sum(CASE WHEN k > 1 AND turned THEN 1 ELSE 0 END)::BIGINT AS label_changes FROM g GROUP BY endpoint, id""",
}
