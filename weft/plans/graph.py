"""Queries of the property-graph operators over the whole social-network tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.props import key_values, prop
from weft.operators import algorithms as A
from weft.operators import dml, snb
from weft.operators.changelog import edge_changes, state_at
from weft.operators.graph import PropertyGraph
from weft.operators.orphans import ENDS
from weft.session import scratch_path
from weft.sources import snb_csv
from weft.sources.catalog import Database
from weft.sources.social import social_graph, vertices
from weft.sources.tables import table

QUERIES = {}
ORACLE = {}

# The loaded graph as SQL: v(tab, vid, primary_label, second_label, name, ...), e(src, dst, label, creationDate, property_c, undirected, is_reverse).
_LIVE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY loaded_at DESC NULLS LAST, {o}) AS rn FROM {t} WHERE deleted_at IS NULL AND {k} IS NOT NULL) WHERE rn = 1"""


def _live(t: str, k: str, *columns: str) -> str:
    return _LIVE.format(t=t, k=f'"{k}"', o=", ".join(f'"{c}" DESC NULLS LAST' for c in columns))


GRAPH = f"""
lp AS ({_live("place", "id", "label", "name", "part_of")}),
lt AS ({_live("tag", "id", "name", "tag_class")}),
lf AS ({_live("forum", "id", "title", "creationDate")}),
lu AS ({_live("person", "personId", "firstName", "lastName", "creationDate")}),
lm AS ({_live("message", "id", "label", "content", "creationDate", "personId")}),
v AS (
  SELECT 'place' AS tab, id AS vid, label AS l1, 'Place' AS l2, map {{'name': name}} AS p FROM lp
  UNION ALL SELECT 'tag', id, 'Tag', NULL, map {{'name': name, 'tagClass': tag_class}} FROM lt
  UNION ALL SELECT 'forum', id, 'Forum', NULL, map {{'title': title, 'creationDate': "creationDate"::VARCHAR}} FROM lf
  UNION ALL SELECT 'person', "personId", 'Person', NULL, map {{'firstName': "firstName", 'lastName': "lastName", 'creationDate': "creationDate"::VARCHAR}} FROM lu
  UNION ALL SELECT 'message', id, label, 'Message', map {{'content': content, 'creationDate': "creationDate"::VARCHAR}} FROM lm),
vl AS (SELECT vid, l1 AS label FROM v WHERE l1 IS NOT NULL UNION ALL SELECT vid, l2 FROM v WHERE l2 IS NOT NULL),
vp AS (SELECT vid, unnest(map_entries(p)).key AS key, unnest(map_entries(p)).value AS value FROM v),
ends(low, label, a, b) AS (VALUES {", ".join(f"('{k.lower()}', '{k}', '{a}', '{b}')" for k, (a, b) in ENDS.items())}),
e0 AS (SELECT edge_id, src, dst, ends.label, a, b, property_c, "creationDate" AS cd, row_number() OVER (
    PARTITION BY ends.label, CASE WHEN low = 'knows' THEN least(src, dst) ELSE src END, CASE WHEN low = 'knows' THEN greatest(src, dst) ELSE dst END ORDER BY edge_id) AS rn
  FROM edges JOIN ends ON lower(edges.label) = ends.low WHERE src IS NOT NULL AND dst IS NOT NULL),
e1 AS (SELECT src, dst, label, cd, property_c FROM e0 WHERE rn = 1 AND (a, src) IN (SELECT tab, vid FROM v) AND (b, dst) IN (SELECT tab, vid FROM v)
  UNION ALL SELECT id, "personId", 'hasCreator', NULL, NULL FROM lm WHERE "personId" IN (SELECT vid FROM v WHERE tab = 'person')
  UNION ALL SELECT id, part_of, 'isPartOf', NULL, NULL FROM lp WHERE part_of IN (SELECT vid FROM v WHERE tab = 'place')),
e AS (SELECT *, label = 'knows' AS undirected, false AS is_reverse FROM e1
  UNION ALL SELECT dst, src, label, cd, property_c, true, true FROM e1 WHERE label = 'knows' AND src <> dst)"""


def _query(name: str, sql: str | None, recursive: bool = False):
    """Register a query on the loaded graph; ``sql`` follows the graph's definitions."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(social_graph(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH}{sql}"
        return f

    return add


def _hub(g: PropertyGraph, rel: str, end: str) -> int:
    """The vertex with most edges of a relation at ``end``, the smallest id on a tie; -1 if there is none."""
    row = g.edges_of(rel).groupBy(end).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), end).first()
    return -1 if row is None else row[0]


def _hub_sql(rel: str, end: str) -> str:
    return f"(SELECT {end} FROM e WHERE label = '{rel}' GROUP BY 1 ORDER BY count(*) DESC, {end} LIMIT 1)"


EDGE = ["src", "dst", "label"]
EDGE_SQL = "e.src, e.dst, e.label"
BEFORE = 1700000000000
FRIENDLY, POPULAR, LIKER, LIKED, AUTHOR = _hub_sql("knows", "src"), _hub_sql("replyOf", "dst"), _hub_sql("likes", "src"), _hub_sql("likes", "dst"), _hub_sql("hasCreator", "dst")


def _is(label: str, column: str) -> str:
    return f"{column} IN (SELECT vid FROM vl WHERE label = '{label}')"


# scans and look-ups

_query("vertex_by_id", f" SELECT vl.vid, vl.label FROM vl WHERE vid = {FRIENDLY}")(lambda g: g.vertex(_hub(g, "knows", "src")).select("vid", F.explode("labels").alias("label")))
_query("vertex_exists", f" SELECT vid FROM v WHERE vid = {FRIENDLY}")(lambda g: g.vertex_exists(_hub(g, "knows", "src")))
_query(
    "vertices_filter",
    """, o AS (SELECT src, count(*) AS n, count(DISTINCT label) AS k FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1)
    SELECT vid, coalesce(o.n, 0) AS outdegree, coalesce(i.n, 0) AS indegree, coalesce(k, 0) AS edge_label_c FROM v LEFT JOIN o ON o.src = vid LEFT JOIN i ON i.dst = vid WHERE coalesce(o.n, 0) > 5 AND coalesce(i.n, 0) < 3""",
)(lambda g: g.vertices_where((F.col("outdegree") > 5) & (F.col("indegree") < 3)).select("vid", "outdegree", "indegree", "edge_label_c"))
_query("vertices_by_label", " SELECT vid FROM vl WHERE label = 'Post'")(lambda g: g.with_label("Post").select("vid"))
_query("vertex_preview", " SELECT f.vid, count(e.src) AS outdegree FROM (SELECT vid FROM v ORDER BY vid LIMIT 5) f LEFT JOIN e ON e.src = f.vid GROUP BY 1")(lambda g: g.preview(5))
_query("edges_filter", " SELECT src, dst, label FROM e WHERE cd >= 1700000000000")(lambda g: g.edges_where(prop("creationDate", "bigint") >= BEFORE).select(*EDGE))
_query("edges_by_label", " SELECT src, dst, label FROM e WHERE label = 'hasInterest'")(lambda g: g.edges_of("hasInterest").select(*EDGE))


def _pair(g: PropertyGraph, rel: str) -> tuple[int, int]:
    row = g.edges_of(rel).select("src", "dst").orderBy("src", "dst").first()
    return (-1, -1) if row is None else (row[0], row[1])


def _pair_sql(rel: str) -> str:
    return f"(SELECT src, dst FROM e WHERE label = '{rel}' ORDER BY src, dst LIMIT 1)"


_query("edges_between", f" SELECT src, dst, label FROM e WHERE (src, dst) IN {_pair_sql('likes')}")(lambda g: g.between(*_pair(g, "likes")).select(*EDGE))


def _exists(g: PropertyGraph) -> DataFrame:
    src, dst = _pair(g, "knows")
    return g.edge_exists(src, "knows", dst)


_query("edge_exists", f" SELECT src, dst, label FROM e WHERE label = 'knows' AND (src, dst) IN {_pair_sql('knows')}")(_exists)
_query("edges_from_label", f" SELECT {EDGE_SQL} FROM e WHERE {_is('Forum', 'src')} AND property_c > 0")(lambda g: g.pattern("Forum", predicate=prop("property_c", "int") > 0).select(*EDGE))
_query("edges_label_rel_pred", f" SELECT {EDGE_SQL} FROM e WHERE label = 'hasTag' AND {_is('Post', 'src')} AND cd < {BEFORE}")(lambda g: g.pattern("Post", "hasTag", predicate=prop("creationDate", "bigint") < BEFORE).select(*EDGE))
_query("edges_label_rel", f" SELECT {EDGE_SQL} FROM e WHERE label = 'hasTag' AND {_is('Comment', 'src')}")(lambda g: g.pattern("Comment", "hasTag").select(*EDGE))
_query("edges_label_rel_label", f" SELECT {EDGE_SQL} FROM e WHERE label = 'replyOf' AND {_is('Comment', 'src')} AND {_is('Post', 'dst')}")(lambda g: g.pattern("Comment", "replyOf", "Post").select(*EDGE))
_query("in_edges_by_rel", f" SELECT {EDGE_SQL} FROM e WHERE label = 'hasCreator' AND {_is('Message', 'src')} AND dst = {AUTHOR}")(lambda g: g.pattern("Message", "hasCreator", _hub(g, "hasCreator", "dst")).select(*EDGE))
_query("out_edges_by_rel", f" SELECT {EDGE_SQL} FROM e WHERE label = 'knows' AND {_is('Person', 'dst')} AND src = {FRIENDLY}")(lambda g: g.pattern(_hub(g, "knows", "src"), "knows", "Person").select(*EDGE))
_query("out_edges", f" SELECT {EDGE_SQL} FROM e WHERE src = {FRIENDLY} AND cd < {BEFORE}")(lambda g: g.pattern(_hub(g, "knows", "src"), predicate=prop("creationDate", "bigint") < BEFORE).select(*EDGE))
_query("neighbours", f" SELECT DISTINCT dst FROM e WHERE src = {FRIENDLY}")(lambda g: g.neighbours(_hub(g, "knows", "src")))
_query("neighbours_by_rel", f" SELECT DISTINCT dst FROM e WHERE src = {LIKER} AND label = 'likes' AND {_is('Post', 'dst')}")(lambda g: g.neighbours(_hub(g, "likes", "src"), "likes", "Post"))
_query(
    "path_k_hop",
    f""", h1 AS (SELECT DISTINCT dst FROM e WHERE src = {FRIENDLY} AND label = 'knows' AND {_is("Person", "dst")}), h2 AS (SELECT DISTINCT e.dst FROM e JOIN h1 ON e.src = h1.dst WHERE label = 'knows' AND {_is("Person", "e.dst")})
    SELECT {EDGE_SQL} FROM e WHERE label = 'hasInterest' AND src IN (SELECT dst FROM h2) AND {_is("Tag", "e.dst")}""",
)(lambda g: g.path(_hub(g, "knows", "src"), [("knows", "Person"), ("knows", "Person"), ("hasInterest", "Tag")]).select(*EDGE))
_query("inverse_graph", " SELECT dst AS src, src AS dst, label FROM e")(lambda g: g.inverse())

# properties

_query("vertex_properties", f" SELECT vid, key, value FROM vp WHERE vid = {FRIENDLY} AND value IS NOT NULL")(lambda g: g.vertex_properties(_hub(g, "knows", "src")))
_query("vertex_property_map", " SELECT vid, key, value FROM vp JOIN vl USING (vid) WHERE label = 'Person' AND value IS NOT NULL")(lambda g: key_values(g.with_label("Person"), "vid"))
_query("edge_properties", " SELECT src, dst, label, unnest(['creationDate', 'property_c']) AS key, unnest([cd::VARCHAR, property_c::VARCHAR]) AS value FROM e WHERE label = 'likes' AND cd IS NOT NULL AND property_c IS NOT NULL")(
    lambda g: g.edge_properties((F.col("label") == "likes") & F.col("props")["creationDate"].isNotNull() & F.col("props")["property_c"].isNotNull())
)

# statistics

_query(
    "graph_summary",
    """ SELECT (SELECT count(*) FROM v) AS num_vertices, (SELECT count(DISTINCT label) FROM vl) AS num_vertex_labels, (SELECT count(*) FROM e WHERE NOT is_reverse) AS num_edges, (SELECT count(*) FROM e) AS num_edge_records,
    (SELECT count(DISTINCT label) FROM e) AS num_edge_labels, round((SELECT count(*) FROM e WHERE NOT is_reverse) / (SELECT count(*) FROM v), 4) AS avg_out_degree""",
)(lambda g: g.summary())
_query("vertex_label_counts", " SELECT label, count(*) AS item_c FROM vl GROUP BY 1")(lambda g: g.vertex_label_counts())
_query("edge_label_counts", " SELECT label, count(*) AS item_c FROM e WHERE NOT is_reverse GROUP BY 1")(lambda g: g.edge_label_counts())
_query("label_dictionary", " SELECT DISTINCT 'vertex' AS kind, label FROM vl UNION ALL SELECT DISTINCT 'edge', label FROM e")(lambda g: g.label_dictionary())
_query("out_degree_of", f" SELECT {AUTHOR} AS vid, (SELECT count(*) FROM e WHERE src = {AUTHOR}) AS degree")(lambda g: g.degree_of(_hub(g, "hasCreator", "dst"), "src"))
_query("in_degree_of", f" SELECT {AUTHOR} AS vid, (SELECT count(*) FROM e WHERE dst = {AUTHOR}) AS degree")(lambda g: g.degree_of(_hub(g, "hasCreator", "dst"), "dst"))
_query("out_degrees", " SELECT vid, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = vid GROUP BY 1")(lambda g: g.degrees("src"))
_query("in_degrees", " SELECT vid, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = vid GROUP BY 1")(lambda g: g.degrees("dst"))
_query("dense_vertex_ids", " SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS idx FROM v")(lambda g: g.dense_ids())
_query(
    "subgraph_summary",
    ", s AS (SELECT src, dst FROM e WHERE label = 'replyOf'), n AS (SELECT src AS vid FROM s UNION SELECT dst FROM s) SELECT (SELECT count(*) FROM n) AS num_vertices, (SELECT count(*) FROM s) AS num_edges, (SELECT count(DISTINCT src) FROM s) AS num_sources, (SELECT count(DISTINCT dst) FROM s) AS num_targets",
)(
    lambda g: (lambda s: s.vertices.agg(F.count(F.lit(1)).alias("num_vertices")).crossJoin(s.edges.agg(F.count(F.lit(1)).alias("num_edges"), F.count_distinct("src").alias("num_sources"), F.count_distinct("dst").alias("num_targets"))))(
        PropertyGraph.from_edges(g.edges_of("replyOf"))
    )
)
_query("aggregate_messages", " SELECT e.dst AS vid, min(e.src) AS msg FROM e GROUP BY 1")(lambda g: A.aggregate_messages(g.edges, g.vertices.select("vid"), F.col("vid"), F.min))

# writes: the rows that a write leaves or changes

_query("dml_add_vertex", " SELECT label, count(*) AS n FROM (SELECT label FROM vl UNION ALL SELECT unnest(['Person', 'Robot'])) GROUP BY 1")(
    lambda g: dml.add_vertex(dml.add_vertex(g, -7, ["Person", "Robot"], {"firstName": "R"}), -7, ["Ignored"], {}).vertices.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
)
_query("dml_add_vertex_auto", " SELECT max(vid) + 1 AS vid, 'Robot' AS label FROM v")(lambda g: dml.add_vertex_auto(g, ["Robot"], {}).with_label("Robot").select("vid", F.explode("labels").alias("label")))


def _add_edge(undirected: bool):
    def run(g: PropertyGraph) -> DataFrame:
        a, b = _hub(g, "knows", "src"), _hub(g, "replyOf", "dst")
        g = dml.add_edge(g, a, b, "follows", {"since": "1"}, undirected)
        g = dml.add_edge(g, a, b, "follows", {"since": "2"}, undirected)
        g = dml.add_edge(g, a, -99, "follows", {}, undirected)
        return g.edges_of("follows").select("src", "dst", "label", prop("since"), "is_reverse")

    return run


_query("dml_add_edge", f" SELECT {FRIENDLY} AS src, {POPULAR} AS dst, 'follows' AS label, '1' AS since, false AS is_reverse")(_add_edge(False))
_query("dml_add_edge_undirected", f" SELECT {FRIENDLY} AS src, {POPULAR} AS dst, 'follows' AS label, '1' AS since, false AS is_reverse UNION ALL SELECT {POPULAR}, {FRIENDLY}, 'follows', '1', true")(_add_edge(True))


def _after(g: PropertyGraph) -> DataFrame:
    return g.edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


_AFTER = " SELECT label, count(*) AS n, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM e WHERE {0} GROUP BY 1"
_query("dml_rm_vertex", _AFTER.format(f"src <> {FRIENDLY} AND dst <> {FRIENDLY}"))(lambda g: _after(dml.rm_vertex(g, _hub(g, "knows", "src"))))
_query("dml_rm_edge", _AFTER.format(f"NOT ((src, dst) IN {_pair_sql('knows')})"))(lambda g: _after(dml.rm_edge(g, *_pair(g, "knows"))))
_query("dml_rm_edge_label", _AFTER.format(f"NOT (label = 'likes' AND (src, dst) IN {_pair_sql('likes')})"))(lambda g: _after(dml.rm_edge(g, *_pair(g, "likes"), "likes")))
_query("prune_dangling", _AFTER.format(f"NOT ({_is('Tag', 'dst')}) AND NOT ({_is('Tag', 'src')})"))(lambda g: _after(dml.prune(PropertyGraph(g.vertices.filter(~F.array_contains("labels", "Tag")), g.edges))))

# interactive queries

_NAME = "(SELECT value FROM vp WHERE vp.vid = {0} AND key = '{1}')"
_PEOPLE = """, pe AS (SELECT vid, p['firstName'] AS first, p['lastName'] AS last FROM v WHERE tab = 'person'), ms AS (SELECT vid, l1, p['content'] AS content, p['creationDate']::BIGINT AS date FROM v WHERE tab = 'message'),
cr AS (SELECT src AS message, dst AS creator FROM e WHERE label = 'hasCreator')"""
_query(
    "snb_ic2",
    f"""{_PEOPLE} SELECT creator AS "personId", first AS "personFirstName", last AS "personLastName", message AS "postOrCommentId", date AS "postOrCommentCreationDate"
    FROM cr JOIN ms ON ms.vid = message JOIN pe ON pe.vid = creator WHERE creator IN (SELECT dst FROM e WHERE label = 'knows' AND src = {FRIENDLY}) AND date < {BEFORE} ORDER BY date DESC, message LIMIT 20""",
)(lambda g: snb.recent_messages_of_friends(g, _hub(g, "knows", "src"), BEFORE))
_query(
    "snb_ic8",
    f"""{_PEOPLE}, r AS (SELECT DISTINCT src FROM e WHERE label = 'replyOf' AND dst IN (SELECT message FROM cr WHERE creator = {AUTHOR}))
    SELECT creator AS "personId", first AS "personFirstName", last AS "personLastName", date AS "commentCreationDate", message AS "commentId", content AS "commentContent"
    FROM r JOIN ms ON ms.vid = r.src AND l1 = 'Comment' JOIN cr ON message = r.src JOIN pe ON pe.vid = creator ORDER BY date DESC NULLS LAST, message LIMIT 20""",
)(lambda g: snb.recent_replies(g, _hub(g, "hasCreator", "dst")))
_query(
    "snb_is2",
    f"""{_PEOPLE}, top AS (SELECT message, date FROM cr JOIN ms ON ms.vid = message WHERE creator = {AUTHOR} ORDER BY date DESC NULLS LAST, message DESC LIMIT 10),
    w(message, node, hops) USING KEY (message, node) AS (SELECT message, message, 0 FROM top
      UNION SELECT w.message, e.dst, min(w.hops) + 1 FROM w JOIN e ON e.src = w.node AND e.label = 'replyOf' WHERE NOT EXISTS (SELECT 1 FROM recurring.w AS r WHERE r.message = w.message AND r.node = e.dst) GROUP BY w.message, e.dst),
    roots AS (SELECT message, node FROM w WHERE node IN (SELECT vid FROM ms WHERE l1 = 'Post') QUALIFY row_number() OVER (PARTITION BY message ORDER BY hops, node) = 1),
    au AS (SELECT cr.message, creator, first, last FROM cr JOIN pe ON pe.vid = creator)
    SELECT top.message AS "messageId", date AS "messageCreationDate", node AS "postId", creator AS "personId", first AS "personFirstName", last AS "personLastName" FROM top LEFT JOIN roots USING (message) LEFT JOIN au ON au.message = node""",
    recursive=True,
)(lambda g: snb.person_messages(g, _hub(g, "hasCreator", "dst")))
_query(
    "snb_is7",
    f"""{_PEOPLE} SELECT message AS "commentId", content AS "commentContent", date AS "commentCreationDate", creator AS "replyAuthorId", first AS "replyAuthorFirstName", last AS "replyAuthorLastName",
    creator IN (SELECT dst FROM e WHERE label = 'knows' AND src IN (SELECT c2.creator FROM cr c2 WHERE c2.message = {POPULAR})) AS "replyAuthorKnowsOriginalMessageAuthor"
    FROM (SELECT DISTINCT src FROM e WHERE label = 'replyOf' AND dst = {POPULAR}) r JOIN ms ON ms.vid = r.src AND l1 = 'Comment' JOIN cr ON message = r.src JOIN pe ON pe.vid = creator""",
)(lambda g: snb.replies_of(g, _hub(g, "replyOf", "dst")))
_query("snb_iu2", f" SELECT {LIKER} AS src, {POPULAR} AS dst, 'likes' AS label UNION SELECT src, dst, label FROM e WHERE label = 'likes' AND src = {LIKER}")(
    lambda g: (lambda a, b: snb.add_like(g, a, b, BEFORE).pattern(a, "likes").select(*EDGE))(_hub(g, "likes", "src"), _hub(g, "replyOf", "dst"))
)
_query("snb_iu8", f""" SELECT src, dst, label FROM e WHERE label = 'knows' AND (src = {LIKER} OR dst = {LIKER}) UNION SELECT {LIKER}, {AUTHOR}, 'knows' UNION SELECT {AUTHOR}, {LIKER}, 'knows'""")(
    lambda g: (lambda a, b: snb.add_friendship(g, a, b, BEFORE).edges_of("knows").filter((F.col("src") == a) | (F.col("dst") == a)).select(*EDGE))(_hub(g, "likes", "src"), _hub(g, "hasCreator", "dst"))
)
_query("snb_id2", " SELECT least(count(*), 1) AS deleted, (SELECT greatest(count(*) - 1, 0) FROM e WHERE label = 'likes') AS remaining FROM e WHERE label = 'likes'")(
    lambda g: (lambda r: r[1].crossJoin(r[0].edges_of("likes").agg(F.count(F.lit(1)).alias("remaining"))))(snb.remove_like(g, *_pair(g, "likes")))
)
_query("snb_id7", f", gone AS (SELECT DISTINCT src FROM e WHERE label = 'replyOf' AND dst = {POPULAR} AND {_is('Comment', 'src')})" + _AFTER.format("src NOT IN (SELECT src FROM gone) AND dst NOT IN (SELECT src FROM gone)"))(
    lambda g: _after(snb.remove_replies(g, _hub(g, "replyOf", "dst"))[0])
)
_query("snb_id8", " SELECT 1 AS deleted, (SELECT count(*) FROM e WHERE label = 'knows') - (SELECT count(DISTINCT (x.src, x.dst)) FROM e x, (SELECT src AS s, dst AS d FROM e WHERE label = 'knows' ORDER BY src, dst LIMIT 1) y WHERE x.label = 'knows' AND ((x.src = s AND x.dst = d) OR (x.src = d AND x.dst = s))) AS remaining")(
    lambda g: (lambda r: r[1].crossJoin(r[0].edges_of("knows").agg(F.count(F.lit(1)).alias("remaining"))))(snb.remove_friendship(g, *_pair(g, "knows")))
)

# algorithms: on every vertex and every edge of every label

_PR = """{0}, deg AS (SELECT src, count(*) AS d FROM re GROUP BY 1), c AS (SELECT count(*) AS n FROM n),
pr(i, vid, r) AS (SELECT 0, vid, 1.0::DOUBLE / (SELECT n FROM c) FROM n
  UNION ALL (WITH y AS (SELECT dst AS vid, sum(0.85 * pr.r / deg.d) AS y FROM pr JOIN re ON re.src = pr.vid JOIN deg ON deg.src = re.src GROUP BY 1), k AS (SELECT max(i) AS i FROM pr)
    SELECT k.i + 1, n.vid, coalesce(y.y, 0) + (1 - (SELECT sum(y) FROM y)) / (SELECT n FROM c) FROM n LEFT JOIN y USING (vid), k WHERE k.i < {1}))"""
_ALL = ", re AS (SELECT src, dst FROM e), n AS (SELECT vid FROM v)"
_RANKS = " SELECT vid, round(r, 8) AS rank FROM pr WHERE i = 20"
_RESIDUAL = f""" {_PR.format(_ALL, 100)}, moves AS (SELECT i, sum(abs(r - before)) AS delta FROM (SELECT i, r, lag(r) OVER (PARTITION BY vid ORDER BY i) AS before FROM pr) GROUP BY i HAVING i > 0),
last AS (SELECT round(delta, 10) AS result FROM moves WHERE delta <= 1e-7 OR i = 100 ORDER BY i LIMIT 1)"""


def _ranks(g: PropertyGraph) -> DataFrame:
    return A.pagerank(g, 20, None)[0].select("vid", F.round("rank", 8).alias("rank"))


_query("pagerank", _PR.format(_ALL, 20) + _RANKS, recursive=True)(_ranks)
_query("pagerank_residual", f"{_RESIDUAL} SELECT result FROM last", recursive=True)(lambda g: A.run_algorithm(g, "pagerank").select(F.round("result", 10).alias("result")))
_WCC = """{0}, sym AS (SELECT src, dst FROM re UNION SELECT dst, src FROM re),
cc(id, lbl) USING KEY (id) AS (SELECT vid, vid FROM n UNION SELECT s.dst, min(cc.lbl) FROM cc JOIN sym s ON s.src = cc.id JOIN recurring.cc AS r ON r.id = s.dst WHERE cc.lbl < r.lbl GROUP BY s.dst)"""
_query("wcc_labels", f"{_WCC.format(_ALL)} SELECT id AS vid, lbl AS component FROM cc", recursive=True)(lambda g: A.wcc(g))
_query("wcc_count", f"{_WCC.format(_ALL)} SELECT count(DISTINCT lbl)::DOUBLE AS result FROM cc", recursive=True)(lambda g: A.run_algorithm(g, "wcc"))
_MIN = f"""{_ALL}, ids AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS idx FROM n), od AS (SELECT vid, idx, count(re.src) AS d FROM ids LEFT JOIN re ON re.src = vid GROUP BY 1, 2),
hub AS (SELECT idx AS h FROM od ORDER BY d DESC, idx LIMIT 1),
ml(id, lbl) USING KEY (id) AS (SELECT vid, CASE WHEN idx = 0 THEN h WHEN idx = h THEN 0 ELSE idx END FROM ids, hub
  UNION SELECT s.dst, min(ml.lbl) FROM ml JOIN re s ON s.src = ml.id JOIN recurring.ml AS r ON r.id = s.dst WHERE ml.lbl < r.lbl GROUP BY s.dst)
SELECT id AS vid, CASE WHEN lbl = 0 THEN h WHEN lbl = h THEN 0 ELSE lbl END AS label FROM ml, hub"""
_query("directed_min_label", _MIN, recursive=True)(lambda g: A.directed_min_label(g).select("vid", "label"))
# The component of one vertex is what it reaches and is reached from. What is left without it is small enough for a transitive closure, over
# vertices with edges both in and out; a path between two vertices of another component never leaves that.
_SCC = f""", re AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), n AS (SELECT vid FROM v),
fw(id, d) USING KEY (id) AS (SELECT {FRIENDLY}, 0 UNION SELECT re.dst, 1 FROM fw JOIN re ON re.src = fw.id WHERE NOT EXISTS (SELECT 1 FROM recurring.fw AS r WHERE r.id = re.dst) GROUP BY re.dst),
bw(id, d) USING KEY (id) AS (SELECT {FRIENDLY}, 0 UNION SELECT re.src, 1 FROM bw JOIN re ON re.dst = bw.id WHERE NOT EXISTS (SELECT 1 FROM recurring.bw AS r WHERE r.id = re.src) GROUP BY re.src),
giant AS (SELECT fw.id FROM fw JOIN bw USING (id)),
r1 AS (SELECT src, dst FROM re WHERE src NOT IN (SELECT id FROM giant) AND dst NOT IN (SELECT id FROM giant)),
r2 AS (SELECT src, dst FROM r1 WHERE dst IN (SELECT src FROM r1) AND src IN (SELECT dst FROM r1)),
reach(a, b) AS (SELECT src, dst FROM r2 UNION SELECT reach.a, r2.dst FROM reach JOIN r2 ON r2.src = reach.b),
mutual AS (SELECT a AS vid, max(b) AS m FROM reach WHERE (b, a) IN (SELECT a, b FROM reach) GROUP BY 1),
comp AS (SELECT n.vid, CASE WHEN giant.id IS NOT NULL THEN (SELECT max(id) FROM giant) ELSE greatest(n.vid, coalesce(m, n.vid)) END AS component FROM n LEFT JOIN giant ON giant.id = n.vid LEFT JOIN mutual USING (vid))"""
_query("scc_labels", f"{_SCC} SELECT vid, component FROM comp", recursive=True)(lambda g: A.scc(g))
_query("scc_count", f"{_SCC} SELECT count(DISTINCT component)::DOUBLE AS result FROM comp", recursive=True)(lambda g: A.run_algorithm(g, "scc"))
_BFS = ", lv(id, d) USING KEY (id) AS (SELECT {0}, 0 UNION SELECT e.dst, min(lv.d) + 1 FROM lv JOIN e ON e.src = lv.id WHERE NOT EXISTS (SELECT 1 FROM recurring.lv AS r WHERE r.id = e.dst) GROUP BY e.dst)"
_query("bfs_levels", f"{_BFS.format(FRIENDLY)} SELECT id AS vid, d AS level FROM lv", recursive=True)(lambda g: A.bfs(g, _hub(g, "knows", "src")))
_query("bfs_reachable_count", f"{_BFS.format(FRIENDLY)} SELECT count(*)::DOUBLE AS result FROM lv", recursive=True)(lambda g: A.run_algorithm(g, "bfs", source=_hub(g, "knows", "src")))


def _runner(g: PropertyGraph) -> DataFrame:
    out = None
    for name in sorted(A.algorithm_table()):
        one = A.run_algorithm(g, name).select(F.lit(name).alias("algorithm"), F.round("result", 10).alias("result"))
        out = one if out is None else out.unionByName(one)
    return out


_RUN = {
    "bfs": f"WITH RECURSIVE {GRAPH}{_BFS.format('(SELECT min(vid) FROM v)')} SELECT count(*)::DOUBLE AS result FROM lv",
    "pagerank": f"WITH RECURSIVE {GRAPH}{_RESIDUAL} SELECT result FROM last",
    "scc": f"WITH RECURSIVE {GRAPH}{_SCC} SELECT count(DISTINCT component)::DOUBLE AS result FROM comp",
    "wcc": f"WITH RECURSIVE {GRAPH}{_WCC.format(_ALL)} SELECT count(DISTINCT lbl)::DOUBLE AS result FROM cc",
}
_query("algorithm_runner", None)(_runner)
ORACLE["algorithm_runner"] = " UNION ALL ".join(f"SELECT '{name}' AS algorithm, result FROM ({sql})" for name, sql in _RUN.items())

# the same on the result of a query

_FORUM = f", re AS (SELECT src, dst FROM e WHERE label = 'hasTag' AND {_is('Post', 'src')}), n AS (SELECT src AS vid FROM re UNION SELECT dst FROM re)"
_REPLIES = ", re AS (SELECT src, dst FROM e WHERE label = 'replyOf'), n AS (SELECT src AS vid FROM re UNION SELECT dst FROM re)"
_query("post_query_wcc", f"{_WCC.format(_FORUM)} SELECT count(DISTINCT lbl)::DOUBLE AS result FROM cc", recursive=True)(lambda g: A.run_algorithm(PropertyGraph.from_edges(g.pattern("Post", "hasTag")), "wcc"))
_query("post_query_pagerank", _PR.format(_REPLIES, 20) + _RANKS, recursive=True)(lambda g: _ranks(PropertyGraph.from_edges(g.edges_of("replyOf"))))

# loading and replay

_written: dict[tuple[str, int], str] = {}


def _csv(g: PropertyGraph, remap: bool = False) -> PropertyGraph:
    """The graph written as a snapshot in CSV, once for each graph of a session, and read by the loader."""
    spark = g.vertices.sparkSession
    key = (spark.sparkContext.applicationId, g.vertices.semanticHash())
    if key not in _written:
        path = scratch_path(spark, "snb", lasting=True)
        snb_csv.write_snb(g, path)
        _written[key] = path
    return snb_csv.read_snb(spark, _written[key], remap)


_query("load_vertices", " SELECT vid, count(*) AS labels, (SELECT count(*) FROM vp WHERE vp.vid = vl.vid AND value IS NOT NULL) AS properties FROM vl GROUP BY 1")(
    lambda g: _csv(g).vertices.select("vid", F.size("labels").cast("bigint").alias("labels"), F.size("props").cast("bigint").alias("properties"))
)
_query("load_edges", " SELECT src, dst, label, cd AS \"creationDate\", is_reverse FROM e")(lambda g: _csv(g).edges.select("src", "dst", "label", prop("creationDate", "bigint"), "is_reverse"))
_query(
    "remap_edges",
    """, st AS (SELECT vid, CASE tab WHEN 'place' THEN 'Place' WHEN 'tag' THEN 'Tag' WHEN 'forum' THEN 'Forum' WHEN 'person' THEN 'Person' ELSE coalesce(l1, 'Message') END AS stem FROM v),
    m AS (SELECT vid, row_number() OVER (ORDER BY stem NOT IN ('Place', 'Tag'), stem, vid) - 1 AS new_id FROM st)
    SELECT a.new_id AS src, b.new_id AS dst, label, is_reverse FROM e JOIN m a ON a.vid = e.src JOIN m b ON b.vid = e.dst""",
)(lambda g: _csv(g, remap=True).edges.select("src", "dst", "label", "is_reverse"))


def _recovered(g: PropertyGraph) -> DataFrame:
    """Load the graph, write in transactions of which one never commits, and open it anew as after a crash."""
    spark, path = g.vertices.sparkSession, scratch_path(g.vertices.sparkSession, "db")
    hub, popular, pair = _hub(g, "knows", "src"), _hub(g, "replyOf", "dst"), _pair(g, "likes")
    db = Database(spark, path)
    db.create_graph("social")
    db.load("social", g)
    with db.begin("social") as tx:
        tx.add_vertex(-7, ["Robot"], {"firstName": "R"})
        tx.add_edge(-7, popular, "follows", {}, undirected=True)
        tx.rm_vertex(hub)
    with db.begin("social") as tx:
        tx.add_edge(-7, hub, "follows", {})  # its target is gone
        tx.rm_edge(*pair, "likes")
    lost = db.begin("social")
    lost.rm_vertex(popular)
    lost.flush()
    return _after(Database(spark, path).open_graph("social"))


def _points(g: PropertyGraph) -> DataFrame:
    """The state at a rollback point and the present one, after the log has been folded into a snapshot."""
    spark, path = g.vertices.sparkSession, scratch_path(g.vertices.sparkSession, "db")
    hub, pair = _hub(g, "knows", "src"), _pair(g, "likes")
    db = Database(spark, path)
    db.create_graph("social")
    db.load("social", g)
    with db.begin("social") as tx:
        tx.rm_edge(*pair, "likes")
    db.create_rollback("social", "before")
    with db.begin("social") as tx:
        tx.rm_vertex(hub)
    db.compact("social")
    states = [_after(s).withColumn("state", F.lit(name)) for name, s in (("before", db.rollback("social", "before")), ("now", db.open_graph("social")))]
    return states[0].unionByName(states[1])


_query(
    "rollback_point_state",
    f""", kept AS (SELECT * FROM e WHERE NOT (label = 'likes' AND (src, dst) IN {_pair_sql("likes")})),
    states AS (SELECT 'before' AS state, src, dst, label FROM kept UNION ALL SELECT 'now', src, dst, label FROM kept WHERE src <> {FRIENDLY} AND dst <> {FRIENDLY})
    SELECT state, label, count(*) AS n, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM states GROUP BY 1, 2""",
)(_points)
_query(
    "recovered_state",
    f""", kept AS (SELECT src, dst, label FROM e WHERE src <> {FRIENDLY} AND dst <> {FRIENDLY} AND NOT (label = 'likes' AND (src, dst) IN {_pair_sql("likes")})
      UNION ALL SELECT -7, {POPULAR}, 'follows' UNION ALL SELECT {POPULAR}, -7, 'follows')
    SELECT label, count(*) AS n, sum(src)::BIGINT AS src_sum, sum(dst)::BIGINT AS dst_sum FROM kept GROUP BY 1""",
)(_recovered)


def remap_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vertices(spark, sf_dir)
    return snb_csv.remap_ids({t: v.filter(F.col("tab") == t) for t in ("person", "forum", "message", "tag", "place")})


def rollback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "edge_log")
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    return state_at(edge_changes(log), half).edges.select("src", "dst", "label", prop("seq", "bigint"))


QUERIES |= {"remap_ids": remap_ids, "rollback_state": rollback_state}
ORACLE |= {
    "remap_ids": f"WITH {GRAPH} SELECT tab, vid, row_number() OVER (ORDER BY CASE tab WHEN 'person' THEN 1 WHEN 'forum' THEN 2 WHEN 'message' THEN 3 WHEN 'tag' THEN 4 ELSE 5 END, vid) - 1 AS new_id FROM v",
    "rollback_state": """WITH done AS (SELECT DISTINCT seq, src, dst, edge_label, remove FROM edge_log WHERE committed = 1 AND seq <= (SELECT floor(max(seq) / 2) FROM edge_log)),
        ended AS (SELECT a.src, a.dst, a.edge_label, max(r.seq) AS s FROM (SELECT DISTINCT src, dst, edge_label FROM done WHERE remove = 0) a JOIN done r ON r.src = a.src AND r.dst = a.dst AND r.remove = 1 AND (r.edge_label IS NULL OR r.edge_label = a.edge_label) GROUP BY ALL)
        SELECT d.src, d.dst, d.edge_label AS label, min(d.seq) AS seq FROM done d LEFT JOIN ended x ON x.src = d.src AND x.dst = d.dst AND x.edge_label = d.edge_label WHERE remove = 0 AND seq > coalesce(s, -1) GROUP BY ALL""",
}
