"""Registered queries and their DuckDB equivalents, one for each operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import gates as G
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.hooks import Hooks
from lodestone.operators import clean, dedup, encode, graph, reason, retrieve, route, stats
from lodestone.plans import fixtures as X
from lodestone.plans import sql as S
from lodestone.runtime import materialize, maybe_broadcast
from lodestone.sources import catalogue as catalogue_sources
from lodestone.sources import jsonl, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ROUND = lambda c: F.round(c, 6)


def query(text: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return register


# ---------------------------------------------------------------- sources

@query("""
    SELECT 'hf://docs/' || doc_id AS url, sha256('docs_' || doc_id) AS url_hash, 'docs#' || doc_id AS title, text AS content, sha256(text) AS content_hash, 'docs' AS source, 'G-1' AS gate, doc_id AS "index"
    FROM documents WHERE length(text) >= 50
""")
def chunk_extract(spark, d):
    rows = X.table(spark, d, "documents").select("text", F.col("doc_id").alias("index"))
    return jsonl.as_chunks(rows, "docs", "G-1")


@query("""
    SELECT doc_id, source FROM (
        SELECT doc_id, source, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents
    ) WHERE before < 65536
""")
def byte_budget(spark, d):
    return jsonl.within_budget(X.table(spark, d, "documents"), 65536, "source", "doc_id", "text").select("doc_id", "source")


@query("SELECT lang, CAST(count(DISTINCT source) AS BIGINT) AS sources, CAST(count(*) AS BIGINT) AS items, round(sum(octet_length(encode(text))) / 1048576.0, 6) AS mb FROM documents GROUP BY lang")
def manifest_sizes(spark, d):
    t = X.table(spark, d, "documents")
    return t.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("items"), ROUND(F.sum(F.octet_length("text")) / 1048576.0).alias("mb"))


@query("SELECT c_custkey, replace(lower(c_mktsegment), '-', '_') || '_' || c_custkey AS dataset FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def resume_anti_join(spark, d):
    done = X.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    rows = jsonl.not_done(X.table(spark, d, "customer"), done, ["c_custkey"])
    return rows.select("c_custkey", jsonl.dataset_id(jsonl.file_name(F.col("c_mktsegment")), F.col("c_custkey").cast("string")).alias("dataset"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 5")
def first_lines(spark, d):
    rows = X.table(spark, d, "documents").withColumn("_file", F.col("source"))
    return jsonl.first_lines(rows, 5, "doc_id").select("doc_id", "source")


@query(f"""
    WITH {X.PATHED}
    SELECT p.chunk_id, coalesce(d.text, '') AS text, gate_path, CAST(p.chunk_id % 12 AS INTEGER) AS gate_id, CAST(p.chunk_id % 5 AS INTEGER) AS branch_id, 0 AS topic_id, 0 AS level_id,
        CASE WHEN p.chunk_id % 3 = 0 THEN 0.5 ELSE (p.chunk_id % 10) / 10.0::DOUBLE END AS confidence, CAST(0.5 AS DOUBLE) AS quality_score, substr(d.text, 1, 200) AS preview
    FROM pathed p JOIN documents d ON d.doc_id = p.chunk_id
""")
def store_rows(spark, d):
    i = F.col("chunk_id")
    c = X.pathed(spark, d).join(X.chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    c = c.withColumns(
        {
            "coordinates": F.struct((i % 12).cast("int").alias("gate_id"), (i % 5).cast("int").alias("branch_id"), F.lit(None).cast("int").alias("topic_id"), F.lit(None).cast("int").alias("level_id")),
            "concepts": F.lit(None).cast("array<string>"),
            "confidence": F.when(i % 3 != 0, (i % 10) / F.lit(10.0)),
            "quality_score": F.lit(None).cast("double"),
        }
    )
    return stores.store_rows(c).drop("concepts", "prerequisites")


@query(f"WITH {X.NODES} SELECT node_id, gate_id, node_type, difficulty_id, depth, CASE WHEN coalesce(quality, 0) = 0 THEN 0.5 ELSE quality END AS quality FROM nodes")
def vector_rows(spark, d):
    return stores.vector_rows(X.nodes(spark, d)).drop("vector")


# ---------------------------------------------------------------- dedup

@query("SELECT min(doc_id) AS chunk_id, sha256(text) AS content_hash FROM documents GROUP BY source, sha256(text)")
def exact_dedup_per_file(spark, d):
    return dedup.exact(X.chunks(spark, d))


@query("SELECT min(doc_id) AS chunk_id, sha256(text) AS content_hash FROM documents GROUP BY sha256(text)")
def exact_dedup_global(spark, d):
    return dedup.exact(X.chunks(spark, d), "global")


def _greedy(scope: str) -> str:
    """Word-set classes, similar pairs of their first documents, and those that go in order of id."""
    by, same = ("source, key", "a.source = b.source AND") if scope == "file" else ("key", "")
    return f"""
    w0 AS (SELECT doc_id, source, sha256(text) AS h, list_sort(list_distinct({S.words("lower(text)")})) AS w FROM documents),
    w1 AS (SELECT *, CASE WHEN len(w) = 0 THEN '=' || h ELSE array_to_string(w, chr(1)) END AS key FROM w0),
    w AS (SELECT *, min(doc_id) OVER (PARTITION BY {by}) AS rep FROM w1),
    firsts AS (SELECT doc_id, source, w, h FROM w WHERE doc_id = rep),
    o AS (SELECT doc_id, source, len(w) AS n, unnest(w) AS word FROM firsts),
    df AS (SELECT word, count(*) AS df FROM o GROUP BY word),
    prefix AS (
        SELECT doc_id, source, n, word FROM (SELECT o.*, row_number() OVER (PARTITION BY doc_id ORDER BY df, o.word) AS k FROM o JOIN df ON df.word = o.word)
        WHERE k <= n - ceil(0.85::DOUBLE * n) + 1
    ),
    shared AS (
        SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON {same} a.word = b.word AND a.doc_id < b.doc_id
        WHERE least(a.n, b.n) >= 0.85::DOUBLE * greatest(a.n, b.n)
    ),
    pairs AS (
        SELECT a, b, j FROM (
            SELECT a, b, len(list_intersect(x.w, y.w)) AS c, len(x.w) AS na, len(y.w) AS nb, c / (na + nb - c) AS j
            FROM shared JOIN firsts x ON x.doc_id = a JOIN firsts y ON y.doc_id = b
        ) WHERE j >= 0.85::DOUBLE
    ),
    ordered AS (SELECT b AS node, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM pairs GROUP BY b),
    walk AS (
        SELECT 0::BIGINT AS i, []::BIGINT[] AS gone
        UNION ALL SELECT o.i, CASE WHEN len(list_filter(o.earlier, lambda x: NOT list_contains(walk.gone, x))) > 0 THEN list_append(walk.gone, o.node) ELSE walk.gone END FROM walk JOIN ordered o ON o.i = walk.i + 1
    ),
    gone AS (SELECT unnest(gone) AS rep FROM walk WHERE i = (SELECT max(i) FROM walk)),
    status AS (
        SELECT w.doc_id AS chunk_id, CASE WHEN g.rep IS NOT NULL THEN 'near' WHEN w.doc_id = w.rep THEN 'kept' WHEN w.h = f.h THEN 'exact' ELSE 'near' END AS status
        FROM w JOIN firsts f ON f.doc_id = w.rep LEFT JOIN gone g ON g.rep = w.rep
    )"""


@query(f"WITH RECURSIVE {_greedy('file')} SELECT a, b, round(j, 6) AS jaccard FROM pairs")
def jaccard_pairs(spark, d):
    return dedup.similar_pairs(X.chunks(spark, d))


@query(f"WITH RECURSIVE {_greedy('file')} SELECT * FROM status")
def near_duplicates(spark, d):
    return dedup.near_duplicates(X.chunks(spark, d))


@query(f"WITH RECURSIVE {_greedy('global')} SELECT * FROM status")
def near_duplicates_global(spark, d):
    return dedup.near_duplicates(X.chunks(spark, d), scope="global")


@query(f"""
    WITH RECURSIVE {_greedy('global')}
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(status = 'exact') AS BIGINT) AS exact_duplicates, CAST(count_if(status = 'near') AS BIGINT) AS near_duplicates,
        CAST(count_if(status = 'kept') AS BIGINT) AS kept, round(count_if(status <> 'kept') / count(*), 6) AS ratio FROM status
""")
def dedup_stats(spark, d):
    return dedup.dedup_stats(dedup.near_duplicates(X.chunks(spark, d), scope="global"))


@query()
def minhash_dedup(spark, d):
    c = X.chunks(spark, d)
    return dedup.near_duplicates(c, pairs=dedup.minhash_pairs(c))


# ---------------------------------------------------------------- cleaning

@query("SELECT doc_id AS chunk_id, " + ", ".join(f"{v} AS {k}" for k, v in S.type_flags("text").items()) + " FROM documents")
def content_type(spark, d):
    return X.chunks(spark, d).select("chunk_id", T.content_type(F.col("content")).alias("t")).select("chunk_id", "t.*")


@query(f"SELECT page_id, {S.contacts('html')} AS content FROM pages")
def strip_contacts(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.remove_contacts(F.col("html")).alias("content"))


@query(f"SELECT page_id, {S.html('html')} AS content FROM pages")
def strip_html(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.remove_html(F.col("html")).alias("content"))


@query(f"WITH t AS (SELECT doc_id, text, {S.type_flags('text')['is_technical']} AS technical FROM documents) SELECT doc_id AS chunk_id, {S.pages('text', 'technical')} AS content FROM t")
def clean_pages(spark, d):
    return X.chunks(spark, d).select("chunk_id", T.clean_pages(F.col("content"), T.content_type(F.col("content"))["is_technical"]).alias("content"))


@query(f"WITH t AS (SELECT doc_id, text, {S.type_flags('text')['is_technical']} AS technical FROM documents) SELECT doc_id AS chunk_id, round({S.quality('text', 'technical')}, 6) AS quality FROM t")
def quality_score(spark, d):
    return X.chunks(spark, d).select("chunk_id", ROUND(T.quality(F.col("content"), T.content_type(F.col("content"))["is_technical"])).alias("quality"))


_CLEAN = f"""
    t0 AS (SELECT doc_id, source, {S.fix_unicode('text')} AS text FROM documents),
    t1 AS (SELECT *, {S.type_flags('text')['is_technical']} AS technical FROM t0),
    t2 AS (SELECT *, {S.contacts('text', 'NOT technical')} AS a FROM t1),
    t3 AS (SELECT *, {S.html('a')} AS b FROM t2),
    t4 AS (SELECT *, {S.pages('b', 'technical')} AS c FROM t3),
    t5 AS (SELECT *, c = '' OR text = '' AS blank FROM t4),
    t6 AS (SELECT *, NOT blank AND NOT technical AND sum(CASE WHEN NOT blank AND NOT technical THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) % 20 = 0 AS checked FROM t5),
    cleaned AS (
        SELECT doc_id AS chunk_id, source, c AS content, round({S.quality('c', 'technical')}, 6) AS quality_score, technical AS is_technical,
            CASE WHEN blank THEN 'too_short' WHEN checked AND {S.language('c')} <> 'en' THEN 'non_english' WHEN length(c) < 100 THEN 'too_short' WHEN length(c) > 50000 THEN 'too_long'
                WHEN round({S.quality('c', 'technical')}, 6) < 0.4::DOUBLE THEN 'low_quality' END AS reason
        FROM t6
    )"""


@query(f"WITH {_CLEAN} SELECT * FROM cleaned")
def clean_pipeline(spark, d):
    return clean.clean_chunks(X.chunks(spark, d))


@query(f"WITH {_CLEAN} SELECT coalesce(reason, 'kept') AS reason, CAST(count(*) AS BIGINT) AS n FROM cleaned GROUP BY 1")
def reject_stats(spark, d):
    return clean.reject_stats(clean.clean_chunks(X.chunks(spark, d)))


@query("SELECT doc_id AS chunk_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n % 20 = 0")
def lang_sample(spark, d):
    return clean.sampled(X.chunks(spark, d).select("chunk_id", "lang"), 20)


_PERSONALITY = ", ".join(f"least(1.0::DOUBLE, {S.hits('text', m)} / {n}::DOUBLE) AS {k}" for k, (n, m) in T.PERSONALITY.items())


@query("SELECT query_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in T.PERSONALITY) + f" FROM (WITH {X.USER_QUERIES} SELECT query_id, {_PERSONALITY} FROM user_queries)")
def personality(spark, d):
    return X.user_queries(spark, d).select("query_id", *(ROUND(c).alias(k) for k, c in T.personality(F.col("text")).items()))


@query("SELECT CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(sum({k}) / count(*), 6) AS {k}" for k in T.PERSONALITY) + f" FROM (SELECT {_PERSONALITY} FROM conversations)")
def personality_mean(spark, d):
    c = X.table(spark, d, "conversations")
    return stats.mean_personality(c.select(*T.personality(F.col("text")).values()), list(T.PERSONALITY), {"helpful": 0.9})


@query("""
    WITH s AS (SELECT event_id, (event_id % 11) / 10.0::DOUBLE AS w, (event_id % 7) / 6.0::DOUBLE AS p, (event_id % 5) / 4.0::DOUBLE AS c FROM events),
    t AS (SELECT event_id, w, p, concat_ws(', ', CASE WHEN w > 0.5 THEN 'warm' END, CASE WHEN c > 0.5 THEN 'encouraging' END, CASE WHEN p > 0.4 THEN 'lightly playful' END, CASE WHEN w > 0.6 THEN 'clear' END, CASE WHEN p > 0.5 THEN 'concise' END) AS tags FROM s)
    SELECT event_id, CASE WHEN tags = '' THEN 'helpful and clear' ELSE tags END AS style, CASE WHEN p > 0.6 THEN 'playful' WHEN w > 0.6 THEN 'warm' ELSE 'plain' END AS greeting FROM t
""")
def style_tags(spark, d):
    i = F.col("event_id")
    w, p, c = (i % 11) / F.lit(10.0), (i % 7) / F.lit(6.0), (i % 5) / F.lit(4.0)
    return X.table(spark, d, "events").select("event_id", stats.style(w, c, p, w, p).alias("style"), stats.greeting(w, p).alias("greeting"))


# ---------------------------------------------------------------- labelling and routing

def _gate_rows(gates: dict[str, list[str]]) -> str:
    return ", ".join(f"({i}, {S.lit(g)}, [{', '.join(map(S.lit, k))}])" for i, (g, k) in enumerate(gates.items()))


@query(f"""
    WITH g AS (SELECT * FROM (VALUES {_gate_rows(G.SYNTHETIC_GATES)}) t(o, gate, k)),
    s AS (SELECT doc_id, o, gate, len(list_filter(k, lambda x: contains(lower(text), x))) AS score FROM documents, g),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS n FROM s)
    SELECT doc_id AS chunk_id, CASE WHEN score > 0 THEN gate ELSE 'MATH-CTRL' END AS gate, CAST(score AS INTEGER) AS score FROM b WHERE n = 1
""")
def keyword_gate(spark, d):
    return route.keyword_gate(X.chunks(spark, d), G.SYNTHETIC_GATES)


@query(f"""
    WITH {X.USER_QUERIES}, g AS (SELECT * FROM (VALUES {_gate_rows(G.SYNTHETIC_GATES)}) t(o, gate, k)),
    m AS (SELECT query_id, o, gate, len(k) AS kn, len(list_filter(k, lambda x: contains(lower(text), x))) AS m FROM user_queries, g),
    s AS (SELECT query_id, o, gate, least(m / kn::DOUBLE + m * 0.1::DOUBLE, 1.0) AS score FROM m WHERE m > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS n FROM s),
    p AS (SELECT query_id, max(gate) FILTER (n = 1) AS gate, max(score) FILTER (n = 1) AS confidence, count(*) FILTER (n > 1 AND score > 0.3) AS more FROM r GROUP BY query_id),
    f AS (SELECT query_id, string_agg(gate, ',' ORDER BY n) AS secondary FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS x FROM r WHERE n > 1 AND score > 0.3) WHERE x <= 2 GROUP BY query_id)
    SELECT q.query_id, coalesce(p.gate, 'EN-ALPHA') AS gate, round(coalesce(p.confidence, 0.3), 6) AS confidence, coalesce(f.secondary, '') AS secondary
    FROM user_queries q LEFT JOIN p ON p.query_id = q.query_id LEFT JOIN f ON f.query_id = q.query_id
""")
def route_keyword(spark, d):
    r = route.route(X.user_queries(spark, d), G.SYNTHETIC_GATES)
    return r.select("query_id", "gate", ROUND("confidence").alias("confidence"), F.concat_ws(",", "secondary").alias("secondary"))


_LOW = S.strip("lower(text)")
_SKIP = " OR ".join(f"regexp_matches(l, {S.lit(p)})" for p in route.SKIP)
_FORCE = " OR ".join(f"regexp_matches(l, {S.lit(p)})" for p in route.FORCE)


@query(f"""
    WITH {X.USER_QUERIES}, q AS (SELECT query_id, text, {_LOW} AS l, len({S.words('text')}) AS n, {S.count('text', '?')} AS m FROM user_queries),
    c AS (SELECT *, CAST(least(10, 1 + CASE WHEN n > 20 THEN 3 WHEN n > 10 THEN 2 WHEN n > 5 THEN 1 ELSE 0 END + CASE WHEN m > 1 THEN 2 WHEN m = 1 THEN 1 ELSE 0 END + least({S.hits('text', route.COMPLEX)}, 3)) AS INTEGER) AS complexity FROM q)
    SELECT query_id, complexity, CASE WHEN {_SKIP} THEN true WHEN {_FORCE} THEN false ELSE n <= 5 END AS skip_vector, complexity >= 3 AS use_graph FROM c
""")
def query_complexity(spark, d):
    c = route.complexity(F.col("text"))
    return X.user_queries(spark, d).select("query_id", c.alias("complexity"), route.skip_vector(F.col("text")).alias("skip_vector"), (c >= route.GRAPH_COMPLEXITY).alias("use_graph"))


_POINTS = "points AS (SELECT vec_id AS node_id, label AS gate_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
_CENTRES = """centres AS (
        SELECT gate_id, list(x ORDER BY i) AS centroid FROM (
            SELECT gate_id, i, avg(x) AS x FROM (SELECT gate_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM points) GROUP BY gate_id, i
        ) GROUP BY gate_id
    )"""


@query(f"WITH {_POINTS}, {_CENTRES} SELECT gate_id, CAST(i - 1 AS INTEGER) AS at, round(x, 6) AS x FROM (SELECT gate_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS i FROM centres)")
def gate_centroids(spark, d):
    return route.centroids(X.nodes(spark, d)).select("gate_id", F.posexplode("centroid").alias("at", "x")).select("gate_id", F.col("at").cast("int").alias("at"), ROUND("x").alias("x"))


_SCORED = f"""
    s AS (SELECT node_id, c.gate_id, {S.cosine('vector', 'centroid')} AS s FROM points p, centres c),
    e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY node_id)) AS e FROM s),
    scored AS (SELECT node_id, gate_id, s AS similarity, e / sum(e) OVER (PARTITION BY node_id) AS probability, row_number() OVER (PARTITION BY node_id ORDER BY s DESC, gate_id) AS rank FROM e)"""


@query(f"WITH {_POINTS}, {_CENTRES}, {_SCORED} SELECT node_id, gate_id, round(similarity, 6) AS similarity, round(probability, 6) AS probability, CAST(rank AS INTEGER) AS rank FROM scored WHERE rank <= 3")
def centroid_route(spark, d):
    p = X.nodes(spark, d)
    return route.centroid_route(p, route.centroids(p)).where("rank <= 3").select("node_id", "gate_id", ROUND("similarity").alias("similarity"), ROUND("probability").alias("probability"), "rank")


@query(f"WITH {_POINTS}, {_CENTRES}, {_SCORED} SELECT node_id, gate_id, round(probability, 6) AS probability, CAST(row_number() OVER (PARTITION BY node_id ORDER BY probability DESC, gate_id) AS INTEGER) AS position FROM scored WHERE probability >= 0.11")
def multi_gate_predict(spark, d):
    p = X.nodes(spark, d)
    return route.multi_gate(route.centroid_route(p, route.centroids(p)), 0.11).select("node_id", "gate_id", ROUND("probability").alias("probability"), "position")


@query(f"""
    WITH {X.LABELLED}
    SELECT chunk_id, gate, depth, level, confidence, CASE WHEN confidence > 0.8 THEN 'approved' ELSE 'flagged' END AS status FROM labelled
    WHERE gate IS NOT NULL AND path_n = ids_n AND path_n = depth AND depth BETWEEN 1 AND 7 AND level <> 'other' AND confidence >= 0.7::DOUBLE
""")
def label_status(spark, d):
    return route.label_status(X.labelled(spark, d)).drop("path", "path_ids")


@query(f"WITH {X.LABELLED} SELECT depth, level, CAST(count(*) AS BIGINT) AS n FROM labelled GROUP BY GROUPING SETS ((depth), (level), ())")
def label_counts(spark, d):
    return X.labelled(spark, d).groupingSets([["depth"], ["level"], []], "depth", "level").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- retrieval

@query(f"WITH {X.NODES} SELECT node_id, depth, quality FROM nodes WHERE gate_id = 3 AND depth BETWEEN 1 AND 6 AND difficulty_id <= 4 ORDER BY quality DESC NULLS FIRST, depth, node_id LIMIT 10")
def hierarchy_lookup(spark, d):
    return retrieve.by_hierarchy(X.nodes(spark, d), 3, depth=(1, 6), difficulty=4).select("node_id", "depth", "quality")


@query(f"WITH {X.NODES} SELECT node_id FROM nodes WHERE len(list_filter(['t1', 'g2'], lambda x: NOT list_contains(path, x))) = 0")
def path_containment(spark, d):
    return X.nodes(spark, d).where(retrieve.contains_all(F.col("path"), ["t1", "g2"])).select("node_id")


_LINKED = "SELECT e.to_node, n.node_id, CASE WHEN coalesce(e.weight, 0) = 0 THEN 1.0 ELSE e.weight END AS weight FROM edges e JOIN nodes n ON n.node_id = e.from_node"


@query(f"WITH {X.NODES}, {X.EDGES} {_LINKED} WHERE e.edge_type = 'EXAMPLE_OF' AND n.node_type = 'PROBLEM'")
def examples(spark, d):
    return retrieve.examples(X.nodes(spark, d), X.edges(spark, d))


@query(f"WITH {X.NODES}, {X.EDGES} {_LINKED} WHERE e.edge_type = 'VERIFIES' AND n.node_type = 'SKILL'")
def verifiers(spark, d):
    return retrieve.verifiers(X.nodes(spark, d), X.edges(spark, d))


_WALK = """
    walk AS (
        SELECT from_node AS start, to_node AS node_id, 1 AS depth FROM edges WHERE edge_type = 'REQUIRES'
        UNION
        SELECT w.start, e.to_node, w.depth + 1 FROM walk w JOIN edges e ON e.from_node = w.node_id AND e.edge_type = 'REQUIRES' WHERE w.depth < {depth}
    ), prereq AS (SELECT start, node_id, min(depth) AS depth FROM walk WHERE start <> node_id GROUP BY start, node_id)"""


@query(f"WITH RECURSIVE {X.NODES}, {X.EDGES}, {_WALK.format(depth=3)} SELECT start, node_id, CAST(depth AS INTEGER) AS depth FROM prereq")
def prereq_walk(spark, d):
    return retrieve.prerequisites(X.edges(spark, d), X.nodes(spark, d).select("node_id"), 3)


@query(f"""
    WITH RECURSIVE {X.EDGES}, u AS (SELECT from_node AS a, to_node AS b FROM edges UNION SELECT to_node, from_node FROM edges),
    l AS (
        SELECT a AS start, b AS node_id, 1 AS depth FROM u WHERE a % 100 = 0
        UNION SELECT l.start, u.b, 2 FROM l JOIN u ON u.a = l.node_id WHERE l.depth = 1
    ), m AS (SELECT start, node_id, min(depth) AS depth FROM l WHERE start <> node_id GROUP BY start, node_id)
    SELECT start, node_id, CAST(depth AS INTEGER) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, node_id) AS n FROM m) WHERE n <= 50
""")
def related_entities(spark, d):
    return graph.related(X.edges(spark, d), X.nodes(spark, d).where("node_id % 100 = 0").select("node_id"))


@query(f"""
    WITH RECURSIVE {X.EDGES}, p AS (
        SELECT 200::BIGINT AS here, [200::BIGINT] AS path, 0 AS depth
        UNION ALL SELECT e.to_node, list_append(p.path, e.to_node), p.depth + 1 FROM p JOIN (SELECT DISTINCT from_node, to_node FROM edges WHERE from_node <> to_node) e ON e.from_node = p.here WHERE p.depth < 6 AND NOT list_contains(p.path, e.to_node)
    ) SELECT array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth FROM p WHERE here = 3 ORDER BY p.depth, p.path LIMIT 1
""")
def find_path(spark, d):
    return graph.find_path(X.edges(spark, d), 200, 3, 6).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "depth")


_TOPK = f"""
    q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
    topk AS (
        SELECT query_id, node_id, s AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank
        FROM (SELECT query_id, node_id, {S.cosine('qv', 'vector')} AS s FROM q, nodes WHERE {{where}}) QUALIFY rank <= 20
    )"""


@query(f"WITH {X.NODES}, {_TOPK.format(where='true')} SELECT query_id, node_id, round(vector_score, 6) AS vector_score, CAST(rank AS INTEGER) AS rank FROM topk")
def vector_topk(spark, d):
    return retrieve.vector_search(X.vector_queries(spark, d), X.nodes(spark, d)).select("query_id", "node_id", ROUND("vector_score").alias("vector_score"), "rank")


@query(f"WITH {X.NODES}, {_TOPK.format(where='''gate_id = 4 AND node_type = 'CONCEPT' AND difficulty_id <= 3 AND depth >= 2''')} SELECT query_id, node_id, round(vector_score, 6) AS vector_score, CAST(rank AS INTEGER) AS rank FROM topk")
def vector_filtered(spark, d):
    found = retrieve.vector_search(X.vector_queries(spark, d), X.nodes(spark, d), gate_id=4, node_type="CONCEPT", difficulty=3, depth=(2, 7))
    return found.select("query_id", "node_id", ROUND("vector_score").alias("vector_score"), "rank")


#: Every document whose id is divisible by 100 asks for its first longer word.
_ASKED = "asked AS (SELECT doc_id AS query_id, regexp_extract(text, '([a-zA-Z]{6,})', 1) AS query FROM documents WHERE doc_id % 100 = 0)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    t = X.table(spark, d, "documents").where("doc_id % 100 = 0")
    return t.select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", "([a-zA-Z]{6,})", 1).alias("text"))


@query(f"""
    WITH {_ASKED}, c AS (SELECT d.doc_id AS node_id, text, CASE WHEN d.doc_id % 7 <> 0 THEN (d.doc_id % 10) / 10.0::DOUBLE END AS quality FROM documents d)
    SELECT query_id, node_id, 0.5::DOUBLE AS vector_score, CAST(n AS INTEGER) AS rank
    FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC NULLS LAST, node_id) AS n FROM asked q JOIN c ON q.query <> '' AND c.text ILIKE '%' || q.query || '%') WHERE n <= 20
""")
def text_fallback(spark, d):
    c = X.chunks(spark, d).select(F.col("chunk_id").alias("node_id"), "content", F.when(F.col("chunk_id") % 7 != 0, (F.col("chunk_id") % 10) / F.lit(10.0)).alias("quality"))
    return retrieve.text_fallback(_asked(spark, d), c)


@query(f"""
    WITH {X.FILES}, {X.FILE_CHUNKS}
    SELECT c.chunk_id, c.file_id, c.chunk_index, CASE WHEN c.content ILIKE '%hathe%' THEN 2.0::DOUBLE WHEN c.contextual_content ILIKE '%hathe%' THEN 1.5 ELSE 1.0 END AS score
    FROM file_chunks c JOIN files f ON f.file_id = c.file_id WHERE f.session_id = 2 AND (c.content ILIKE '%hathe%' OR c.contextual_content ILIKE '%hathe%')
    ORDER BY score DESC, chunk_index, chunk_id LIMIT 10
""")
def file_search(spark, d):
    return retrieve.file_search("hathe", X.files(spark, d), X.file_chunks(spark, d), 2)


@query(f"""
    WITH {X.FILES}, {X.FILE_CHUNKS}
    SELECT chunk_id, file_id, chunk_index, 1.0::DOUBLE AS score FROM file_chunks
    WHERE file_id = (SELECT file_id FROM files WHERE session_id = 2 ORDER BY uploaded_at DESC, file_id DESC LIMIT 1) ORDER BY chunk_index LIMIT 5
""")
def file_summary(spark, d):
    return retrieve.file_search("Give me an overview", X.files(spark, d), X.file_chunks(spark, d), 2)


_ENRICH = """
    e AS (SELECT e.to_node AS node_id, count(*) AS e FROM edges e JOIN nodes n ON n.node_id = e.from_node WHERE e.edge_type = 'EXAMPLE_OF' AND n.node_type = 'PROBLEM' GROUP BY 1),
    v AS (SELECT e.to_node AS node_id, count(*) AS v FROM edges e JOIN nodes n ON n.node_id = e.from_node WHERE e.edge_type = 'VERIFIES' AND n.node_type = 'SKILL' GROUP BY 1),
    p AS (SELECT start AS node_id, count(*) AS p FROM prereq GROUP BY 1),
    counted AS (
        SELECT n.node_id, n.quality, coalesce(p, 0) AS p, CASE WHEN n.node_type IN ('CONCEPT', 'FORMULA') THEN coalesce(e, 0) ELSE 0 END AS e, coalesce(v, 0) AS v
        FROM nodes n LEFT JOIN p ON p.node_id = n.node_id LEFT JOIN e ON e.node_id = n.node_id LEFT JOIN v ON v.node_id = n.node_id
    ), enriched AS (SELECT *, 0.4::DOUBLE * least(p / 3.0::DOUBLE, 1.0) + 0.3::DOUBLE * least(e / 2.0::DOUBLE, 1.0) + 0.3::DOUBLE * least(v / 1.0::DOUBLE, 1.0) AS graph_score FROM counted)"""


@query(f"WITH RECURSIVE {X.NODES}, {X.EDGES}, {_WALK.format(depth=2)}, {_ENRICH} SELECT node_id, CAST(p AS BIGINT) AS p, CAST(e AS BIGINT) AS e, CAST(v AS BIGINT) AS v, round(graph_score, 6) AS graph_score FROM enriched")
def graph_enrichment(spark, d):
    n = X.nodes(spark, d)
    out = retrieve.enrich(n.select("node_id"), n, X.edges(spark, d))
    return out.select("node_id", *(F.col(c).cast("long").alias(c) for c in "pev"), ROUND("graph_score").alias("graph_score"))


_FUSED = """
    f AS (SELECT {by}, t.node_id, rank, 0.5::DOUBLE * vector_score + 0.3::DOUBLE * graph_score + 0.2::DOUBLE * CASE WHEN coalesce(quality, 0) = 0 THEN 0.5 ELSE quality END AS combined FROM topk t JOIN enriched e ON e.node_id = t.node_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY combined DESC, rank) AS position FROM f)"""


@query(f"WITH RECURSIVE {X.NODES}, {X.EDGES}, {_TOPK.format(where='difficulty_id <= 2')}, {_WALK.format(depth=2)}, {_ENRICH}, {_FUSED.format(by='query_id')} SELECT query_id, node_id, round(combined, 6) AS combined, CAST(position AS INTEGER) AS position FROM o WHERE position <= 10")
def hybrid_rank(spark, d):
    n = X.nodes(spark, d)
    out = retrieve.hybrid(X.vector_queries(spark, d), n, n, X.edges(spark, d))
    return out.select("query_id", "node_id", ROUND("combined").alias("combined"), "position")


_BY_GATE = f"""
    q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
    topk AS (
        SELECT query_id, gate_id, node_id, s AS vector_score, row_number() OVER (PARTITION BY query_id, gate_id ORDER BY s DESC, node_id) AS rank
        FROM (SELECT query_id, gate_id, node_id, {S.cosine('qv', 'vector')} AS s FROM q, nodes WHERE gate_id IN (1, 2, 3)) QUALIFY rank <= 20
    )"""


@query(f"WITH RECURSIVE {X.NODES}, {X.EDGES}, {_BY_GATE}, {_WALK.format(depth=2)}, {_ENRICH}, {_FUSED.format(by='query_id, gate_id')} SELECT query_id, gate_id, node_id, round(combined, 6) AS combined, CAST(position AS INTEGER) AS position FROM o WHERE position <= 5")
def multi_gate(spark, d):
    n = X.nodes(spark, d)
    out = retrieve.multi_gate(n, n, X.edges(spark, d), X.vector_queries(spark, d), [1, 2, 3])
    return out.select("query_id", "gate_id", "node_id", ROUND("combined").alias("combined"), "position")


_BM25_WORDS = "w AS (SELECT doc_id AS chunk_id, unnest(" + S.words("lower(text)") + ") AS word FROM documents)"


@query(f"""
    WITH {_BM25_WORDS}, q AS (SELECT DISTINCT item_id AS query_id, unnest({S.words('lower(text)')}) AS word FROM benchmark),
    n AS (SELECT chunk_id, count(*) AS n FROM w GROUP BY 1), st AS (SELECT count(*) AS chunks, avg(n) AS mean FROM n),
    tf AS (SELECT chunk_id, word, count(*) AS tf FROM w WHERE word IN (SELECT word FROM q) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
    s AS (
        SELECT query_id, chunk_id, round(sum(ln(1 + (chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score
        FROM tf JOIN df USING (word) JOIN q USING (word) JOIN n USING (chunk_id), st GROUP BY 1, 2
    ), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS position FROM s)
    SELECT query_id, chunk_id, round(score, 4) AS score FROM o WHERE position <= 1
""")
def bm25(spark, d):
    words = X.chunks(spark, d).select("chunk_id", F.explode(T.words(F.lower("content"))).alias("word"))
    q = X.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.words(F.lower("text")))).alias("word"))
    return retrieve.bm25(q, words, 1).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


@query(f"""
    WITH {X.NODES}, {_TOPK.format(where='true')},
    rel AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id FROM embeddings q JOIN embeddings n ON n.label = q.label WHERE q.vec_id % 100 = 0),
    r AS (SELECT query_id, count(*) AS r FROM rel GROUP BY 1),
    h AS (SELECT t.query_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS f FROM topk t JOIN rel ON rel.query_id = t.query_id AND rel.node_id = t.node_id GROUP BY 1),
    i AS (SELECT r.query_id, r, coalesce(hits, 0) AS hits, coalesce(dcg / list_sum(list_transform(range(1, least(r, 20) + 1), lambda k: 1 / log2(k + 1))), 0) AS ndcg, coalesce(1 / f, 0) AS rr FROM r LEFT JOIN h ON h.query_id = r.query_id)
    SELECT round(avg(ndcg), 6) AS ndcg, round(avg(hits / 20), 6) AS precision, round(avg(hits / r), 6) AS recall, round(avg(rr), 6) AS mrr FROM i
""")
def ir_metrics(spark, d):
    n = X.nodes(spark, d)
    ranked = retrieve.vector_search(X.vector_queries(spark, d), n)
    q = n.where("node_id % 100 = 0").select(F.col("node_id").alias("query_id"), "gate_id")
    return retrieve.ir_metrics(ranked, q.join(n.select("node_id", "gate_id"), "gate_id").select("query_id", "node_id"))


@query(f"WITH {X.NODES} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(gate_id = 3) AS BIGINT) AS gate, CAST(count_if(gate_id = 3 AND branch_id = 2) AS BIGINT) AS branch, CAST(count_if(gate_id = 3 AND branch_id = 2 AND difficulty_id <= 3) AS BIGINT) AS level FROM nodes")
def search_reduction(spark, d):
    return retrieve.search_reduction(X.nodes(spark, d), 3, 2, 3)


# ---------------------------------------------------------------- knowledge graph

_TYPES = "[" + ", ".join(map(S.lit, graph.ENTITY_TYPES)) + "]"
_RELATIONS = "[" + ", ".join(map(S.lit, graph.RELATIONS)) + "]"
_ENTITIES = f"""
    found AS (SELECT doc_id AS chunk_id, regexp_extract_all(substr(text, 1, 5000), '(\\p{{Lu}}\\p{{L}}{{3,}})') AS x FROM documents),
    listed AS (
        SELECT chunk_id, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS pos, 0 AS list FROM found
        UNION ALL SELECT doc_id, lang || ' text', 0, 1 FROM documents
    ),
    entities AS (
        SELECT chunk_id, {S.strip('lower(text)')} AS key, text, ({_TYPES})[length(text) % {len(graph.ENTITY_TYPES)} + 1] AS type, list, pos FROM listed
        WHERE length({S.strip('lower(text)')}) > 2 QUALIFY row_number() OVER (PARTITION BY chunk_id, key ORDER BY list, pos) = 1
    )"""
_GRAPH = f"""{_ENTITIES},
    numbered AS (SELECT chunk_id, text, row_number() OVER (PARTITION BY chunk_id ORDER BY pos, key) AS n, key, pos FROM entities),
    triplets AS (
        SELECT chunk_id, n AS pos, text AS subject, object, ({_RELATIONS})[(length(text) + length(object)) % {len(graph.RELATIONS)} + 1] AS relation
        FROM (SELECT *, lead(text) OVER (PARTITION BY chunk_id ORDER BY pos, key) AS object FROM numbered WHERE n <= 20) WHERE object IS NOT NULL
    ),
    gnodes AS (SELECT text AS name, arg_max(type, (chunk_id, list, pos)) AS type FROM entities GROUP BY text),
    gedges AS (SELECT subject, upper(translate(relation, ' -', '__')) AS relation, object, max(chunk_id) AS chunk_id FROM triplets GROUP BY ALL),
    simple AS (SELECT least(subject, object) AS u, greatest(subject, object) AS v, arg_max(relation, (chunk_id, relation)) AS relation FROM gedges WHERE subject <> object GROUP BY 1, 2)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = X.chunks(spark, d)
    hooks = Hooks()
    whole = c.select("chunk_id", F.lit(0).alias("pos"), F.concat("lang", F.lit(" text")).alias("text"), F.lit(1.0).alias("score"), F.lit("label").alias("source"))
    kind = F.element_at(F.array(*(F.lit(t) for t in graph.ENTITY_TYPES)), F.length("text") % len(graph.ENTITY_TYPES) + 1)
    e = graph.merge_entities(hooks.entities(c), whole.withColumn("type", kind))
    n = graph.upsert_nodes(e)
    return e, n, graph.upsert_edges(hooks.triplets(e), n)


@query(f"WITH {_ENTITIES} SELECT chunk_id, key, text, type, CAST(list AS INTEGER) AS list, CAST(pos AS INTEGER) AS pos FROM entities")
def entity_merge(spark, d):
    return _graph(spark, d)[0].drop("score", "source")


@query(f"WITH {_GRAPH} SELECT * FROM gnodes")
def node_upsert(spark, d):
    return _graph(spark, d)[1]


@query(f"WITH {_GRAPH} SELECT * FROM gedges")
def edge_upsert(spark, d):
    return _graph(spark, d)[2]


@query(f"WITH {_GRAPH} SELECT * FROM simple")
def simple_graph(spark, d):
    return graph.simple_graph(_graph(spark, d)[2])


@query(f"WITH {_GRAPH} SELECT name, CAST(count(*) AS BIGINT) AS degree FROM (SELECT u AS name FROM simple UNION ALL SELECT v FROM simple) GROUP BY name")
def degrees(spark, d):
    return graph.degrees(graph.simple_graph(_graph(spark, d)[2]))


def _propagation(rounds: int = 8) -> str:
    """Label propagation as a chain of tables, one for each round."""
    out = ["nb AS (SELECT u, v FROM simple UNION ALL SELECT v, u FROM simple), l0 AS (SELECT DISTINCT u AS name, u AS label FROM nb)"]
    for i in range(rounds):
        out.append(f"""l{i + 1} AS MATERIALIZED (
        SELECT u AS name, label FROM (
            SELECT u, label, sum(n) AS n FROM (SELECT nb.u, l.label, 1 AS n FROM nb JOIN l{i} l ON l.name = nb.v UNION ALL SELECT name, label, 1 FROM l{i}) GROUP BY u, label
        ) QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC, label) = 1
    )""")
    return ", ".join(out) + f""",
    sized AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS community FROM l{rounds} GROUP BY label),
    community AS (SELECT name, CAST(community AS INTEGER) AS community FROM l{rounds} JOIN sized USING (label))"""


_COMMUNITY = _propagation()


@query(f"WITH {_GRAPH}, {_COMMUNITY} SELECT * FROM community")
def communities(spark, d):
    return graph.communities(graph.simple_graph(_graph(spark, d)[2]))


@query(f"""
    WITH {_GRAPH}, {_COMMUNITY}
    SELECT n.name, '{{"data":{{"id":' || to_json(n.name) || ',"label":' || to_json(n.name) || ',"type":"' || type || '","gate":"UNKNOWN","community":' || coalesce(community, 0) || ',"color":"'
        || ([{', '.join(map(S.lit, graph.PALETTE))}])[coalesce(community, 0) % 15 + 1] || '"}}}}' AS element FROM gnodes n LEFT JOIN community c ON c.name = n.name
""")
def cytoscape_nodes(spark, d):
    _, n, e = _graph(spark, d)
    return graph.cytoscape_nodes(n, graph.communities(graph.simple_graph(e)))


@query(f"""
    WITH {_GRAPH} SELECT '{{"data":{{"source":' || to_json(subject) || ',"target":' || to_json(object) || ',"relation":"' || relation || '"}}}}' AS element FROM gedges
""")
def cytoscape_edges(spark, d):
    return graph.cytoscape_edges(_graph(spark, d)[2])


@query(f"""
    WITH {_GRAPH}, {_COMMUNITY}, g AS (SELECT name, CAST(count(*) AS BIGINT) AS degree FROM (SELECT u AS name FROM simple UNION ALL SELECT v FROM simple) GROUP BY name)
    SELECT n.name, '{{"id":' || to_json(n.name) || ',"label":' || to_json('[[' || n.name || ']]') || ',"community":' || coalesce(community, 0) || ',"degree":' || coalesce(degree, 0) || ',"type":"' || type || '"}}' AS element
    FROM gnodes n LEFT JOIN g ON g.name = n.name LEFT JOIN community c ON c.name = n.name
""")
def note_graph(spark, d):
    _, n, e = _graph(spark, d)
    simple = graph.simple_graph(e)
    return graph.note_nodes(n, graph.communities(simple), graph.degrees(simple))


@query(f"""
    WITH {_GRAPH}
    SELECT 1 AS part, name, '<node id="' || name || '"><data key="type">' || type || '</data></node>' AS line FROM gnodes
    UNION ALL SELECT 2, u || '|' || v, '<edge source="' || u || '" target="' || v || '"><data key="relation">' || relation || '</data></edge>' FROM simple
""")
def graphml(spark, d):
    _, n, e = _graph(spark, d)
    return graph.graphml_lines(n, graph.simple_graph(e)).where("part in (1, 2)")


@query(f"WITH {_GRAPH} SELECT chunk_id, CAST(pos AS INTEGER) AS pos, subject, relation, object FROM triplets")
def ner_triplets(spark, d):
    e, _, _ = _graph(spark, d)
    return Hooks().triplets(e).withColumn("pos", F.col("pos").cast("int"))


@query(f"""
    WITH {X.PATHED}, by_path AS (SELECT gate_path, max(chunk_id) AS prerequisite_chunk_id FROM pathed GROUP BY gate_path),
    w AS (SELECT chunk_id, unnest(prerequisites) AS gate_path FROM pathed)
    SELECT DISTINCT chunk_id, prerequisite_chunk_id, 1.0::DOUBLE AS strength FROM w JOIN by_path USING (gate_path) WHERE len(gate_path) = 4
""")
def prereq_dag(spark, d):
    return graph.prerequisite_links(X.pathed(spark, d))


@query(f"WITH {_GRAPH} SELECT type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT key) AS BIGINT) AS entities, 1.0::DOUBLE AS avg_score FROM entities GROUP BY type")
def entity_types(spark, d):
    return stats.entity_types(_graph(spark, d)[0])


@query(f"""
    WITH {_GRAPH}, l AS (SELECT subject AS name FROM gedges UNION SELECT object FROM gedges)
    SELECT CAST((SELECT count(*) FROM gnodes) AS BIGINT) AS entities, CAST((SELECT count(*) FROM gedges) AS BIGINT) AS relations,
        round((SELECT count(*) FROM gedges) / (SELECT count(*) FROM gnodes), 6) AS per_entity, round((SELECT count(*) FROM l) / (SELECT count(*) FROM gnodes), 6) AS connected
""")
def graph_connectivity(spark, d):
    _, n, e = _graph(spark, d)
    return stats.connectivity(n, e)


@query(f"WITH {_ENTITIES} SELECT d.source AS gate, e.key, CAST(count(*) AS BIGINT) AS mentions FROM entities e JOIN documents d ON d.doc_id = e.chunk_id GROUP BY ALL")
def entity_mentions(spark, d):
    e = _graph(spark, d)[0]
    return e.join(X.chunks(spark, d).select("chunk_id", F.col("source").alias("gate")), "chunk_id").groupBy("gate", "key").agg(F.count("*").alias("mentions"))


# ---------------------------------------------------------------- encoding

_TOKENS = f"occ AS (SELECT doc_id AS chunk_id, unnest(x) AS token, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, {S.lit('(' + encode.TOKEN + ')')}) AS x FROM documents))"
_VOCAB = f"""{_TOKENS},
    counted AS (SELECT token, count(*) AS frequency, min((chunk_id, pos)) AS first FROM occ GROUP BY token),
    vocab AS (SELECT token, row_number() OVER (ORDER BY first) - 1 AS id, frequency FROM counted)"""


@query(f"WITH {_VOCAB} SELECT token, CAST(id AS BIGINT) AS id, CAST(frequency AS BIGINT) AS frequency FROM vocab WHERE frequency >= 5")
def vocabulary(spark, d):
    return encode.vocabulary(X.chunks(spark, d))


@query(f"WITH {_VOCAB} SELECT chunk_id, string_agg(CASE WHEN frequency >= 5 THEN id ELSE -1 END, ' ' ORDER BY pos) AS ids FROM occ JOIN vocab USING (token) GROUP BY chunk_id")
def encode_tokens(spark, d):
    c = X.chunks(spark, d)
    return encode.encode(c, encode.vocabulary(c)).select("chunk_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("SELECT doc_id AS chunk_id, doc_id * 7 % 500 AS cluster, CASE WHEN doc_id % 300 <= 255 THEN printf('%02X%02X%02X%02X', doc_id % 300, doc_id % 12, doc_id % 5, doc_id % 7) END AS packed FROM documents")
def pack_coords(spark, d):
    i = F.col("doc_id")
    return X.table(spark, d, "documents").select(i.alias("chunk_id"), encode.cluster(i * 7).alias("cluster"), F.hex(encode.pack(i % 300, i % 12, i % 5, i % 7)).alias("packed"))


# ---------------------------------------------------------------- statistics

@query(f"WITH {X.NODES} SELECT gate_id, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM nodes), 6) AS percent, round(avg(quality), 6) AS avg_quality FROM nodes GROUP BY gate_id")
def gate_distribution(spark, d):
    return stats.gate_distribution(X.nodes(spark, d))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, round(sum(octet_length(encode(text))) / 1048576.0, 6) AS mb FROM documents GROUP BY ROLLUP (source)")
def gate_volume(spark, d):
    return stats.gate_volume(X.chunks(spark, d))


@query(f"""
    WITH {X.NODES}
    SELECT CAST(count_if(quality >= 0 AND quality < 0.3::DOUBLE) AS BIGINT) AS q0, CAST(count_if(quality >= 0.3::DOUBLE AND quality < 0.5) AS BIGINT) AS q3, CAST(count_if(quality >= 0.5 AND quality < 0.7::DOUBLE) AS BIGINT) AS q5,
        CAST(count_if(quality >= 0.7::DOUBLE AND quality < 0.9::DOUBLE) AS BIGINT) AS q7, CAST(count_if(quality >= 0.9::DOUBLE) AS BIGINT) AS q9, round(avg(quality), 6) AS mean, round(quantile_cont(quality, 0.5), 6) AS median,
        round(count_if(quality > 0.7::DOUBLE) / count(quality), 6) AS above_07, round(count(quality) / count(*), 6) AS complete FROM nodes
""")
def quality_histogram(spark, d):
    return stats.quality_histogram(X.nodes(spark, d))


@query("SELECT lang, round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY lang")
def chunk_lengths(spark, d):
    return X.chunks(spark, d).groupBy("lang").agg(ROUND(F.avg(F.length("content"))).alias("mean_length"))


# ---------------------------------------------------------------- reasoning

_SET = lambda t: f"list_distinct({S.words(f'lower({t})')})"


@query(f"""
    WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS sample FROM conversations),
    s AS (SELECT conv_id, {_SET('text')} AS a, {_SET('sample')} AS b FROM p WHERE sample IS NOT NULL),
    j AS (SELECT conv_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS s FROM s)
    SELECT conv_id AS query_id, round(1 - var_pop(s), 6) AS confidence, var_pop(s) < 0.05::DOUBLE AS confident FROM j GROUP BY conv_id
""")
def confidence_check(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = X.table(spark, d, "conversations").withColumn("sample", F.lead("text").over(w)).where("sample is not null")
    return reason.agreement(c.select(F.col("conv_id").alias("query_id"), F.col("text").alias("answer"), "sample"))


@query("""
    WITH o AS (SELECT DISTINCT user_id, event_id % 10 AS iteration FROM events WHERE event_type = 'click'), n AS (SELECT DISTINCT user_id, event_id % 10 AS iteration FROM events WHERE event_type <> 'click')
    SELECT CAST(user_id AS VARCHAR) AS query_id, CAST(iteration AS INTEGER) AS iteration FROM (SELECT * FROM o UNION SELECT * FROM n)
""")
def trace_upsert(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("query_id"), (F.col("event_id") % 10).cast("int").alias("iteration"), "event_type")
    old = e.where("event_type = 'click'").select("query_id", "iteration").distinct()
    return reason.append_trace(old, e.where("event_type <> 'click'").select("query_id", "iteration"))


@query()
def reasoning_loop(spark, d):
    """Every user turn is a problem; whole texts that contain its first word are its context."""
    c = X.chunks(spark, d).select(F.col("chunk_id").alias("node_id"), "content", F.lit(None).cast("double").alias("quality"))
    problems = materialize(X.user_queries(spark, d), "problems")
    # what is asked begins with the problem, so that its first word is the same in all rounds
    first = lambda t: F.get(T.words(t), F.lit(0))
    word = first(F.concat(F.coalesce("text", F.lit("")), F.lit(" Current thinking:")))
    words = problems.select(word.alias("text")).distinct().select(F.col("text").alias("query_id"), "text")
    hits = materialize(retrieve.text_fallback(words, c, reason.CONTEXTS).select("query_id", "node_id", "rank"), "hits")

    def find(asked: DataFrame) -> DataFrame:
        found = hits.join(asked.select("query_id"), "query_id", "left_semi")
        shown = c.select("node_id", "content").join(maybe_broadcast(found.where(F.col("rank") <= reason.SHOWN)), "node_id")
        others = found.where(F.col("rank") > reason.SHOWN).withColumn("content", F.lit(None).cast("string"))
        return shown.unionByName(others).select("query_id", "node_id", "content", "rank")

    answers, _ = reason.solve(problems, find, spark, rounds=2, term=first)
    return answers


@query(f"""
    WITH w AS (SELECT doc_id, {S.words('text')} AS w FROM documents),
    k AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(greatest(ceil((len(w) - 200) / 150.0::DOUBLE), 0) AS BIGINT))) AS k FROM w WHERE len(w) > 0)
    SELECT doc_id AS chunk_id, CAST(k AS INTEGER) AS window, array_to_string(w[k * 150 + 1 : k * 150 + 200], ' ') AS content FROM k
""")
def window_chunks(spark, d):
    return X.chunks(spark, d).select("chunk_id", F.posexplode(T.window_chunks(F.col("content"))).alias("window", "content")).withColumn("window", F.col("window").cast("int"))


@query("""
    SELECT doc_id AS chunk_id, source AS gate, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS INTEGER) AS batch,
        CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 % 3 AS INTEGER) AS worker FROM documents
""")
def batch_assignment(spark, d):
    return route.assign_batches(X.chunks(spark, d).select("chunk_id", F.col("source").alias("gate")), 3)


@query("""
    SELECT p_brand AS source_type, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(p_size AS DOUBLE)), 6) AS gb FROM part GROUP BY p_brand
""")
def source_manifest(spark, d):
    rows = X.table(spark, d, "part").select(F.col("p_brand").alias("source_type"), F.col("p_size").cast("double").alias("size_gb"))
    return catalogue_sources.manual_manifest(rows)


@query(f"""
    WITH {X.PATHED} SELECT chunk_id, '{{"data":{{"id":"' || chunk_id || '","label":"' || gate_path[3] || '","gate":"' || gate_path[1] || '"}}}}' AS element FROM pathed
""")
def prereq_elements(spark, d):
    return graph.prerequisite_elements(X.pathed(spark, d))


@query(f"WITH {X.NODES} SELECT node_id, gate_id FROM nodes WHERE gate_id = 3 AND list_contains(path, 't1') AND difficulty_id <= 3")
def filter_by_names(spark, d):
    names = spark.createDataFrame([(i, f"gate {i}") for i in range(10)], "gate_id int, gate string")
    return retrieve.by_names(X.nodes(spark, d), names, "gate 3", ["t1"], "advanced").select("node_id", "gate_id")


FLAGSHIP = hybrid_rank
