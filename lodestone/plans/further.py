"""More registered queries: sources, sinks read back, labelling, staged routing, retrieval in full, an index of cells, streaming."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.functions import gates as G
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import clean, encode, graph, reason, retrieve, route, stats, vectorscan
from lodestone.plans import catalogue as C
from lodestone.plans import fixtures as X
from lodestone.plans import sql as S
from lodestone.runtime import materialize, work_path
from lodestone.sources import catalogue as catalogue_sources
from lodestone.sources import jsonl, stores
from lodestone.streaming import incremental

query, ROUND = C.query, C.ROUND


# ---------------------------------------------------------------- sources and sinks

@query("SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents) WHERE index < 524")
def source_scan(spark, d):
    return catalogue_sources.scan(spark, f"{d}/documents.parquet", 0.005, order="doc_id").select("doc_id", "index")


@query("""
    SELECT CAST(count_if(doc_id % 7 <> 0) AS BIGINT) AS rows, CAST(count_if(doc_id % 7 = 0) AS BIGINT) AS errors, CAST(sum(CASE WHEN doc_id % 7 <> 0 THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM documents
""")
def jsonl_lines(spark, d):
    """Lines are written, some of them cut off, and read back."""
    t = X.table(spark, d, "documents")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("content"), F.lit("docs").alias("source")))
    path = work_path(spark, "lines")
    t.select(F.when(F.col("doc_id") % 7 != 0, line).otherwise(F.substring(line, 1, 9))).write.text(path)
    good, bad = jsonl.read_jsonl(spark, path)
    n = jsonl.error_counts(good, bad).agg(F.sum("rows").alias("rows"), F.sum("errors").alias("errors"))
    return n.crossJoin(F.broadcast(good.agg(F.sum(F.length("content")).alias("chars"))))  # one row


@query("SELECT 'doc-' || doc_id AS item_id, source AS gate, 'too short' AS error FROM documents WHERE length(text) < 50")
def failure_log(spark, d):
    t = X.table(spark, d, "documents").where(F.length("text") < 50)
    path = work_path(spark, "failures")
    rows = t.select(F.concat(F.lit("doc-"), "doc_id").alias("item_id"), F.lit(None).cast("string").alias("url"), F.col("source").alias("gate"), F.lit("too short").alias("error"), F.lit("scan").alias("context"))
    jsonl.write_failures(rows, path)
    return spark.read.schema("item_id string, gate string, error string").json(path)


@query("SELECT replace(lower(source), '-', '_') AS gate_file, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def gate_files(spark, d):
    path = work_path(spark, "gates")
    jsonl.write_by_gate(X.table(spark, d, "documents").select(F.col("source").alias("gate"), "text"), path)
    return spark.read.schema("text string, gate_file string").json(path).groupBy("gate_file").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0")
def progress_backup(spark, d):
    """What is left to do after a progress table that is read from its backup."""
    t = X.table(spark, d, "documents").select("doc_id")
    saved = jsonl.backup(t.where("doc_id % 2 = 0 or doc_id % 5 = 0"), work_path(spark, "progress"), "20240101T000000")
    return jsonl.not_done(t, saved, ["doc_id"])


@query("SELECT source, max(doc_id) FILTER (doc_id % 3 = 1) AS doc_id FROM documents GROUP BY source HAVING max(doc_id) FILTER (doc_id % 3 = 1) IS NOT NULL UNION ALL SELECT source, max(doc_id) FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 3 = 1) GROUP BY source")
def table_merge(spark, d):
    """Two upserts into one table: the later rows replace the earlier ones."""
    t = X.table(spark, d, "documents").select("source", "doc_id")
    path = work_path(spark, "merged")
    stores.merge(t, path, ["source"], "doc_id")
    return stores.merge(t.where("doc_id % 3 = 1"), path, ["source"], "doc_id")


@query(f"""
    WITH {X.NODES} SELECT node_id, gate_id, CASE WHEN gate_id < 5 THEN 'gate ' || gate_id ELSE 'GENERAL' END AS gate, node_type, difficulty_id, depth, CASE WHEN coalesce(quality, 0) = 0 THEN 0.5 ELSE quality END AS quality FROM nodes
""")
def vector_store(spark, d):
    """Vectors are upserted in two parts and read back with their payload."""
    n = X.nodes(spark, d)
    names = spark.createDataFrame([(i, f"gate {i}") for i in range(5)], "gate_id int, gate string")
    rows, path = stores.named_vectors(n, names), work_path(spark, "vectors")
    stores.merge(rows.where("node_id % 2 = 0"), path, ["node_id"])
    return stores.merge(rows, path, ["node_id"]).drop("vector")


@query("SELECT CAST(n // 300 + CASE WHEN n % 300 > 0 THEN 1 ELSE 0 END AS BIGINT) AS pages, CAST(n AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM embeddings)")
def vector_pages(spark, d):
    n = X.nodes(spark, d).select("node_id")
    seen = None
    for i, page in enumerate(stores.pages(n, "node_id", 300)):
        one = page.select(F.lit(i).alias("page"), "node_id")
        seen = one if seen is None else seen.unionAll(one)
    return seen.agg(F.countDistinct("page").alias("pages"), F.countDistinct("node_id").alias("rows"))


@query(f"WITH {X.NODES} SELECT node_id, quality, depth FROM nodes WHERE quality > 0.6::DOUBLE")
def high_quality(spark, d):
    path = work_path(spark, "quality")
    stores.write_quality(X.nodes(spark, d).select("node_id", "quality", "depth"), path)
    return stores.read_good(spark, path)


@query("SELECT vec_id AS node_id, CAST(label AS INTEGER) AS gate_id, 'vector' AS origin, vec_id % 3 AS score FROM embeddings")
def payload_spread(spark, d):
    e = X.table(spark, d, "embeddings")
    payload = F.struct(F.col("label").cast("int").alias("gate_id"), F.lit("vector").alias("origin"))
    return stores.spread_payload(e.select(F.col("vec_id").alias("node_id"), (F.col("vec_id") % 3).alias("score"), F.lit(-1).alias("gate_id"), payload.alias("payload")), "payload")


@query("SELECT count(*) AS rows, count(*) AS ids, count(*) AS times FROM documents")
def stamped_rows(spark, d):
    rows = materialize(stores.stamped(X.table(spark, d, "documents").select("doc_id")), "stamped")
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(F.to_timestamp("processed_at").isNotNull()).alias("times"))


_WORDS = f"regexp_extract_all(text, {S.lit('(' + encode.TOKEN + ')')})"


@query(f"SELECT doc_id AS chunk_id, CAST(len({_WORDS}) AS INTEGER) AS tokens FROM documents WHERE len({_WORDS}) > 0")
def encoded_archive(spark, d):
    path = work_path(spark, "archive")
    stores.write_archive(X.chunks(spark, d), path)
    return spark.read.parquet(f"{path}/chunks").select("chunk_id", F.size("ids").alias("tokens"))


# ---------------------------------------------------------------- text

@query(f"SELECT doc_id AS chunk_id, {S.contacts('text', 'true')} AS content FROM documents")
def strip_phones(spark, d):
    return X.chunks(spark, d).select("chunk_id", T.remove_contacts(F.col("content"), True).alias("content"))


@query(f"SELECT doc_id AS chunk_id, {S.language('text')} AS language FROM documents")
def language(spark, d):
    return X.chunks(spark, d).select("chunk_id", T.language(F.col("content")).alias("language"))


_REPAIRS = " + ".join(S.count("html", b) for b in T.REPAIRS)


@query(f"SELECT page_id, CAST({_REPAIRS} AS INTEGER) AS repairs FROM pages")
def unicode_repairs(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.unicode_repairs(F.col("html")).cast("int").alias("repairs"))


@query("SELECT doc_id AS chunk_id, '[{\"n\":' || doc_id || '}]' AS answer FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 3 = 0")
def json_answers(spark, d):
    i = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n[{\"n\":"), i, F.lit("}]\n```\nDone."))).when(F.col("doc_id") % 3 == 2, F.concat(F.lit("[{\"n\":"), i, F.lit("}]"))).otherwise("nothing")
    return X.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), T.json_block(reply).alias("answer"))


@query("SELECT vec_id AS node_id, round(0.4::DOUBLE * (vec_id % 10) / 10.0::DOUBLE + 0.3::DOUBLE * (vec_id % 7) / 7.0::DOUBLE + 0.2::DOUBLE * (vec_id % 5) / 5.0::DOUBLE + 0.1::DOUBLE * (vec_id % 3) / 3.0::DOUBLE, 6) AS quality FROM embeddings")
def composite_quality(spark, d):
    i = F.col("vec_id")
    return X.table(spark, d, "embeddings").select(i.alias("node_id"), stats.composite_quality(*((i % k) / F.lit(float(k)) for k in (10, 7, 5, 3))).alias("quality"))


@query("SELECT doc_id AS chunk_id, 384 AS size, CASE WHEN length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) > 0 THEN 1.0::DOUBLE ELSE 0 END AS length FROM documents")
def embed_text(spark, d):
    """Vectors of whole size and unit length (zero for a text without words)."""
    v = X.chunks(spark, d).select("chunk_id", V.hashed_embedding(F.col("content")).alias("v"))
    return v.select("chunk_id", F.size("v").alias("size"), F.round(V.norm(F.col("v")), 4).alias("length"))


@query("SELECT doc_id AS chunk_id, " + ", ".join(f"CAST(length(substr(text, 1, {n})) AS INTEGER) AS {k}" for k, n in T.PREVIEWS.items()) + " FROM documents")
def previews(spark, d):
    return X.chunks(spark, d).select("chunk_id", *(F.length(T.preview(F.col("content"), k)).alias(k) for k in T.PREVIEWS))


@query()
def bpe_tokens(spark, d):
    return encode.bpe_ids(X.chunks(spark, d)).select("chunk_id", F.size("ids").alias("tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))


# ---------------------------------------------------------------- labels and routing

@query(f"""
    WITH {X.LABELLED}, p AS (SELECT doc_id, {C._PERSONALITY} FROM documents)
    SELECT l.chunk_id, d.source, l.gate, l.depth, l.level, CASE WHEN l.confidence > 0.8 THEN 'approved' ELSE 'flagged' END AS status, round(p.polite, 6) AS polite, round(p.casual, 6) AS casual
    FROM labelled l JOIN documents d ON d.doc_id = l.chunk_id JOIN p ON p.doc_id = l.chunk_id
    WHERE l.gate IS NOT NULL AND path_n = ids_n AND path_n = depth AND depth BETWEEN 1 AND 7 AND level <> 'other' AND confidence >= 0.7::DOUBLE
""")
def label_assembly(spark, d):
    out = route.assemble_labels(X.chunks(spark, d), X.labelled(spark, d), T.personality(F.col("content")))
    return out.select("chunk_id", "source", "gate", "depth", "level", "status", ROUND("personality.polite").alias("polite"), ROUND("personality.casual").alias("casual"))


@query("SELECT doc_id AS chunk_id, CAST(CASE WHEN CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) % 2 = 0 THEN CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) + 1 ELSE 0 END AS INTEGER) AS gate_id FROM documents")
def taxonomy_ids(spark, d):
    c = X.chunks(spark, d).select("chunk_id", F.col("source").alias("gate"))
    number = F.regexp_extract("gate", "([0-9]+)", 1).cast("int")
    tree = c.select("gate").distinct().where(number % 2 == 0).select("gate", (number + 1).alias("gate_id"))
    return route.taxonomy_id(c, tree).select("chunk_id", "gate_id")


@query(f"""
    WITH {X.LABELLED}, c AS (
        SELECT d.source AS gate, count(*) AS chunks, ceil(count(*) / 10) AS api_calls,
            count_if(l.gate IS NOT NULL AND path_n = ids_n AND path_n = depth AND depth BETWEEN 1 AND 7 AND level <> 'other' AND confidence >= 0.7::DOUBLE) AS labelled
        FROM documents d JOIN labelled l ON l.chunk_id = d.doc_id GROUP BY 1
    ), a AS (SELECT * FROM c UNION ALL SELECT NULL, sum(chunks), sum(api_calls), sum(labelled) FROM c)
    SELECT gate, CAST(chunks AS BIGINT) AS chunks, CAST(api_calls AS BIGINT) AS api_calls, CAST(labelled AS BIGINT) AS labelled, round(labelled / chunks, 6) AS success_rate FROM a
""")
def label_report(spark, d):
    return route.label_report(X.chunks(spark, d).select("chunk_id", F.col("source").alias("gate")), X.labelled(spark, d))


@query("SELECT doc_id AS chunk_id, CAST(length(substr(text, 1, 500)) AS INTEGER) AS chars FROM documents WHERE doc_id % 4 <> 0")
def batch_classify(spark, d):
    """A stand-in model that is asked for ten texts at a time, leaves some out, and answers with their lengths in another order."""

    def ask(gate: str, texts: list[str]) -> str:
        answers = [{"n": n, "chars": len(t)} for n, t in enumerate(texts)]
        return "```json\n" + json.dumps(answers[::-1]) + "\n```"

    c = X.chunks(spark, d).where("chunk_id % 4 <> 0").select("chunk_id", F.col("source").alias("gate"), F.coalesce("content", F.lit("")).alias("content"))
    return route.classify(c, ask).select("chunk_id", F.get_json_object("answer", "$.chars").cast("int").alias("chars"))


@query(f"SELECT * FROM (VALUES (2, 'DE-ALPHA', 3), (6, 'ES-ALPHA', 3)) t(ordinal, gate, keywords)")
def gate_lookup(spark, d):
    g = G.gate_table(spark, G.SYNTHETIC_GATES)
    both = route.gate_lookup(g, name="DE-ALPHA").unionAll(route.gate_lookup(g, gate_id=6))
    return both.select("ordinal", "gate", F.size("keywords").alias("keywords"))


@query(f"""
    WITH {C._POINTS}, {C._CENTRES}, {C._SCORED}
    SELECT node_id, CASE WHEN node_id * 37 % 100 >= 70 THEN CAST(node_id % 10 AS INTEGER) WHEN node_id * 53 % 100 >= 60 AND node_id % 3 <> 0 THEN CAST(node_id % 7 AS INTEGER) ELSE gate_id END AS gate_id,
        round(CASE WHEN node_id * 37 % 100 >= 70 THEN (node_id * 37 % 100) / 100.0::DOUBLE WHEN node_id * 53 % 100 >= 60 AND node_id % 3 <> 0 THEN (node_id * 53 % 100) / 100.0::DOUBLE ELSE probability END, 6) AS confidence,
        CASE WHEN node_id * 37 % 100 >= 70 THEN 'model' WHEN node_id * 53 % 100 >= 60 AND node_id % 3 <> 0 THEN 'model,keyword' ELSE 'model,keyword,semantic' END AS fallback_chain
    FROM scored WHERE rank = 1
""")
def staged_route(spark, d):
    p = X.nodes(spark, d)
    i = F.col("node_id")
    model = p.select("node_id", (i % 10).cast("int").alias("gate_id"), (i * 37 % 100 / F.lit(100.0)).alias("confidence"))
    keyword = p.where("node_id % 3 <> 0").select("node_id", (i % 7).cast("int").alias("gate_id"), (i * 53 % 100 / F.lit(100.0)).alias("confidence"))
    out = route.route_in_stages(p, model, keyword, route.centroid_route(p, route.centroids(p)))
    return out.select("node_id", "gate_id", ROUND("confidence").alias("confidence"), F.array_join("fallback_chain", ",").alias("fallback_chain"))


@query(f"""
    WITH {C._POINTS}, {C._CENTRES}, {C._SCORED}, sec AS (SELECT node_id, string_agg(gate_id, ',' ORDER BY rank) AS secondary FROM scored WHERE rank BETWEEN 2 AND 3 AND probability > 0.1 GROUP BY node_id)
    SELECT p.node_id, coalesce(sec.secondary, '') AS secondary FROM points p LEFT JOIN sec ON sec.node_id = p.node_id
""")
def secondary_gates(spark, d):
    p = X.nodes(spark, d)
    return route.secondary_gates(route.centroid_route(p, route.centroids(p))).select("node_id", F.array_join(F.col("secondary").cast("array<string>"), ",").alias("secondary"))


@query(f"WITH {C._POINTS}, {C._CENTRES} SELECT gate_id, CAST(len(centroid) AS INTEGER) AS size, round(list_sum(centroid), 5) AS total FROM centres")
def cached_centroids(spark, d):
    path = work_path(spark, "centroids")
    p = X.nodes(spark, d)
    route.cached_centroids(p, path)
    again = route.cached_centroids(p.limit(0), path)  # the table is there
    return again.select("gate_id", F.size("centroid").alias("size"), F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_IDF = route.inverse_frequencies(G.SYNTHETIC_GATES)
_TFIDF = " UNION ALL ".join(
    f"SELECT query_id, {i} AS o, {S.lit(g)} AS gate, round(({' + '.join(f'CASE WHEN contains(lower(text), {S.lit(k)}) THEN {_IDF[k]!r}::DOUBLE ELSE 0 END' for k in words)}) / {sum(_IDF[k] for k in words)!r}::DOUBLE, 6) AS score FROM user_queries"
    for i, (g, words) in enumerate(G.SYNTHETIC_GATES.items())
)


@query(f"""
    WITH {X.USER_QUERIES}, s AS ({_TFIDF})
    SELECT query_id, CASE WHEN score > 0 THEN gate ELSE {S.lit(G.DEFAULT_QUERY_GATE)} END AS gate, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) = 1
""")
def tfidf_route(spark, d):
    return route.tfidf_gate(X.user_queries(spark, d), G.SYNTHETIC_GATES)


# ---------------------------------------------------------------- retrieval

@query(f"WITH {X.NODES} SELECT node_id, depth, quality FROM nodes WHERE gate_id = 2 AND difficulty_id <= 5 AND depth BETWEEN 1 AND 7 ORDER BY quality DESC NULLS FIRST, depth, node_id LIMIT 7")
def unset_filters(spark, d):
    """A branch of 0 and an empty path don't filter."""
    return retrieve.by_hierarchy(X.nodes(spark, d), 2, branch_id=0, prefix=[], limit=7).select("node_id", "depth", "quality")


@query(f"""
    WITH {X.NODES}, {X.EDGES}, l AS ({C._LINKED} WHERE e.edge_type = 'EXAMPLE_OF' AND n.node_type = 'PROBLEM')
    SELECT to_node, node_id, weight, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY to_node ORDER BY weight DESC, node_id) AS rank FROM l) WHERE rank <= 5
""")
def ranked_examples(spark, d):
    return retrieve.ranked_examples(X.nodes(spark, d), X.edges(spark, d))


@query(f"WITH RECURSIVE {X.NODES}, {X.EDGES}, {C._BY_GATE.replace('WHERE gate_id IN (1, 2, 3)', '')}, {C._WALK.format(depth=2)}, {C._ENRICH}, {C._FUSED.format(by='query_id, gate_id')} SELECT query_id, gate_id, node_id, round(combined, 6) AS combined, CAST(position AS INTEGER) AS position FROM o WHERE position <= 5")
def all_gates(spark, d):
    n = X.nodes(spark, d)
    out = retrieve.multi_gate(n, n, X.edges(spark, d), X.vector_queries(spark, d))
    return out.select("query_id", "gate_id", "node_id", ROUND("combined").alias("combined"), "position")


@query(f"""
    WITH {X.NODES}, {C._TOPK.format(where='true')} SELECT query_id, node_id, round(vector_score, 6) AS vector_score, CAST(rank AS INTEGER) AS rank FROM topk
""")
def cells_exhaustive(spark, d):
    """A search that looks into all cells of an index equals the exact one."""
    n = X.nodes(spark, d).select("node_id", "vector")
    learnt = vectorscan.centres(n, 16)
    out = vectorscan.scan(X.vector_queries(spark, d), vectorscan.index(n, learnt), retrieve.CANDIDATES, centres=learnt, probes=16)
    return out.select("query_id", "node_id", ROUND("vector_score").alias("vector_score"), "rank")


@query("SELECT CAST(count(*) AS BIGINT) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def cells_recall(spark, d):
    """Recall of the index against brute force, with the default share of its cells."""
    n, q = X.nodes(spark, d).select("node_id", "vector"), X.vector_queries(spark, d)
    learnt = vectorscan.centres(n, 16)
    found = vectorscan.scan(q, vectorscan.index(n, learnt, work_path(spark, "cells")), retrieve.CANDIDATES, centres=learnt)
    return vectorscan.recall(found, vectorscan.scan(q, n, retrieve.CANDIDATES)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


_HYBRID_QUERIES = """
    hq AS (
        SELECT e.vec_id AS query_id, CASE WHEN e.vec_id % 300 <> 0 THEN CAST(e.embedding AS DOUBLE[]) END AS vector,
            CASE WHEN e.vec_id % 500 = 100 THEN 'an overview' ELSE regexp_extract(d.text, '([a-zA-Z]{6,})', 1) END AS text, CAST(e.vec_id // 100 % 7 AS INTEGER) AS session_id
        FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 100 = 0
    )"""
_HYBRID = f"""
    fh AS (
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, id) AS position, most FROM (
            SELECT q.query_id, c.chunk_id AS id, c.chunk_index, 1.0::DOUBLE AS score, 5 AS most
            FROM hq q JOIN (SELECT session_id, arg_max(file_id, (uploaded_at, file_id)) AS file_id FROM files GROUP BY 1) f ON f.session_id = q.session_id JOIN file_chunks c ON c.file_id = f.file_id WHERE contains(q.text, 'overview')
            UNION ALL
            SELECT q.query_id, c.chunk_id, c.chunk_index, CASE WHEN c.content ILIKE '%' || q.text || '%' THEN 2.0::DOUBLE ELSE 1.5 END, 10
            FROM hq q JOIN files f ON f.session_id = q.session_id JOIN file_chunks c ON c.file_id = f.file_id
            WHERE NOT contains(q.text, 'overview') AND q.text <> '' AND (c.content ILIKE '%' || q.text || '%' OR c.contextual_content ILIKE '%' || q.text || '%')
        ) QUALIFY position <= most
    ),
    topk AS (
        SELECT query_id, node_id, s AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, node_id) AS rank
        FROM (SELECT query_id, node_id, {S.cosine('hq.vector', 'nodes.vector')} AS s FROM hq, nodes WHERE hq.vector IS NOT NULL AND difficulty_id <= 2) QUALIFY rank <= 20
        UNION ALL
        SELECT query_id, node_id, 0.5::DOUBLE, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC NULLS LAST, node_id) AS rank
        FROM (SELECT q.query_id, n.node_id, n.quality FROM hq q JOIN documents d ON q.text <> '' AND d.text ILIKE '%' || q.text || '%' JOIN nodes n ON n.node_id = d.doc_id WHERE q.vector IS NULL) QUALIFY rank <= 20
    )"""


@query(f"""
    WITH RECURSIVE {X.NODES}, {X.EDGES}, {X.FILES}, {X.FILE_CHUNKS}, {_HYBRID_QUERIES}, {_HYBRID}, {C._WALK.format(depth=2)}, {C._ENRICH}, {C._FUSED.format(by='query_id')},
    kb AS (SELECT query_id, node_id AS id, combined AS score, position FROM o WHERE position <= 10),
    n AS (SELECT q.query_id, (SELECT count(*) FROM fh WHERE fh.query_id = q.query_id) AS f, (SELECT count(*) FROM kb WHERE kb.query_id = q.query_id) AS k FROM hq q)
    SELECT query_id, 'file' AS kind, id, round(score, 6) AS score, CAST(position AS INTEGER) AS position FROM fh JOIN n USING (query_id) WHERE f >= 10 OR k = 0
    UNION ALL SELECT query_id, 'node', id, round(score, 6), CAST(position AS INTEGER) FROM kb JOIN n USING (query_id) WHERE f < 10
""")
def hybrid_full(spark, d):
    """Files first, vectors or texts, enrichment and fusion: every branch of the whole retrieval."""
    n = X.nodes(spark, d)
    t = X.table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.regexp_extract("text", "([a-zA-Z]{6,})", 1).alias("text"))
    i = F.col("query_id")
    q = X.vector_queries(spark, d).drop("text").join(t, "query_id").select(
        "query_id",
        F.when(i % 300 != 0, F.col("vector")).alias("vector"),
        F.when(i % 500 == 100, "an overview").otherwise(F.col("text")).alias("text"),
        ((i / 100).cast("int") % 7).alias("session_id"),
    )
    texts = X.chunks(spark, d).select(F.col("chunk_id").alias("node_id"), "content").join(n.select("node_id", "quality"), "node_id")
    out = retrieve.hybrid_retrieve(materialize(q, "queries"), n, n, X.edges(spark, d), texts, X.files(spark, d), X.file_chunks(spark, d))
    return out.withColumn("score", ROUND("score"))


@query(f"""
    WITH {X.NODES}, {X.EDGES}, l AS ({C._LINKED} WHERE e.edge_type = 'VERIFIES' AND n.node_type = 'SKILL')
    SELECT n.node_id AS query_id, true AS passed, coalesce((SELECT 'v' || l.node_id FROM l WHERE l.to_node = n.node_id ORDER BY weight DESC, 'v' || l.node_id LIMIT 1), 'none') AS verifier FROM nodes n
""")
def verified_context(spark, d):
    n = X.nodes(spark, d)
    v = retrieve.verifiers(n, X.edges(spark, d)).select(F.col("to_node").alias("node_id"), F.concat(F.lit("v"), "node_id").alias("verifier"), "weight")
    context = n.select(F.col("node_id").alias("query_id"), "node_id", F.lit(0).alias("rank"))
    return reason.context_verifiers(context, v).select("query_id", reason.verify(F.col("verifiers")).alias("v")).select("query_id", "v.*")


# ---------------------------------------------------------------- graph

@query(f"WITH {X.PATHED} SELECT gate_path[1] AS name, CAST(count(*) AS BIGINT) AS chunks FROM pathed GROUP BY 1")
def gate_nodes(spark, d):
    return graph.gate_nodes(X.pathed(spark, d))


@query(f"""
    WITH {C._GRAPH} SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS chunks, CAST((SELECT count(DISTINCT chunk_id) FROM entities) AS BIGINT) AS with_entities, CAST((SELECT count(*) FROM entities) AS BIGINT) AS entities,
        CAST((SELECT count(*) FROM triplets) AS BIGINT) AS triplets, CAST((SELECT count(*) FROM gnodes) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM gedges) AS BIGINT) AS edges
""")
def graph_counters(spark, d):
    e, n, edges = C._graph(spark, d)
    return stats.graph_counters(X.chunks(spark, d), e, graph.cooccurrence_triplets(e), n, edges)


@query(f"""
    WITH f AS (SELECT doc_id AS chunk_id, regexp_extract_all(substr(text, 1, 5000), {S.lit(graph.NOUN_CHUNK)}, 1) AS x FROM documents)
    SELECT chunk_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS text, 'CONCEPT' AS type, 0.7::DOUBLE AS score FROM f
""")
def noun_chunks(spark, d):
    return graph.noun_chunks(X.chunks(spark, d)).drop("source")


# ---------------------------------------------------------------- streams

@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_load(spark, d):
    """Events as a stream of files into a table, and what the table then holds."""
    source, out = work_path(spark, "stream-in"), work_path(spark, "stream")
    e = X.table(spark, d, "events").select("event_id", "event_type", "value")
    e.repartition(4).write.parquet(source)
    incremental.load(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source), out, work_path(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
    WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
    s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id, CAST(count(DISTINCT session) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS events FROM s GROUP BY user_id
""")
def session_counts(spark, d):
    s = incremental.sessions(X.table(spark, d, "events"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query(f"WITH {C._CLEAN} SELECT chunk_id FROM cleaned WHERE reason IS NULL")
def clean_kept(spark, d):
    return clean.clean_chunks(X.chunks(spark, d)).where("reason is null").select("chunk_id")
