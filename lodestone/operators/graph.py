"""Knowledge graph: mentions, entities, triplets, upserts, prerequisite links, walks, communities, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.runtime import drop, materialize, number_rows

#: Relations that a triplet may have, and the communities' colours.
RELATIONS = [
    "is_used_for", "is_part_of", "requires", "enables", "implements", "extends", "controls", "processes",
    "communicates_with", "depends_on", "contains", "produces", "measures", "optimizes", "configures", "integrates_with",
]
ENTITY_TYPES = [
    "concept", "technology", "algorithm", "framework", "language", "hardware", "sensor", "actuator", "protocol", "standard",
    "method", "technique", "tool", "library", "model", "system", "component", "process", "operation", "function",
]
PALETTE = [
    "#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FFEAA7", "#DDA0DD", "#98D8C8", "#F7DC6F", "#BB8FCE", "#85C1E9",
    "#F8B500", "#00CED1", "#FF69B4", "#32CD32", "#FFD700",
]


def capitalised_entities(chunks: DataFrame, limit: int = 5000) -> DataFrame:
    """(chunk_id, pos, text, type, score, source): capitalised words of the first ``limit``
    characters, a stand-in for a trained recogniser."""
    found = F.regexp_extract_all(F.substring("content", 1, limit), F.lit(r"(\p{Lu}\p{L}{3,})"), 1)
    rows = chunks.select("chunk_id", F.posexplode(found).alias("pos", "text"))
    kind = F.element_at(F.array(*(F.lit(t) for t in ENTITY_TYPES)), F.length("text") % len(ENTITY_TYPES) + 1)
    return rows.select("chunk_id", F.col("pos").cast("int").alias("pos"), "text", kind.alias("type"), F.lit(1.0).alias("score"), F.lit("rule").alias("source"))


#: Articles that noun chunks begin with; their words have so many letters at least, and this confidence.
ARTICLES, NOUN, NOUN_SCORE = ("the", "a", "an"), 4, 0.7
NOUN_CHUNK = rf"(?:^|[^\p{{L}}])(?:{'|'.join(ARTICLES)}) ([a-z]{{{NOUN},}})"


def noun_chunks(chunks: DataFrame, limit: int = 5000) -> DataFrame:
    """(chunk_id, pos, text, type, score, source): the longer words after an article, a stand-in for a parser's noun chunks."""
    found = F.regexp_extract_all(F.substring("content", 1, limit), F.lit(NOUN_CHUNK), 1)
    rows = chunks.select("chunk_id", F.posexplode(found).alias("pos", "text"))
    return rows.select("chunk_id", F.col("pos").cast("int").alias("pos"), "text", F.lit("CONCEPT").alias("type"), F.lit(NOUN_SCORE).alias("score"), F.lit("chunk").alias("source"))


def merge_entities(*lists: DataFrame) -> DataFrame:
    """One entity per chunk and lower-cased name of over two characters; earlier lists, then earlier places win."""
    rows = None
    for i, part in enumerate(lists):
        part = part.withColumn("list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("key", T.strip(F.lower("text"))).where(F.length("key") > 2)
    first = F.row_number().over(Window.partitionBy("chunk_id", "key").orderBy("list", "pos"))
    return rows.withColumn("n", first).where("n = 1").select("chunk_id", "key", "text", "type", "score", "source", "list", "pos")


def cooccurrence_triplets(entities: DataFrame, most: int = 20) -> DataFrame:
    """(chunk_id, pos, subject, relation, object): neighbours among the first entities of a chunk,
    a stand-in for a language model."""
    w = Window.partitionBy("chunk_id").orderBy("pos", "key")
    rows = entities.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).withColumn("object", F.lead("text").over(w))
    relation = F.element_at(F.array(*(F.lit(r) for r in RELATIONS)), (F.length("text") + F.length("object")) % len(RELATIONS) + 1)
    return rows.where("object is not null").select("chunk_id", F.col("n").alias("pos"), F.col("text").alias("subject"), relation.alias("relation"), "object")


def relation_name(relation: Column) -> Column:
    return F.upper(F.translate(relation, " -", "__"))


def upsert_nodes(entities: DataFrame) -> DataFrame:
    """(name, type): the last type of each name wins."""
    return entities.groupBy(F.col("text").alias("name")).agg(F.max_by("type", F.struct("chunk_id", "list", "pos")).alias("type"))


def gate_nodes(chunks: DataFrame) -> DataFrame:
    """(name, chunks): gates, the first part of the paths, and how many chunks belong to each."""
    gate = F.get("gate_path", F.lit(0))
    return chunks.where(gate.isNotNull()).groupBy(gate.alias("name")).agg(F.count("*").alias("chunks"))


def upsert_edges(triplets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(subject, relation, object, chunk_id): unique edges between known nodes, the last chunk wins."""
    known = nodes.select("name")
    rows = triplets.join(known.withColumnRenamed("name", "subject"), "subject", "left_semi").join(known.withColumnRenamed("name", "object"), "object", "left_semi")
    return rows.groupBy("subject", relation_name(F.col("relation")).alias("relation"), "object").agg(F.max("chunk_id").alias("chunk_id"))


def simple_graph(edges: DataFrame) -> DataFrame:
    """(u, v, relation): undirected, without parallels; the last relation wins."""
    return (
        edges.where("subject <> object")
        .groupBy(F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v"))
        .agg(F.max_by("relation", F.struct("chunk_id", "relation")).alias("relation"))
    )


def degrees(graph: DataFrame) -> DataFrame:
    ends = graph.select(F.col("u").alias("name")).unionAll(graph.select("v"))
    return ends.groupBy("name").agg(F.count("*").alias("degree"))


def communities(graph: DataFrame, rounds: int = 8) -> DataFrame:
    """(name, community): label propagation; each node takes its neighbours' commonest label, the least of equals.

    Deterministic and distributed; communities are numbered by size, then by name.
    """
    both = materialize(graph.select("u", "v").unionAll(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))), "neighbours")
    labels = materialize(both.select(F.col("u").alias("name")).distinct().withColumn("label", F.col("name")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("name", "v"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        # a node's own label counts once, which keeps two sides from swapping for ever
        own = labels.select(F.col("name").alias("u"), "label", F.lit(1).cast("long").alias("n"))
        best = votes.unionByName(own).groupBy("u", "label").agg(F.sum("n").alias("n")).groupBy("u").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
        following = materialize(best.select(F.col("u").alias("name"), "label"), "labels")
        same = following.join(labels.withColumnRenamed("label", "old"), "name").where("label <> old").limit(1).count() == 0
        drop(labels)
        labels = following
        if same:
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    number = number_rows(sizes, F.desc("size"), F.col("label"), name="community").withColumn("community", F.col("community").cast("int"))
    return labels.join(number.select("label", "community"), "label").select("name", "community")


def cytoscape_nodes(nodes: DataFrame, community: DataFrame, gate: Column | None = None) -> DataFrame:
    """One JSON element per node; community 0 if it has none."""
    c = F.coalesce("community", F.lit(0))
    colour = F.element_at(F.array(*(F.lit(x) for x in PALETTE)), c % len(PALETTE) + 1)
    rows = nodes.join(community, "name", "left")
    data = F.struct(F.col("name").alias("id"), F.col("name").alias("label"), F.col("type"), (gate if gate is not None else F.lit("UNKNOWN")).alias("gate"), c.alias("community"), colour.alias("color"))
    return rows.select("name", F.to_json(F.struct(data.alias("data"))).alias("element"))


def cytoscape_edges(edges: DataFrame) -> DataFrame:
    data = F.struct(F.col("subject").alias("source"), F.col("object").alias("target"), "relation")
    return edges.select(F.to_json(F.struct(data.alias("data"))).alias("element"))


def note_nodes(nodes: DataFrame, community: DataFrame, degree: DataFrame) -> DataFrame:
    """Nodes labelled as notes, with degree and community."""
    rows = nodes.join(community, "name", "left").join(degree, "name", "left")
    return rows.select("name", F.to_json(F.struct(F.col("name").alias("id"), F.concat(F.lit("[["), "name", F.lit("]]")).alias("label"), F.coalesce("community", F.lit(0)).alias("community"), F.coalesce("degree", F.lit(0)).alias("degree"), "type")).alias("element"))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml_lines(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """Lines of a GraphML document with their order (part, name): written sorted as text."""
    spark = nodes.sparkSession
    head = spark.createDataFrame(
        [(0, "", '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="node" attr.name="type" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/><graph edgedefault="undirected">'), (3, "", "</graph></graphml>")],
        "part int, name string, line string",
    )
    n = nodes.select(F.lit(1).alias("part"), "name", F.concat(F.lit('<node id="'), _xml(F.col("name")), F.lit('"><data key="type">'), _xml(F.col("type")), F.lit("</data></node>")).alias("line"))
    e = graph.select(F.lit(2), F.concat_ws("|", "u", "v"), F.concat(F.lit('<edge source="'), _xml(F.col("u")), F.lit('" target="'), _xml(F.col("v")), F.lit('"><data key="relation">'), _xml(F.col("relation")), F.lit("</data></edge>")))
    return head.unionAll(n).unionAll(e)


def prerequisite_links(chunks: DataFrame) -> DataFrame:
    """(chunk_id, prerequisite_chunk_id, strength) of chunks (chunk_id, gate_path, prerequisites: paths);
    of chunks with one path the last counts; only four-part paths are links."""
    by_path = chunks.groupBy("gate_path").agg(F.max("chunk_id").alias("prerequisite_chunk_id"))
    wanted = chunks.select("chunk_id", F.explode("prerequisites").alias("gate_path")).where(F.size("gate_path") == 4)
    return wanted.join(by_path, "gate_path").select("chunk_id", "prerequisite_chunk_id").distinct().withColumn("strength", F.lit(1.0))


def related(edges: DataFrame, start: DataFrame, depth: int = 2, most: int = 50) -> DataFrame:
    """(start, node_id, depth): nodes reached over any edge in either direction, the ``most`` nearest of each start."""
    both = edges.select(F.col("from_node").alias("at"), F.col("to_node").alias("node_id")).unionAll(edges.select(F.col("to_node").alias("at"), F.col("from_node").alias("node_id"))).distinct()
    level = start.select(F.col("node_id").alias("start"), F.col("node_id").alias("at")).distinct()
    found = None
    for d in range(1, depth + 1):
        level = level.join(both, "at").select("start", F.col("node_id").alias("at")).distinct()
        rows = level.select("start", F.col("at").alias("node_id"), F.lit(d).alias("depth"))
        found = rows if found is None else found.unionAll(rows)
    near = found.where("start <> node_id").groupBy("start", "node_id").agg(F.min("depth").alias("depth"))
    return near.withColumn("n", F.row_number().over(Window.partitionBy("start").orderBy("depth", "node_id"))).where(F.col("n") <= most).drop("n")


def find_path(edges: DataFrame, start: int, end: int, depth: int = 4) -> DataFrame:
    """(path, depth): the shortest path, the least of equals; nodes are visited once at their least depth."""
    step = edges.where("from_node <> to_node").select(F.col("from_node").alias("at"), F.col("to_node").alias("next")).distinct()
    spark = edges.sparkSession
    level = spark.createDataFrame([(start, [start])], "at long, path array<long>")
    seen = level
    for _ in range(depth):
        level = level.join(step, "at").select(F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        level = level.groupBy("at").agg(F.min("path").alias("path")).join(seen.select("at"), "at", "left_anti")
        level = materialize(level, "paths")  # each level is read by all later ones
        seen = seen.unionAll(level)
    return seen.where(F.col("at") == end).select("path", (F.size("path") - 1).alias("depth"))


def prerequisite_elements(chunks: DataFrame) -> DataFrame:
    """One JSON element per chunk of the prerequisite graph: its topic as the label, its first part as the gate."""
    label = F.coalesce(F.get("gate_path", F.lit(2)), F.lit("Unknown"))
    data = F.struct(F.col("chunk_id").cast("string").alias("id"), label.alias("label"), F.get("gate_path", F.lit(0)).alias("gate"))
    return chunks.select("chunk_id", F.to_json(F.struct(data.alias("data"))).alias("element"))
