"""Operators on small inputs: ties, cycles, invariants, hooks, sources, streaming."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import gates as G
from lodestone.hooks import Hooks, predict, train_router
from lodestone.operators import dedup, encode, graph, reason, retrieve, route, stats, vectorscan
from lodestone.plans import catalogue
from lodestone.runtime import require_space, running_total
from lodestone.sources import jsonl, stores
from lodestone.streaming import incremental

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- dedup

def chunks(spark, texts, source="f"):
    return spark.createDataFrame([(i, t, source, "en") for i, t in enumerate(texts)], "chunk_id long, content string, source string, lang string")


def test_similar_pairs_at_the_threshold(spark):
    w = [f"w{i}" for i in range(40)]
    c = chunks(spark, [" ".join(w[:18]), " ".join(w[:17] + w[20:22]), " ".join(w[:17] + w[30:32] + ["x"]), ""])
    assert [r[:2] for r in rows(dedup.similar_pairs(c))] == [(0, 1)]  # 17 / 20


def test_similar_pairs_equal_brute_force(spark):
    """Sets of all sizes against all pairs; texts that are in no candidate pair aren't moved."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(12)], k=rng.randint(0, 9))) for _ in range(60)]
    for _ in range(25):
        base = [f"{rng.randrange(400)}x" for _ in range(rng.randint(10, 60))]
        texts += [" ".join(base), " ".join(base[rng.randint(0, 4) :] + ["New"] * rng.randint(0, 2)), " ".join(base[: -rng.randint(1, 9)] + [f"{rng.randrange(400)}x"])]
    texts += [None, "", " "]
    sets = [frozenset((x or "").lower().split()) for x in texts]
    first = [i for i, x in enumerate(sets) if x and x not in sets[:i]]
    want = {(i, j) for i in first for j in first if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85}
    c = chunks(spark, texts).repartition(3)
    for scope in ("file", "global"):
        assert {tuple(r)[:2] for r in dedup.similar_pairs(c, scope=scope).collect()} == want and len(want) > 15
    packed = dedup._prefixes(c, 0.85)
    assert "content" not in packed.columns and all(len(r.words) <= r.n - math.ceil(0.85 * r.n) + 1 for r in packed.collect() if r.n)


def test_first_wins_on_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "chunk_id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    assert rows(dedup.first_wins(nodes, pairs)) == [(0, True), (1, False), (2, True), (3, False), (4, True), (5, False)]


def test_first_wins_equals_the_greedy_order(spark):
    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    kept = []
    for i in range(40):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    got = dedup.first_wins(spark.range(40).toDF("chunk_id"), spark.createDataFrame(pairs, "a long, b long"))
    assert [i for i, k in rows(got) if k] == kept


@pytest.mark.parametrize("scope, want", [("file", {"exact": 2, "near": 2, "kept": 996}), ("global", {"exact": 73, "near": 54, "kept": 873})])
def test_golden_counts(spark, scope, want):
    c = catalogue.X.chunks(spark, SF)
    got = dict(rows(dedup.near_duplicates(c, scope=scope).groupBy("status").count()))
    assert got["kept"] == want["kept"] and sum(got.values()) == 1000


def test_minhash_pairs_are_verified(spark):
    c = catalogue.X.chunks(spark, SF)
    exact = {r[:2] for r in rows(dedup.similar_pairs(c, scope="global"))}
    found = set(rows(dedup.minhash_pairs(c, scope="global")))
    assert found <= exact and len(found) > 0.3 * len(exact)


# --- routing

def test_keyword_gate_ties_and_default(spark):
    c = chunks(spark, ["algebra and quantum", "nothing here", "a matrix of robot slam"])
    assert [r[1] for r in rows(route.keyword_gate(c))] == ["MATH-CTRL", "MATH-CTRL", "AV-NAV"]


def test_query_rules(spark):
    q = ["hi", "what is an error", "how to fly", "plain words only", "six plain words are in here", "why? how? explain the error of an implementation that must integrate and configure all of it now please thanks"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(q)], "query_id string, text string")
    got = [tuple(r) for r in df.select(route.skip_vector(F.col("text")), route.complexity(F.col("text"))).collect()]
    assert [g[0] for g in got] == [True, True, False, True, False, False]
    assert got[5][1] == 8 and got[0][1] == 1


def test_route_prefers_a_confident_prediction(spark):
    q = spark.createDataFrame([("a", "rocket and orbital"), ("b", "zzz")], "query_id string, text string")
    p = spark.createDataFrame([("a", "CODE-GEN", 0.9), ("b", "CODE-GEN", 0.6)], "query_id string, predicted string, predicted_confidence double")
    got = {r.query_id: r for r in route.route(q, G.CHUNK_GATES, p).collect()}
    assert got["a"].gate == "CODE-GEN" and got["a"].method == "model"
    assert got["b"].gate == "MATH-CTRL" and got["b"].confidence == 0.3 and got["b"].method == "default"


def test_trained_router(spark):
    data = [(f"{w} text number {i}", w) for i in range(40) for w in ("alpha", "beta")]
    model, accuracy = train_router(spark.createDataFrame(data, "text string, label string"))
    assert accuracy > 0.9
    q = spark.createDataFrame([("1", "an alpha text")], "query_id string, text string")
    assert predict(model, q).first().predicted == "alpha"


def test_taxonomy_outline():
    tree = [{"name": f"n{i}", "id": i, "sublayers": [{"name": "s", "id": 1, "sublayers": [{"name": "t", "id": 2, "sublayers": [{"name": "u", "id": 3}]}]}]} for i in range(7)]
    out = route.format_taxonomy(tree)
    assert out.count("n") == 5 and "u" not in out


# --- retrieval

def test_hierarchy_puts_unknown_quality_first(spark):
    n = spark.createDataFrame([(1, 1, 0, 1, 1, 0.5), (2, 1, 0, 1, 1, None), (3, 1, 0, 2, 1, 0.5), (4, 2, 0, 1, 1, 0.9)], "node_id long, gate_id int, branch_id int, depth int, difficulty_id int, quality double")
    assert [r.node_id for r in retrieve.by_hierarchy(n, 1).collect()] == [2, 1, 3]


def test_containment_ignores_order(spark):
    n = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "id int, path array<string>")
    assert [r.id for r in n.where(retrieve.contains_all(F.col("path"), ["b", "a"])).collect()] == [1]
    assert n.where(retrieve.contains_all(F.col("path"), [])).count() == 2


def test_walks_end_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "from_node long, to_node long").withColumns({"edge_type": F.lit("REQUIRES"), "weight": F.lit(1.0)})
    start = spark.createDataFrame([(1,)], "node_id long")
    assert rows(retrieve.prerequisites(e, start, 3)) == [(1, 2, 1), (1, 3, 1)]
    assert graph.find_path(e, 2, 1).first().path == [2, 3, 1]
    assert graph.find_path(e, 2, 9).count() == 0
    assert len(rows(graph.related(e, start))) == 2


def test_fusion_defaults_and_ties(spark):
    c = spark.createDataFrame([("q", 1, 0.5, 2, 0.0, None), ("q", 2, 0.5, 1, 0.0, 0.0), ("q", 3, 0.9, 3, 0.0, 0.5)], "query_id string, node_id long, vector_score double, rank int, graph_score double, quality double")
    assert [r.node_id for r in retrieve.fuse(c, 3).orderBy("position").collect()] == [3, 2, 1]


def test_ilike_wildcards(spark):
    c = spark.createDataFrame([(1, "a_b"), (2, "axb")], "i int, t string")
    hit = lambda literal: [r.i for r in c.where(retrieve.ilike(F.col("t"), F.lit("A_B"), literal)).collect()]
    assert hit(False) == [1, 2] and hit(True) == [1]


def test_combine(spark):
    side = lambda n, first: spark.createDataFrame([("q", i, 1.0, i + 1 - first) for i in range(first, first + n)], "query_id string, id long, score double, position int")
    ids = lambda f, k, n, merge=False: [r.id for r in retrieve.combine(side(f, 0), side(k, 10), n, merge).orderBy("position").collect()]
    assert ids(2, 5, 5) == [10, 11, 12, 13, 14]  # too few in files: dropped
    assert ids(2, 5, 2) == [0, 1] and ids(2, 0, 5) == [0, 1]  # enough, or nothing else
    assert ids(2, 5, 4, merge=True) == [0, 1, 10, 11]


def test_copies_of_a_near_duplicate_are_near(spark):
    w = [f"w{i}" for i in range(40)]
    c = chunks(spark, [" ".join(w), " ".join([*w, "extra"]), " ".join([*w, "extra"]), " ".join(w[::-1]), " ".join(w), "", " ", ""])
    assert [s for _, s in rows(dedup.near_duplicates(c))] == ["kept", "near", "near", "near", "exact", "kept", "kept", "exact"]


def test_running_total_of_a_group_over_many_ranges(spark):
    rows_ = [(i, "hot" if i % 3 else None, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows_, "i long, g string, before int").repartition(7)
    got = {r.i: r.n for r in running_total(df, "g", "i", F.col("before"), "n").collect()}
    held = {}
    for i, g, v in rows_:
        assert got[i] == held.get(g, 0)
        held[g] = held.get(g, 0) + v


def test_vector_scan_ties_and_odd_vectors(spark):
    points = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (4, [0.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0])], "node_id long, vector array<float>").repartition(3)
    q = spark.createDataFrame([("a", [5.0, 0.0]), ("b", [0.0, 0.0])], "query_id string, vector array<float>")
    got = vectorscan.scan(q, points, 3)
    assert [(r.node_id, r.vector_score) for r in got.where("query_id = 'a'").orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (5, 0.0)]
    assert [(r.node_id, r.vector_score) for r in got.where("query_id = 'b'").orderBy("rank").collect()] == [(1, None), (2, None), (3, None)]
    assert vectorscan.scan(q.limit(0), points, 3).count() == 0 and vectorscan.scan(q, points.limit(0), 3).count() == 0


def test_merged_tables_keep_the_last(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    assert rows(stores.merge(a, path, ["k"], "at")) == [(1, "b", 2), (2, "c", 1)]
    assert rows(stores.merge(a.where("k = 2").withColumn("v", F.lit("z")), path, ["k"])) == [(1, "b", 2), (2, "z", 1)]
    assert stores.versions(spark, path) == ["v000001", "v000002"]


def test_lines_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"url": "u", "content": "c\xff\xfed"}\n{"url"\n')
    (tmp_path / "b.jsonl").write_bytes(b'{"url": "u", "content": "longer content"}\n' * 5)
    good, bad = jsonl.read_jsonl(spark, str(tmp_path))
    assert sorted(r.content for r in good.collect())[0] == "cd"
    assert rows(jsonl.error_counts(good, bad)) == [("a.jsonl", 1, 1), ("b.jsonl", 5, 0)]
    assert [p.rsplit("/", 1)[1] for p in jsonl.smallest_first(spark, str(tmp_path))] == ["a.jsonl", "b.jsonl"]


def test_space_is_checked(spark, tmp_path):
    assert require_space(spark, f"file://{tmp_path}", 0.0) > 0
    with pytest.raises(OSError):
        require_space(spark, f"file://{tmp_path}", 1e12)


def test_first_verifier_of_the_context_is_used(spark):
    find = lambda asked: asked.select("query_id", F.explode(F.array(F.lit(7), F.lit(1)).cast("array<long>")).alias("node_id"), F.lit("fact").alias("content"))
    v = spark.createDataFrame([(1, "far", 9.0), (7, "light", 0.1), (7, "heavy", 0.9)], "node_id long, verifier string, weight double")
    _, trace = reason.solve([("p", "x")], find, spark, Hooks(generate=lambda p, t: "four"), rounds=1, verifiers=v)
    assert trace.first().verification_details == "heavy" and trace.first().verification_passed


def test_summary_intent():
    assert retrieve.wants_summary("Please SUMMARIZE it") and not retrieve.wants_summary("how to fly")


# --- graph, encoding, statistics, reasoning

def test_upserts_and_simple_graph(spark):
    e = spark.createDataFrame([(1, 0, "A", "x", 0), (2, 0, "A", "y", 0), (1, 1, "B", "x", 0)], "chunk_id long, pos int, text string, type string, list int")
    n = graph.upsert_nodes(e)
    assert rows(n) == [("A", "y"), ("B", "x")]
    t = spark.createDataFrame([(1, "A", "is part-of", "B"), (2, "B", "uses", "A"), (1, "A", "x", "C")], "chunk_id long, subject string, relation string, object string")
    edges = graph.upsert_edges(t, n)
    assert rows(edges.select("subject", "relation", "object")) == [("A", "IS_PART_OF", "B"), ("B", "USES", "A")]
    assert rows(graph.simple_graph(edges)) == [("A", "B", "USES")]
    lines = rows(graph.graphml_lines(n.withColumn("name", F.concat("name", F.lit("<&"))), graph.simple_graph(edges)))
    assert "A&lt;&amp;" in lines[1][2]


def test_communities_of_two_cliques(spark):
    pairs = [(f"a{i}", f"a{j}") for i in range(4) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0")]
    g = spark.createDataFrame([(min(p), max(p), "R") for p in pairs], "u string, v string, relation string")
    got = dict(rows(graph.communities(g)))
    assert {got[f"b{i}"] for i in range(1, 5)} == {0} and {got[f"a{i}"] for i in range(1, 4)} == {1}


def test_exports_are_json(spark):
    n = spark.createDataFrame([('A"b', "x")], "name string, type string")
    c = spark.createDataFrame([('A"b', 16)], "name string, community int")
    data = json.loads(graph.cytoscape_nodes(n, c).first().element)["data"]
    assert data["id"] == 'A"b' and data["color"] == graph.PALETTE[1]


def test_entities_merge_by_precedence(spark):
    a = spark.createDataFrame([(1, 3, " Robot", "t1", 1.0, "s"), (1, 5, "ab", "t", 1.0, "s")], "chunk_id long, pos int, text string, type string, score double, source string")
    b = a.withColumns({"text": F.lit("robot"), "type": F.lit("t2"), "pos": F.lit(0)})
    assert [(r.key, r.type) for r in graph.merge_entities(a, b).collect()] == [("robot", "t1")]


def test_vocabulary_ids_count_all_tokens(spark):
    c = chunks(spark, ["a b b b b b", "c b a a a a"])
    assert rows(encode.vocabulary(c)) == [("a", 0, 5), ("b", 1, 6)]
    got = rows(encode.encode(c, encode.vocabulary(c)))
    assert got[1][1] == [-1, 1, 0, 0, 0, 0]
    packed = spark.range(1).select(encode.pack(F.lit(1), F.lit(255)), encode.pack(F.lit(256), F.lit(0))).first()
    assert packed[0] == b"\x01\xff" and packed[1] is None


@pytest.mark.skipif(not os.path.exists(encode.BPE), reason="no vocabulary here")
def test_bpe_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["Hello  world", "", None, "naïve 日本 <|endoftext|> x", "a" * 5000, "\n\n tab\t"]
    t = Tokenizer.from_file(encode.BPE)
    t.encode_special_tokens = True
    got = dict(rows(encode.bpe_ids(chunks(spark, texts))))
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}


def test_agreement(spark):
    s = spark.createDataFrame([("same", "a b", "a b")] * 4 + [("fail", "a", None)] * 4 + [("empty", "", "x")] * 2 + [("split", "a", "a"), ("split", "a", "b")], "query_id string, answer string, sample string")
    got = {r.query_id: (r.confidence, r.confident) for r in reason.agreement(s).collect()}
    assert got == {"same": (1.0, True), "fail": (1.0, True), "empty": (1.0, True), "split": (0.75, False)}


def test_text_fallback_looks_for_all_strings_at_once(spark):
    """Against brute force, with wildcards and without; no text is compared with each query where none is a pattern."""
    import re

    rng = random.Random(3)
    piece = lambda k: "".join(rng.choices("abÄ ß", k=k))
    texts = [(i, rng.choice([None, piece(rng.randint(0, 90))]) if i % 9 == 0 else piece(rng.randint(0, 90)), rng.choice([None, 0.1, 0.5, float("nan")])) for i in range(300)]
    asked = [(i, piece(rng.randint(1, 4))) for i in range(40)] + [(50 + i, rng.choice(texts)[1] or "b") for i in range(30)] + [(100, None), (101, "")]
    c = spark.createDataFrame(texts, "node_id long, content string, quality double").repartition(3)
    order = lambda r: (r[2] is None, -(math.inf if r[2] is not None and math.isnan(r[2]) else r[2] or 0), r[0])

    def want(queries, hit):
        return {(q, r[0], k + 1) for q, s in queries if s for k, r in enumerate(sorted((r for r in texts if r[1] is not None and hit(r[1].lower(), s.lower())), key=order)[:7])}

    def got(queries, literal):
        return {(r.query_id, r.node_id, r.rank) for r in retrieve.text_fallback(spark.createDataFrame(queries, "query_id long, text string"), c, 7, literal=literal).collect()}

    assert got(asked, False) == want(asked, lambda t, s: s in t)
    like = [(1, "a%b_ß"), (2, "_ä_"), (3, "%"), (4, "ab")]
    assert got(like, False) == want(like, lambda t, s: re.search(re.escape(s).replace("%", ".*").replace("_", "."), t, re.S))
    assert got(like, True) == want(like, lambda t, s: s in t)
    plan = retrieve.text_fallback(spark.createDataFrame(asked, "query_id long, text string"), c)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "MapInArrow" in plan


def test_reasoning_loop(spark):
    find = lambda asked: asked.select("query_id", F.lit(1).cast("long").alias("node_id"), F.lit("fact").alias("content"))
    answers, trace = reason.solve([("p", "two and two")], find, spark, Hooks(generate=lambda p, t: "four"), rounds=3)
    assert answers.first().status == "confident" and trace.count() == 1

    def broken(prompt, temperature):
        raise RuntimeError("down")

    answers, trace = reason.solve([("p", "x")], find, spark, Hooks(generate=broken), rounds=2)
    assert answers.first().status == "confident" and "[Error" in trace.first().z_stream[0]
    varied = iter(range(10_000))
    answers, trace = reason.solve([("p", "x")], find, spark, Hooks(generate=lambda p, t: "x" if next(varied) % 2 else "y"), rounds=2)
    assert answers.first().status == "uncertain" and answers.first().confidence == 0.5 and trace.count() == 2


def plain_loop(problems, texts, rounds):
    """Answers of the loop, problem by problem, on (node_id, content) searched for the first word."""
    from lodestone.hooks import stub_generate as generate

    out, asked = {}, {}
    for q, x in problems:
        word = f"{x or ''} Current thinking:".split()[0]
        context = [(i, t) for i, t in sorted(texts) if word.lower() in (t or "").lower()][:5]
        y, z, status, confidence = "", [], "uncertain", 0.5
        for n in range(1, rounds + 1):
            z.append(generate(reason.step_prompt(x or "", y, z, [t for _, t in context]), 0.6))
            y = generate(reason.answer_prompt(x or "", z), 0.2)
            sims = []
            for t in reason.TEMPERATURES:
                a, b = set(y.lower().split()), set(generate(reason.answer_prompt(x or "", z), t).lower().split())
                sims.append(len(a & b) / len(a | b) if a and b else 0)
            v = sum(s * s for s in sims) / 4 - (sum(sims) / 4) ** 2
            asked[q, n - 1] = [i for i, _ in context]
            if v < reason.AGREE:
                status, confidence = "confident", round(1 - v, 6)
                break
        out[q] = (y, status, pytest.approx(confidence, abs=2e-6), n)
    return out, asked


def test_reasoning_loop_takes_every_user_turn(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    # the word that a long text ends with is part of it as well
    docs = [(i, None if i % 13 == 0 else say(rng.choice([0, 3, 40, 300])) + f" end{i}", "s", "en") for i in range(60)]
    turns = [(i, t, "user" if (i + t) % 2 else "assistant", rng.choice([None, "", " "]) if (i, t) == (7, 2) else say(rng.choice([1, 5, 60, 120]))) for i in range(1, 40) for t in range(4)]
    turns[1] = (1, 1, "user", None) if turns[1][2] == "user" else turns[1]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, _ = plain_loop([(f"{i}-{t}", x) for i, t, role, x in turns if role == "user"], [d[:2] for d in docs], 2)
    got = catalogue.QUERIES["reasoning_loop"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 78 and {r.query_id: tuple(r)[1:] for r in got} == want
    assert {r.status for r in got} == {"confident", "uncertain"} and {r.rounds for r in got} == {1, 2}


def test_reasoning_loop_on_tables(spark):
    """Problems as a table, contexts by rank and verifiers; the trace has a row of every round and problem."""
    problems = [(f"p{i}", " ".join(f"w{i * j % 97}" for j in range(1, 90))) for i in range(30)] + [("e", ""), ("n", None)]
    nodes = [(i, f"w{i} text") for i in range(9)]
    find = lambda asked: asked.join(spark.createDataFrame(nodes, "node_id long, content string"), F.contains("content", F.split_part("text", F.lit(" "), F.lit(1)))).withColumn("rank", -F.col("node_id"))
    verifiers = spark.createDataFrame([(3, "units", 0.5), (3, "limits", 0.9)], "node_id long, verifier string, weight double")
    answers, trace = reason.solve(spark.createDataFrame(problems, "query_id string, text string"), find, spark, rounds=3, verifiers=verifiers)
    got, rows = {r.query_id: r for r in answers.collect()}, trace.collect()
    assert set(got) == {q for q, _ in problems} and len(rows) == sum(r.rounds for r in got.values()) == len({(r.query_id, r.iteration) for r in rows})
    assert all(r.verification_passed for r in rows) and {tuple(r.nodes_used) for r in rows if r.query_id == "p3"} == {(3,)}
    assert {r.verification_details for r in rows if 3 in r.nodes_used} == {"limits"} and {r.verification_details for r in rows if 3 not in r.nodes_used} == {"none"}
    none, trace = reason.solve([], find, spark)
    assert none.count() == trace.count() == 0


def test_personality_means(spark):
    c = spark.createDataFrame([(0.5, None), (None, None), (1.0, 1.0)], "warm double, clear double")
    r = stats.mean_personality(c, ["warm", "clear"], {})
    assert tuple(r.first()) == (2, 0.75, 0.5)
    assert stats.mean_personality(c.limit(0), ["warm"], {"warm": 0.7}).first().warm == 0.7


# --- sources, sinks, streaming

def test_jsonl_counts_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u", "content": "c"}\nnot json\n')
    good, bad = jsonl.read_jsonl(spark, str(tmp_path))
    assert good.count() == 1 and bad.count() == 1 and good.first().url == "u"
    assert jsonl.first_lines(good, 1, "url").count() == 1


def test_content_fields(spark):
    df = spark.createDataFrame([(0, "q", "", "a", "b"), (1, None, None, None, None)], "index long, question string, text string, answer string, output string")
    got = [r[0] for r in df.select(jsonl.extract_content(df.drop("index"))).collect()]
    assert got[0] == "q\n\na\n\nb" and got[1] == "{}"


def test_stores(spark, tmp_path):
    c = chunks(spark, ["a b " * 20] * 3)
    stores.write_archive(c, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive/chunks")).count() == 3
    assert stores.archive_ratio(spark, c, str(tmp_path / "archive")) > 0
    n = spark.createDataFrame([(1, 2, 3, 4, 5)], "chunk_id long, gate_id int, branch_id int, topic_id int, level_id int")
    stores.write_store(n, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("gate_id = 2").count() == 1
    raw = c.select(F.lit("AV-NAV").alias("gate"), "content")
    jsonl.write_by_gate(raw, str(tmp_path / "gates"))
    assert (tmp_path / "gates/gate_file=av_nav").exists()
    jsonl.write_once(n, str(tmp_path / "once"))
    jsonl.write_once(n, str(tmp_path / "once"))
    lines = graph.graphml_lines(spark.createDataFrame([("a", "t")], "name string, type string"), spark.createDataFrame([], "u string, v string, relation string"))
    stores.write_graphml(lines, str(tmp_path / "graphml"))
    text = "".join(p.read_text() for p in (tmp_path / "graphml").glob("part-*"))
    assert text.startswith("<?xml") and text.rstrip().endswith("</graphml>")


def test_gates_from_yaml(spark, tmp_path):
    (tmp_path / "gates.yaml").write_text("gates:\n  - {id: 1, name: A, keywords: [x], provider: p, specialist_model: m}\n")
    assert G.load_gates(spark, str(tmp_path / "gates.yaml")).first().keywords == ["x"]
    with pytest.raises(OSError):
        G.load_gates(spark, str(tmp_path / "none.yaml"))


def test_stream_drops_repeated_content(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"content": "a", "at": "2024-01-01T00:00:00Z"}\n{"content": "a", "at": "2024-01-01T00:01:00Z"}\n{"content": "b", "at": "2024-01-01T00:02:00Z"}\n')
    stream = incremental.stream_json(spark, str(source), "content string, at timestamp")
    q = incremental.load(incremental.new_content(stream, "at"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sessions(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id long, at string").select("user_id", F.to_timestamp("at").alias("ts"))
    assert sorted(r.n for r in incremental.sessions(e).collect()) == [1, 2]


# --- the contract

def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_source_catalogue(spark, tmp_path):
    from lodestone.sources import catalogue as sources

    config = {"A": {"huggingface": [{"name": "x/y", "split": "train", "size_gb": 0.5}], "pdfs": [{"name": "p", "size_gb": 2.0, "url": "u"}, {"name": "q", "size_gb": 1.0}], "total_gb": 3.5}}
    c = sources.catalogue(spark, config)
    assert c.count() == 3 and rows(sources.manual_manifest(c)) == [("pdfs", 2, 3.0)]
    assert c.select(F.max(sources.item_limit(F.col("size_gb")))).first()[0] == 100_000
    spark.range(50).write.parquet(str(tmp_path / "d"))
    assert sources.scan(spark, str(tmp_path / "d"), 20 / 104857.6).count() == 20


def test_batched_labels_are_matched_by_place(spark):
    c = chunks(spark, ["one", "two", "three"]).withColumn("gate", F.lit("G")).coalesce(1)
    got = route.classify(c, lambda gate, texts: 'sure: [{"n": 1, "label": "%s"}, {"n": 9}, 3]' % texts[1])
    assert [(r.chunk_id, json.loads(r.answer)["label"]) for r in got.collect()] == [(1, "two")]
    assert route.classify(c, lambda g, t: "no list [").count() == 0


def test_cached_centroids(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "node_id long, gate_id int, vector array<float>")
    assert route.cached_centroids(p, str(tmp_path / "c")).first().centroid == [0.5, 0.5]
    assert route.cached_centroids(p.limit(0), str(tmp_path / "c")).count() == 1
