"""Operators against plain Python on small random graphs, and sources, streams and retrieval."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracewalk.functions.text import fingerprint, label_key, label_key_column, phrase_key, phrase_key_column
from tracewalk.operators import aggregate, claims, evidence, existence, search, traverse
from tracewalk.operators.match import Pattern, PatternEdge, PatternNode, match_pattern, proofs
from tracewalk.plans.ir import Step
from tracewalk.sources import documents
from tracewalk.sources.bundled import load_domain, load_facts
from tracewalk.sources.graph import FactGraph, coerce_edges, coerce_nodes, last_wins
from tracewalk.streaming.upserts import GraphLog


def random_facts(seed):
    rng = random.Random(seed)
    nodes = [{"id": f"n{i:02}", "type": rng.choice("ABC"), "properties": {"name": f"N {i}"}} for i in range(25)]
    edges = [{"id": f"e{i:03}", "source": f"n{rng.randrange(28):02}", "target": f"n{rng.randrange(28):02}", "relation_type": rng.choice(["r", "S"])} for i in range(120)]
    return {"nodes": nodes, "edges": edges}


def brute_walks(facts, start, steps):
    kind = {n["id"]: n["type"] for n in facts["nodes"]}
    paths = [((start,), ())] if start in kind else []
    for s in steps:
        grown = []
        for ns, es in paths:
            for e in sorted(facts["edges"], key=lambda e: e["id"]):
                a, b = (e["source"], e["target"]) if s.direction == "OUT" else (e["target"], e["source"])
                if e["relation_type"].upper() == s.relation and a == ns[-1] and (kind.get(b) == s.there or s.there == "ANY" and b in kind):
                    grown.append(((*ns, b), (*es, e["id"])))
        paths = grown
    return paths


STEPS = [Step("R", "OUT", "A", "B"), Step("S", "IN", "C", "B")]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("steps", [STEPS, STEPS[:1], [Step("R", "OUT", "A", "ANY"), Step("R", "OUT", "ANY", "A")]])
def test_walks_agree_with_nested_loops(spark, seed, steps):
    facts = random_facts(seed)
    g = FactGraph.from_facts(spark, facts)
    starts = [n["id"] for n in facts["nodes"] if n["type"] == "A"]
    rows = traverse.walk(g, traverse.anchors_of(g, "A"), steps).collect()
    k = len(steps)
    got = sorted((tuple(r[f"n{i}"] for i in range(k + 1)), tuple(r[f"e{i}"] for i in range(1, k + 1))) for r in rows)
    assert got == sorted(p for s in starts for p in brute_walks(facts, s, steps))


def test_limit_takes_the_first_walks_by_edge_ids(spark):
    facts = random_facts(4)
    g = FactGraph.from_facts(spark, facts)
    rows = traverse.limit_per_request(traverse.walk(g, traverse.anchors_of(g, "A"), STEPS[:1]), 2).collect()
    for s in {r.request_id for r in rows}:
        assert sorted(r.e1 for r in rows if r.request_id == s) == [p[1][0] for p in brute_walks(facts, s, STEPS[:1])][:2]


def test_cap_probe_and_wrong_direction(spark):
    g = FactGraph.from_facts(spark, random_facts(1))
    some = next(n["id"] for n in random_facts(1)["nodes"] if n["type"] == "A" and brute_walks(random_facts(1), n["id"], STEPS[:1]))
    start = traverse.anchor(g, "A", some)
    with pytest.raises(traverse.WalkError, match="cap"):
        traverse.checked_walk(g, start, STEPS[:1], 0)
    assert traverse.checked_walk(g, start, STEPS[:1], 999, some).count() > 0
    with pytest.raises(traverse.WalkError, match="direction"):
        traverse.walk(g, start, [Step("R", "UP", "A", "B")])


def test_missing_anchor_has_no_walks(spark):
    g = FactGraph.from_facts(spark, random_facts(1))
    assert traverse.walk(g, traverse.anchor(g, "A", "nope"), STEPS).count() == 0


def test_coercion_and_upserts(spark):
    raw = spark.createDataFrame([(" a ", None, "T", None, 1), (None, "b", None, "U", 2), (None, None, "T", None, 3), ("c", None, " ", None, 4), ("a", None, "T2", None, 5)], "node_id string, id string, node_type string, type string, seq long")
    got = {r.node_id: r.node_type for r in last_wins(coerce_nodes(raw, ("seq",)), "node_id", "seq").collect()}
    assert got == {"a": "T2", "b": "U"}
    edges = spark.createDataFrame([(None, "x", "y", "R"), ("k", "x", None, "R"), (None, "x", "y", "R")], "edge_id string, source string, target string, relation string")
    (r,) = coerce_edges(edges).distinct().collect()
    assert r.edge_id == fingerprint({"source": "x", "target": "y", "relation": "R"})
    g = FactGraph.from_facts(spark, load_facts("research_network"))
    more = g.upsert_nodes(spark.createDataFrame([("researcher-bob", "RESEARCHER", json.dumps({"name": "Robert"}))], "node_id string, node_type string, properties string"))
    assert {r.name for r in more.nodes("RESEARCHER").collect()} == {"Alice", "Robert"}
    nodes, links = more.query()
    assert nodes.count() == 6 and links.count() == 3


def test_parallel_edges_stay_apart(spark):
    g = FactGraph.from_facts(spark, {"nodes": [{"id": "a", "type": "A"}, {"id": "b", "type": "B"}], "edges": [{"id": f"e{i}", "source": "a", "target": "b", "relation": "R"} for i in range(3)]})
    assert traverse.walk(g, traverse.anchors_of(g, "A"), STEPS[:1]).count() == 3


def test_provenance(spark):
    bags = ['{"source_ref":" z ","evidence_id":["b","a","b"],"other":"q"}', "{}", '{"source_id":null,"provenance":""}', '{"source_doc_ids":[]}', '{"provenance":5}', None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, p string")
    got = [r[0] for r in df.orderBy("i").select(evidence.provenance_column(F.col("p"), F.lit("own"))).collect()]
    assert got == [["a", "b", "z"], ["own"], ["own"], ["own"], ["5"], ["own"]]


def test_pattern_join_finds_every_injective_binding(spark):
    edges = spark.createDataFrame([(1, "a", "R", "b1"), (1, "a", "R", "b2"), (1, "b2", "S", "c"), (1, "b2", "S", "b2"), (2, "a", "R", "b1")], "request_id int, source_id string, relation string, target_id string")
    nodes = spark.createDataFrame([(q, n, t) for q in (1, 2) for n, t in (("a", "X"), ("b1", "Y"), ("b2", "Y"), ("c", "Z"))], "request_id int, node_id string, node_type string")
    p = Pattern("p", (PatternNode("x", "X"), PatternNode("y", "Y"), PatternNode("z")), (PatternEdge("x", "R", "y"), PatternEdge("y", "S", "z")))
    assert [tuple(r) for r in proofs(match_pattern(edges, nodes, p), ["x", "y", "z"]).collect()] == [(1, 1, "a>b2>c")]


def test_group_by_max_and_counts(spark):
    paths = spark.createDataFrame([(1, 5, 9, "a"), (1, 5, 8, "b"), (1, 4, 8, "c"), (1, 4, 7, "d"), (2, 3, 1, "e")], "request_id int, n1 int, n2 int, e1 string")
    assert sorted(tuple(r) for r in aggregate.group_by_max(paths, "n1").collect()) == [(1, 4, 2), (2, 3, 1)]
    assert sorted(tuple(r) for r in aggregate.count_walks(paths, "n2").collect()) == [(1, 4, 3), (2, 1, 1)]


def test_ambiguity_counts_the_best_score_only(spark):
    rows = [("k", "a", "T", 1.0), ("k", "b", "T", 0.9), ("m", "a", "T", 1.0), ("m", "c", "U", 1.0), ("m", "a", "T", 1.0)]
    got = existence.ambiguous(spark.createDataFrame(rows, "label_key string, node_id string, node_type string, score double")).collect()
    assert [tuple(r) for r in got] == [("m", 1.0, 2, "a")]


def test_claims(spark):
    edges = spark.createDataFrame([("q", "a", "R", "b", "e2"), ("q", "a", "R", "b", "e1"), ("q", "a", "R", "zz", "e3")], "request_id string, source_id string, relation string, target_id string, edge_id string")
    names = spark.createDataFrame([("a", "Alice"), ("b", "Bob")], "node_id string, name string")
    got = claims.dedupe_claims(claims.edge_claims(edges, names)).orderBy(*claims.claim_order()).collect()
    assert [(r.subject, r.object, r.provenance, r.n) for r in got] == [("Alice", "Bob", "e1", 2), ("Alice", "zz", "e3", 1)]


def test_labels_in_columns_and_on_the_driver(spark):
    texts = ["Straße 12", "ÉCOLE x²", " A_b-C?", "", "Ⅷ no. 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(label_key_column(F.col("t"))).collect()] == [label_key(t) for t in texts]
    asked = ["Who  is\tBob ?", " show it", "?"]
    df = spark.createDataFrame([(t,) for t in asked], "t string")
    assert [r[0] for r in df.select(phrase_key_column(F.col("t"))).collect()] == [phrase_key(t) for t in asked]


def test_streamed_upserts(spark, tmp_path):
    schema = "id string, type string, properties string"
    log = GraphLog(spark, f"{tmp_path}/log")
    assert log.graph().query()[0].count() == 0
    for i, rows in enumerate([[("a", "T", "{}"), ("b", "T", "{}")], [("a", "T2", '{"name":"A"}')]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        log.follow_nodes(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/cp", once=True).awaitTermination()
    for g in (log.graph(), log.compact(f"{tmp_path}/small").graph()):
        assert {(r.node_id, r.node_type) for r in g.node_table.collect()} == {("a", "T2"), ("b", "T")}


def test_document_store_and_retrieval(spark):
    docs = spark.createDataFrame([(1, "cats chase mice\n\n  mice hide", "en"), (2, "dogs chase cats", "en"), (3, "le chat", "fr"), (4, None, None)], "doc_id long, text string, lang string")
    store = documents.DocumentStore.over(docs)
    assert store.chunks.count() == 4 and store.get_chunk("1#2").first().text == "  mice hide"
    newer = store.upsert_documents(spark.createDataFrame([(3, "le chien", "fr"), (5, "new", "en")], docs.schema))
    assert newer.documents.count() == 5 and newer.get_document(3).first().text == "le chien"
    asked = spark.createDataFrame([("q", "mice cats")], "query_id string, text string")
    got = documents.LexicalIndex(docs).search(asked, 5, {"lang": "en"}).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "doc_id long, vector array<float>")
    near = documents.VectorIndex(vectors).search(spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, vector array<float>"), 5)
    assert [r.doc_id for r in near.orderBy("rank").collect()] == [2, 1]
    fused = search.reciprocal_rank_fusion([documents.LexicalIndex(docs).search(asked, 5), near])
    assert {r.doc_id for r in fused.collect()} == {1, 2}
    scores = documents.evaluate(near, spark.createDataFrame([("q", 2), ("p", 1)], "query_id string, doc_id long"))
    assert {r.query_id: (r.precision, r.recall) for r in scores.collect()} == {"q": (0.5, 1.0), "p": (None, 0.0)}


def test_telemetry(spark, tmp_path):
    log = documents.TelemetryLog(f"{tmp_path}/t")
    for i in range(2):
        log.append(spark.createDataFrame([(f"q{i}", "a", 0.5)], "question string, answer string, seconds double"))
    assert log.read(spark).count() == 2


def test_bundled_domains_are_copies():
    load_domain("research_network")["entities"].clear()
    assert load_domain("research_network")["entities"]
    with pytest.raises(KeyError):
        load_facts("nothing")


def test_providers_and_extractors(spark):
    from tracewalk.sources import providers

    # Defined here, so that they travel to the workers whole.
    class Lengths:
        def embed(self, texts):
            return [[len(t), 1.0] for t in texts]

        def complete(self, prompt):
            return prompt.upper()

    class Names:
        def extract(self, chunk, entities=None):
            words = sorted({w for w in chunk["text"].split() if w.istitle()})
            if entities is None:
                return [{"node_id": w.lower(), "node_type": "NAME", "properties": {"name": w}} for w in words]
            return [{"src_id": a["node_id"], "dst_id": b["node_id"], "relation": "WITH"} for a, b in zip(entities, entities[1:], strict=False)]

    class CountNames:
        def can_handle(self, question):
            return question.startswith("count")

        def build(self, question, graph):
            return graph.nodes("NAME")

        def summarize(self, rows):
            return f"{len(rows)} names"

        def is_satisfied(self, rows):
            return bool(rows)

    chunks = spark.createDataFrame([(1, "Ann met Bob"), (2, "Bob left")], "chunk_id long, text string")
    got = {r.chunk_id: list(r.vector) for r in providers.embed_column(chunks, Lengths()).collect()}
    assert got == {1: [11.0, 1.0], 2: [8.0, 1.0]}
    assert providers.complete_column(chunks, Lengths(), "text").orderBy("chunk_id").first().completion == "ANN MET BOB"
    g = providers.extract_graph(chunks, Names(), Names())
    assert {r.name for r in g.nodes("NAME").collect()} == {"Ann", "Bob"}
    assert [(r.src, r.dst) for r in g.edges("WITH").collect()] == [("ann", "bob")]
    assert providers.answer_by_intent("count them", g, [CountNames()]) == "2 names"
    assert providers.answer_by_intent("show them", g, [CountNames()]) is None
