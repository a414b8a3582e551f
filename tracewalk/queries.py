"""Registered queries: the operators over whole tables, each with the SQL it is compared with.

Questions about one entity are point lookups by nature; everything else answers its
question for every anchor of a type at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewalk.functions.text import label_key, label_key_column
from tracewalk.operators import aggregate, claims, evidence, existence, search, traverse
from tracewalk.operators.match import Pattern, PatternEdge, PatternNode, match_pattern, proofs
from tracewalk.plans.answers import MOST_LINES
from tracewalk.plans.governance import StaticAssurance
from tracewalk.plans.ir import Step
from tracewalk.runtime import build, standard_runtime
from tracewalk.sources import documents
from tracewalk.sources.bundled import COMMERCE, load_domain, load_facts
from tracewalk.sources.graph import FactGraph, StarGraph, coerce_edges, coerce_nodes, commerce, last_wins, surrogate_edge_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PLACED = Step("PLACED", "OUT", "CUSTOMER", "ORDER")
PLACED_BY = Step("PLACED", "IN", "CUSTOMER", "ORDER")
INCLUDES = Step("INCLUDES", "OUT", "ORDER", "PART")
FULFILLED_BY = Step("FULFILLED_BY", "OUT", "ORDER", "SUPPLIER")
BASED_IN = Step("BASED_IN", "OUT", "SUPPLIER", "NATION")
LOCATED_IN = Step("LOCATED_IN", "OUT", "CUSTOMER", "NATION")
RESIDENTS = Step("LOCATED_IN", "IN", "CUSTOMER", "NATION")

#: The edge id of a line of an order, in SQL.
LINE = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"
#: The walk customer -> order -> part, in SQL.
PARTS = f"SELECT c_custkey AS n0, CAST(o_orderkey AS VARCHAR) AS e1, o_orderkey AS n1, {LINE} AS e2, l_partkey AS n2 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"
QUESTION = "Which parts are included in orders placed by Customer#000000005"
MOST = 10
CAP = 12


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _walks(g: StarGraph, kind: str, *steps: Step) -> DataFrame:
    return traverse.walk(g, traverse.anchors_of(g, kind), steps)


@query("""SELECT 'customer-' || c_custkey AS node_id, 'CUSTOMER' AS node_type, c_name AS name FROM customer WHERE regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]', '', 'g') = 'customer000000005'""")
def entity_lookup(spark, d):
    """An entity by its label, whatever its case and punctuation."""
    rows = commerce(spark, d).nodes("CUSTOMER")
    return rows.where(label_key_column(F.col("name")) == label_key("customer 000000005")).select("node_id", "node_type", "name")


@query("SELECT c_custkey AS request_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'TRUE' ELSE 'UNKNOWN' END AS truth FROM customer")
def entity_exists(spark, d):
    g = commerce(spark, d)
    return existence.exists(traverse.anchors_of(g, "CUSTOMER"), _walks(g, "CUSTOMER", PLACED), closed=False)


@query("""WITH l AS (
  SELECT 'part-' || p_partkey AS node_id, 'PART' AS node_type, p_name AS name FROM part UNION ALL SELECT 'customer-' || c_custkey, 'CUSTOMER', c_name FROM customer
  UNION ALL SELECT 'supplier-' || s_suppkey, 'SUPPLIER', s_name FROM supplier UNION ALL SELECT 'nation-' || n_nationkey, 'NATION', n_name FROM nation UNION ALL SELECT 'region-' || r_regionkey, 'REGION', r_name FROM region
) SELECT regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '', 'g') AS label_key, 1.0::DOUBLE AS best_score, count(DISTINCT (node_type, node_id)) AS n, arg_min(node_id, (node_type, node_id)) AS first_id FROM l GROUP BY 1 HAVING count(DISTINCT (node_type, node_id)) > 1""")
def entity_ambiguity(spark, d):
    """Labels that name several entities, over every labelled type."""
    g = commerce(spark, d)
    rows = None
    for kind in ("PART", "CUSTOMER", "SUPPLIER", "NATION", "REGION"):
        own = g.nodes(kind).select("node_id", "node_type", label_key_column(F.col("name")).alias("label_key"), F.lit(1.0).alias("score"))
        rows = own if rows is None else rows.unionByName(own)
    return existence.ambiguous(rows)


@query("SELECT c_custkey AS request_id, CAST(o_orderkey AS VARCHAR) AS edge_id, 'order-' || o_orderkey AS node_id, 'customer-' || c_custkey || '>order-' || o_orderkey AS path_nodes FROM customer JOIN orders ON o_custkey = c_custkey")
def traverse_out_1hop(spark, d):
    g = commerce(spark, d)
    return traverse.result_rows(g, _walks(g, "CUSTOMER", PLACED), [PLACED], "CUSTOMER").select("request_id", F.col("e1").alias("edge_id"), "node_id", "path_nodes")


@query("SELECT n_nationkey AS request_id, 'customer-' || c_custkey AS node_id, c_name AS name, c_mktsegment FROM nation JOIN customer ON c_nationkey = n_nationkey")
def traverse_in_1hop(spark, d):
    g = commerce(spark, d)
    rows = traverse.result_rows(g, _walks(g, "NATION", RESIDENTS), [RESIDENTS], "NATION")
    return rows.select("request_id", "node_id", "name", F.get_json_object("properties", "$.c_mktsegment").alias("c_mktsegment"))


@query(f"SELECT n0 AS request_id, 'part-' || n2 AS node_id, p_name AS name, 'customer-' || n0 || '>order-' || n1 || '>part-' || n2 AS path_nodes, e1 || '>' || e2 AS path_edges FROM ({PARTS}) JOIN part ON p_partkey = n2")
def traverse_out_2hop(spark, d):
    g = commerce(spark, d)
    return traverse.result_rows(g, _walks(g, "CUSTOMER", PLACED, INCLUDES), [PLACED, INCLUDES], "CUSTOMER").select("request_id", "node_id", "name", "path_nodes", "path_edges")


@query("SELECT c_custkey AS request_id, 'nation-' || n_nationkey AS node_id, n_name AS name, count(*) AS n_paths FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3")
def traverse_mixed_3hop(spark, d):
    g = commerce(spark, d)
    steps = [PLACED, FULFILLED_BY, BASED_IN]
    counts = _walks(g, "CUSTOMER", *steps).groupBy("request_id", "n3").agg(F.count("*").alias("n_paths"))
    return counts.join(g.nodes("NATION"), F.col("n3") == F.col("key")).select("request_id", "node_id", "name", "n_paths")


def _limited(g: StarGraph) -> DataFrame:
    return traverse.limit_per_request(_walks(g, "CUSTOMER", PLACED, INCLUDES), MOST)


LIMITED = f"SELECT *, row_number() OVER (PARTITION BY n0 ORDER BY e1, e2, n1, n2) AS path_rank FROM ({PARTS}) QUALIFY path_rank <= {MOST}"


@query(f"SELECT n0 AS request_id, path_rank, e1, e2, n2 AS part FROM ({LIMITED})")
def batch_traverse_per_anchor_limit(spark, d):
    """max_results for each of many requests: the first walks by edge ids."""
    return _limited(commerce(spark, d)).select("request_id", "path_rank", "e1", "e2", F.col("n2").alias("part"))


@query(f"SELECT e1, e2, n2 AS part FROM ({PARTS}) WHERE n0 = 5 ORDER BY e1, e2, n1, n2 LIMIT 25")
def traverse_limit_truncation(spark, d):
    """One question with max_results: a top-k, with the anchor pushed into the scan."""
    g = commerce(spark, d)
    paths = traverse.walk(g, traverse.anchor(g, "CUSTOMER", "customer-5"), [PLACED, INCLUDES], 5)
    return traverse.limit_walks(paths, 25).select("e1", "e2", F.col("n2").alias("part"))


FAN_OUT = f"SELECT c_custkey AS request_id, 1 AS hop, count(*) AS walks FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 UNION ALL SELECT n0, 2, count(*) FROM ({PARTS}) GROUP BY 1"


@query(FAN_OUT)
def hop_cardinality(spark, d):
    """True fan-out of each hop, before any limit."""
    g = commerce(spark, d)
    return traverse.fan_out(g, traverse.anchors_of(g, "CUSTOMER"), [PLACED, INCLUDES])


@query(f"SELECT * FROM ({FAN_OUT}) WHERE walks > {CAP}")
def cap_violations(spark, d):
    g = commerce(spark, d)
    return traverse.cap_violations(g, traverse.anchors_of(g, "CUSTOMER"), [PLACED, INCLUDES], CAP)


@query(f"SELECT request_id, hop, count(*) AS n FROM (SELECT n0 AS request_id, unnest([1, 2]) AS hop FROM ({LIMITED})) GROUP BY 1, 2")
def evidence_cardinality(spark, d):
    """Evidence rows of each hop, after the limit."""
    g = commerce(spark, d)
    return evidence.hop_cardinality(evidence.evidence_edges(g, _limited(g), [PLACED, INCLUDES], "CUSTOMER"))


@query(f"SELECT n0 AS request_id, count(*) AS n_paths, count(DISTINCT n2) AS n_nodes FROM ({PARTS}) GROUP BY 1")
def count_neighbors(spark, d):
    return aggregate.count_walks(_walks(commerce(spark, d), "CUSTOMER", PLACED, INCLUDES), "n2")


def _dated(spark, d) -> DataFrame:
    g = commerce(spark, d)
    return traverse.walk(g, traverse.anchors_of(g, "CUSTOMER"), [PLACED]).join(g.nodes("ORDER").select("key", "o_orderdate"), F.col("n1") == F.col("key")).drop("key")


DATED = "SELECT o_custkey AS request_id, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, CAST(o_orderkey AS VARCHAR)) AS date_rank FROM orders JOIN customer ON c_custkey = o_custkey"


@query(f"SELECT request_id, 'order-' || o_orderkey AS node_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date, date_rank FROM ({DATED}) WHERE date_rank <= 3")
def topn_by_date(spark, d):
    top = aggregate.top_by_date(_dated(spark, d), F.col("o_orderdate"), 3)
    return top.select("request_id", F.concat(F.lit("order-"), F.col("n1")).alias("node_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "date_rank")


@query(f"SELECT request_id, 'order-' || o_orderkey AS node_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM ({DATED}) WHERE date_rank = 1")
def latest_by_date(spark, d):
    top = aggregate.latest_by_date(_dated(spark, d), F.col("o_orderdate"))
    return top.select("request_id", F.concat(F.lit("order-"), F.col("n1")).alias("node_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


NATIONS = "SELECT c_custkey AS request_id, s_nationkey AS nation, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"


@query(f"SELECT * FROM ({NATIONS}) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC, nation) = 1")
def group_by_max(spark, d):
    """The nation that supplies each customer most."""
    walks = _walks(commerce(spark, d), "CUSTOMER", PLACED, FULFILLED_BY, BASED_IN).withColumnRenamed("n3", "nation")
    return aggregate.group_by_max(walks, "nation")


def _targets(spark, d, closed: bool) -> DataFrame:
    g = commerce(spark, d)
    asked = g.nodes("CUSTOMER").select(F.col("key").alias("request_id"), F.col("key").alias("target"))
    return existence.boolean_targets(asked, _walks(g, "CUSTOMER", PLACED), "n1", closed)


TARGETS = "SELECT c_custkey AS request_id, c_custkey AS target, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey = c_custkey) THEN 'TRUE' ELSE '{}' END AS truth FROM customer"


@query(TARGETS.format("UNKNOWN"))
def boolean_target_true(spark, d):
    """Did customer k place order k? In an open world, no edge is no answer."""
    return _targets(spark, d, closed=False)


@query(TARGETS.format("FALSE"))
def boolean_target_missing(spark, d):
    """The same in a closed world."""
    return _targets(spark, d, closed=True)


@query("SELECT p_partkey AS request_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def closed_world_negatives(spark, d):
    """Parts that no order includes."""
    g = commerce(spark, d)
    walks = _walks(g, "PART", Step("INCLUDES", "IN", "ORDER", "PART"))
    return existence.negatives(traverse.anchors_of(g, "PART").select("request_id"), walks)


LOCAL = Pattern("local_supplier", (PatternNode("c", "CUSTOMER"), PatternNode("o", "ORDER"), PatternNode("s", "SUPPLIER"), PatternNode("n", "NATION")), (PatternEdge("c", "PLACED", "o"), PatternEdge("o", "FULFILLED_BY", "s"), PatternEdge("s", "BASED_IN", "n"), PatternEdge("c", "LOCATED_IN", "n")))


@query("""SELECT request_id, count(*) AS n_proofs, min(w) AS witness FROM (SELECT DISTINCT c_custkey AS request_id, 'customer-' || c_custkey || '>order-' || o_orderkey || '>supplier-' || s_suppkey || '>nation-' || s_nationkey AS w
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey) GROUP BY 1""")
def required_subgraph_proof(spark, d):
    """Customers who bought from a supplier of their own nation, with proofs counted."""
    g = commerce(spark, d)
    steps = [PLACED, FULFILLED_BY, BASED_IN]
    walks = _walks(g, "CUSTOMER", *steps)
    home = _walks(g, "CUSTOMER", LOCATED_IN)
    columns = ["request_id", "source_id", "relation", "target_id"]
    edges = evidence.evidence_edges(g, walks, steps, "CUSTOMER").select(*columns).unionByName(evidence.evidence_edges(g, home, [LOCATED_IN], "CUSTOMER").select(*columns))
    nodes = evidence.evidence_nodes(g, walks, steps, "CUSTOMER").unionByName(evidence.evidence_nodes(g, home, [LOCATED_IN], "CUSTOMER"))
    return proofs(match_pattern(edges, nodes, LOCAL), [n.alias for n in LOCAL.nodes])


@query("SELECT 'u1' AS unit_id, 1 AS unit_ordinal, c_custkey AS request_id, 'order-' || o_orderkey AS node_id FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'u2', 2, c_custkey, 'nation-' || n_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def composite_union(spark, d):
    g = commerce(spark, d)
    units = [traverse.result_rows(g, _walks(g, "CUSTOMER", s), [s], "CUSTOMER").select("request_id", "node_id") for s in (PLACED, LOCATED_IN)]
    return aggregate.union_units(units).select("unit_id", "unit_ordinal", "request_id", "node_id")


@query(f"SELECT request_id, hop, sum(n)::BIGINT AS n FROM (SELECT c_custkey AS request_id, 1 AS hop, 1 AS n FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n0, unnest([1, 2]), 1 FROM ({LIMITED})) GROUP BY 1, 2")
def composite_roll_up(spark, d):
    """Per-hop counts of a composite: its units' added up."""
    g = commerce(spark, d)
    one = evidence.evidence_edges(g, _limited(g), [PLACED, INCLUDES], "CUSTOMER")
    two = evidence.evidence_edges(g, _walks(g, "CUSTOMER", LOCATED_IN), [LOCATED_IN], "CUSTOMER")
    return aggregate.roll_up([evidence.hop_cardinality(one), evidence.hop_cardinality(two)])


EDGES = f"SELECT n0 AS request_id, 1 AS hop, e1 AS edge_id, 'customer-' || n0 AS source_id, 'PLACED' AS relation, 'order-' || n1 AS target_id, 'OUT' AS direction FROM ({LIMITED}) UNION ALL SELECT n0, 2, e2, 'order-' || n1, 'INCLUDES', 'part-' || n2, 'OUT' FROM ({LIMITED})"


@query(EDGES)
def evidence_edges(spark, d):
    g = commerce(spark, d)
    return evidence.evidence_edges(g, _limited(g), [PLACED, INCLUDES], "CUSTOMER")


@query(f"SELECT DISTINCT request_id, node_id, node_type FROM (SELECT n0 AS request_id, 'customer-' || n0 AS node_id, 'CUSTOMER' AS node_type FROM ({LIMITED}) UNION ALL SELECT n0, 'order-' || n1, 'ORDER' FROM ({LIMITED}) UNION ALL SELECT n0, 'part-' || n2, 'PART' FROM ({LIMITED}))")
def evidence_nodes_distinct(spark, d):
    g = commerce(spark, d)
    return evidence.evidence_nodes(g, _limited(g), [PLACED, INCLUDES], "CUSTOMER")


@query(f"SELECT DISTINCT request_id, source_id AS subject, relation AS predicate, target_id AS object, edge_id FROM ({EDGES})")
def typed_facts(spark, d):
    g = commerce(spark, d)
    return evidence.typed_facts(evidence.evidence_edges(g, _limited(g), [PLACED, INCLUDES], "CUSTOMER"))


def _over_all(name: str) -> str:
    """The SQL of a query that shows the limit, over every walk."""
    return SQL[name].replace(LIMITED, PARTS)


def _all_edges(g: StarGraph) -> DataFrame:
    return evidence.evidence_edges(g, _walks(g, "CUSTOMER", PLACED, INCLUDES), [PLACED, INCLUDES], "CUSTOMER")


@query(_over_all("evidence_cardinality"))
def evidence_cardinality_all(spark, d):
    """Evidence rows of each hop, of all walks."""
    return evidence.hop_cardinality(_all_edges(commerce(spark, d)))


@query(_over_all("composite_roll_up"))
def composite_roll_up_all(spark, d):
    g = commerce(spark, d)
    two = evidence.evidence_edges(g, _walks(g, "CUSTOMER", LOCATED_IN), [LOCATED_IN], "CUSTOMER")
    return aggregate.roll_up([evidence.hop_cardinality(_all_edges(g)), evidence.hop_cardinality(two)])


@query(_over_all("evidence_edges"))
def evidence_edges_all(spark, d):
    return _all_edges(commerce(spark, d))


@query(_over_all("evidence_nodes_distinct"))
def evidence_nodes_distinct_all(spark, d):
    g = commerce(spark, d)
    return evidence.evidence_nodes(g, _walks(g, "CUSTOMER", PLACED, INCLUDES), [PLACED, INCLUDES], "CUSTOMER")


@query(_over_all("typed_facts"))
def typed_facts_all(spark, d):
    return evidence.typed_facts(_all_edges(commerce(spark, d)))


@query("SELECT DISTINCT o_orderkey AS edge_key, CAST(o_orderkey AS VARCHAR) AS edge_id, o_custkey AS src FROM orders JOIN customer ON c_custkey = o_custkey")
def result_graph_edges(spark, d):
    """The graph's own edges that are in evidence."""
    g = commerce(spark, d)
    rows = evidence.result_graph(g, evidence.evidence_edges(g, _walks(g, "CUSTOMER", PLACED), [PLACED], "CUSTOMER"), "PLACED")
    return rows.select(F.col("dst").alias("edge_key"), "edge_id", "src").distinct()


def _event_records(spark, d) -> DataFrame:
    """Events as generic records whose properties say where they come from, single or listed."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k")
    props = F.to_json(F.struct(F.col("event_type").alias("source_ref"), F.array(F.concat(F.lit("k:"), k), F.concat(F.lit("user:"), F.col("user_id")), F.concat(F.lit("k:"), k)).alias("evidence_id")))
    bare = F.when(F.col("event_type") == "view", F.lit("{}")).otherwise(props)
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), bare.alias("properties"), "event_id", "user_id")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(event_id AS VARCHAR) ELSE array_to_string(list_sort(list_distinct([event_type, 'k:' || json_extract_string(props, '$.k'), 'user:' || user_id])), '|') END AS refs FROM events""")
def provenance_refs(spark, d):
    rows = _event_records(spark, d)
    return rows.select("event_id", F.array_join(evidence.provenance_column(F.col("properties"), F.col("id")), "|").alias("refs"))


CLAIMS = """SELECT c_custkey AS request_id, c_name AS subject, 'BUYS_FROM' AS predicate, s_name AS object, 'AFFIRM' AS polarity, 'KNOWN' AS status, min(l) AS provenance, count(*) AS n
FROM (SELECT o_custkey, l_suppkey, LINE AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4""".replace("LINE", LINE)


@query(CLAIMS)
def claims_deduped(spark, d):
    """Who buys from whom, each claim once, with names for ids."""
    g = commerce(spark, d)
    walks = _walks(g, "CUSTOMER", PLACED, FULFILLED_BY)
    edges = walks.select("request_id", F.concat(F.lit("customer-"), F.col("n0")).alias("source_id"), F.lit("BUYS_FROM").alias("relation"), F.concat(F.lit("supplier-"), F.col("n2")).alias("target_id"), F.col("e2").alias("edge_id"))
    names = g.nodes("CUSTOMER").select("node_id", "name").unionByName(g.nodes("SUPPLIER").select("node_id", "name"))
    return claims.dedupe_claims(claims.edge_claims(edges, names))


@query("SELECT 'supplier-' || s_suppkey AS request_id, s_name AS subject, 'IS_A' AS predicate, 'SUPPLIER' AS object, 'AFFIRM' AS polarity, 'KNOWN' AS status, 'supplier-' || s_suppkey AS provenance FROM supplier")
def is_a_claims(spark, d):
    rows = commerce(spark, d).nodes("SUPPLIER")
    return claims.is_a_claims(rows.select(F.col("node_id").alias("request_id"), "node_id", "node_type", "name"))


@query(f"SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY object) AS place, subject, object FROM ({CLAIMS}) QUALIFY place <= 5")
def claims_ordered(spark, d):
    """The first lines of each customer's answer."""
    from pyspark.sql import Window

    own = Window.partitionBy("request_id").orderBy(*claims.claim_order())
    return claims_deduped(spark, d).withColumn("place", F.row_number().over(own)).where("place <= 5").select("request_id", "place", "subject", "object")


@query("SELECT 'user-' || user_id AS node_id, arg_max(event_type, event_id) AS node_type, CAST(max(event_id) AS VARCHAR) AS last_event FROM events GROUP BY 1")
def node_upsert_last_wins(spark, d):
    """Events as a stream of writes to user nodes."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = coerce_nodes(e.select(F.concat(F.lit(" user-"), F.col("user_id")).alias("id"), F.col("event_type").alias("type"), F.to_json(F.struct(F.col("event_id").alias("event"))).alias("properties"), F.col("event_id").alias("seq")), ("seq",))
    return last_wins(rows, "node_id", "seq").select("node_id", "node_type", F.get_json_object("properties", "$.event").alias("last_event"))


@query("SELECT user_id || ':' || event_type AS edge_id, 'user-' || user_id AS src_id, arg_max('event-' || event_id, event_id) AS dst_id, 'DID' AS relation FROM events GROUP BY 1, 2")
def edge_upsert_last_wins(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = e.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"), F.concat(F.lit("user-"), F.col("user_id")).alias("source"), F.concat(F.lit("event-"), F.col("event_id")).alias("target"), F.lit("DID").alias("relation_type"), F.col("event_id").alias("seq"))
    return last_wins(coerce_edges(raw, ("seq",)), "edge_id", "seq").select("edge_id", "src_id", "dst_id", "relation")


@query("""SELECT n_nationkey, sha256('{"relation":"IN_REGION","source":"nation-' || n_nationkey || '","target":"region-' || n_regionkey || '"}') AS edge_id FROM nation""")
def surrogate_edge_ids(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select("n_nationkey", surrogate_edge_id(F.lit("IN_REGION"), F.concat(F.lit("nation-"), F.col("n_nationkey")), F.concat(F.lit("region-"), F.col("n_regionkey"))).alias("edge_id"))


@query("SELECT CAST(event_id AS VARCHAR) AS node_id, event_type AS node_type, CAST(event_id AS VARCHAR) AS name FROM events WHERE trim(event_type) <> ''")
def record_coercion(spark, d):
    """Records with aliased fields as nodes, named by id where no property names them."""
    g = FactGraph(spark, coerce_nodes(_event_records(spark, d)), spark.createDataFrame([], "edge_id string, src_id string, dst_id string, relation string, properties string"))
    return g.nodes().select("node_id", F.lower("node_type").alias("node_type"), "name")


FILTERS = {"lang": "fr", "source": ["src1", "src2", "src3"]}


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2', 'src3')")
def metadata_filter(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(search.matches_all(FILTERS)).select("doc_id", "lang", "source")


@query("""SELECT doc_id || '#' || (i - 1) AS chunk_id, doc_id, CAST(i - 1 AS INTEGER) AS position, lines[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL) WHERE length(trim(lines[i])) > 0""")
def document_chunks(spark, d):
    return documents.chunk_lines(spark.read.parquet(f"{d}/documents.parquet"))


def _lexical(spark, d, k: int) -> DataFrame:
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return documents.LexicalIndex(spark.read.parquet(f"{d}/documents.parquet")).search(asked, k)


def _bm25_sql(k: int) -> str:
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""SELECT query_id, doc_id, score, rank FROM (
WITH w AS (SELECT doc_id, {words} AS ws FROM documents), z AS (SELECT count(*) AS n_docs, avg(len(ws)) AS mean_length FROM w),
q AS (SELECT DISTINCT item_id AS query_id, unnest({words}) AS term FROM benchmark),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(mean_length) AS mean_length FROM p, z GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score FROM p JOIN i USING (term) JOIN q USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""


@query(_bm25_sql(10))
def lexical_topk(spark, d):
    """BM25 of every benchmark item over all documents."""
    return _lexical(spark, d, 10)


def _centroids(spark, d) -> tuple[DataFrame, DataFrame]:
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").alias("query_id"), "vector")
    return first, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _vector_sql(k: int) -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= {k}"""


@query(_vector_sql(10))
def vector_topk(spark, d):
    """The nearest vectors to the first of each label, exactly."""
    asked, held = _centroids(spark, d)
    return documents.VectorIndex(held).search(asked, 10)


@query(f"""SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 9) DESC, doc_id) AS rank
FROM (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, rank FROM ({_bm25_sql(10)}) UNION ALL SELECT CAST(query_id AS BIGINT), doc_id, rank FROM ({_vector_sql(10)})) GROUP BY 1, 2) WHERE rank <= 5""")
def rrf_fusion(spark, d):
    asked, held = _centroids(spark, d)
    vectors = documents.VectorIndex(held).search(asked, 10).withColumn("query_id", F.col("query_id").cast("long"))
    return search.reciprocal_rank_fusion([_lexical(spark, d, 10), vectors])


@query(f"""SELECT query_id, n_found, n_expected, hits, CASE WHEN n_found > 0 THEN round(hits / n_found, 6) END AS "precision", CASE WHEN n_expected > 0 THEN round(hits / n_expected, 6) END AS recall FROM (
SELECT query_id, sum(f)::BIGINT AS n_found, sum(e)::BIGINT AS n_expected, sum(f * e)::BIGINT AS hits FROM (
SELECT coalesce(a.query_id, b.query_id) AS query_id, CASE WHEN a.doc_id IS NULL THEN 0 ELSE 1 END AS f, CASE WHEN b.doc_id IS NULL THEN 0 ELSE 1 END AS e
FROM (SELECT DISTINCT query_id, doc_id FROM ({_vector_sql(10)})) a FULL JOIN (SELECT label AS query_id, vec_id AS doc_id FROM embeddings) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id) GROUP BY 1)""")
def retrieval_evaluation(spark, d):
    """Precision and recall of the vector search against the labels."""
    want = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))
    return documents.evaluate(vector_topk(spark, d), want)


@query("""SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM (SELECT * FROM conversations WHERE role = 'user') q LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1""")
def question_log(spark, d):
    return documents.question_log(spark.read.parquet(f"{d}/conversations.parquet"))


@query(f"SELECT e1 || '>' || e2 AS path_edges, 'part-' || n2 AS node_id, p_name AS name, 'INCLUDES' AS relation FROM ({PARTS}) JOIN part ON p_partkey = n2 WHERE n0 = 5 ORDER BY e1, e2, n1, n2 LIMIT 1000")
def compiled_question(spark, d):
    """A question in words, compiled, bound and built: the un-run DataFrame."""
    return standard_runtime(COMMERCE, commerce(spark, d), StaticAssurance()).explain(QUESTION).select("path_edges", "node_id", "name", "relation")


ASKED = (
    QUESTION,
    "How many orders does Customer#000000005 place?",
    "Which customers located in NATION_3?",
    "Show Customer#000000005",
    "Does Customer#000000005 exist?",
    "top 3 orders Customer#000000005 placed",
)


@query()
def rendered_answer(spark, d):
    """Questions asked through the whole runtime: status, truth, answer and digests."""
    runtime = standard_runtime(COMMERCE, commerce(spark, d), StaticAssurance())
    rows = []
    for q in ASKED:
        c = runtime.compile(q)
        if not c.accepted:
            rows.append((q, "REJECTED", c.result.reason, "", ""))
            continue
        a = runtime.ask(q)
        rows.append((q, a.status, a.response["answer"], a.compilation.bound.digest, a.receipt.digest))
    return spark.createDataFrame(rows, "question string, status string, answer string, plan_digest string, receipt_digest string")


FORMS = {
    "relation out": QUESTION,
    "relation in": "Which customers located in NATION_3?",
    "count": "How many orders does Customer#000000005 place?",
    "lookup": "Show Customer#000000005",
    "existence": "Does Customer#000000005 exist?",
    "top": "top 3 orders Customer#000000005 placed",
    "latest": "most recent order Customer#000000005 placed",
}
_FIFTH = "SELECT 'order-' || o_orderkey AS id, o_orderdate AS placed FROM orders WHERE o_custkey = 5"


@query(f"""WITH f AS (
  SELECT 'relation out' AS form, 'INCLUDES' AS relation, 'order-' || n1 || ' —INCLUDES→ ' || p_name AS line FROM ({PARTS}) JOIN part ON p_partkey = n2 WHERE n0 = 5
  UNION ALL SELECT 'relation out', 'PLACED', c_name || ' —PLACED→ order-' || n1 FROM ({PARTS}) JOIN customer ON c_custkey = n0 WHERE n0 = 5
  UNION ALL SELECT 'relation in', 'LOCATED_IN', c_name || ' —LOCATED_IN→ ' || n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3'
  UNION ALL SELECT 'lookup', 'IS_A', c_name || ' —IS_A→ CUSTOMER' FROM customer WHERE c_name = 'Customer#000000005')
SELECT form, 'COMPLETE' AS status, 'Facts:' || string_agg(chr(10) || '- ' || line, '' ORDER BY i) AS answer FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY relation, line) AS i FROM (SELECT DISTINCT * FROM f)) WHERE i <= {MOST_LINES} GROUP BY form
UNION ALL SELECT 'count', 'COMPLETE', 'COUNT: ' || count(*) FROM ({_FIFTH})
UNION ALL SELECT 'existence', 'COMPLETE', 'Yes.' FROM customer WHERE c_name = 'Customer#000000005'
UNION ALL SELECT 'top', 'COMPLETE', 'TOP_N: [' || string_agg(chr(39) || id || chr(39), ', ' ORDER BY placed DESC, id) || ']' FROM (SELECT * FROM ({_FIFTH}) ORDER BY placed DESC, id LIMIT 3)
UNION ALL SELECT 'latest', 'COMPLETE', 'LATEST: ' || id FROM (SELECT * FROM ({_FIFTH}) ORDER BY placed DESC, id LIMIT 1)""")
def question_forms(spark, d):
    """A question of each form through the whole runtime, from words to the rendered answer."""
    runtime = standard_runtime(COMMERCE, commerce(spark, d), StaticAssurance())
    asked = [(form, runtime.ask(q)) for form, q in FORMS.items()]
    rows = [(form, a.status, a.response["answer"]) for form, a in asked]
    return spark.createDataFrame(rows, "form string, status string, answer string")


@query()
def receipt_lineage(spark, d):
    """Lineage rows of the bundled domains' questions."""
    asked = {"research_network": ["Which datasets were produced by projects contributed to by Alice?", "Which labs is Alice member of?", "Does Bob contribute?"], "equipment_network": ["Which components are contained by facilities located at Device One?"]}
    rows = []
    for name, questions in asked.items():
        runtime = standard_runtime(load_domain(name), FactGraph.from_facts(spark, load_facts(name)).cached(), StaticAssurance())
        rows += [tuple(str(v) for v in runtime.ask(q).lineage.values()) for q in questions]
    names = "receipt_digest planner_id domain_id pack_fingerprint pack_version logical_plan_digest executable_plan_digest execution_status assurance_status pre_status post_status execution_reference".split()
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    runtime = standard_runtime(COMMERCE, commerce(spark, d), StaticAssurance())
    return build(runtime.compile(QUESTION).bound, runtime.graph)
