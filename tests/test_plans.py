"""Grammar, packs, plans, policy and governance, without Spark."""

from dataclasses import replace

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewalk.functions.text import Template, Words, canonical_json, fingerprint, label_key, relation_phrases, type_phrases
from tracewalk.operators.match import Pattern, PatternEdge, PatternNode, pattern_of_walk
from tracewalk.plans.governance import AdmissionError, AmbiguousPlanner, ExtensionRegistry, Planner, PlannerRegistry, Selection, StaticAssurance, UnsupportedPlanner, admit
from tracewalk.plans.grammar import Candidate, Compiler, FixedResolver
from tracewalk.plans.ir import Annotation, Bounds, Constraint, PlanError, Unit, bind, check_acyclic, check_plan
from tracewalk.plans.pack import DomainPack, PackError
from tracewalk.plans.policy import Context, Evidence, after, before, binds_pattern
from tracewalk.sources.bundled import load_domain

PEOPLE = FixedResolver([Candidate("researcher:alice", "RESEARCHER", "Alice", 1.0), Candidate("researcher:bob", "RESEARCHER", "Bob", 1.0), Candidate("project:atlas", "PROJECT", "Atlas", 1.0), Candidate("x:1", "LAB", "Twin", 1.0), Candidate("x:2", "LAB", "Twin", 1.0)])


def compiler(**changes):
    raw = load_domain("research_network")
    raw["capabilities"] = [*raw["capabilities"], "AGGREGATION"]
    raw["query"]["aggregations"] = {"operations": ["COUNT", "TOP_N", "LATEST"], "date_keys": ["date"]}
    return Compiler(DomainPack.load({**raw, **changes}), PEOPLE)


@pytest.mark.parametrize(
    ("question", "kind", "direction", "reason"),
    [
        ("Which datasets were produced by projects contributed to by Alice?", "TRAVERSE", "OUT", "ok"),
        ("Does Alice exist?", "EXISTS", None, "ok"),
        ("Show Alice", "TRAVERSE", None, "ok"),
        ("Which researchers contributed to Atlas?", "TRAVERSE", "IN", "ok"),
        ("Who contributed to Atlas?", None, None, "unsupported_intent"),
        ("Does Alice contributed to Atlas?", "BOOLEAN_CHECK", "OUT", "ok"),
        ("Does nobody contributed to Atlas?", "BOOLEAN_CHECK", "IN", "ok"),
        ("latest project Alice contributed to", "AGGREGATE", "OUT", "ok"),
        ("top 3 projects Alice contributed to", "AGGREGATE", "OUT", "ok"),
        ("most recent project Alice contributed to", "AGGREGATE", "OUT", "ok"),
        ("How many projects does Alice contributed to", "AGGREGATE", "OUT", "ok"),
        ("How many", None, None, "unsupported_intent"),
        ("Which labs is Alice member of and Show Bob", "COMPOSITE", None, "ok"),
        ("Show Twin", None, None, "entity_ambiguous"),
        ("Show Zed", None, None, "entity_not_found"),
        ("What is the weather", None, None, "unsupported_intent"),
        ("", None, None, "unsupported_intent"),
    ],
)
def test_forms(question, kind, direction, reason):
    r = compiler().compile(question)
    assert r.reason == reason
    assert (r.plan.plan_type if r.plan else None) == kind
    if direction:
        assert r.plan.steps[0].direction == direction


def test_missing_capability_and_hop_limit():
    assert compiler(capabilities=["RELATION_LOOKUP"]).compile("Show Alice").reason == "entity_lookup_unsupported"
    limited = compiler(governance={"max_hops": 1})
    assert limited.compile("Which datasets were produced by projects contributed to by Alice?").reason == "max_hops_exceeds_governance"


def test_as_edges_is_not_part_of_the_mention():
    r = compiler().compile("Which researchers contributed to Atlas as edges?")
    assert r.ok and r.plan.projection.kind == "EDGES" and r.plan.anchors[0].node_id == "project:atlas"


def test_equal_programs_are_ambiguous():
    raw = load_domain("research_network")
    twin = {**raw["query"]["semantic_programs"][1], "program_id": "twin"}
    raw["query"]["semantic_programs"].append(twin)
    assert Compiler(DomainPack.load(raw), PEOPLE).compile("Which labs is Alice member of").reason == "semantic_program_ambiguous"


def test_pack_errors():
    raw = load_domain("research_network")
    for bad, code in (({"domain_name": ""}, "domain_name_required"), ({"capabilities": ["FLY"]}, "capability_unknown"), ({"world_model": {"mode": "CLOSED_WORLD"}}, "closed_world_scope_required"), ({"governance": {"max_results": 0}}, "max_results_invalid"), ({"relations": raw["relations"] * 2}, "relation_declared_twice")):
        with pytest.raises(PackError, match=code):
            DomainPack.load({**raw, **bad})


def test_fingerprint_ignores_order_of_declarations():
    raw = load_domain("research_network")
    turned = {**raw, "relations": raw["relations"][::-1], "entities": raw["entities"][::-1]}
    assert DomainPack.load(raw).fingerprint == DomainPack.load(turned).fingerprint
    assert DomainPack.load(raw).fingerprint != DomainPack.load(raw).closed().fingerprint


def plan():
    return compiler().compile("Which labs is Alice member of").plan


def test_identity_of_plans():
    p = plan()
    noted = replace(p, annotations=(Annotation("a", 1),))
    assert noted.digest == p.digest
    two = (Constraint("TARGET_TYPE", "LAB"), Constraint("RELATION_TYPE", "MEMBER_OF"))
    assert replace(p, constraints=two).digest == replace(p, constraints=two[::-1]).digest != p.digest
    assert replace(p, bounds=Bounds(1, 7, 7)).digest != p.digest


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"planner_id": " "}, "planner_id_required"),
        ({"anchors": ()}, "anchor_required"),
        ({"bounds": Bounds(0, 1, 1)}, "path_exceeds_max_hops"),
        ({"bounds": Bounds(1, 0, 1)}, "plan_bounds_invalid"),
        ({"constraints": (Constraint("NO_SUCH", 1),)}, "unknown_constraint"),
        ({"constraints": (Constraint("TARGET_TYPE", None),)}, "constraint_value_required"),
        ({"declared": ()}, "undeclared_capability"),
        ({"version": 9}, "protocol"),
    ],
)
def test_invalid_plans(change, code):
    with pytest.raises(PlanError, match=code):
        check_plan(replace(plan(), **change))


def test_dependency_cycles():
    check_acyclic((Unit("a", None), Unit("b", None, ("a",))))
    for units, code in (((Unit("a", None, ("b",)), Unit("b", None, ("a",))), "cycle"), ((Unit("a", None, ("a",)),), "self"), ((Unit("a", None, ("z",)),), "unknown")):
        with pytest.raises(PlanError, match=code):
            check_acyclic(units)


def context(p, **more):
    return Context(("RELATION_LOOKUP", "ENTITY_LOOKUP", "BOOLEAN_CHECK", "COMPOSITION", "EXISTENCE_CHECK"), **more)


def bound(*constraints, **changes):
    return bind(replace(plan(), constraints=constraints, **changes))


def test_pre_checks():
    assert before(bound(), context(None)).allowed
    assert "capability_not_supported:RELATION_LOOKUP" in before(bound(), Context(())).reasons
    assert "max_results_exceeds_environment" in before(bound(), context(None, max_results=1)).reasons
    for c, reason in ((Constraint("MAX_CARDINALITY", 1), "max_cardinality_exceeded"), (Constraint("SOURCE_TYPE", "LAB"), "source_type_not_planned"), (Constraint("RELATION_TYPE", "PRODUCED"), "relation_type_not_planned"), (Constraint("PATH_SELECTION_KEY", " "), "path_selection_key_blank"), (Constraint("CAPABILITY_REQUIRED", "AGGREGATION"), "capability_required_missing"), (Constraint("DATE_KEY_REQUIRED", "d"), "date_key_missing"), (Constraint("CLOSED_WORLD_SCOPE", "s"), "closed_world_scope_differs"), (Constraint("ORDERED_UNITS", ["u9"]), "ordered_units_differ"), (Constraint("REQUIRED_SUBGRAPH", "p"), "required_subgraph_unknown")):
        assert reason in before(bound(c), context(None)).reasons


EDGE = {"hop": 1, "edge_id": "e", "source_id": "researcher:alice", "relation": "MEMBER_OF", "target_id": "lab", "direction": "OUT"}
NODES = [{"node_id": "researcher:alice", "node_type": "RESEARCHER"}, {"node_id": "lab", "node_type": "LAB"}]


def test_post_checks():
    good = Evidence(NODES, [EDGE], n_results=1, per_hop={1: 1})
    assert after(bound(), good, context(None)).allowed
    for c, reason in ((Constraint("TARGET_ID", "z"), "target_id_not_proven"), (Constraint("TARGET_TYPE", "DATASET"), "target_type_not_proven"), (Constraint("MAX_CARDINALITY", 0), "max_cardinality_exceeded")):
        assert reason in after(bound(c), good, context(None)).reasons
    assert "result_count_exceeds_bound" in after(bound(), replace(good, n_results=99), context(None)).reasons
    assert "hop_cardinality_exceeds_cap" in after(bound(), replace(good, fan_out={1: 999}), context(None)).reasons


def test_optional_unit_may_fail_under_allow_partial():
    p = compiler().compile("Which labs is Alice member of and Show Bob").plan
    units = (p.units[0], replace(p.units[1], required=False))
    part = bind(replace(p, units=units, composition_policy="ALLOW_PARTIAL"))
    bad = Evidence(children={"u1": Evidence(NODES, [EDGE], n_results=1, per_hop={1: 1}), "u2": Evidence(n_results=5)})
    assert after(part, bad, context(None)).status == "ALLOWED_PARTIAL"
    assert not after(bind(replace(p, units=units)), bad, context(None)).allowed


def test_pattern_search_backtracks():
    """The first typed binding fails on its edge; another fits."""
    nodes = [{"node_id": i, "node_type": t} for i, t in (("a", "X"), ("b1", "Y"), ("b2", "Y"), ("c", "Z"))]
    edges = [{"source_id": s, "relation": r, "target_id": t} for s, r, t in (("a", "R", "b1"), ("a", "R", "b2"), ("b2", "S", "c"))]
    p = Pattern("p", (PatternNode("x", "X"), PatternNode("y", "Y"), PatternNode("z", "Z")), (PatternEdge("x", "R", "y"), PatternEdge("y", "S", "z")))
    assert binds_pattern(p, nodes, edges)
    assert not binds_pattern(p, nodes, edges[:2])
    assert pattern_of_walk("w", "RESEARCHER", plan().steps).edges == (PatternEdge("a0", "MEMBER_OF", "a1"),)


def test_registry():
    reg = PlannerRegistry()
    s = Selection("p", "d", "1")
    with pytest.raises(UnsupportedPlanner):
        reg.resolve(s)
    reg.register(Planner("p"))
    high = reg.register(Planner("p", ("d",), priority=2))
    assert reg.resolve(s) is high
    with pytest.raises(ValueError, match="twice"):
        reg.register(Planner("p"))
    reg.register(Planner("p", ("d",), ("1",), priority=2))
    with pytest.raises(AmbiguousPlanner):
        reg.resolve(s)


def test_admission():
    p = bound()
    assert admit(p, p.logical).bound_digest == p.digest
    with pytest.raises(AdmissionError, match="lineage_required"):
        admit(p)
    with pytest.raises(AdmissionError, match="bound_digest_differs"):
        admit(p, bound_digest="x")
    with pytest.raises(AdmissionError, match="domain_id_differs"):
        admit(p, p.logical, domain_id="other")


def test_assurance_helpers():
    a = StaticAssurance()
    assert a.normalize_ingress("q", text="x")["digest"] == a.normalize_ingress("q", text="x")["digest"]
    one = a.attach_integrity({"answer": "x"})
    assert a.attach_integrity({"answer": "x"}, one["integrity"]["digest"])["integrity"] != one["integrity"]
    a.record_mutation("nodes", {"n": 1})
    assert a.mutations and a.evaluate_mutation()["status"] == "ALLOWED"
    assert StaticAssurance(False).evaluate(bound(), "OFF")["status"] == "ALLOWED"


def test_extensions_add_notes_only():
    reg = ExtensionRegistry()
    reg.register("hint", lambda **k: {"topic": k["domain_id"]})
    reg.register("grab", lambda **k: {"steps": []})
    p = plan()
    assert reg.apply(p, ["hint"], "q").digest == p.digest
    with pytest.raises(ValueError, match="authority"):
        reg.apply(p, ["grab"], "q")


@given(st.dictionaries(st.text(), st.one_of(st.text(), st.integers(), st.none(), st.lists(st.booleans()))))
def test_canonical_json_is_ascii_and_order_free(d):
    turned = dict(reversed(d.items()))
    assert canonical_json(d) == canonical_json(turned) and canonical_json(d).isascii()
    assert fingerprint(d) == fingerprint(turned)


def test_word_rules():
    assert relation_phrases("CONTAINS", ("Holds up",)) == [("contains",), ("contain",), ("holds", "up")]
    assert relation_phrases("S") == [("s",)] and relation_phrases("PASS") == [("pass",)] and relation_phrases("") == []
    assert type_phrases("FACILITY", ("facilities",)) == [("facility",), ("facilitys",), ("facilities",)]
    assert type_phrases("SALES_ORDERS") == [("sales", "orders"), ("sales", "order")]
    assert label_key("  Straße-12 ") == "strasse12"
    assert Template("Does <X> run?").match("does the dog run ?") == {"X": "the dog"}
    assert Template("<a>'s <b> of <c>").match("Ann's hat of felt of wool") == {"A": "Ann", "B": "hat", "C": "felt of wool"}
    assert Template("Does <X> run").match("does run") is None and Template("Does <X> run").match("does the dog run off") is None
    assert Template("<x> ab").match("ab ab ab") == {"X": "ab ab"} and Template("a <1> b").match("so a <1> b") == {}
    assert Template(r"how (?P<what>\w+)").match("Say how far?") == {"WHAT": "far"}
    w = Words("Which labs, pray, is  Alice member of?")
    assert w.find(("member", "of")) == 5 and w.quote(2, 5) == "pray, is  Alice" and w.without(1, 3).text == "Which is  Alice member of"
