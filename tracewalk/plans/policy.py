"""Policy: what must hold before a bound plan runs, and of its evidence afterwards."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from tracewalk.functions.text import clean, distinct_in_order, symbol
from tracewalk.operators.match import Pattern

from .grammar import required_capabilities
from .ir import BindError, BoundPlan, CompositionPolicy, PlanType, check_bound
from .pack import DomainPack

PRE, POST = "PRE", "POST"
ALLOWED, ALLOWED_PARTIAL, DENIED, INDETERMINATE = "ALLOWED", "ALLOWED_PARTIAL", "DENIED", "INDETERMINATE"


@dataclass(frozen=True)
class Witness:
    """A statement that a scope is complete, perhaps for one plan only."""

    scope: str
    reference: str
    complete: bool = True
    plan_digest: str | None = None


@dataclass
class Evidence:
    """A unit's bounded evidence on the driver. Fan-out is what the cap held; counts are of the rows returned."""

    nodes: list[dict] = field(default_factory=list)  # node_id, node_type, name
    edges: list[dict] = field(default_factory=list)  # hop, edge_id, source_id, relation, target_id, direction
    facts: list[dict] = field(default_factory=list)
    provenance: list[str] = field(default_factory=list)
    witnesses: list[Witness] = field(default_factory=list)
    n_results: int = 0
    per_hop: dict[int, int] = field(default_factory=dict)
    fan_out: dict[int, int] = field(default_factory=dict)
    aggregation: dict[str, Any] | None = None
    claimed: list[dict] = field(default_factory=list)  # the first claims of all walks, where the limit left walks out: subject, relation, object, edge_id
    children: dict[str, Evidence] = field(default_factory=dict)


@dataclass(frozen=True)
class Context:
    """What the environment supports and allows."""

    capabilities: tuple[str, ...]
    max_hops: int | None = None
    max_results: int | None = None
    cap_per_hop: int | None = None
    closed_scopes: tuple[str, ...] = ()
    patterns: Mapping[str, Pattern] = field(default_factory=dict)

    @classmethod
    def of_pack(cls, pack: DomainPack, patterns: Mapping[str, Pattern]) -> Context:
        return cls(pack.capabilities, pack.max_hops, None, None, (pack.world.scope,) if pack.world.closed else (), patterns)


@dataclass(frozen=True)
class Decision:
    """status with every reason; truth is TRUE, FALSE or UNKNOWN, and only a POST decision has one."""

    phase: str
    status: str
    reasons: tuple[str, ...]
    plan_digest: str
    truth: str = "UNKNOWN"
    children: tuple[tuple[str, Decision], ...] = ()

    @property
    def allowed(self) -> bool:
        return self.status in (ALLOWED, ALLOWED_PARTIAL)


def binds_pattern(pattern: Pattern, nodes: list[dict], edges: list[dict]) -> bool:
    """Whether distinct evidence nodes fit the pattern with all its edges; every binding is tried, edge by edge."""
    kinds = {n["node_id"]: symbol(n["node_type"]) for n in nodes}
    rules = {n.alias: n for n in pattern.nodes}

    def fits(alias: str, node: str, bound: dict[str, str]) -> bool:
        r = rules[alias]
        if alias in bound:
            return bound[alias] == node
        return node in kinds and node not in bound.values() and (not r.node_type or symbol(r.node_type) in ("ENTITY", "ANY", kinds[node])) and (not r.node_id or r.node_id == node)

    def grow(k: int, bound: dict[str, str]) -> bool:
        if k == len(pattern.edges):
            left = [a for a in rules if a not in bound]
            return not left or any(fits(left[0], n, bound) and grow(k, {**bound, left[0]: n}) for n in kinds)
        e = pattern.edges[k]
        return any(symbol(x["relation"]) == symbol(e.relation) and fits(e.source, x["source_id"], bound) and fits(e.target, x["target_id"], {**bound, e.source: x["source_id"]}) and grow(k + 1, {**bound, e.source: x["source_id"], e.target: x["target_id"]}) for x in edges)

    return grow(0, {})


def _decide(phase: str, plan: BoundPlan, reasons: list[str], truth: str, children: dict[str, Decision]) -> Decision:
    """A failed unit fails the whole, unless it is optional and the plan allows partial answers."""
    partial = False
    for u in plan.units:
        if not children[u.unit_id].allowed:
            if u.required or symbol(plan.composition_policy) != CompositionPolicy.ALLOW_PARTIAL:
                reasons.append(f"unit_not_allowed:{u.unit_id}")
            else:
                partial = True
        partial |= children[u.unit_id].status == ALLOWED_PARTIAL
    status = (DENIED if phase == PRE else INDETERMINATE) if reasons else ALLOWED_PARTIAL if partial else ALLOWED
    return Decision(phase, status, distinct_in_order(reasons), plan.digest, truth if status in (ALLOWED, ALLOWED_PARTIAL) else "UNKNOWN", tuple(children.items()))


def before(plan: BoundPlan, context: Context) -> Decision:
    """The checks that need no data."""
    out: list[str] = []
    try:
        check_bound(plan)
    except BindError as e:
        return Decision(PRE, DENIED, (f"plan_invalid:{e}",), getattr(plan, "digest", ""))
    b, top = plan.bounds, plan.aggregation.top_n if plan.aggregation else None
    for name in ("max_hops", "max_results", "cap_per_hop"):
        most = getattr(context, name)
        if most is not None and getattr(b, name) > most:
            out.append(f"{name}_exceeds_environment")
    if top is not None and top > b.max_results:
        out.append("top_n_exceeds_max_results")
    used = {symbol(u.capability) for u in plan.uses}
    for x in required_capabilities(plan.plan_type, bool(plan.steps)):
        if x not in used or x not in map(symbol, plan.declared):
            out.append(f"capability_not_declared:{x}")
        if x not in context.capabilities:
            out.append(f"capability_not_supported:{x}")
    if plan.world.closed and plan.world.scope not in context.closed_scopes:
        out.append("closed_world_scope_not_supported")
    for c in plan.constraints:
        out += _before(symbol(c.kind), c.value, plan, context)
    return _decide(PRE, plan, out, "UNKNOWN", {u.unit_id: before(u.plan, context) for u in plan.units})


def _before(kind: str, value: Any, plan: BoundPlan, context: Context) -> list[str]:
    def need(ok: Any, reason: str) -> list[str]:
        return [] if ok else [reason]

    match kind:
        case "GOVERNANCE_MAX_HOPS":
            return need(plan.bounds.max_hops <= int(value), "governance_max_hops_exceeded")
        case "DATE_KEY_REQUIRED":
            asked = {value} if isinstance(value, str) else set(value)
            return need(plan.aggregation and asked <= set(plan.aggregation.date_keys), "date_key_missing")
        case "CLOSED_WORLD_SCOPE":
            return need(plan.world.closed and plan.world.scope == value, "closed_world_scope_differs")
        case "PATH_SELECTION_KEY":
            return need(clean(value), "path_selection_key_blank")
        case "CAPABILITY_REQUIRED":
            own = {value} if isinstance(value, str) else set(value)
            return need({symbol(x) for x in own} <= set(map(symbol, plan.declared)) & set(context.capabilities), "capability_required_missing")
        case "ORDERED_UNITS":
            return need([u.unit_id for u in plan.units] == list(value), "ordered_units_differ")
        case "SOURCE_TYPE":
            return need(any(symbol(s.source_type) == symbol(value) for s in plan.steps), "source_type_not_planned")
        case "RELATION_TYPE":
            return need(any(symbol(s.relation) == symbol(value) for s in plan.steps), "relation_type_not_planned")
        case "MAX_CARDINALITY":
            return need(plan.bounds.cap_per_hop <= int(value), "max_cardinality_exceeded")
        case "REQUIRED_SUBGRAPH":
            return need(clean(value) in context.patterns, "required_subgraph_unknown")
    return []


def after(plan: BoundPlan, evidence: Evidence, context: Context) -> Decision:
    """The checks on evidence, and what truth it allows."""
    out: list[str] = []
    if plan.plan_type != PlanType.COMPOSITE:
        if evidence.n_results > plan.bounds.max_results:
            out.append("result_count_exceeds_bound")
        if any(h < 1 or h > plan.bounds.max_hops for h in evidence.per_hop):
            out.append("hop_out_of_range")
        if any(n > plan.bounds.cap_per_hop for n in [*evidence.per_hop.values(), *evidence.fan_out.values()]):
            out.append("hop_cardinality_exceeds_cap")
        out += _aggregated(plan, evidence)
        proves = evidence.n_results > 0
        for c in plan.constraints:
            out += _after(symbol(c.kind), c.value, plan, evidence, context, proves)
    truth, world = world_truth(plan, evidence)
    out += world
    children = {u.unit_id: after(u.plan, evidence.children.get(u.unit_id, Evidence()), context) for u in plan.units}
    return _decide(POST, plan, out, truth, children)


def _aggregated(plan: BoundPlan, evidence: Evidence) -> list[str]:
    a, got = plan.aggregation, evidence.aggregation
    if a is None:
        return []
    if got is None or symbol(got.get("operation")) != symbol(a.operation):
        return ["aggregation_evidence_missing"]
    if a.top_n is not None and got.get("count", 0) > a.top_n:
        return ["aggregation_exceeds_top_n"]
    return []


def _after(kind: str, value: Any, plan: BoundPlan, evidence: Evidence, context: Context, proves: bool) -> list[str]:
    def need(ok: Any, reason: str) -> list[str]:
        return [] if ok else [reason]

    types = {symbol(n["node_type"]) for n in evidence.nodes}
    match kind:
        case "TARGET_ID":  # nothing found is an answer of its own; something found must hold the target
            return need(not proves or any(n["node_id"] == value for n in evidence.nodes), "target_id_not_proven")
        case "TARGET_TYPE":
            return need(symbol(value) in types, "target_type_not_proven")
        case "SOURCE_TYPE":
            return need(symbol(value) in types, "source_type_not_proven")
        case "RELATION_TYPE":
            return need(any(symbol(e["relation"]) == symbol(value) for e in evidence.edges), "relation_type_not_proven")
        case "CLOSED_WORLD_SCOPE":
            return need(plan.world.closed and plan.world.scope == value, "closed_world_scope_differs")
        case "MAX_CARDINALITY":
            return need(all(n <= int(value) for n in evidence.per_hop.values()), "max_cardinality_exceeded")
        case "REQUIRED_SUBGRAPH":
            pattern = context.patterns.get(clean(value))
            return need(pattern and binds_pattern(pattern, evidence.nodes, evidence.edges), f"required_subgraph_missing:{clean(value)}")
    return []


def world_truth(plan: BoundPlan, evidence: Evidence) -> tuple[str, list[str]]:
    """(truth, reasons against). Only a boolean or existence plan can be TRUE; empty evidence is FALSE only in a closed world with a complete witness."""
    if plan.plan_type == PlanType.COMPOSITE:
        return "UNKNOWN", []
    negated = any(symbol(c.kind) == "PATH_SELECTION_KEY" and symbol(c.value) == "NEGATED" for c in plan.constraints)
    if evidence.n_results:
        found = "TRUE" if plan.plan_type in (PlanType.BOOLEAN_CHECK, PlanType.EXISTS) else "UNKNOWN"
        return ("FALSE" if negated and found == "TRUE" else found), []
    if not plan.world.closed:
        return "UNKNOWN", []
    held = any(w.scope == plan.world.scope and w.complete and w.plan_digest in (None, plan.digest) for w in evidence.witnesses)
    if not held:
        return "UNKNOWN", ["completeness_witness_missing"]
    return ("TRUE" if negated else "FALSE"), []
