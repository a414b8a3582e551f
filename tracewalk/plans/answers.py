"""From evidence to claims, and from claims to a rendered answer."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tracewalk.functions.text import symbol

from .ir import BoundPlan, PlanType
from .policy import Evidence

# Caps and texts of a rendered answer.
MOST_NODE_CLAIMS, MOST_EDGE_CLAIMS, MOST_LINES = 25, 250, 25
DONT_KNOW, YES, NO, NO_RESULTS = "I don't know.", "Yes.", "No.", "No results found."


@dataclass(frozen=True)
class Claim:
    subject: str
    predicate: str
    object: str
    polarity: str = "AFFIRM"
    status: str = "KNOWN"
    confidence: float = 1.0
    provenance: tuple[str, ...] = ()
    scope_tags: tuple[str, ...] = ()

    @property
    def key(self) -> tuple:
        return self.subject, self.predicate, self.object, self.polarity, self.status

    def to_dict(self) -> dict[str, Any]:
        return {"subject": self.subject, "predicate": self.predicate, "object": self.object, "polarity": self.polarity, "status": self.status, "confidence": self.confidence, "provenance": list(self.provenance), "scope_tags": list(self.scope_tags)}


@dataclass
class ClaimBundle:
    claims: list[Claim] = field(default_factory=list)
    projection: str = "TYPED_FACTS"
    domain_id: str = ""
    boolean: bool = False
    existence: bool = False
    closed_world: bool = False
    truth: str = "UNKNOWN"
    value: Any = None
    units: dict[str, ClaimBundle] = field(default_factory=dict)

    def ordered(self) -> list[Claim]:
        """Each claim once, known and affirmed first."""
        once = {c.key: c for c in reversed(self.claims)}
        return sorted(once.values(), key=lambda c: (c.status != "KNOWN", c.polarity != "AFFIRM", c.predicate, c.subject, c.object))


def claims_of(plan: BoundPlan, evidence: Evidence, truth: str, allowed: bool = True) -> ClaimBundle:
    """What the evidence of a plan claims, cut in the order of claims; a plan whose evidence did not pass claims nothing but that."""
    tags = (f"domain:{plan.domain_id}",)
    out = ClaimBundle([], plan.projection.kind, plan.domain_id, plan.plan_type == PlanType.BOOLEAN_CHECK, plan.plan_type == PlanType.EXISTS, plan.world.closed, truth)
    anchor = plan.anchors[0].node_id if plan.anchors else "RESULT"
    if not allowed:
        out.claims = [Claim(anchor, "RESULT", "INDETERMINATE", status="UNKNOWN", confidence=0.0)]
        return out
    if plan.plan_type == PlanType.COMPOSITE:
        for u in plan.units:
            e = evidence.children[u.unit_id]
            from .policy import world_truth

            out.units[u.unit_id] = claims_of(u.plan, e, world_truth(u.plan, e)[0])
            out.claims += out.units[u.unit_id].claims
        return out
    if evidence.aggregation:
        out.value = evidence.aggregation
    names = {n["node_id"]: n.get("name") or n["node_id"] for n in evidence.nodes}
    if out.existence and evidence.nodes:
        n = evidence.nodes[0]
        out.claims = [Claim(names[n["node_id"]], "EXISTS", symbol(n["node_type"]), provenance=(n["node_id"],), scope_tags=tags)]
    elif evidence.edges:
        own = [(symbol(e["relation"]), names.get(e["source_id"], e["source_id"]), names.get(e["target_id"], e["target_id"]), e["edge_id"]) for e in evidence.edges]
        own += [(symbol(c["relation"]), c["subject"], c["object"], c["edge_id"]) for c in evidence.claimed]
        once: dict[tuple, str] = {}
        for *said, edge_id in own:
            once[tuple(said)] = min(edge_id, once.get(tuple(said), edge_id))
        out.claims = [Claim(s, p, o, provenance=(once[p, s, o],), scope_tags=tags) for p, s, o in sorted(once)[:MOST_EDGE_CLAIMS]]
    elif evidence.nodes and not out.boolean:
        out.claims = [Claim(names[n["node_id"]], "IS_A", symbol(n["node_type"]), provenance=(n["node_id"],), scope_tags=tags) for n in evidence.nodes[:MOST_NODE_CLAIMS]]
    if not out.claims:
        out.claims = _when_empty(plan, out, anchor, tags)
    return out


def _when_empty(plan: BoundPlan, bundle: ClaimBundle, anchor: str, tags: tuple[str, ...]) -> list[Claim]:
    target = plan.constraint("TARGET_ID")
    if bundle.boolean or bundle.existence:
        known = bundle.truth != "UNKNOWN"
        return [Claim(anchor, symbol(plan.steps[-1].relation) if plan.steps else "EXISTS", str(target.value) if target else "NO_MATCH", "DENY" if known else "AFFIRM", "KNOWN" if known else "UNKNOWN", scope_tags=tags)]
    if plan.world.closed:
        return []
    return [Claim(anchor, "RESULT", "UNKNOWN", status="UNKNOWN", scope_tags=tags)]


def answer_of(bundle: ClaimBundle) -> str:
    if bundle.units:
        return "\n".join(answer_of(b) for b in bundle.units.values())
    claims = bundle.ordered()
    known = [c for c in claims if c.status == "KNOWN" and c.polarity == "AFFIRM"]
    if any(c.object == "INDETERMINATE" for c in claims):
        return DONT_KNOW
    if bundle.boolean or bundle.existence:
        return {"TRUE": YES, "FALSE": NO}.get(bundle.truth, DONT_KNOW)
    if bundle.value is not None:
        a = bundle.value
        return f"{a['operation']}: {a['value']}"
    if not claims:
        return NO_RESULTS
    if not known:
        return DONT_KNOW
    return "Facts:\n- " + "\n- ".join(f"{c.subject} —{c.predicate}→ {c.object}" for c in known[:MOST_LINES])


def render(bundle: ClaimBundle, receipt: dict[str, Any], lineage: dict[str, Any], evidence: dict[str, Any]) -> dict[str, Any]:
    return {
        "answer": answer_of(bundle),
        "claims": [c.to_dict() for c in bundle.ordered()],
        "metadata": {"result_type": bundle.projection, "domain_id": bundle.domain_id, "truth": bundle.truth, "execution_receipt": receipt, "lineage": lineage, "evidence": evidence},
    }
