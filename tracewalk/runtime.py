"""Asking: select, compile, admit, assure, check, run, check again, answer.

Only two places run Spark jobs: the entity lookup while a question is compiled, and
``Executor.run``, which probes each hop's cap and collects at most max_results rows and,
where those are not all walks, the first claims of all of them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewalk.functions.text import fingerprint, symbol
from tracewalk.operators.aggregate import top_by_date
from tracewalk.operators.match import Pattern, pattern_of_walk
from tracewalk.operators.traverse import WalkError, anchor, checked_walk, limit_walks, result_rows, walk
from tracewalk.plans.answers import MOST_EDGE_CLAIMS, ClaimBundle, claims_of, render
from tracewalk.plans.governance import Admission, AssuranceError, Planner, PlannerRegistry, Router, Selection, admit, resolve_assurance
from tracewalk.plans.grammar import Candidate, CompileResult, Compiler
from tracewalk.plans.ir import WILDCARDS, BoundPlan, PlanType, bind
from tracewalk.plans.pack import DomainPack
from tracewalk.plans.policy import Context, Decision, Evidence, Witness, after, before
from tracewalk.plans.receipts import Receipt
from tracewalk.sources.graph import Graph

PROVENANCE_LIMIT = 10_000


class ConfigurationError(ValueError):
    pass


class QuestionError(RuntimeError):
    """A question that did not compile."""


class GraphResolver:
    """Entities by label, in the graph's own tables: id and name score 1, other labels 0.9."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def resolve(self, mention: str, expected_type: str | None) -> list[Candidate]:
        return [Candidate(*c) for c in self.graph.candidates(mention, expected_type)]


@dataclass
class Compilation:
    question: str
    selection: Selection
    result: CompileResult
    bound: BoundPlan | None = None

    @property
    def accepted(self) -> bool:
        return self.result.ok and self.bound is not None


@dataclass
class Execution:
    rows: list[dict[str, Any]]
    evidence: Evidence
    result_digest: str
    evidence_digest: str
    units: dict[str, Execution] = field(default_factory=dict)


@dataclass
class Answer:
    """status is DENIED, REJECTED, EXECUTION_FAILED, COMPLETE, PARTIAL or POSTCHECK_FAILED."""

    compilation: Compilation
    admission: Admission
    pre: Decision
    post: Decision | None
    execution: Execution | None
    receipt: Receipt
    claims: ClaimBundle | None
    response: dict[str, Any]
    status: str

    @property
    def lineage(self) -> dict[str, Any]:
        return self.receipt.lineage()


def build(plan: BoundPlan, graph: Graph) -> DataFrame:
    """The DataFrame of a single plan's result, un-run: for ``explain`` and for composing."""
    a = plan.anchors[0]
    start = anchor(graph, a.node_type, a.node_id)
    paths = walk(graph, start, plan.steps, graph.key(a.node_type, a.node_id) if symbol(a.node_type) not in ("ENTITY", "ANY") else None)
    target = plan.constraint("TARGET_ID")
    if target and plan.steps:
        paths = paths.where(F.col(f"n{len(plan.steps)}") == F.lit(graph.key(plan.steps[-1].there, target.value)))
    agg = plan.aggregation
    if agg and agg.operation == "COUNT":
        last = f"n{len(plan.steps)}"
        return paths.agg(F.count("*").alias("n_paths"), F.count_distinct(last).alias("n_nodes"))
    if agg and agg.operation in ("TOP_N", "LATEST"):
        rows = result_rows(graph, paths, plan.steps, a.node_type)
        date = F.coalesce(*(F.get_json_object("properties", f"$.{k}") for k in agg.date_keys))
        return top_by_date(rows, date, agg.top_n or 1)
    if agg and agg.operation == "GROUP_BY_MAX":
        kinds = [symbol(a.node_type), *(s.there for s in plan.steps)]
        at = kinds.index(symbol(agg.group_by_node_type)) if agg.group_by_node_type else [symbol(s.relation) for s in plan.steps].index(symbol(agg.group_by_relation_type)) + 1
        return paths.groupBy(F.col(f"n{at}").alias("grp")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp").limit(1)
    if plan.plan_type in (PlanType.BOOLEAN_CHECK, PlanType.EXISTS) and target:
        paths = limit_walks(paths, 1)
    else:
        paths = limit_walks(paths, plan.bounds.max_results)
    return result_rows(graph, paths, plan.steps, a.node_type)


class Executor:
    """Runs bound plans on a graph."""

    def __init__(self, graph: Graph, capabilities: tuple[str, ...]):
        self.graph, self.capabilities = graph, capabilities

    def run(self, plan: BoundPlan, reference: str, allowed: bool) -> Execution:
        if not isinstance(plan, BoundPlan):
            raise WalkError("bound_plan_required")
        if not allowed:
            raise WalkError("pre_execution_admission_required")
        if not reference:
            raise WalkError("execution_reference_required")
        missing = sorted({symbol(u.capability) for u in plan.uses} - set(self.capabilities))
        if missing:
            raise WalkError("unsupported_capability:" + ",".join(missing))
        if plan.plan_type == PlanType.COMPOSITE:
            return self._composite(plan, {u.unit_id: self.run(u.plan, f"{reference}:{u.unit_id}", True) for u in plan.units})
        return self._single(plan)

    def _composite(self, plan: BoundPlan, units: dict[str, Execution]) -> Execution:
        ev = Evidence(children={k: x.evidence for k, x in units.items()})
        for x in units.values():
            ev.nodes += [n for n in x.evidence.nodes if n not in ev.nodes]
            ev.edges += [e for e in x.evidence.edges if e not in ev.edges]
            ev.facts += x.evidence.facts
            ev.n_results += x.evidence.n_results
            for hop, n in x.evidence.per_hop.items():
                ev.per_hop[hop] = ev.per_hop.get(hop, 0) + n
        ev.nodes.sort(key=lambda n: n["node_id"])
        ev.edges.sort(key=lambda e: (e["hop"], e["edge_id"]))
        ev.provenance = sorted({r for x in units.values() for r in x.evidence.provenance})
        rows = [r for x in units.values() for r in x.rows]
        return _sealed(plan, rows, ev, units)

    def _single(self, plan: BoundPlan) -> Execution:
        a, steps, graph = plan.anchors[0], plan.steps, self.graph
        ev = Evidence()
        wild = symbol(a.node_type) in ("ENTITY", "ANY")
        start = anchor(graph, a.node_type, a.node_id)
        target = plan.constraint("TARGET_ID")
        paths = start
        if steps:
            paths = checked_walk(graph, start, steps, plan.bounds.cap_per_hop, None if wild else graph.key(a.node_type, a.node_id))
            if target and plan.plan_type == PlanType.BOOLEAN_CHECK:
                paths = paths.where(F.col(f"n{len(steps)}") == F.lit(graph.key(steps[-1].there, target.value)))
        agg = plan.aggregation
        if agg:
            ev.aggregation = self._aggregated(plan)
        most = max(plan.bounds.max_results, agg.top_n or 1) if agg else plan.bounds.max_results
        shown = top_by_date(result_rows(graph, paths, steps, a.node_type), F.coalesce(*(F.get_json_object("properties", f"$.{k}") for k in agg.date_keys)), agg.top_n or 1) if agg and agg.operation in ("TOP_N", "LATEST") else result_rows(graph, limit_walks(paths, most), steps, a.node_type)
        order = [f"e{i}" for i in range(1, len(steps) + 1)] or ["node_id"]
        held = sorted((r.asDict() for r in shown.collect()), key=lambda r: tuple(r[c] for c in order))
        ev.n_results = len(held)
        self._evidence(plan, held, ev)
        if steps and not agg and plan.plan_type not in (PlanType.BOOLEAN_CHECK, PlanType.EXISTS) and len(held) >= most:
            ev.claimed = self._first_claims(plan, paths)
        rows = [{"node_id": r["node_id"], "node_type": r["node_type"], "name": r["name"], "path_nodes": r["path_nodes"], "path_edges": r["path_edges"], "relation": r["relation"], "properties": json.loads(r["properties"] or "{}")} for r in held]
        if plan.projection.fields:
            rows = [{k: r[k] for k in plan.projection.fields if k in r} for r in rows]
        if plan.world.closed:
            ev.witnesses.append(Witness(plan.world.scope, f"snapshot:{plan.world.scope}", True, plan.digest))
        return _sealed(plan, rows, ev, {})

    def _first_claims(self, plan: BoundPlan, paths: DataFrame) -> list[dict[str, Any]]:
        """The first claims of each hop over all walks, by the names of the ends and once each: the limit's first walks are others."""
        graph, out = self.graph, []
        kinds = [symbol(plan.anchors[0].node_type), *(s.there for s in plan.steps)]
        for i, s in enumerate(plan.steps, 1):
            rows = paths.select(f"n{i - 1}", f"n{i}", F.col(f"e{i}").alias("edge_id"))
            for at, end in zip((i - 1, i), ("subject", "object") if symbol(s.direction) == "OUT" else ("object", "subject"), strict=True):
                named = graph.nodes(None if kinds[at] in WILDCARDS else kinds[at]).select(F.col("key").alias("named"), F.col("name").alias(end))
                rows = rows.join(named, F.col(f"n{at}") == F.col("named")).drop("named")
            first = rows.groupBy("subject", "object").agg(F.min("edge_id").alias("edge_id")).orderBy("subject", "object").limit(MOST_EDGE_CLAIMS)
            out += [{"hop": i, "relation": symbol(s.relation), **r.asDict()} for r in first.collect()]
        return out

    def _aggregated(self, plan: BoundPlan) -> dict[str, Any]:
        got = [r.asDict() for r in build(plan, self.graph).collect()]
        op = plan.aggregation.operation
        if op == "COUNT":
            return {"operation": op, "value": got[0]["n_paths"], "distinct": got[0]["n_nodes"], "count": 1}
        if op == "GROUP_BY_MAX":
            return {"operation": op, "value": [got[0]["grp"], got[0]["n"]] if got else None, "count": len(got)}
        got.sort(key=lambda r: r["date_rank"])
        names = [r["name"] for r in got]
        return {"operation": op, "value": (names[0] if names else None) if op == "LATEST" else names, "count": len(got)}

    def _evidence(self, plan: BoundPlan, held: list[dict], ev: Evidence) -> None:
        """Evidence of the bounded rows, and the names and provenance of what is on them, by one lookup for each type and relation."""
        graph, steps = self.graph, plan.steps
        kinds = [symbol(plan.anchors[0].node_type), *(s.there for s in steps)]
        nodes: dict[str, dict] = {}
        for i, kind in enumerate(kinds):
            keys = sorted({r[f"n{i}"] for r in held}, key=str)
            if not keys:
                continue
            rows = graph.nodes(None if kind in ("ENTITY", "ANY") else kind).where(F.col("key").isin(keys))
            for r in rows.select("key", "node_id", "node_type", "name", "properties").collect():
                nodes[r.node_id] = {"node_id": r.node_id, "node_type": r.node_type, "name": r.name}
                ev.provenance += _references(r.properties, r.node_id)
        props = {}
        for i, s in enumerate(steps, 1):
            ends = sorted({r[f"n{i - 1}"] for r in held}, key=str)
            if ends:
                here = "src" if symbol(s.direction) == "OUT" else "dst"
                ids = {r[f"e{i}"] for r in held}
                for r in graph.edges(s.relation).where(F.col(here).isin(ends)).select("edge_id", "properties").collect():
                    if r.edge_id in ids:
                        props[i, r.edge_id] = r.properties
        for r in held:
            at = r["path_nodes"].split(">")
            for i, s in enumerate(steps, 1):
                a, b = (at[i - 1], at[i]) if symbol(s.direction) == "OUT" else (at[i], at[i - 1])
                refs = _references(props.get((i, r[f"e{i}"])), r[f"e{i}"])
                ev.edges.append({"hop": i, "edge_id": r[f"e{i}"], "source_id": a, "relation": symbol(s.relation), "target_id": b, "direction": symbol(s.direction)})
                ev.facts.append({"subject": a, "predicate": symbol(s.relation), "object": b, "provenance": refs})
                ev.provenance += refs
                ev.per_hop[i] = ev.per_hop.get(i, 0) + 1
        ev.nodes = [nodes[k] for k in sorted(nodes)]
        ev.provenance = sorted(set(ev.provenance))[:PROVENANCE_LIMIT]


def _references(properties: str | None, fallback: str) -> list[str]:
    from tracewalk.operators.evidence import PROVENANCE_KEYS

    bag, out = json.loads(properties or "{}"), []
    for key in PROVENANCE_KEYS:
        v = bag.get(key)
        out += [str(x).strip() for x in (v if isinstance(v, list) else [v]) if x is not None and str(x).strip()]
    return sorted(set(out)) or [fallback]


def _sealed(plan: BoundPlan, rows: list[dict], ev: Evidence, units: dict[str, Execution]) -> Execution:
    return Execution(rows, ev, fingerprint({"plan": plan.digest, "rows": rows, "aggregation": ev.aggregation}), fingerprint({"plan": plan.digest, "evidence": ev}), units)


def _patterns(plan: BoundPlan) -> dict[str, Pattern]:
    """The subgraphs that a plan and its units require: what their own steps walk."""
    out = {}
    c = plan.constraint("REQUIRED_SUBGRAPH") if plan.plan_type != PlanType.COMPOSITE else None
    if c:
        out[str(c.value)] = pattern_of_walk(str(c.value), plan.anchors[0].node_type, plan.steps, plan.anchors[0].node_id)
    for u in plan.units:
        out |= _patterns(u.plan)
    return out


def _outcome(plan: BoundPlan, x: Execution, reference: str) -> dict[str, Any]:
    own = {"bound_digest": plan.digest, "reference": reference, "result_digest": x.result_digest, "evidence_digest": x.evidence_digest}
    if plan.units:
        own["units"] = {u.unit_id: _outcome(u.plan, x.units[u.unit_id], f"{reference}:{u.unit_id}") for u in plan.units}
    return own


class Runtime:
    """One pack over one graph; planner registry and assurance provider are given, never assumed."""

    def __init__(self, pack: Any, graph: Graph, registry: PlannerRegistry | None, assurance: Any, planner_id: str = "", patterns: dict[str, Pattern] | None = None):
        if registry is None:
            raise ConfigurationError("planner_registry_required")
        if graph is None:
            raise ConfigurationError("graph_required")
        self.assurance = resolve_assurance(assurance)
        self.pack = DomainPack.load(pack)
        self.graph = graph
        self.patterns = patterns or {}
        self.router = Router(self.pack, registry, planner_id)
        self.compiler = Compiler(self.pack, GraphResolver(graph), planner_id or self.pack.planner_id)
        self.executor = Executor(graph, self.pack.capabilities)
        self.router.select("")  # a pack without a planner fails here, not at the first question

    def compile(self, question: str) -> Compilation:
        selection = self.router.select(question)
        result = self.router.route(question, self.compiler.compile)
        return Compilation(question, selection, result, bind(result.plan) if result.ok else None)

    def explain(self, question: str) -> DataFrame:
        """The un-run DataFrame of a single plan, for ``explain('formatted')``."""
        c = self.compile(question)
        if not c.accepted:
            raise QuestionError(c.result.reason)
        return build(c.bound, self.graph)

    def ask(self, question: str, reference: str = "") -> Answer:
        c = self.compile(question)
        if not c.accepted:
            raise QuestionError(c.result.reason)
        plan = c.bound
        admission = admit(plan, c.result.plan)
        assured = self.assurance.evaluate(plan, "ENFORCE", "tracewalk")
        context = Context.of_pack(self.pack, {**_patterns(plan), **self.patterns})
        pre = before(plan, context)
        receipt = Receipt.prepare(plan, pre, assured)
        if assured.get("status") != "ALLOWED":
            return self._finish(c, admission, pre, None, None, receipt, "DENIED")
        if not pre.allowed:
            return self._finish(c, admission, pre, None, None, receipt, "REJECTED")
        reference = reference or f"exec:{plan.digest}"
        try:
            with self.assurance.bind(plan):
                ran = self.executor.run(plan, reference, True)
        except (WalkError, AssuranceError) as e:
            failed = receipt.executed({"bound_digest": plan.digest, "reference": reference, "failed": str(e)})
            return self._finish(c, admission, pre, None, None, failed, "EXECUTION_FAILED")
        receipt = receipt.executed(_outcome(plan, ran, reference))
        post = after(plan, ran.evidence, context)
        receipt = receipt.judged(post)
        return self._finish(c, admission, pre, post, ran, receipt, receipt.status)

    def _finish(self, c: Compilation, admission: Admission, pre: Decision, post: Decision | None, ran: Execution | None, receipt: Receipt, status: str) -> Answer:
        receipt.check_plan(c.bound)
        if ran is None:
            response = {"answer": "I don't know.", "claims": [], "metadata": {"execution_receipt": receipt.to_dict(), "lineage": receipt.lineage(), "reasons": list(pre.reasons)}}
            return Answer(c, admission, pre, post, ran, receipt, None, response, status)
        claims = claims_of(c.bound, ran.evidence, post.truth, post.allowed)
        shown = {"nodes": ran.evidence.nodes, "edges": ran.evidence.edges, "claimed": ran.evidence.claimed, "provenance": ran.evidence.provenance, "witnesses": [vars(w) for w in ran.evidence.witnesses], "reasons": list(post.reasons)}
        return Answer(c, admission, pre, post, ran, receipt, claims, render(claims, receipt.to_dict(), receipt.lineage(), shown), status)


def standard_runtime(pack: Any, graph: Graph, assurance: Any) -> Runtime:
    """A runtime whose registry holds the grammar planner that the pack names."""
    loaded = DomainPack.load(pack)
    registry = PlannerRegistry()
    registry.register(Planner(loaded.planner_id, (loaded.domain_id,), capabilities=loaded.capabilities))
    return Runtime(loaded, graph, registry, assurance)
