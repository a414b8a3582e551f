"""Domain packs: what a question may be about, declared as a dict and checked once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from tracewalk.functions.text import clean, fingerprint, names, symbol, whole_number

from .ir import AGGREGATIONS, CAPABILITIES, DIRECTIONS, PROGRAM_SOURCE, PROJECTIONS, Aggregation, Annotation, CompositionPolicy, Constraint, PlanType, World, WorldMode


class PackError(ValueError):
    """A pack that cannot be used; the message is its reason code."""


@dataclass(frozen=True)
class Relation:
    name: str
    source_type: str
    target_type: str
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class ProgramStep:
    relation: str
    direction: str
    source_type: str = ""
    target_type: str = ""


@dataclass(frozen=True)
class Program:
    """A named question template with the walk it stands for."""

    program_id: str
    patterns: tuple[str, ...]
    anchor_type: str
    steps: tuple[ProgramStep, ...] = ()
    projection: str = "TYPED_FACTS"
    plan_type: PlanType | None = None
    priority: int = 0
    constraints: tuple[Constraint, ...] = ()
    annotations: tuple[Annotation, ...] = ()
    aggregation: Aggregation | None = None
    source: str = PROGRAM_SOURCE


@dataclass(frozen=True)
class DomainPack:
    domain_id: str
    version: str
    entities: tuple[str, ...]
    relations: tuple[Relation, ...]
    capabilities: tuple[str, ...]
    programs: tuple[Program, ...] = ()
    world: World = World()
    max_hops: int | None = None
    max_results: int = 50
    cap_per_hop: int = 200
    aggregations: tuple[str, ...] = ()
    date_keys: tuple[str, ...] = ()
    composition_policy: CompositionPolicy = CompositionPolicy.FAIL_CLOSED
    planner_id: str = ""
    plurals: tuple[tuple[str, str], ...] = ()
    declared_fingerprint: str = ""

    @cached_property
    def fingerprint(self) -> str:
        """Declared, or over all content: the order of declarations does not matter."""
        return self.declared_fingerprint or fingerprint({k: v for k, v in vars(self).items() if k not in ("fingerprint", "declared_fingerprint")})

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name == symbol(name)), None)

    def plurals_of(self, kind: str) -> tuple[str, ...]:
        return tuple(p for k, p in self.plurals if k == kind)

    def closed(self) -> DomainPack:
        """The same pack over a complete graph."""
        world = World(WorldMode.CLOSED_WORLD, f"{self.domain_id}.reference.graph", "EXHAUSTIVE")
        return replace(self, world=world, declared_fingerprint="")

    @classmethod
    def load(cls, raw: Mapping[str, Any] | DomainPack) -> DomainPack:
        return raw if isinstance(raw, DomainPack) else _load(raw)


def closed_domain(raw: Mapping[str, Any]) -> dict[str, Any]:
    """A pack's dict with a complete closed world."""
    return {**raw, "world_model": {"mode": "CLOSED_WORLD", "scope": f"{raw['domain_name']}.reference.graph", "completeness": "EXHAUSTIVE"}}


def _world(raw: Mapping[str, Any] | None) -> World:
    raw = raw or {}
    mode = symbol(raw.get("mode") or "OPEN_WORLD")
    if mode not in list(WorldMode):
        raise PackError("world_mode_invalid")
    if mode == WorldMode.OPEN_WORLD:
        return World()
    if not clean(raw.get("scope")):
        raise PackError("closed_world_scope_required")
    return World(WorldMode.CLOSED_WORLD, clean(raw["scope"]), symbol(raw.get("completeness") or "EXHAUSTIVE"))


def _aggregation(raw: Mapping[str, Any] | None) -> Aggregation | None:
    if not raw:
        return None
    op = symbol(raw.get("operation"))
    if op not in AGGREGATIONS:
        raise PackError("aggregation_operation_invalid")
    return Aggregation(op, whole_number(raw.get("top_n"), "top_n", 1), names(raw.get("date_keys")), symbol(raw.get("group_by_node_type")) or None, symbol(raw.get("group_by_relation_type")) or None)


def _program(raw: Mapping[str, Any]) -> Program:
    own = clean(raw.get("program_id"))
    patterns = names(raw.get("patterns"))
    if not own or not patterns or not symbol(raw.get("anchor_type")):
        raise PackError("program_incomplete")
    steps = tuple(ProgramStep(symbol(s.get("relation")), symbol(s.get("direction") or "OUT"), symbol(s.get("source_type")), symbol(s.get("target_type"))) for s in raw.get("steps") or ())
    if any(s.direction not in DIRECTIONS for s in steps):
        raise PackError("program_direction_invalid")
    projection = symbol(raw.get("projection") or "TYPED_FACTS")
    if projection not in PROJECTIONS:
        raise PackError("program_projection_invalid")
    meta = raw.get("metadata") or {}
    constraints = [Constraint(symbol(c["kind"]), c["value"]) for c in raw.get("normative_constraints") or ()]
    constraints += [Constraint(kind, clean(meta[key])) for key, kind in (("required_subgraph", "REQUIRED_SUBGRAPH"), ("path_selection_key", "PATH_SELECTION_KEY")) if clean(meta.get(key))]
    annotations = tuple(Annotation(clean(a["key"]), a["value"]) for a in raw.get("annotations") or ())
    kind = symbol(raw.get("plan_type"))
    if kind and kind not in list(PlanType):
        raise PackError("program_plan_type_invalid")
    aggregation = _aggregation(raw.get("aggregation"))
    if aggregation and not kind:
        kind = PlanType.AGGREGATE
    return Program(own, patterns, symbol(raw["anchor_type"]), steps, projection, PlanType(kind) if kind else None, int(raw.get("priority") or 0), tuple(constraints), annotations, aggregation)


def _load(raw: Mapping[str, Any]) -> DomainPack:
    own = clean(raw.get("domain_name") or raw.get("domain_id"))
    if not own:
        raise PackError("domain_name_required")
    relations, seen = [], set()
    for r in raw.get("relations") or ():
        rel = Relation(symbol(r.get("type")), symbol(r.get("source")), symbol(r.get("target")), names(r.get("aliases")))
        if not (rel.name and rel.source_type and rel.target_type):
            raise PackError("relation_incomplete")
        if rel.name in seen:  # one endpoint pair for each relation, so a lookup by name is never a choice
            raise PackError(f"relation_declared_twice:{rel.name}")
        seen.add(rel.name)
        relations.append(rel)
    capabilities = tuple(sorted(set(names(raw.get("capabilities"), upper=True))))
    if set(capabilities) - set(CAPABILITIES):
        raise PackError("capability_unknown")
    programs = sorted((_program(p) for p in (raw.get("query") or {}).get("semantic_programs") or ()), key=lambda p: p.program_id)
    if len({p.program_id for p in programs}) < len(programs):
        raise PackError("program_declared_twice")
    governance = raw.get("governance") or {}
    query = raw.get("query") or {}
    try:
        max_hops = whole_number(governance.get("max_hops"), "max_hops")
        max_results = whole_number(governance.get("max_results", 50), "max_results", 1)
        cap = whole_number(governance.get("cardinality_cap_per_hop", 200), "cardinality_cap_per_hop", 1)
    except ValueError as e:
        raise PackError(str(e)) from e
    rules = query.get("aggregations") or {}
    return DomainPack(
        own,
        clean(raw.get("pack_version")) or "1.0",
        tuple(sorted(set(names(raw.get("entities"), upper=True)))),
        tuple(sorted(relations, key=lambda r: r.name)),
        capabilities,
        tuple(programs),
        _world(raw.get("world_model")),
        max_hops,
        max_results,
        cap,
        names(rules.get("operations"), upper=True),
        names(rules.get("date_keys")),
        CompositionPolicy(symbol(raw.get("composition_policy") or "FAIL_CLOSED")),
        clean((query.get("router") or {}).get("planner")),
        tuple(sorted((symbol(k), clean(v)) for k, v in (raw.get("plurals") or {}).items())),
        clean(raw.get("pack_fingerprint")),
    )
