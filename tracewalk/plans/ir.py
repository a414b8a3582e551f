"""Plans: what a question means (logical) and what will run (bound), with identities.

A logical plan says everything that decides an answer. A bound plan is that plan, its
digest and the operation it runs as; binding copies no field, so it cannot lose one.
Identity is the SHA-256 of canonical JSON over the fields in ``identity``: annotations and
declared (as against used) capabilities are not part of it, and neither is the order of constraints.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum
from functools import cached_property
from typing import Any

from tracewalk.functions.text import clean, fingerprint, in_json_order, plain, symbol

LOGICAL_PROTOCOL = "tracewalk.plan.logical"
BOUND_PROTOCOL = "tracewalk.plan.bound"
PROTOCOL_VERSION = 1
PROGRAM_SOURCE = "query.semantic_programs"


class PlanError(ValueError):
    """A plan that breaks a rule; the message is its reason code."""


class BindError(ValueError):
    """A plan that cannot be bound."""


class PlanType(StrEnum):
    TRAVERSE = "TRAVERSE"
    EXISTS = "EXISTS"
    BOOLEAN_CHECK = "BOOLEAN_CHECK"
    AGGREGATE = "AGGREGATE"
    COMPOSITE = "COMPOSITE"


class WorldMode(StrEnum):
    OPEN_WORLD = "OPEN_WORLD"
    CLOSED_WORLD = "CLOSED_WORLD"


class CompositionPolicy(StrEnum):
    FAIL_CLOSED = "FAIL_CLOSED"
    ALLOW_PARTIAL = "ALLOW_PARTIAL"


# The vocabularies of plans.
DIRECTIONS = ("IN", "OUT")
PROJECTIONS = ("NODE_ONLY", "EDGES", "TYPED_FACTS", "AGGREGATION", "COMPOSITE")
AGGREGATIONS = ("COUNT", "TOP_N", "LATEST", "GROUP_BY_MAX")
CAPABILITIES = ("ENTITY_LOOKUP", "RELATION_LOOKUP", "BOOLEAN_CHECK", "EXISTENCE_CHECK", "AGGREGATION", "COMPOSITION")
CONSTRAINTS = (
    "TARGET_ID", "TARGET_TYPE", "SOURCE_TYPE", "RELATION_TYPE", "REQUIRED_SUBGRAPH", "GOVERNANCE_MAX_HOPS",
    "DATE_KEY_REQUIRED", "CLOSED_WORLD_SCOPE", "PATH_SELECTION_KEY", "CAPABILITY_REQUIRED", "MAX_CARDINALITY", "ORDERED_UNITS",
)
#: Endpoint types that fit any type.
WILDCARDS = ("ENTITY", "ANY")


@dataclass(frozen=True)
class Anchor:
    node_type: str
    node_id: str


@dataclass(frozen=True)
class Step:
    relation: str
    direction: str
    source_type: str
    target_type: str

    @property
    def here(self) -> str:
        """The type this step leaves from."""
        return symbol(self.source_type if symbol(self.direction) == "OUT" else self.target_type)

    @property
    def there(self) -> str:
        return symbol(self.target_type if symbol(self.direction) == "OUT" else self.source_type)


@dataclass(frozen=True)
class Bounds:
    max_hops: int
    max_results: int
    cap_per_hop: int


@dataclass(frozen=True)
class Projection:
    kind: str
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class Aggregation:
    operation: str
    top_n: int | None = None
    date_keys: tuple[str, ...] = ()
    group_by_node_type: str | None = None
    group_by_relation_type: str | None = None


@dataclass(frozen=True)
class Constraint:
    kind: str
    value: Any


@dataclass(frozen=True)
class Annotation:
    key: str
    value: Any


@dataclass(frozen=True)
class World:
    mode: WorldMode = WorldMode.OPEN_WORLD
    scope: str | None = None
    completeness: str | None = None

    @property
    def closed(self) -> bool:
        return symbol(self.mode) == WorldMode.CLOSED_WORLD


@dataclass(frozen=True)
class CapabilityUse:
    capability: str
    source: str


@dataclass(frozen=True)
class ProgramRef:
    source: str
    program_id: str


@dataclass(frozen=True)
class Unit:
    """One part of a composite: ``plan`` is logical in a logical plan and bound in a bound one."""

    unit_id: str
    plan: Any
    dependencies: tuple[str, ...] = ()
    required: bool = True


@dataclass(frozen=True)
class LogicalPlan:
    planner_id: str
    domain_id: str
    pack_fingerprint: str
    pack_version: str
    plan_type: PlanType
    anchors: tuple[Anchor, ...]
    steps: tuple[Step, ...]
    projection: Projection
    bounds: Bounds
    world: World = World()
    declared: tuple[str, ...] = ()
    uses: tuple[CapabilityUse, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    annotations: tuple[Annotation, ...] = ()
    program: ProgramRef | None = None
    aggregation: Aggregation | None = None
    units: tuple[Unit, ...] = ()
    composition_policy: CompositionPolicy = CompositionPolicy.FAIL_CLOSED
    protocol: str = LOGICAL_PROTOCOL
    version: int = PROTOCOL_VERSION

    def constraint(self, kind: str) -> Constraint | None:
        return next((c for c in self.constraints if symbol(c.kind) == kind), None)

    def identity(self) -> dict[str, Any]:
        own = {k: getattr(self, k) for k in ("protocol", "version", "planner_id", "domain_id", "pack_fingerprint", "pack_version", "plan_type", "anchors", "steps", "projection", "bounds", "world", "program", "aggregation", "composition_policy")}
        own["constraints"] = in_json_order({"kind": symbol(c.kind), "value": plain(c.value)} for c in self.constraints)
        own["uses"] = in_json_order({"capability": symbol(u.capability), "source": clean(u.source)} for u in self.uses)
        own["units"] = [{"unit_id": u.unit_id, "dependencies": u.dependencies, "required": u.required, "plan": u.plan.digest} for u in self.units]
        return own

    @cached_property
    def digest(self) -> str:
        return fingerprint(self.identity())


@dataclass(frozen=True)
class BoundPlan:
    """A logical plan that is about to run, with the digest it had when it was bound."""

    logical: LogicalPlan
    logical_digest: str
    operation: str
    units: tuple[Unit, ...] = ()
    protocol: str = BOUND_PROTOCOL
    version: int = PROTOCOL_VERSION

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.logical, name)

    def identity(self) -> dict[str, Any]:
        return {"protocol": self.protocol, "version": self.version, "operation": self.operation, "logical": self.logical.identity(), "logical_digest": self.logical_digest, "units": [{"unit_id": u.unit_id, "plan": u.plan.digest} for u in self.units]}

    @cached_property
    def digest(self) -> str:
        return fingerprint(self.identity())


def _need(ok: Any, reason: str) -> None:
    if not ok:
        raise PlanError(reason)


def check_acyclic(units: tuple[Unit, ...]) -> None:
    """Unit ids are there and unique, and dependencies name units and form no cycle."""
    ids = [u.unit_id for u in units]
    _need(all(map(clean, ids)), "unit_id_required")
    _need(len(set(ids)) == len(ids), "unit_ids_must_be_unique")
    waiting = {u.unit_id: set(u.dependencies) for u in units}
    for own, needs in waiting.items():
        _need(needs <= set(ids), "unknown_dependency")
        _need(own not in needs, "self_dependency")
    while waiting:
        free = [k for k, needs in waiting.items() if not needs & waiting.keys()]
        _need(free, "dependency_cycle")
        for k in free:
            del waiting[k]


def _check_world(world: World) -> None:
    _need(symbol(world.mode) in list(WorldMode), "world_mode_invalid")
    if world.closed:
        _need(clean(world.scope), "closed_world_scope_required")
        _need(symbol(world.completeness) == "EXHAUSTIVE", "closed_world_exhaustiveness_required")
    else:
        _need(world.scope is None and world.completeness is None, "open_world_cannot_have_closed_scope")


def _check_capabilities(plan: LogicalPlan) -> None:
    declared, used = [symbol(x) for x in plan.declared], [symbol(u.capability) for u in plan.uses]
    _need(len(set(declared)) == len(declared), "duplicate_declared_capability")
    for x in declared:
        _need(x in CAPABILITIES, f"unknown_declared_capability:{x}")
    for u, x in zip(plan.uses, used, strict=True):
        _need(x in CAPABILITIES, f"unknown_capability_use:{x}")
        _need(clean(u.source), f"capability_source_required:{x}")
        _need(x in declared, f"undeclared_capability:{x}")
        _need(used.count(x) == 1, f"duplicate_capability_use:{x}")


def _check_constraints(plan: LogicalPlan) -> None:
    kinds = [symbol(c.kind) for c in plan.constraints]
    for c, kind in zip(plan.constraints, kinds, strict=True):
        _need(kind in CONSTRAINTS, f"unknown_constraint:{kind}")
        _need(kinds.count(kind) == 1, f"duplicate_constraint:{kind}")
        _need(c.value is not None, f"constraint_value_required:{kind}")
    limit = plan.constraint("GOVERNANCE_MAX_HOPS")
    if limit:
        _need(str(limit.value).isdigit(), "governance_max_hops_invalid")
        _need(plan.bounds.max_hops <= int(limit.value), "max_hops_exceeds_governance")


def _check_aggregation(plan: LogicalPlan) -> None:
    a = plan.aggregation
    _need((plan.plan_type == PlanType.AGGREGATE) == (a is not None), "aggregate_plan_requires_aggregation" if a is None else "non_aggregate_plan_has_aggregation")
    if a is not None:
        _need(symbol(a.operation) in AGGREGATIONS, f"aggregation_operation_invalid:{symbol(a.operation)}")
        _need(a.top_n is None or a.top_n > 0, "aggregation_top_n_invalid")
        _need(len(set(a.date_keys)) == len(a.date_keys), "aggregation_date_keys_duplicate")
        _need(symbol(a.operation) not in ("LATEST", "TOP_N") or a.date_keys, "aggregation_date_keys_required")
        _need(symbol(a.operation) != "GROUP_BY_MAX" or a.group_by_node_type or a.group_by_relation_type, "aggregation_group_required")


def _check_steps(plan: LogicalPlan) -> None:
    at = symbol(plan.anchors[0].node_type) if plan.anchors else ""
    for s in plan.steps:
        _need(clean(s.relation), "relation_required")
        _need(symbol(s.direction) in DIRECTIONS, f"relation_direction_invalid:{symbol(s.direction)}")
        _need(clean(s.source_type) and clean(s.target_type), "step_endpoint_types_required")
        _need(s.here in WILDCARDS or at in WILDCARDS or s.here == at, "relation_type_chain_inconsistent")
        at = s.there


def check_plan(plan: LogicalPlan) -> None:
    """Raise PlanError with a reason code unless the plan is sound."""
    _need(plan.protocol == LOGICAL_PROTOCOL and plan.version == PROTOCOL_VERSION, "logical_plan_protocol_invalid")
    for name in ("planner_id", "domain_id", "pack_fingerprint", "pack_version"):
        _need(clean(getattr(plan, name)), f"{name}_required")
    _need(symbol(plan.plan_type) in list(PlanType), "plan_type_invalid")
    composite = plan.plan_type == PlanType.COMPOSITE
    _need(composite or plan.anchors, "anchor_required")
    _need(composite or len(plan.anchors) == 1, "single_plan_requires_one_anchor")
    _need(all(clean(a.node_type) and clean(a.node_id) for a in plan.anchors), "anchor_incomplete")
    _need(symbol(plan.projection.kind) in PROJECTIONS, "projection_invalid")
    _need(all(map(clean, plan.projection.fields)), "projection_field_invalid")
    b = plan.bounds
    _need(b.max_hops >= 0, "max_hops_invalid")
    _need(b.max_results > 0 and b.cap_per_hop > 0, "plan_bounds_invalid")
    _need(len(plan.steps) <= b.max_hops, "path_exceeds_max_hops")
    _check_world(plan.world)
    _check_capabilities(plan)
    _check_constraints(plan)
    _check_aggregation(plan)
    _check_steps(plan)
    if not plan.steps and not composite:
        _need(b.max_hops == 0, "zero_hop_plan_requires_zero_max_hops")
        _need(plan.plan_type != PlanType.BOOLEAN_CHECK, "boolean_plan_requires_proof_path")
        if plan.plan_type == PlanType.TRAVERSE and symbol(plan.projection.kind) == "NODE_ONLY":
            _need("ENTITY_LOOKUP" in [symbol(u.capability) for u in plan.uses], "entity_lookup_unsupported")
    if plan.program is not None:
        _need(plan.program.source == PROGRAM_SOURCE and clean(plan.program.program_id), "program_source_invalid")
    _need(symbol(plan.composition_policy) in list(CompositionPolicy), "composition_policy_invalid")
    _need(not composite or len(plan.units) >= 2, "composite_requires_multiple_units")
    _need(composite or not plan.units, "non_composite_plan_has_units")
    check_acyclic(plan.units)
    for u in plan.units:
        for name in ("domain_id", "pack_fingerprint", "planner_id"):
            _need(getattr(u.plan, name) == getattr(plan, name), f"unit_{name}_differs")
        check_plan(u.plan)


def bind(plan: LogicalPlan) -> BoundPlan:
    check_plan(plan)
    units = tuple(Unit(u.unit_id, bind(u.plan), u.dependencies, u.required) for u in plan.units)
    return BoundPlan(plan, plan.digest, symbol(plan.plan_type), units)


def check_bound(plan: BoundPlan) -> None:
    """Raise BindError unless the bound plan is its logical plan, unit by unit."""
    if not isinstance(plan, BoundPlan):
        raise BindError("bound_plan_required")
    if plan.protocol != BOUND_PROTOCOL or plan.version != PROTOCOL_VERSION:
        raise BindError("bound_plan_protocol_invalid")
    try:
        check_plan(plan.logical)
    except PlanError as e:
        raise BindError(str(e)) from e
    if plan.operation != symbol(plan.logical.plan_type):
        raise BindError("operation_differs")
    if plan.logical_digest != LogicalPlan.digest.func(plan.logical):
        raise BindError("logical_digest_differs")
    if [u.unit_id for u in plan.units] != [u.unit_id for u in plan.logical.units]:
        raise BindError("units_differ")
    for own, meant in zip(plan.units, plan.logical.units, strict=True):
        if own.plan.logical != meant.plan:
            raise BindError(f"unit_plan_differs:{own.unit_id}")
        check_bound(own.plan)
