"""Who may plan and whether a plan may run: planners, routing, admission, assurance, extensions."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any, Protocol

from tracewalk.functions.text import clean, fingerprint, names

from .ir import Annotation, BindError, BoundPlan, LogicalPlan, check_bound
from .pack import DomainPack


class SelectionError(LookupError):
    """No planner can be selected."""


class UnsupportedPlanner(SelectionError):
    pass


class AmbiguousPlanner(SelectionError):
    pass


@dataclass(frozen=True)
class Selection:
    planner_id: str
    domain_id: str
    pack_version: str
    source: str = "domain_pack"


@dataclass(frozen=True)
class Planner:
    """A registered planner. ``compile`` takes a question and gives a compile result; empty lists of domains or versions fit all."""

    planner_id: str
    domains: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    priority: int = 0
    capabilities: tuple[str, ...] = ()
    compile: Callable[..., Any] | None = None
    can_handle: Callable[[str], bool] | None = None

    def fits(self, s: Selection) -> bool:
        return self.planner_id == s.planner_id and (not self.domains or s.domain_id in self.domains) and (not self.versions or s.pack_version in self.versions)


class PlannerRegistry:
    def __init__(self) -> None:
        self._held: list[Planner] = []

    def register(self, planner: Planner) -> Planner:
        if not clean(planner.planner_id):
            raise ValueError("planner_id_required")
        if any((p.planner_id, p.domains, p.versions, p.priority) == (planner.planner_id, planner.domains, planner.versions, planner.priority) for p in self._held):
            raise ValueError(f"planner_registered_twice:{planner.planner_id}")
        self._held.append(planner)
        return planner

    def resolve(self, s: Selection) -> Planner:
        """The fitting planner of highest priority; none, or two alike, is an error and never a fallback."""
        fit = [p for p in self._held if p.fits(s)]
        if not fit:
            raise UnsupportedPlanner(s.planner_id)
        best = [p for p in fit if p.priority == max(x.priority for x in fit)]
        if len(best) > 1:
            raise AmbiguousPlanner(s.planner_id)
        return best[0]


class Router:
    """The pack (or an override) names the planner; the question never does."""

    def __init__(self, pack: DomainPack, registry: PlannerRegistry, planner_id: str = ""):
        self.pack, self.registry, self.planner_id = pack, registry, planner_id

    def select(self, question: str = "") -> Selection:
        own = self.planner_id or self.pack.planner_id
        if not own:
            raise UnsupportedPlanner("domain_pack_planner_required")
        s = Selection(own, self.pack.domain_id, self.pack.version, "override" if self.planner_id else "domain_pack")
        self.registry.resolve(s)
        return s

    def can_handle(self, question: str) -> bool:
        try:
            planner = self.registry.resolve(self.select(question))
        except SelectionError:
            return False
        return planner.can_handle is None or bool(planner.can_handle(question))

    def route(self, question: str, compile_question: Callable[[str], Any]) -> Any:
        planner = self.registry.resolve(self.select(question))
        result = (planner.compile or compile_question)(question)
        plan = getattr(result, "plan", None)
        if plan is not None and plan.planner_id != planner.planner_id:
            raise SelectionError("planned_by_another_planner")
        return result


class AdmissionError(ValueError):
    """A bound plan that is not the one expected."""


@dataclass(frozen=True)
class Admission:
    plan: BoundPlan
    bound_digest: str
    logical_digest: str
    fields: Mapping[str, str]
    children: tuple[tuple[str, Admission], ...] = ()


#: Where each field of a plan is held to account.
FIELD_CLASSES = {
    "identity": ("planner_id", "domain_id", "pack_fingerprint", "pack_version", "protocol", "version", "logical_digest", "operation"),
    "shape": ("plan_type", "anchors", "steps", "projection", "aggregation", "units", "program"),
    "policy": ("bounds", "world", "declared", "uses", "constraints", "composition_policy"),
    "note": ("annotations",),
}


def admit(plan: BoundPlan, logical: LogicalPlan | None = None, bound_digest: str = "", **expected: str) -> Admission:
    """Admit a bound plan that fits a logical plan or a digest, and any expected planner_id, domain_id, pack_fingerprint or pack_version."""
    if logical is None and not bound_digest:
        raise AdmissionError("lineage_required")
    try:
        check_bound(plan)
    except BindError as e:
        raise AdmissionError(str(e)) from e
    if logical is not None and logical.digest != plan.logical_digest:
        raise AdmissionError("logical_plan_differs")
    if bound_digest and bound_digest != plan.digest:
        raise AdmissionError("bound_digest_differs")
    for name, value in expected.items():
        if getattr(plan, name) != value:
            raise AdmissionError(f"{name}_differs")
    classes = {f: kind for kind, fields in FIELD_CLASSES.items() for f in fields}
    unknown = (set(LogicalPlan.__dataclass_fields__) | set(BoundPlan.__dataclass_fields__)) - classes.keys() - {"logical"}
    if unknown:
        raise AdmissionError(f"field_not_classified:{sorted(unknown)[0]}")
    kids = tuple((u.unit_id, admit(u.plan, u.plan.logical, u.plan.digest, **expected)) for u in plan.units)
    return Admission(plan, plan.digest, plan.logical_digest, classes, kids)


ASSURANCE_PROTOCOL, ASSURANCE_VERSION = "tracewalk.assurance", 1
ASSURANCE_NEEDS = ("evaluate", "bind", "normalize_ingress", "attach_integrity", "evaluate_mutation", "record_mutation")


class AssuranceConfigurationError(ValueError):
    pass


class AssuranceError(RuntimeError):
    def __init__(self, code: str, **details: Any):
        super().__init__(code)
        self.code, self.details = code, details


class Assurance(Protocol):
    protocol: str
    version: int

    def evaluate(self, plan: BoundPlan, mode: str = "ENFORCE", audience: str = "") -> dict[str, Any]: ...
    def bind(self, plan: BoundPlan): ...


@dataclass
class StaticAssurance:
    """Allows or denies by a flag; OFF always allows."""

    allow: bool = True
    protocol: str = ASSURANCE_PROTOCOL
    version: int = ASSURANCE_VERSION
    mutations: list[dict] = field(default_factory=list)

    def evaluate(self, plan: BoundPlan, mode: str = "ENFORCE", audience: str = "") -> dict[str, Any]:
        if mode not in ("OFF", "OBSERVE", "ENFORCE"):
            raise AssuranceError("assurance_mode_invalid", mode=mode)
        ok = self.allow or mode == "OFF"
        return {"protocol": self.protocol, "version": self.version, "mode": mode, "audience": audience, "status": "ALLOWED" if ok else "DENIED", "plan_digest": plan.digest}

    @contextmanager
    def bind(self, plan: BoundPlan):
        """Raises AssuranceError if the plan is another when the work is done."""
        held = plan.digest
        yield plan
        if fingerprint(plan.identity()) != held:
            raise AssuranceError("plan_changed_while_bound")

    def normalize_ingress(self, kind: str, **values: Any) -> dict[str, Any]:
        own = {"kind": clean(kind), "values": values}
        return {**own, "digest": fingerprint(own)}

    def attach_integrity(self, response: Mapping[str, Any], previous: str = "") -> dict[str, Any]:
        return {**response, "integrity": {"previous": previous, "digest": fingerprint({"previous": previous, "response": response})}}

    def evaluate_mutation(self, **_: Any) -> dict[str, Any]:
        return {"status": "ALLOWED" if self.allow else "DENIED"}

    def record_mutation(self, target: str, details: Mapping[str, Any]) -> None:
        self.mutations.append({"target": target, **details})


def resolve_assurance(provider: Any) -> Any:
    """The provider, if it is one; there is no default."""
    if provider is None:
        raise AssuranceConfigurationError("assurance_provider_required")
    if getattr(provider, "protocol", None) != ASSURANCE_PROTOCOL or getattr(provider, "version", None) != ASSURANCE_VERSION:
        raise AssuranceConfigurationError("assurance_protocol_unsupported")
    missing = [x for x in ASSURANCE_NEEDS if not callable(getattr(provider, x, None))]
    if missing:
        raise AssuranceConfigurationError(f"assurance_capability_missing:{missing[0]}")
    return provider


#: What a semantic extension may say nothing about.
AUTHORITY_KEYS = ("plan", "anchors", "steps", "constraints", "capabilities", "bounds", "world", "receipt")


class ExtensionRegistry:
    """Extensions add notes to plans; they cannot change what runs, as notes are outside a plan's identity."""

    def __init__(self) -> None:
        self._held: dict[str, Callable[..., Mapping[str, Any]]] = {}

    def register(self, name: str, resolve: Callable[..., Mapping[str, Any]]) -> None:
        if not clean(name) or name in self._held:
            raise ValueError("extension_name_invalid")
        self._held[name] = resolve

    def apply(self, plan: LogicalPlan, wanted: Sequence[str], question: str) -> LogicalPlan:
        from dataclasses import replace

        notes = list(plan.annotations)
        for name in names(wanted):
            if name not in self._held:
                raise ValueError(f"extension_unknown:{name}")
            said = dict(self._held[name](question=question, domain_id=plan.domain_id))
            taken = set(said) & set(AUTHORITY_KEYS)
            if taken:
                raise ValueError(f"extension_claims_authority:{sorted(taken)[0]}")
            json.dumps(said)  # a TypeError here is the extension's
            notes.append(Annotation(f"extension.{name}", said))
        return replace(plan, annotations=tuple(notes))
