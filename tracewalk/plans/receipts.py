"""Receipts: an immutable record of what was asked, allowed, run and found, sealed with its own SHA-256.

PREPARED -> EXECUTED -> COMPLETE | PARTIAL | POSTCHECK_FAILED, or REJECTED before, or
EXECUTION_FAILED after; no other step is possible.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from tracewalk.functions.text import canonical_json, fingerprint, plain

from .ir import BoundPlan
from .policy import ALLOWED_PARTIAL, Decision

RECEIPT_PROTOCOL = "tracewalk.receipt"
RECEIPT_VERSION = 1
NEXT = {"PREPARED": ("EXECUTED", "EXECUTION_FAILED"), "EXECUTED": ("COMPLETE", "PARTIAL", "POSTCHECK_FAILED")}


class ReceiptError(ValueError):
    """A receipt that does not fit its plan, its state or its seal."""


@dataclass(frozen=True)
class Receipt:
    planner_id: str
    domain_id: str
    pack_fingerprint: str
    pack_version: str
    logical_digest: str
    bound_digest: str
    status: str
    assurance: dict[str, Any]
    pre: dict[str, Any]
    post: dict[str, Any] | None = None
    outcome: dict[str, Any] | None = None
    unit_id: str = ""
    parent_digest: str = ""
    children: tuple[Receipt, ...] = ()
    protocol: str = RECEIPT_PROTOCOL
    version: int = RECEIPT_VERSION
    notes: dict[str, Any] = field(default_factory=dict)

    def body(self) -> dict[str, Any]:
        own = {k: getattr(self, k) for k in self.__dataclass_fields__ if k != "children"}
        return {**plain(own), "children": [c.to_dict() for c in self.children]}

    @cached_property
    def digest(self) -> str:
        return fingerprint(self.body())

    @property
    def complete(self) -> bool:
        return self.status == "COMPLETE"

    def to_dict(self) -> dict[str, Any]:
        return {**self.body(), "receipt_digest": self.digest}

    def to_json(self) -> str:
        return canonical_json(self.to_dict())

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Receipt:
        """Raises ReceiptError unless the digest is that of the rest."""
        own = {k: v for k, v in raw.items() if k != "receipt_digest"}
        made = cls(**{**own, "children": tuple(cls.from_dict(c) for c in own.get("children", ()))})
        if made.digest != raw.get("receipt_digest"):
            raise ReceiptError("receipt_digest_differs")
        return made

    @classmethod
    def from_json(cls, text: str) -> Receipt:
        return cls.from_dict(json.loads(text))

    @classmethod
    def prepare(cls, plan: BoundPlan, pre: Decision, assurance: dict[str, Any], unit_id: str = "", parent: str = "") -> Receipt:
        if pre.phase != "PRE" or pre.plan_digest != plan.digest:
            raise ReceiptError("pre_decision_of_another_plan")
        decisions = dict(pre.children)
        children = tuple(cls.prepare(u.plan, decisions.get(u.unit_id) or replace(pre, plan_digest=u.plan.digest, children=()), assurance, u.unit_id, plan.digest) for u in plan.units)
        status = "PREPARED" if pre.allowed and assurance.get("status") == "ALLOWED" else "REJECTED"
        return cls(plan.planner_id, plan.domain_id, plan.pack_fingerprint, plan.pack_version, plan.logical_digest, plan.digest, status, assurance, _decision(pre), unit_id=unit_id, parent_digest=parent, children=children)

    def _to(self, status: str, **changes: Any) -> Receipt:
        if status not in NEXT.get(self.status, ()):
            raise ReceiptError(f"no_step_from_{self.status}_to_{status}")
        return replace(self, status=status, **changes)

    def executed(self, outcome: dict[str, Any]) -> Receipt:
        """``outcome``: reference, result and evidence digests, or a failure's reason; with the units' under "units"."""
        if outcome.get("bound_digest") != self.bound_digest:
            raise ReceiptError("outcome_of_another_plan")
        units = outcome.get("units", {})
        kids = tuple(c.executed(units[c.unit_id]) if c.unit_id in units else c._to("EXECUTION_FAILED") if c.status == "PREPARED" else c for c in self.children)
        own = {k: v for k, v in outcome.items() if k != "units"}
        return self._to("EXECUTION_FAILED" if outcome.get("failed") else "EXECUTED", outcome=own, children=kids)

    def judged(self, post: Decision) -> Receipt:
        if post.phase != "POST" or post.plan_digest != self.bound_digest:
            raise ReceiptError("post_decision_of_another_plan")
        decisions = dict(post.children)
        kids = tuple(c.judged(decisions[c.unit_id]) if c.status == "EXECUTED" else c for c in self.children)
        status = ("PARTIAL" if post.status == ALLOWED_PARTIAL else "COMPLETE") if post.allowed else "POSTCHECK_FAILED"
        return self._to(status, post=_decision(post), children=kids)

    def check_plan(self, plan: BoundPlan) -> None:
        """Raises ReceiptError unless this is a receipt of exactly this plan."""
        if (self.logical_digest, self.bound_digest) != (plan.logical.digest, plan.digest):
            raise ReceiptError("receipt_of_another_plan")
        if [c.unit_id for c in self.children] != [u.unit_id for u in plan.units]:
            raise ReceiptError("receipt_units_differ")
        for c, u in zip(self.children, plan.units, strict=True):
            c.check_plan(u.plan)

    def lineage(self) -> dict[str, Any]:
        """The flat view: which receipt, planner, pack, plans and states."""
        return {
            "receipt_digest": self.digest,
            "planner_id": self.planner_id,
            "domain_id": self.domain_id,
            "pack_fingerprint": self.pack_fingerprint,
            "pack_version": self.pack_version,
            "logical_plan_digest": self.logical_digest,
            "executable_plan_digest": self.bound_digest,
            "execution_status": self.status,
            "assurance_status": self.assurance.get("status"),
            "pre_status": self.pre["status"],
            "post_status": self.post["status"] if self.post else None,
            "execution_reference": (self.outcome or {}).get("reference"),
        }


def _decision(d: Decision) -> dict[str, Any]:
    return {"phase": d.phase, "status": d.status, "reasons": list(d.reasons), "plan_digest": d.plan_digest, "truth": d.truth}


def audit_failures(receipts, payload: str = "payload", digest: str = "digest"):
    """Rows of a receipt table whose payload no longer has its digest."""
    from pyspark.sql import functions as F

    return receipts.where(F.sha2(payload, 256) != F.col(digest))
