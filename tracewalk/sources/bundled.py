"""Two small synthetic domains with their facts, and the pack of the star-schema graph."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

# Packs and facts of the bundled domains.
CAPABILITIES = ["ENTITY_LOOKUP", "RELATION_LOOKUP", "BOOLEAN_CHECK", "EXISTENCE_CHECK", "COMPOSITION"]
SMALL = {"max_hops": 2, "max_results": 25, "cardinality_cap_per_hop": 25}


def _pack(name: str, entities: list[str], relations: list[tuple[str, str, str, str]], programs: list[dict]) -> dict[str, Any]:
    return {
        "domain_name": name,
        "pack_version": "1.0",
        "entities": entities,
        "relations": [{"type": t, "source": s, "target": d, "aliases": [a]} for t, s, d, a in relations],
        "capabilities": CAPABILITIES,
        "world_model": {"mode": "OPEN_WORLD"},
        "governance": SMALL,
        "query": {"router": {"planner": f"reference.{name}.v1"}, "semantic_programs": programs},
    }


def _program(program_id: str, pattern: str, anchor: str, steps: list[tuple[str, str, str]], **more: Any) -> dict[str, Any]:
    walked = [{"relation": r, "direction": "OUT", "source_type": s, "target_type": t} for r, s, t in steps]
    return {"program_id": program_id, "patterns": [pattern], "anchor_type": anchor, "steps": walked, "projection": "TYPED_FACTS", **more}


_TO_PROJECT = ("CONTRIBUTED_TO", "RESEARCHER", "PROJECT")

DOMAINS = {
    "research_network": _pack(
        "research_network",
        ["PROJECT", "RESEARCHER", "LAB", "DATASET"],
        [("MEMBER_OF", "RESEARCHER", "LAB", "member of"), ("CONTRIBUTED_TO", "RESEARCHER", "PROJECT", "contributed to"), ("PRODUCED", "PROJECT", "DATASET", "produced")],
        [
            _program("research.datasets_from_contributor", "Which datasets were produced by projects contributed to by <RESEARCHER>", "RESEARCHER", [_TO_PROJECT, ("PRODUCED", "PROJECT", "DATASET")], metadata={"required_subgraph": "research_contribution_path"}),
            _program("research.labs_for_researcher", "Which labs is <RESEARCHER> member of", "RESEARCHER", [("MEMBER_OF", "RESEARCHER", "LAB")]),
            _program("research.researcher_contributes", "Does <RESEARCHER> contribute", "RESEARCHER", [_TO_PROJECT], plan_type="BOOLEAN_CHECK"),
        ],
    ),
    "equipment_network": _pack(
        "equipment_network",
        ["DEVICE", "FACILITY", "COMPONENT", "MAINTENANCE_RECORD"],
        [("LOCATED_AT", "DEVICE", "FACILITY", "located at"), ("CONTAINS", "FACILITY", "COMPONENT", "contains"), ("SERVICED_BY", "COMPONENT", "MAINTENANCE_RECORD", "serviced by")],
        [_program("equipment.components_at_device_facility", "Which components are contained by facilities located at <DEVICE>", "DEVICE", [("LOCATED_AT", "DEVICE", "FACILITY"), ("CONTAINS", "FACILITY", "COMPONENT")], metadata={"required_subgraph": "equipment_location_path"})],
    ),
}


def _facts(nodes: list[tuple[str, str, str]], edges: list[tuple[str, str, str, str, str]]) -> dict[str, Any]:
    return {
        "nodes": [{"node_id": i, "node_type": t, "properties": {"name": n}} for i, t, n in nodes],
        "edges": [{"edge_id": i, "src_id": s, "dst_id": d, "relation": r, "properties": {"source_ref": ref}} for i, s, r, d, ref in edges],
    }


FACTS = {
    "research_network": _facts(
        [("researcher-alice", "RESEARCHER", "Alice"), ("researcher-bob", "RESEARCHER", "Bob"), ("project-atlas", "PROJECT", "Atlas"), ("project-beacon", "PROJECT", "Beacon"), ("lab-north", "LAB", "North Lab"), ("dataset-atlas-1", "DATASET", "Atlas Dataset")],
        [("edge-alice-atlas", "researcher-alice", "CONTRIBUTED_TO", "project-atlas", "synthetic:record:1"), ("edge-atlas-dataset", "project-atlas", "PRODUCED", "dataset-atlas-1", "synthetic:record:2"), ("edge-alice-lab", "researcher-alice", "MEMBER_OF", "lab-north", "synthetic:record:3")],
    ),
    "equipment_network": _facts(
        [("device-one", "DEVICE", "Device One"), ("facility-east", "FACILITY", "East Facility"), ("component-pump", "COMPONENT", "Pump"), ("maintenance-1", "MAINTENANCE_RECORD", "Maintenance One")],
        [("edge-device-facility", "device-one", "LOCATED_AT", "facility-east", "synthetic:record:4"), ("edge-facility-component", "facility-east", "CONTAINS", "component-pump", "synthetic:record:5"), ("edge-component-maintenance", "component-pump", "SERVICED_BY", "maintenance-1", "synthetic:record:6")],
    ),
}


def load_domain(name: str) -> dict[str, Any]:
    """A copy of a bundled pack; KeyError for another name."""
    return deepcopy(DOMAINS[name])


def load_facts(name: str) -> dict[str, Any]:
    return deepcopy(FACTS[name])


COMMERCE: dict[str, Any] = {
    "domain_name": "commerce",
    "pack_version": "1.0",
    "entities": ["REGION", "NATION", "CUSTOMER", "SUPPLIER", "PART", "ORDER", "USER", "EVENT"],
    "relations": [
        {"type": "IN_REGION", "source": "NATION", "target": "REGION", "aliases": ["in region"]},
        {"type": "LOCATED_IN", "source": "CUSTOMER", "target": "NATION", "aliases": ["located in"]},
        {"type": "BASED_IN", "source": "SUPPLIER", "target": "NATION", "aliases": ["based in"]},
        {"type": "PLACED", "source": "CUSTOMER", "target": "ORDER", "aliases": ["place", "placed"]},
        {"type": "INCLUDES", "source": "ORDER", "target": "PART", "aliases": ["include", "includes"]},
        {"type": "FULFILLED_BY", "source": "ORDER", "target": "SUPPLIER", "aliases": ["fulfilled by"]},
        {"type": "EMITTED", "source": "USER", "target": "EVENT", "aliases": ["emit", "emitted"]},
    ],
    "capabilities": [*CAPABILITIES, "AGGREGATION"],
    "governance": {"max_hops": 3, "max_results": 1000, "cardinality_cap_per_hop": 5000},
    "query": {
        "router": {"planner": "tracewalk.commerce"},
        "aggregations": {"operations": ["COUNT", "TOP_N", "LATEST", "GROUP_BY_MAX"], "date_keys": ["o_orderdate", "ts"]},
        "semantic_programs": [
            _program("commerce.parts_of_customer", "Which parts are included in orders placed by <CUSTOMER>", "CUSTOMER", [("PLACED", "CUSTOMER", "ORDER"), ("INCLUDES", "ORDER", "PART")], metadata={"required_subgraph": "customer_part_path"}),
            _program("commerce.supplier_nations", "Which nations supply <CUSTOMER>", "CUSTOMER", [("PLACED", "CUSTOMER", "ORDER"), ("FULFILLED_BY", "ORDER", "SUPPLIER"), ("BASED_IN", "SUPPLIER", "NATION")]),
        ],
    },
}
