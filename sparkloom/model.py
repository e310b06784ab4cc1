"""Profiles and specifications: plain data that the operators read and write.

Nothing here holds source rows.  Everything turns into JSON or YAML and back.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

TYPES = ("integer", "float", "boolean", "string", "date", "datetime")
VERSION = "1.0"
MODES = ("valid", "mixed", "negative", "edge", "load_test")
DISTRIBUTIONS = {
    "synthetic_identifier": {"prefix"},
    "masked_patterns": {"patterns"},
    "numeric": {"min", "max", "p05", "p95", "scale_factor"},
    "numeric_shape": {"max_abs_magnitude", "has_negative", "has_positive"},
    "boolean": {"true_ratio"},
    "date_range": {"min", "max"},
    "datetime_range": {"min", "max"},
    "categorical": {"values"},
    "string_pattern": {"min_length", "max_length"},
}


class SpecError(ValueError):
    """A specification or rule set that contradicts itself."""


def _ratio(name: str, value: float) -> None:
    if not 0.0 <= value <= 1.0:
        raise SpecError(f"{name} must lie between 0 and 1")


def check_distribution(d: dict[str, Any] | None) -> None:
    """Known kinds must be sound; unknown ones are kept and ignored."""
    kind = (d or {}).get("kind")
    if kind not in DISTRIBUTIONS:
        return
    if extra := set(d) - DISTRIBUTIONS[kind] - {"kind"}:
        raise SpecError(f"{kind}: unknown keys {sorted(extra)}")
    if kind == "numeric":
        if not 0.1 <= d.get("scale_factor", 1.0) <= 10:
            raise SpecError("scale_factor must lie between 0.1 and 10")
        for a, b in (("min", "max"), ("p05", "p95")):
            if d.get(a) is not None and d.get(b) is not None and d[a] > d[b]:
                raise SpecError(f"{a} is above {b}")
    elif kind == "numeric_shape":
        m = d.get("max_abs_magnitude")
        if m is not None and not -308 <= m <= 307:
            raise SpecError("max_abs_magnitude is out of range")
    elif kind == "categorical" and sum(v["weight"] for v in d["values"]) <= 0:
        raise SpecError("weights must add up to more than 0")
    elif kind in ("date_range", "datetime_range") and d.get("min") and d.get("max") and str(d["min"]) > str(d["max"]):
        raise SpecError("range ends before it begins")
    elif kind == "string_pattern" and d.get("min_length", 0) > d.get("max_length", d.get("min_length", 0)):
        raise SpecError("min_length is above max_length")
    elif kind == "masked_patterns" and len(d["patterns"]) > 10:
        raise SpecError("at most 10 patterns")


@dataclass
class Field:
    name: str
    data_type: str = "string"
    nullable: bool = False
    null_ratio: float = 0.0
    unique_ratio: float = 0.0
    sensitive: bool = False
    semantic_type: str | None = None
    is_identifier: bool = False
    distribution: dict[str, Any] | None = None

    def __post_init__(self):
        if self.data_type not in TYPES:
            raise SpecError(f"{self.name}: unknown type {self.data_type}")
        _ratio("null_ratio", self.null_ratio)
        check_distribution(self.distribution)


@dataclass
class Entity:
    name: str
    row_count: int
    fields: list[Field]
    primary_key: str | None = None
    primary_key_candidates: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SpecError(f"{self.name} has no field {name}")


@dataclass
class Relationship:
    parent_entity: str
    parent_field: str
    child_entity: str
    child_field: str
    kind: str = "many_to_one"
    status: str = "inferred"
    confidence: float = 1.0

    def __post_init__(self):
        if self.kind not in ("many_to_one", "one_to_one"):
            raise SpecError(f"unknown relationship {self.kind}")


@dataclass
class Constraint:
    """formula: entity, target, expression.  temporal: entity, start, end.
    conditional_required: entity, condition_field, condition_value, required_field.
    aggregate_mapping: entity (parent), target, child_entity, child_field, aggregate."""

    kind: str
    entity: str
    target: str | None = None
    expression: str | None = None
    start: str | None = None
    end: str | None = None
    condition_field: str | None = None
    condition_value: Any = None
    required_field: str | None = None
    child_entity: str | None = None
    child_field: str | None = None
    aggregate: str | None = None
    tolerance: float = 1e-6
    status: str = "inferred"
    confidence: float = 1.0

    def __post_init__(self):
        need = {
            "formula": ("target", "expression"),
            "temporal": ("start", "end"),
            "conditional_required": ("condition_field", "required_field"),
            "aggregate_mapping": ("target", "child_entity"),
        }
        if self.kind not in need:
            raise SpecError(f"unknown constraint {self.kind}")
        if missing := [n for n in need[self.kind] if getattr(self, n) is None]:
            raise SpecError(f"{self.kind} lacks {missing}")
        if self.aggregate not in (None, "sum", "count", "avg"):
            raise SpecError(f"unknown aggregate {self.aggregate}")


@dataclass
class Dataset:
    """A profile, or (with seed and mode) a specification."""

    entities: list[Entity]
    relationships: list[Relationship] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    name: str = "dataset"
    version: str = VERSION
    seed: int = 0
    mode: str = "valid"
    invalid_ratio: float = 0.0

    def __getitem__(self, name: str) -> Entity:
        for e in self.entities:
            if e.name == name:
                return e
        raise SpecError(f"there is no entity {name}")

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.as_dict(), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _strict(kind, payload: dict[str, Any]):
    if not isinstance(payload, dict):
        raise SpecError(f"{kind.__name__}: an object is expected")
    if extra := set(payload) - {f.name for f in fields(kind)}:
        raise SpecError(f"{kind.__name__}: unknown keys {sorted(extra)}")
    return kind(**payload)


def dataset_from_dict(payload: dict[str, Any], spec: bool = True) -> Dataset:
    """Fail-closed: unknown keys, versions and references are refused."""
    payload = dict(payload)
    entities = [_strict(Entity, dict(e) | {"fields": [_strict(Field, f) for f in e.get("fields", [])]}) for e in payload.pop("entities", [])]
    relationships = [_strict(Relationship, r) for r in payload.pop("relationships", [])]
    constraints = [_strict(Constraint, c) for c in payload.pop("constraints", [])]
    out = _strict(Dataset, payload | {"entities": entities, "relationships": relationships, "constraints": constraints})
    if spec:
        check_spec(out)
    return out


def check_spec(spec: Dataset) -> Dataset:
    """Cross-references and bounds of a specification."""
    if spec.version != VERSION:
        raise SpecError(f"version {spec.version} is not {VERSION}")
    if spec.mode not in MODES:
        raise SpecError(f"unknown mode {spec.mode}")
    _ratio("invalid_ratio", spec.invalid_ratio)
    names = [e.name for e in spec.entities]
    if not names or len(set(names)) != len(names):
        raise SpecError("entities must exist and have distinct names")
    for e in spec.entities:
        if e.row_count <= 0:
            raise SpecError(f"{e.name}: row_count must be above 0")
        own = [f.name for f in e.fields]
        if not own or len(set(own)) != len(own):
            raise SpecError(f"{e.name}: fields must exist and have distinct names")
        if e.primary_key is not None and not e[e.primary_key].is_identifier:
            raise SpecError(f"{e.name}: the primary key must be an identifier")
    for r in spec.relationships:
        spec[r.parent_entity][r.parent_field]
        spec[r.child_entity][r.child_field]
    for c in spec.constraints:
        own = spec[c.entity]
        for name in (c.target, c.start, c.end, c.condition_field, c.required_field):
            if name is not None:
                own[name]
        if c.child_entity is not None:
            child = spec[c.child_entity]
            if c.child_field is not None:
                child[c.child_field]
    return spec
