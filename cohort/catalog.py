"""The declared catalog and the job spec.

Parquet carries no keys, so tables, foreign keys and polymorphic relations are declared here; ``sources.profile`` checks the
declaration against the data.  A spec loads from JSON strictly: an unknown key, operator or kind is an error.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

CLASSES = ("transactional", "reference", "structure", "excluded")
OPERATORS = (
    "eq", "neq", "lt", "lte", "gt", "gte", "contains", "notContains", "startsWith", "endsWith",
    "isNull", "notNull", "in", "notIn", "withinLast", "olderThan", "matches",
)
#: Operators that also keep nulls, unless a condition says otherwise.
WIDENED = ("neq", "notContains", "notIn")
UNITS = ("day", "week", "month", "year")
MIN_OBFUSCATED = 6


class SpecError(ValueError):
    """A spec that must not run."""


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` refers to ``parent.parent_column``; unknown nullability counts as not nullable."""

    table: str
    column: str
    parent: str
    parent_column: str
    nullable: bool = False

    @property
    def label(self) -> str:
        return f"{self.table}.{self.column}"


@dataclass(frozen=True)
class MorphRelation:
    """A polymorphic pair: ``type_column`` names the table that ``id_column`` refers to."""

    table: str
    type_column: str
    id_column: str
    type_map: tuple[tuple[str, str | None], ...]
    cascade_down: bool = False
    backfill_up: bool = True

    def mapped(self) -> list[tuple[str, str]]:
        return [(v, t) for v, t in self.type_map if v and t]


@dataclass(frozen=True)
class Edge:
    """One directed reference, a foreign key or one value of a polymorphic relation."""

    child: str
    column: str
    parent: str
    parent_column: str | None = None
    type_column: str | None = None
    type_value: str | None = None

    @property
    def label(self) -> str:
        return f"{self.child}.{self.column}" if self.type_column is None else f"{self.child}.{self.type_column}={self.type_value}"


@dataclass(frozen=True)
class Table:
    """What is declared about a table; ``pk`` has one column for tables whose rows can be addressed."""

    name: str
    pk: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    generated: tuple[str, ...] = ()
    sequences: tuple[str, ...] = ()

    @property
    def key(self) -> str | None:
        return self.pk[0] if len(self.pk) == 1 else None


@dataclass(frozen=True)
class Condition:
    """``column`` None is the primary key."""

    column: str | None
    op: str
    value: Any = None
    include_nulls: bool = True

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise SpecError(f"unknown operator {self.op!r}")


@dataclass(frozen=True)
class Take:
    """``all``; ``sample`` of n rows; ``top`` n by a column; ``none``: the rule only flags rows kept by others."""

    kind: str = "all"
    n: int = 0
    column: str | None = None
    descending: bool = True

    def __post_init__(self) -> None:
        if self.kind not in ("all", "sample", "top", "none"):
            raise SpecError(f"unknown take {self.kind!r}")
        if self.kind == "top" and not self.column:
            raise SpecError("take top needs a column")


@dataclass(frozen=True)
class Rule:
    """Which rows of a table to keep, and whether to anonymize them.  ``raw`` is a SQL predicate instead of conditions."""

    table: str
    where: tuple[Condition, ...] = ()
    match: str = "all"
    raw: str | None = None
    take: Take = Take()
    anonymize: bool = True

    def __post_init__(self) -> None:
        if self.match not in ("all", "any"):
            raise SpecError(f"unknown match {self.match!r}")
        if self.raw is not None and self.where:
            raise SpecError("a rule has conditions or a raw predicate, not both")

    @property
    def keeps_all(self) -> bool:
        return self.take.kind == "all" and not self.where and self.raw is None


@dataclass(frozen=True)
class Binding:
    """What a template does at one dot path of a JSON value: ``fake`` (by a generator), ``redact`` or ``remove``."""

    path: str
    action: str = "fake"
    generator: str | None = None

    def __post_init__(self) -> None:
        if self.action not in ("fake", "redact", "remove"):
            raise SpecError(f"unknown template action {self.action!r}")


@dataclass(frozen=True)
class Strategy:
    """How to rewrite a value: preserve, redact, fake, jitter, obfuscate or template, with what that kind needs."""

    kind: str
    generator: str | None = None
    percent: float = 0.0
    side: str | None = None
    count: int = 0
    delimiter: str = ""
    bindings: tuple[Binding, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("preserve", "redact", "fake", "jitter", "obfuscate", "template"):
            raise SpecError(f"unknown strategy {self.kind!r}")
        if self.kind == "obfuscate" and self.side not in ("first", "last", "before"):
            raise SpecError(f"unknown side {self.side!r}")
        if self.kind == "obfuscate" and self.side != "before" and self.count < MIN_OBFUSCATED:
            raise SpecError(f"obfuscate hides at least {MIN_OBFUSCATED} characters")
        if self.kind == "fake" and not self.generator:
            raise SpecError("fake needs a generator")


@dataclass(frozen=True)
class FieldException:
    """Rows whose source values meet the conditions get another strategy."""

    where: tuple[Condition, ...]
    strategy: Strategy
    match: str = "all"

    def __post_init__(self) -> None:
        if not self.where:
            raise SpecError("an exception needs a condition")
        if self.strategy.kind == "template":
            raise SpecError("an exception cannot be a template")


@dataclass(frozen=True)
class FieldStrategy:
    table: str
    column: str
    strategy: Strategy
    exception: FieldException | None = None


@dataclass(frozen=True)
class LocaleSource:
    """Where a table's rows keep their country: a column, or a dot path in a JSON column."""

    table: str
    column: str
    path: str | None = None


@dataclass(frozen=True)
class IdentitySource:
    """``table.column`` holds the key of the ``entity`` row that a row's fake values follow."""

    table: str
    column: str
    entity: str


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, Table]
    foreign_keys: tuple[ForeignKey, ...] = ()

    def key(self, table: str) -> str | None:
        t = self.tables.get(table)
        return t.key if t else None


@dataclass(frozen=True)
class SubsetSpec:
    """A whole job.  Tables without a class are transactional."""

    classes: dict[str, str] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    strategies: tuple[FieldStrategy, ...] = ()
    morphs: tuple[MorphRelation, ...] = ()
    policies: dict[tuple[str, str], str] = field(default_factory=dict)
    locales: tuple[LocaleSource, ...] = ()
    identities: tuple[IdentitySource, ...] = ()

    def __post_init__(self) -> None:
        for table, cls in self.classes.items():
            if cls not in CLASSES:
                raise SpecError(f"{table}: unknown class {cls!r}")
        for edge, policy in self.policies.items():
            if policy not in ("follow", "null"):
                raise SpecError(f"{'.'.join(edge)}: unknown policy {policy!r}")
        seen = set()
        for s in self.strategies:
            if (s.table, s.column) in seen:
                raise SpecError(f"{s.table}.{s.column} has two strategies")
            seen.add((s.table, s.column))

    def class_of(self, table: str) -> str:
        return self.classes.get(table, "transactional")

    def role_of(self, table: str) -> str:
        """``complete`` (copied whole), ``subset``, or ``omitted`` (no rows come out)."""
        return {"reference": "complete", "transactional": "subset"}.get(self.class_of(table), "omitted")

    @classmethod
    def from_json(cls, text: str) -> SubsetSpec:
        raw = json.loads(text)
        _only(raw, "spec", "classes", "rules", "strategies", "morphs", "policies", "locales", "identities")
        return cls(
            classes=dict(raw.get("classes", {})),
            rules=tuple(_rule(r) for r in raw.get("rules", [])),
            strategies=tuple(_field(s) for s in raw.get("strategies", [])),
            morphs=tuple(_morph(m) for m in raw.get("morphs", [])),
            policies={(p["table"], p["column"]): p["policy"] for p in (_only(p, "policy", "table", "column", "policy") for p in raw.get("policies", []))},
            locales=tuple(_build(LocaleSource, x) for x in raw.get("locales", [])),
            identities=tuple(_build(IdentitySource, x) for x in raw.get("identities", [])),
        )


def _only(raw: Any, what: str, *keys: str) -> dict:
    if not isinstance(raw, dict):
        raise SpecError(f"{what}: an object is needed")
    if odd := sorted(set(raw) - set(keys)):
        raise SpecError(f"{what}: unknown {', '.join(odd)}")
    return raw


def _build(cls, raw: dict, **made):
    """A dataclass from JSON, its tuples and nested parts given in ``made``."""
    names = list(cls.__dataclass_fields__)
    _only(raw, cls.__name__, *names)
    try:
        return cls(**{**raw, **made})
    except TypeError as e:
        raise SpecError(f"{cls.__name__}: {e}") from None


def _conditions(raw: list) -> tuple[Condition, ...]:
    return tuple(_build(Condition, c, **({"value": tuple(c["value"])} if isinstance(c.get("value"), list) else {})) for c in raw)


def _rule(raw: dict) -> Rule:
    return _build(Rule, raw, where=_conditions(raw.get("where", [])), take=_build(Take, raw.get("take", {})))


def _strategy(raw: dict) -> Strategy:
    return _build(Strategy, raw, bindings=tuple(_build(Binding, b) for b in raw.get("bindings", [])))


def _field(raw: dict) -> FieldStrategy:
    made: dict[str, Any] = {"strategy": _strategy(raw["strategy"])}
    if raw.get("exception"):
        e = raw["exception"]
        made["exception"] = _build(FieldException, e, where=_conditions(e.get("where", [])), strategy=_strategy(e["strategy"]))
    return _build(FieldStrategy, raw, **made)


def _morph(raw: dict) -> MorphRelation:
    return _build(MorphRelation, raw, type_map=tuple((v, t) for v, t in raw.get("type_map", [])))
