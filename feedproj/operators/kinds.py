"""Registration of entity kinds: event types, actions and aggregate types follow from the specs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedproj.operators.canonical import CONTENT, EntitySpec


@dataclass(frozen=True)
class Kinds:
    """The entity kinds a feed knows. Adding one is all that its events need to be handled.

    An event type belongs to one kind, and a kind is registered once; anything else is an
    error when the registry is made, not when an event arrives.
    """

    specs: tuple[EntitySpec, ...] = ()

    def __post_init__(self):
        names = [s.kind for s in self.specs]
        types = [t for s in self.specs for t in s.event_types]
        for seen in (names, types):
            twice = sorted({x for x in seen if seen.count(x) > 1})
            if twice:
                raise ValueError(f"registered twice: {', '.join(twice)}")

    def with_(self, more: Iterable[EntitySpec]) -> Kinds:
        """The registry with further kinds; a spec that is there already stays as it is."""
        return Kinds((*self.specs, *[s for s in more if s not in self.specs]))

    def spec(self, kind: str) -> EntitySpec:
        for s in self.specs:
            if s.kind == kind:
                return s
        raise KeyError(kind)

    @property
    def event_types(self) -> tuple[str, ...]:
        return tuple(t for s in self.specs for t in s.event_types)

    @property
    def aggregate_types(self) -> tuple[str, ...]:
        return tuple(s.kind for s in self.specs)

    def registered(self, event_type: Column) -> Column:
        return F.coalesce(event_type.isin(*self.event_types), F.lit(False))

    def action(self, event_type: Column) -> Column:
        """``upsert`` or ``tombstone``, as the type's kind declares its verbs; NULL for unknown types."""
        up = [f"{s.domain}.{s.kind}.{v}" for s in self.specs for v in s.upserts]
        down = [f"{s.domain}.{s.kind}.{v}" for s in self.specs for v in s.tombstones]
        return F.when(event_type.isin(*up), "upsert").when(event_type.isin(*down), "tombstone")

    def aggregate_type(self, event_type: Column) -> Column:
        """The second name segment, where a registered kind of that domain has it."""
        parts = [F.split_part(event_type, F.lit("."), F.lit(n)) for n in (1, 2)]
        known = [(parts[0] == s.domain) & (parts[1] == s.kind) for s in self.specs]
        out = F.lit(None).cast("string")
        for s, here in zip(self.specs, known, strict=True):
            out = F.when(here, s.kind).otherwise(out)
        return out


CONTENT_KINDS = Kinds(CONTENT)
