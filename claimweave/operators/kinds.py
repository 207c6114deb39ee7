"""What ids tell of claims: where the beginning of an id names the type of its claim, and types of references join known types, a walk knows what it may meet before it looks.

That needs no action and leaves whole tables out of a plan: those of claims that no step can reach. None stands for any types: nothing is known, and nothing is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.glob import regex_of


def fits(value: str, patterns: Iterable[str] | None) -> bool:
    """glob.matches_types of one value."""
    patterns = list(patterns or ())
    match = lambda p: (e := regex_of(p)) is not None and re.search(e.replace(r"\z", r"\Z"), value) is not None
    wanted = [p for p in patterns if not p.startswith("-")]
    return (not wanted or any(map(match, wanted))) and not any(match(p[1:]) for p in patterns if p.startswith("-"))


@dataclass(frozen=True)
class Kinds:
    """types: for what stands before an id's first colon, the type of its claim. links: (type of the citing claim, of the reference, of the claim cited). plain: the types of claims whose ids
    begin otherwise. All that there are: an id that tells another type is that of no claim."""

    types: dict[str, str]
    links: frozenset[tuple[str, str, str]]
    plain: frozenset[str] = frozenset()

    def of(self, *ids: str) -> frozenset[str]:
        """The types that some ids may have."""
        return frozenset().union(*(self._type(i.partition(":")[0]) for i in ids))

    def _type(self, beginning: str) -> frozenset[str]:
        return frozenset({self.types[beginning]}) if beginning in self.types else self.plain

    def met(self, ids: DataFrame, column: str = "id") -> frozenset[str]:
        """The types that the ids of a stored table may have: an action."""
        beginning = F.substring_index(column, ":", 1)
        known = F.when(beginning.isin(sorted(self.types)), beginning).otherwise("")  # others are all alike, however many there are
        return self.of(*(r[0] for r in ids.where(F.col(column).isNotNull()).select(known).distinct().collect()))

    def with_claims(self, types: Iterable[str], links: Iterable[tuple[str, str, frozenset[str]]]) -> Kinds:
        """With claims more, whose ids tell nothing. links: (type, type of the reference, types that its target may have)."""
        return Kinds(self.types, self.links | {(s, e, d) for s, e, own in links for d in own}, self.plain | frozenset(types))

    def below(self, kinds: frozenset[str] | None, patterns: Iterable[str] | None = None) -> frozenset[str] | None:
        """The types that claims of these types reference, by references whose types match."""
        return None if kinds is None else frozenset(d for s, e, d in self.links if s in kinds and fits(e, patterns))

    def above(self, kinds: frozenset[str] | None, patterns: Iterable[str] | None = None) -> frozenset[str] | None:
        return None if kinds is None else frozenset(s for s, e, d in self.links if d in kinds and fits(e, patterns))

    def reached(self, kinds: frozenset[str] | None) -> frozenset[str] | None:
        """The types within the closure of claims of these types."""
        while kinds is not None and not (more := self.below(kinds)) <= kinds:
            kinds = kinds | more
        return kinds

    def holds(self, id_: str, kinds: frozenset[str]) -> Column:
        """Whether an id tells one of these types."""
        own = F.substring_index(id_, ":", 1).isin(sorted(p for p, t in self.types.items() if t in kinds))
        return own | ~F.substring_index(id_, ":", 1).isin(sorted(self.types)) if self.plain & kinds else own

    def references(self, edges: DataFrame, src: frozenset[str] | None = None, dst: frozenset[str] | None = None) -> DataFrame:
        """References from claims of the types src to claims of the types dst."""
        if src is None and dst is None:
            return edges
        own = {x for x in self.links if (src is None or x[0] in src) and (dst is None or x[2] in dst)}
        types = {e for _, e, _ in own}
        out = edges.where(F.col("type").isin(sorted(types)))
        rest = {x for x in self.links if x[1] in types} - own
        if src is not None and any(s not in src for s, _, _ in rest):
            out = out.where(self.holds("src", src))
        if dst is not None and any(d not in dst for _, _, d in rest):
            out = out.where(self.holds("dst", dst))
        return out

    def rows(self, table: DataFrame, kinds: frozenset[str] | None) -> DataFrame:
        """Rows of claims of these types: of a table with their types, or else by their ids."""
        if kinds is None:
            return table
        return table.where(F.col("type").isin(sorted(kinds)) if "type" in table.columns else self.holds("id", kinds))


def references(known: Kinds | None, edges: DataFrame, src: frozenset[str] | None = None, dst: frozenset[str] | None = None) -> DataFrame:
    return edges if known is None else known.references(edges, src, dst)


def rows(known: Kinds | None, table: DataFrame, kinds: frozenset[str] | None) -> DataFrame:
    return table if known is None else known.rows(table, kinds)


def met(known: Kinds | None, ids: DataFrame, column: str = "id") -> frozenset[str] | None:
    return None if known is None else known.met(ids, column)


def both(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    return a if b is None else b if a is None else a & b
