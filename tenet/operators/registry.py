"""The verb registry: inverse pairs, renames and declared verbs, folded from declarations in transaction order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The standard pairs (primary, inverse).
STANDARD = (("CONTAINS", "PART-OF"), ("USES", "USED-BY"), ("CAUSE", "CAUSED-BY"), ("REQUIRES", "REQUIRED-BY"), ("PRODUCES", "PRODUCED-BY"), ("OWNS", "OWNED-BY"), ("PRECEDES", "FOLLOWS"), ("SUPPORTS", "SUPPORTED-BY"))


@dataclass(frozen=True)
class Registry:
    inverses: dict[str, str] = field(default_factory=lambda: {i: p for p, i in STANDARD})
    renames: dict[str, str] = field(default_factory=dict)
    problems: tuple[str, ...] = ()

    def stored(self, verb: str) -> str:
        """The oldest spelling of a verb, which is its identity."""
        seen = set()
        while verb in self.renames and verb not in seen:
            seen.add(verb)
            verb = self.renames[verb]
        return verb

    def primary(self, verb: str) -> str | None:
        """The primary verb, if this is an inverse."""
        return self.inverses.get(verb)

    def inverse(self, verb: str) -> str | None:
        return next((i for i, p in self.inverses.items() if p == verb), None)

    def reverse(self, primary: str, inverse: str) -> Registry:
        """Declare a pair; the first declaration of either verb wins."""
        known = self.inverses.get(inverse)
        if known == primary:
            return self
        if primary == inverse or known or inverse in self.inverses.values() or primary in self.inverses or self.inverse(primary):
            return self._problem(f"{primary} REVERSE {inverse} conflicts with an earlier declaration")
        return Registry({**self.inverses, inverse: primary}, self.renames, self.problems)

    def rename(self, old: str, new: str) -> Registry:
        """New spellings of a verb; branches and cycles are refused."""
        if self.renames.get(new) == old:
            return self
        if new in self.renames or old in self.renames.values() or self.stored(old) == new or old == new or new in self.inverses or new in self.inverses.values():
            return self._problem(f"{old} RENAMED-TO {new} branches, conflicts or closes a cycle")
        return Registry(self.inverses, {**self.renames, new: old}, self.problems)

    def _problem(self, text: str) -> Registry:
        return Registry(self.inverses, self.renames, (*self.problems, text))

    def declare(self, subject: str, verb: str, obj: str | None) -> Registry:
        if verb == "REVERSE" and obj:
            return self.reverse(subject, obj)
        return self.rename(subject, obj) if verb == "RENAMED-TO" and obj else self

    def column(self, verb: Column) -> Column:
        """Stored spellings of a column of verbs, as a literal map."""
        if not self.renames:
            return verb
        m = F.create_map(*[F.lit(x) for v in self.renames for x in (v, self.stored(v))])
        return F.coalesce(F.try_element_at(m, verb), verb)

    def canonical(self, rows: DataFrame) -> DataFrame:
        """Rename, then swap relations of inverse verbs (their objects become subjects)."""
        verb = self.column(F.col("verb"))
        m = F.create_map(*[F.lit(x) for kv in self.inverses.items() for x in kv]) if self.inverses else None
        if m is None:
            return rows.withColumn("verb", verb)
        primary, swap = F.try_element_at(m, verb), F.col("object").isNotNull()
        swap = F.coalesce(primary.isNotNull() & swap, F.lit(False))
        return rows.withColumns({"subject": F.when(swap, F.col("object")).otherwise(F.col("subject")), "object": F.when(swap, F.col("subject")).otherwise(F.col("object")), "verb": F.when(swap, primary).otherwise(verb)})


def fold(claims: DataFrame, edges: DataFrame | None = None, bound: str | None = None) -> Registry:
    """Replay declarations in order of tx, without those that are children of conditions or reasons. They are few by nature."""
    rows = claims.where(F.col("verb").isin("REVERSE", "RENAMED-TO") & ~F.col("negated") & (F.col("conf") > 0))
    rows = rows if bound is None else rows.where(F.col("tx") <= bound)
    if edges is not None:
        children = edges.where(F.col("role").isin("WHEN", "VIA", "BECAUSE")).select("child_id")
        rows = rows.join(children, rows["id"] == children["child_id"], "left_anti")
    registry = Registry()
    for r in rows.select("tx", "subject", "verb", "object").orderBy("tx").collect():
        registry = registry.declare(r["subject"], r["verb"], r["object"])
    return registry
