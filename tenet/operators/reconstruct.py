"""Best-first reconstruction: from a seed, follow current claims by falling score, one entity a step, under a policy."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenet.extensions import Agent, WalkPolicy
from tenet.operators.belief import current, supported

STEPS, LEAST, DECAY = 16, 0.05, 0.8
#: A step reads at most so many rows of an entity, the newest of them; `Walk.cut` names entities that have more.
MOST_ROWS = 10_000


@dataclass
class Walk:
    """What was visited, in order, with scores; the ids of the rows that were gathered; and entities of more rows than were read."""

    visited: list[tuple[str, float]] = field(default_factory=list)
    rows: list[str] = field(default_factory=list)
    cut: list[str] = field(default_factory=list)


@dataclass
class BestFirst:
    """The entity of highest score next, ties by who was found first; a neighbour gets parent x conf x DECAY."""

    decay: float = DECAY

    def select(self, frontier: dict[str, float], visited: list[tuple[str, float]]) -> str | None:
        return max(frontier, key=frontier.__getitem__, default=None)  # the first of equal ones

    def score(self, parent: float, conf: float, verb: str) -> float:
        return parent * conf * self.decay

    def done(self, visited: list[tuple[str, float]]) -> bool:
        return False


@dataclass
class AskedNext(BestFirst):
    """An agent chooses the next entity among those of highest score, or stops the walk; a reply that names none of them means the best."""

    agent: Agent = str
    shown: int = 10

    def select(self, frontier: dict[str, float], visited: list[tuple[str, float]]) -> str | None:
        best = sorted(frontier, key=lambda e: -frontier[e])[: self.shown]
        if not best:
            return None
        seen = ", ".join(e for e, _ in visited) or "nothing"
        reply = self.agent("\n".join([f"Visited: {seen}.", "Which entity next? Answer with its number, or STOP.", *(f"{i}. {e} ({frontier[e]:.3f})" for i, e in enumerate(best, 1))])).strip()
        if re.search(r"\bSTOP\b", reply):
            return None
        numbers = [int(x) for x in re.findall(r"\d+", reply) if 1 <= int(x) <= len(best)]
        return best[numbers[-1] - 1] if numbers else best[0]


def reconstruct(claims: DataFrame, seed: str, steps: int = STEPS, least: float = LEAST, policy: WalkPolicy | None = None) -> Walk:
    """At each step the policy's choice is read, and its neighbours are scored; those below `least` are left.

    Sequential by nature, and bounded by its steps: each is one filtered read of the entity's rows."""
    guide = policy or BestFirst()
    now, out = supported(current(claims)), Walk()
    frontier, done = {seed: 1.0}, set()
    gathered: set[str] = set()
    while frontier and len(out.visited) < steps and not guide.done(out.visited):
        entity = guide.select(frontier, out.visited)
        if entity is None:
            break
        worth = frontier.pop(entity)
        done.add(entity)
        out.visited.append((entity, worth))
        near = now.where((F.col("subject") == entity) | (F.col("object") == entity)).select("id", "tx", "subject", "verb", "object", "conf")
        found = near.orderBy(F.desc("tx")).limit(MOST_ROWS + 1).collect()
        if len(found) > MOST_ROWS:
            out.cut.append(entity)
        for r in reversed(found[:MOST_ROWS]):
            if r["id"] not in gathered:
                gathered.add(r["id"])
                out.rows.append(r["id"])
            other = r["object"] if r["subject"] == entity else r["subject"]
            if other is None or other in done:
                continue
            score = guide.score(worth, r["conf"], r["verb"])
            if score >= least and score > frontier.get(other, 0.0):
                frontier[other] = score
    return out
