"""Automations: triggers with steps, declared as claims, that run and cascade until nothing fires.

    automation/NAME HAS automation: `premise, ?x op literal, … => action/NAME, hook/NAME, "a prompt about ?x"`

A solution of the premises fires if it cites an event row: one later than the automation's declaration that it has not acted on, that no
bookkeeping made, and neither the automation nor its own actions. Other automations' rows are events like any: so automations chain.

What was acted on is written down before anything is done: as a mark in the store (later rows are events), or, where rows may come
late, by row in a ledger, which a late row is not in yet. Steps run in order, each for all solutions that fire: actions as joins of their
preconditions with the solutions, hooks once with the table of them, prompts one by one, as they are outside calls. A step that fails is told,
and stops nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.extensions import Agent, Hooks
from tenet.functions.values import number
from tenet.operators import rules, shape
from tenet.operators.rules import Action, declarations, is_event, parse_action, parse_rule, reply_rows
from tenet.plans.pattern import Pattern, PatternError, is_variable
from tenet.plans.query import Options, joined
from tenet.schema import conform
from tenet.staging import staged

AUTOMATION, ACTION = "automation", "action"
PASSES = 20
#: Replies that are parsed and appended together.
REPLIES = 1000
#: A part of a list, but for commas in quotes.
COMMA = re.compile(r",(?=(?:[^\"`]|\"[^\"]*\"|`[^`]*`)*$)")


@dataclass(frozen=True)
class Step:
    """kind: action, hook or prompt; name: of the first two, or the prompt's text."""

    kind: str
    name: str


@dataclass(frozen=True)
class Automation:
    name: str
    premises: tuple[Pattern, ...]
    constraints: tuple[tuple[str, str, str], ...]
    steps: tuple[Step, ...]
    text: str

    @property
    def subject(self) -> str:
        return f"automation/{self.name}"

    @property
    def own(self) -> tuple[str, ...]:
        """Sources whose rows are no events to it."""
        return (f"src:{self.subject}", *[f"src:action/{s.name}" for s in self.steps if s.kind == "action"])


def parse_automation(name: str, text: str) -> Automation:
    left, arrow, right = text.partition("=>")
    if not arrow or "=>" in right:
        raise PatternError("an automation has exactly one =>")
    rule = parse_rule(f"{left} => it HAS fired: yes")  # premises and constraints as rules have them
    steps = []
    for part in (p.strip() for p in COMMA.split(right)):
        if m := re.fullmatch(r"(action|hook)/(\S+)", part):
            steps.append(Step(m[1], m[2]))
        elif len(part) > 2 and part[0] == part[-1] and part[0] in '"`':
            steps.append(Step("prompt", part[1:-1]))
        else:
            raise PatternError(f"no step: {part!r} is neither action/…, hook/… nor a quoted prompt")
    return Automation(name, rule.premises, rule.constraints, tuple(steps), text.strip())


def declare(spark: SparkSession, claims: DataFrame, texts: dict[str, str], attribute: str = AUTOMATION) -> DataFrame:
    """Rows to append for automations (or actions) by name: none for those that are declared just so."""
    for name, text in texts.items():
        parse_automation(name, text) if attribute == AUTOMATION else parse_action(name, text)
    held = {(r["subject"], r["value_text"]) for r in declarations(claims, attribute).select("subject", "value_text").collect()}
    rows = [(f"{attribute}/{n}", attribute, rules.literal(t)) for n, t in texts.items()]
    return rules.attribute_rows(spark, [r for r in rows if (r[0], r[2]) not in held], "src:automate")


def listed(claims: DataFrame, attribute: str = AUTOMATION) -> tuple[list[tuple[Automation | Action, str]], list[str]]:
    """([(automation or action, tx of its declaration)] in that order, problems)."""
    found, problems = [], []
    for r in declarations(claims, attribute).orderBy("tx").select("subject", "value_text", "tx").collect():
        name, text = r["subject"].removeprefix(f"{attribute}/"), r["value_text"][1:-1]
        try:
            found.append((parse_automation(name, text) if attribute == AUTOMATION else parse_action(name, text), r["tx"]))
        except PatternError as e:
            problems.append(f"{r['subject']}: {e}")
    return found, problems


class Ledger(Protocol):
    """Which rows an automation has acted on."""

    def acted(self, name: str) -> DataFrame:
        """(row_id)"""

    def note(self, name: str, ids: DataFrame) -> None:
        """Write rows (row_id) down, before anything is done about them."""


@dataclass
class TableLedger:
    """A ledger in a folder: a batch of rows a note, in files of their automation. Ids are in order of time, and files sorted by them, so a
    read with a bound on ids leaves older files out."""

    spark: SparkSession
    path: str

    def acted(self, name: str) -> DataFrame:
        from tenet.streaming.feed import exists

        at = f"{self.path}/{name}"
        schema = "row_id string"
        return self.spark.read.schema(schema).parquet(f"{at}/*") if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def note(self, name: str, ids: DataFrame) -> None:
        from uuid import uuid4

        ids.select("row_id").distinct().repartitionByRange("row_id").sortWithinPartitions("row_id").write.parquet(f"{self.path}/{name}/{uuid4().hex}")


def firing(spark: SparkSession, claims: DataFrame, a: Automation, events: DataFrame, options: Options | None = None) -> DataFrame:
    """Solutions, each once, that cite at least one of the events (row_id): its variables, ids and confs.

    A premise at a time takes events alone and the others all rows. A transitive premise cites the edges on its paths: its solutions are
    found with their support, and kept where an event is among it."""
    from dataclasses import replace

    out, walks = None, [p for p in a.premises if p.transitive]
    o = replace(options or Options(), support=True) if walks else options
    for i, p in enumerate(a.premises):
        if p.transitive:
            continue
        rows = joined(spark, claims, list(a.premises), o, among={i: events})
        out = rows if out is None else out.unionByName(rows)
    if walks:
        every = joined(spark, claims, list(a.premises), o)
        keys = [c for c in every.columns if c != "confs"]
        cited = every.withColumn("row_id", F.explode("ids")).join(events.select("row_id"), "row_id", "left_semi").drop("row_id").dropDuplicates(keys)
        out = cited if out is None else out.unionByName(cited)
    return rules.constrained(out.dropDuplicates([c for c in out.columns if c != "confs"]), a.constraints)


@dataclass
class Outcome:
    """What a step did: to how many solutions it applied, how many rows were added or changed, how many solutions it refused, and why."""

    automation: str
    step: str
    solutions: int
    appended: int = 0
    refused: int = 0
    detail: str | None = None


@dataclass
class Settled:
    store: object
    passes: int
    fired: dict[str, int]
    outcomes: list[Outcome]
    problems: list[str]
    notes: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.problems and not any(o.refused or o.detail for o in self.outcomes)


def bare_text(c):
    """A binding without its delimiters."""
    quoted = (F.length(c) >= 2) & ((c.startswith('"') & c.endswith('"')) | (c.startswith("`") & c.endswith("`")))
    return F.when(quoted, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def effects(spark: SparkSession, claims: DataFrame, action: Action, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of an action for a table of calls (call, and a column for each parameter): the rows that it would append,
    with their call, and the calls (call, why) whose preconditions have not exactly one binding."""
    calls = calls.select("call", *action.parameters)
    found = calls
    if action.preconditions:
        start = calls.select(*action.parameters).distinct()
        rows = joined(spark, claims, list(action.preconditions), start=start).drop("ids", "confs").distinct()
        found = calls.join(rows, list(action.parameters)) if action.parameters else None
        if found is None:
            raise PatternError(f"{action.name} has preconditions and no parameter that they share")
    counts = found.groupBy("call").agg(F.count("*").alias("bindings"))
    judged = calls.join(counts, "call", "left").withColumn("bindings", F.coalesce("bindings", F.lit(0)))
    refused = judged.where("bindings != 1").select("call", F.when(F.col("bindings") == 0, "no binding of its preconditions").otherwise("more than one binding of its preconditions").alias("why"))
    found = found.join(refused.select("call"), "call", "left_anti")
    out = None
    for p in action.effects:
        term = lambda s: F.lit(None).cast("string") if s is None else F.col(s[1:]) if is_variable(s) else F.lit(s)
        literal = number(p.value) if p.value and not is_variable(p.value) else None
        value = term(p.value)
        rows = found.select(
            "call",
            term(p.subject).alias("subject"),
            F.lit(p.verb).alias("verb"),
            F.lit(p.negated).alias("negated"),
            term(p.obj).alias("object"),
            F.lit(p.attribute).cast("string").alias("attribute"),
            value.alias("value_text"),
            (F.lit(float(literal[0])) if literal else value.try_cast("double")).cast("double").alias("value_num"),
            F.lit(literal[1] if literal else None).cast("string").alias("value_unit"),
            F.array(F.lit(f"src:action/{action.name}"), *[F.lit(c) for c in p.contexts]).alias("contexts"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out, refused


class Engine:
    """Runs one store's automations. `actions` are known beside those that the store declares."""

    def __init__(self, store, hooks: Hooks | None = None, agent: Agent | None = None, ledger: Ledger | None = None, actions: dict[str, Action] | None = None, derive: bool = True, check: bool = True):
        self.store, self.hooks, self.agent, self.ledger, self.derive, self.check = store, hooks, agent, ledger, derive, check
        self.actions = actions or {}
        self.outcomes: list[Outcome] = []

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def events(self, a: Automation, since: str) -> DataFrame:
        rows = self.store.claims
        if self.ledger is None:
            return rows.where(is_event(rules.armed(rows, a.subject) or since, own=a.own) & (F.col("conf") > 0)).select(F.col("id").alias("row_id"))
        fresh = rows.where(is_event(since, own=a.own) & (F.col("conf") > 0)).select(F.col("id").alias("row_id"))
        return fresh.join(self.ledger.acted(a.name).where(F.col("row_id") > since), "row_id", "left_anti")

    def fire(self, a: Automation, since: str) -> int:
        """Note and run what fires now: how many solutions."""
        events = staged(self.spark, self.events(a, since), "events")
        if events.limit(1).count() == 0:
            return 0
        found = staged(self.spark, firing(self.spark, self.store.claims, a, events), "firing")
        n = found.count()
        if n == 0:
            return 0
        if self.ledger is not None:
            self.ledger.note(a.name, found.select(F.explode("ids").alias("row_id")).join(events, "row_id", "left_semi"))
        last = self.store.claims.agg(F.max("tx")).first()[0]
        self.store = self.store.add(rules.fired(self.spark, a.subject, last))
        for step in a.steps:
            self.outcomes.append({"action": self.act, "hook": self.hook, "prompt": self.prompt}[step.kind](a, step, found, n))
        return n

    def act(self, a: Automation, step: Step, found: DataFrame, n: int) -> Outcome:
        out = Outcome(a.name, f"action/{step.name}", n)
        action = self.actions.get(step.name) or next((x for x, _ in listed(self.store.claims, ACTION)[0] if x.name == step.name), None)
        if action is None:
            out.refused, out.detail = n, "no such action is declared"
            return out
        if missing := [p for p in action.parameters if p not in found.columns]:
            out.refused, out.detail = n, f"the trigger binds no {missing}"
            return out
        calls = found.select(*[bare_text(F.col(p)).alias(p) for p in action.parameters]).distinct().withColumn("call", F.to_json(F.struct(*action.parameters)) if action.parameters else F.lit(""))
        rows, refused = effects(self.spark, self.store.claims, action, calls)
        refused, rows = staged(self.spark, refused, "refused"), staged(self.spark, rows, "effects")
        new = staged(self.spark, reply_rows(self.store.claims, rows.drop("call"), f"src:action/{action.name}"), "effects")
        if self.check and new.limit(1).count():
            added = self.violated(new)
            if added is not None:  # the calls that touch what is violated go; if that does not mend it, all do
                touching = rows.join(added.select(F.col("entity").alias("subject")).distinct(), "subject", "left_semi").select("call").distinct()
                kept = staged(self.spark, rows.join(touching, "call", "left_anti"), "effects")
                new = staged(self.spark, reply_rows(self.store.claims, kept.drop("call"), f"src:action/{action.name}"), "effects")
                if self.violated(new) is not None:
                    out.refused, out.detail = n, "the effects add violations of shapes"
                    return out
                refused = refused.unionByName(touching.withColumn("why", F.lit("its effects add violations of shapes")))
        out.refused = refused.count()
        why = [f"{r['why']} ({r['n']})" for r in refused.groupBy("why").agg(F.count("*").alias("n")).orderBy("why").collect()]
        out.detail = "; ".join(why) or None
        out.appended = new.count()
        self.store = self.store.add(new) if out.appended else self.store
        if self.hooks is not None and out.appended:  # once the rows are in the store, and for no change not at all
            self.hooks.run(action.name, {"automation": a.name}, new)
        return out

    def violated(self, new: DataFrame) -> DataFrame | None:
        """Violations that the rows would add, if any."""
        change = conform(new.withColumn("tx", F.concat(F.lit("f"), F.sha2("claim_key", 256))))
        added = staged(self.spark, shape.added(self.spark, self.store.claims, change), "violations")
        return added if added.limit(1).count() else None

    def hook(self, a: Automation, step: Step, found: DataFrame, n: int) -> Outcome:
        out = Outcome(a.name, f"hook/{step.name}", n)
        if self.hooks is None or step.name not in self.hooks.named:
            return out  # not configured: nothing is done, and nothing is wrong
        before = len(self.hooks.problems)
        self.hooks.run(step.name, {"automation": a.name}, found)
        failed = self.hooks.problems[before:]
        out.refused, out.detail = (n, "; ".join(str(e) for _, e in failed)) if failed else (0, None)
        return out

    def prompt(self, a: Automation, step: Step, found: DataFrame, n: int) -> Outcome:
        out = Outcome(a.name, step.name, n)
        if self.agent is None:
            return out
        replies: list[str] = []
        names = sorted((c for c in found.columns if c not in ("ids", "confs")), key=len, reverse=True)
        for r in found.toLocalIterator():
            text = step.name
            for v in names:
                text = re.sub(rf"\?{re.escape(v)}(?![\w-])", lambda _, v=v: str(r[v]).strip('"`'), text)
            try:
                replies.append(self.agent(text))
            except Exception as e:  # an agent is outside: it stops nothing
                out.refused, out.detail = out.refused + 1, str(e)
            if len(replies) >= REPLIES:
                out.appended += self.reply(a, replies)
                replies = []
        out.appended += self.reply(a, replies)
        return out

    def reply(self, a: Automation, replies: list[str]) -> int:
        from tenet.sources.text import claims_of

        text = "\n".join(r for r in replies if r.strip())
        if not text:
            return 0
        rows, _, _ = claims_of(self.spark, text, self.store.next_ms(), registry=self.store.registry())
        new = staged(self.spark, reply_rows(self.store.claims, rows.drop("id", "tx"), f"src:{a.subject}"), "replies")
        if n := new.count():
            self.store = self.store.add(new)
        return n

    def settle(self, passes: int = PASSES) -> Settled:
        fired: dict[str, int] = {}
        problems: list[str] = []
        n, moved, notes = 0, True, []
        while moved and n < passes:
            n, moved = n + 1, False
            if self.derive and rules.listed(self.store.claims)[0]:
                self.store, found = self.store.derive()
                moved = any(x.limit(1).count() for x in (found.append, found.retract))
                if not found.complete:
                    notes.append(f"derivation stopped at {found.passes} passes")
            automations, wrong = listed(self.store.claims)
            problems += [p for p in wrong if p not in problems]
            for a, since in automations:
                k = self.fire(a, since)
                fired[a.name] = fired.get(a.name, 0) + k
                moved = moved or k > 0
        if moved:
            notes.append(f"stopped at {passes} passes before it came to rest")
        return Settled(self.store, n, fired, self.outcomes, problems, notes)


def settle(store, hooks: Hooks | None = None, agent: Agent | None = None, ledger: Ledger | None = None, actions: dict[str, Action] | None = None, derive: bool = True, check: bool = True, passes: int = PASSES) -> Settled:
    """Derive and fire until nothing changes, at most so many passes."""
    return Engine(store, hooks, agent, ledger, actions, derive, check).settle(passes)

