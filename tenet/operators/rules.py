"""Rules: premises, constraints and a conclusion; derivation to a fixpoint with retractable results; actions and triggers.

A pass evaluates each rule set at a time: premises are DataFrames joined on shared variables. After the first pass a premise joins
what the last pass changed with everything for the other premises, each premise in turn, so no pass repeats an earlier one's work.
Support is recomputed from rows that no rule derived, so results whose reasons went, cycles included, are found by difference.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.functions.keys import claim_key, is_uuid7
from tenet.functions.values import number, rounded_confidence
from tenet.operators.belief import current
from tenet.operators.closure import written
from tenet.staging import delete, stage
from tenet.operators.registry import Registry
from tenet.plans.pattern import OPS as OPERATORS
from tenet.plans.pattern import Pattern, PatternError, is_variable, parse
from tenet.plans.query import OPS, Options, joined, rewritten
from tenet.schema import conform

PASSES, LEAST_CONF, SAME = 20, 0.05, 1e-9


@dataclass(frozen=True)
class Rule:
    name: str
    premises: tuple[Pattern, ...]
    constraints: tuple[tuple[str, str, str], ...]
    conclusion: Pattern
    conf: float = 1.0

    text: str = ""

    @property
    def subject(self) -> str:
        return f"rule/{self.name}"

    @property
    def source(self) -> str:
        return f"src:{self.subject}"


def parse_rule(text: str, conf: float = 1.0) -> Rule:
    """premise, premise, ?x op literal => conclusion"""
    if text.count("=>") != 1:
        raise PatternError("a rule has exactly one =>")
    left, right = (x.strip() for x in text.split("=>"))
    premises, constraints = [], []
    for part in (p.strip() for p in re.split(r",(?=(?:[^\"`]|\"[^\"]*\"|`[^`]*`)*$)", left)):
        m = re.fullmatch(r"\?([\w-]+)\s*(<=|>=|!=|=|<|>)\s*(.+)", part)
        if m:
            constraints.append((m[1], m[2], m[3].strip()))
        elif part:
            premises.append(parse(part))
    conclusion = parse(right)
    bound = {v for p in premises for v in p.variables}
    if not premises or conclusion.transitive:
        raise PatternError("a rule needs premises, and a conclusion of one hop")
    if missing := [v for v in [*conclusion.variables, *[c[0] for c in constraints]] if v not in bound]:
        raise PatternError(f"unbound in the premises: {missing}")
    return Rule(hashlib.sha256(text.strip().encode()).hexdigest()[:12], tuple(premises), tuple(constraints), conclusion, conf, text.strip())


def constrained(rows: DataFrame, constraints: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Numbers compare as numbers (in the literal's unit, if it has one); texts only by = and !=."""
    for var, op, literal in constraints:
        assert op in OPERATORS
        found = number(literal)
        if found:
            n, unit = found
            c = OPS[op](F.regexp_extract(F.col(var), r"^(-?\d+(?:\.\d+)?(?:[eE]-?\d+)?)", 1).try_cast("double"), F.lit(n))
            rows = rows.where(c if unit is None else c & F.col(var).endswith(unit))
        elif op in ("=", "!="):
            rows = rows.where(OPS[op](F.col(var), F.lit(literal.strip('"'))))
        else:
            raise PatternError(f"{literal} has no order")
    return rows


def term(slot: str) -> Column:
    return F.col(slot[1:]) if is_variable(slot) else F.lit(slot)


def concluded(rows: DataFrame, rule: Rule) -> DataFrame:
    """Conclusion rows, a key's strongest derivation alone; of equal ones that with the least premise ids."""
    c, conf = rule.conclusion, F.aggregate("confs", F.lit(float(rule.conf)), lambda a, x: a * x)
    literal = number(c.value) if c.value and not is_variable(c.value) else None
    value = None if c.value is None else term(c.value)
    out = rows.select(
        term(c.subject).alias("subject"),
        F.lit(c.verb).alias("verb"),
        F.lit(c.negated).alias("negated"),
        (term(c.obj) if c.obj is not None else F.lit(None).cast("string")).alias("object"),
        F.lit(c.attribute).cast("string").alias("attribute"),
        (value if value is not None else F.lit(None).cast("string")).alias("value_text"),
        (F.lit(literal[0]) if literal else F.lit(None) if value is None else value.try_cast("double")).cast("double").alias("value_num"),
        F.lit(literal[1] if literal else None).cast("string").alias("value_unit"),
        rounded_confidence(conf).alias("conf"),
        F.array(F.lit(rule.source), *[F.lit(x) for x in c.contexts]).alias("contexts"),
        F.array_sort("ids").alias("because"),
    ).where(F.col("conf") >= LEAST_CONF)
    out = out.withColumn("claim_key", claim_key())
    names = [x for x in out.columns if x != "claim_key"]
    best = out.groupBy("claim_key").agg(F.max_by(F.struct(*names), F.struct("conf", F.transform("because", lambda i: -F.xxhash64(i).bitwiseAND(F.lit(2**62))))).alias("r"))
    return best.select(*[F.col(f"r.{n}").alias(n) for n in names], "claim_key")


def evaluate(spark: SparkSession, claims: DataFrame, rule: Rule, options: Options | None = None) -> DataFrame:
    rows = joined(spark, claims, list(rule.premises), options)
    return concluded(constrained(rows, rule.constraints), rule)


def evaluate_changed(spark: SparkSession, claims: DataFrame, changed: DataFrame, verbs: set[str], rule: Rule) -> DataFrame | None:
    """Conclusions that rest on at least one changed row; changes have these verbs. None if no premise can match one."""
    r, out = Registry(), None
    if any(p.transitive for p in rule.premises):
        return evaluate(spark, claims, rule)  # a path may use any changed edge
    for i, p in enumerate(rule.premises):
        q = rewritten(p, r)
        if not is_variable(q.verb) and q.verb != "_" and q.verb not in verbs:
            continue
        rows = concluded(constrained(joined(spark, claims, list(rule.premises), each={i: changed}), rule.constraints), rule)
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class Derived:
    """rows: (claim columns, because), the strongest of each key. Not complete: the passes ended before the fixpoint."""

    rows: DataFrame
    complete: bool
    passes: int

    @property
    def note(self) -> str | None:
        return None if self.complete else f"stopped at {self.passes} passes before a fixpoint: nothing is retracted, and no mark is set"


def seen_as_claims(found: DataFrame) -> DataFrame:
    """Conclusions as rows that premises see; later than any base row, so their ids say what they are."""
    return conform(found.withColumn("tx", F.concat(F.lit("f"), F.sha2("claim_key", 256))))


def derive(spark: SparkSession, base: DataFrame, rules: list[Rule], passes: int = PASSES) -> Derived:
    """All conclusions from rows that no rule derived, at the fixpoint or after so many passes, whichever comes first.

    A pass joins what the last one added or strengthened; conclusions that it repeats change nothing. `passes` bounds programs
    whose numbers grow for ever: what they concluded is kept."""
    base = written(spark, base, "base")
    found, changed, verbs, n, parts = None, base, None, 0, []
    while n < passes:
        n += 1
        new = None
        seen = base if found is None else base.unionByName(seen_as_claims(found))
        for rule in rules:
            rows = evaluate(spark, seen, rule) if found is None else evaluate_changed(spark, seen, changed, verbs, rule)
            if rows is not None:
                new = rows if new is None else new.unionByName(rows)
        if new is None:
            return Derived(found, True, n)
        names = [c for c in new.columns if c != "claim_key"]
        best = new.groupBy("claim_key").agg(F.max_by(F.struct(*names), "conf").alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in names], "claim_key")
        if found is not None:  # only what is new, or stronger than it was
            was = found.select("claim_key", F.col("conf").alias("was"))
            best = best.join(was, "claim_key", "left").where(F.col("was").isNull() | (F.col("conf") > F.col("was") + SAME))
        else:
            best = best.withColumn("was", F.lit(None).cast("double"))
        path, step = stage(spark, best, "derived")
        if step.limit(1).count() == 0:
            return Derived(step.drop("was") if found is None else found, True, n)
        # A pass that strengthens nothing is one more part; else what it strengthens goes, and the parts are written anew as one.
        old = []
        if step.where("was is not null").limit(1).count():
            whole, _ = stage(spark, found.join(step.select("claim_key"), "claim_key", "left_anti").withColumn("was", F.lit(None).cast("double")), "derived")
            old, parts = parts, [whole]
        parts.append(path)
        found = spark.read.schema(step.schema).parquet(*parts).drop("was")
        delete(spark, *old)
        step = step.drop("was")
        changed, verbs = seen_as_claims(step), {r.conclusion.verb for r in rules}
    return Derived(found, False, n)


def derived(spark: SparkSession, base: DataFrame, rules: list[Rule], passes: int = PASSES) -> DataFrame:
    """The rows of `derive`."""
    return derive(spark, base, rules, passes).rows


def changes(spark: SparkSession, claims: DataFrame, rules: list[Rule], passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(to append, to retract): conclusions that are new or of another confidence, and earlier rule rows that lost support. Where the
    passes ended before the fixpoint nothing is retracted: support may yet be found."""
    of_rule = F.exists("contexts", lambda c: c.startswith("src:rule/"))
    found = derive(spark, claims.where(~of_rule), rules, passes)
    held = current(claims.where(of_rule)).where(F.col("conf") > 0)
    was = held.select("claim_key", F.col("conf").alias("was"))
    append = found.rows.join(was, "claim_key", "left").where(F.col("was").isNull() | (F.abs(F.col("conf") - F.col("was")) > SAME)).drop("was")
    lost = held.join(found.rows.select("claim_key"), "claim_key", "left_anti") if found.complete else held.limit(0)
    return append, lost.withColumn("conf", F.lit(0.0))


# --- rules as claims ---

#: Where declarations and marks come from, and the attributes that hold them.
DERIVE, RULE, MARK = "src:derive", "rule", "watermark"


def literal(text: str) -> str:
    """A text as a stored literal, in the delimiter that it has not."""
    for q in ("`", '"'):
        if q not in text:
            return f"{q}{text}{q}"
    raise ValueError("a text with both delimiters cannot be stored")


def attribute_rows(spark: SparkSession, rows: list[tuple[str, str, str]], source: str = DERIVE) -> DataFrame:
    """(subject, attribute, value text) as rows to append."""
    df = spark.createDataFrame(rows, "subject string, attribute string, value_text string")
    return df.withColumns({"verb": F.lit("HAS"), "contexts": F.array(F.lit(source))})


def declarations(claims: DataFrame, attribute: str = RULE) -> DataFrame:
    """Current positive declarations of an attribute: few by nature."""
    rows = current(claims.where((F.col("verb") == "HAS") & (F.col("attribute") == attribute)))
    return rows.where("conf > 0 and not negated and value_text is not null")


def declare(spark: SparkSession, claims: DataFrame, texts: list[str]) -> tuple[DataFrame, list[Rule]]:
    """(rows to append, the rules): one declaration for each rule that is not declared just so already."""
    rules = [parse_rule(t) for t in texts]
    held = {(r["subject"], r["value_text"]) for r in declarations(claims).select("subject", "value_text").collect()}
    new = [(r.subject, RULE, literal(r.text)) for r in rules if (r.subject, literal(r.text)) not in held]
    return attribute_rows(spark, new), rules


def listed(claims: DataFrame) -> tuple[list[Rule], list[str]]:
    """(rules, problems) of the current declarations in order of declaration; the same rule twice counts once."""
    rules: dict[str, Rule] = {}
    problems = []
    for r in declarations(claims).orderBy("tx").select("subject", "value_text").collect():
        try:
            rule = parse_rule(r["value_text"][1:-1])
            rules.setdefault(rule.name, rule)
        except PatternError as e:
            problems.append(f"{r['subject']}: {e}")
    return list(rules.values()), problems


def retracted(claims: DataFrame, name: str) -> DataFrame:
    """The rows that retract a rule, by its subject, digest, or a beginning of the digest that no other has: its declaration, and all
    that it derived but declarations of verbs, which others rest on."""
    held = declarations(claims)
    named = (F.col("subject") == name) | (F.col("subject") == f"rule/{name}")
    named = named | F.col("subject").startswith(f"rule/{name}") if len(name) >= 4 else named
    found = [r[0] for r in held.where(named).select("subject").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} current rule matches {name}")
    own = current(claims.where(F.array_contains("contexts", f"src:{found[0]}"))).where("conf > 0")
    lasting = F.col("verb").isin("REVERSE", "RENAMED-TO") | ((F.col("verb") == "IS") & F.coalesce(F.col("object") == "verb", F.lit(False)))
    return held.where(F.col("subject") == found[0]).unionByName(own.where(~lasting)).withColumn("conf", F.lit(0.0))


def marks(claims: DataFrame) -> dict[str, str]:
    """The mark of each declared rule up to which all rows are accounted for. One from before the rule's declaration does not count:
    its conclusions went with the earlier declaration."""
    declared = declarations(claims).groupBy("subject").agg(F.max("tx").alias("since"))
    held = declarations(claims, MARK).where(F.array_contains("contexts", DERIVE))
    both = held.select("subject", "tx", "value_text").join(declared, "subject").where("tx > since")
    return {r["subject"]: r["value_text"] for r in both.select("subject", "value_text").collect()}


def may_match(p: Pattern, registry: Registry) -> Column:
    """Can a row extend a match of this premise? Confidence and currency are left out, for a retraction changes conclusions, too."""
    q = rewritten(p, registry)
    c = F.col("negated") == (q.negated and not q.transitive)
    if not is_variable(q.verb) and q.verb != "_":
        c &= F.col("verb") == q.verb
    if q.transitive:
        return c & F.col("object").isNotNull()
    for column, slot in (("subject", q.subject), ("object", q.obj)):
        if slot and slot != "_" and not is_variable(slot):
            same = F.col(column) == slot
            c &= same if column == "subject" else same | (F.col("value_text") == slot)
    if q.attribute is not None:
        c &= F.col("attribute") == q.attribute
    for ctx in q.contexts:
        c &= F.array_contains("contexts", ctx)
    return F.coalesce(c, F.lit(False))


def due(claims: DataFrame, rules: list[Rule], marked: dict[str, str], registry: Registry | None = None) -> list[Rule]:
    """The rules that rows after their marks may concern, those without a mark included: one job for all."""
    r = registry or Registry()
    tests = []
    for rule in rules:
        hit = F.lit(False)
        for p in rule.premises:
            hit = hit | may_match(p, r)
        mark = marked.get(rule.subject)
        tests.append(F.coalesce(F.max(hit & (F.col("tx") > mark)), F.lit(False)) if mark else F.lit(True))
    if not tests:
        return []
    found = claims.agg(*[t.alias(f"r{i}") for i, t in enumerate(tests)]).first()
    return [rule for i, rule in enumerate(rules) if found[i]]


def mark_rows(spark: SparkSession, rules: list[Rule], tx: str) -> DataFrame:
    return attribute_rows(spark, [(r.subject, MARK, tx) for r in rules])


# --- triggers ---


#: Sources of the engine's own bookkeeping, which never trigger.
INFRASTRUCTURE = ("src:automate", DERIVE)


def is_event(mark: str, infrastructure: tuple[str, ...] = INFRASTRUCTURE, own: tuple[str, ...] = (), prefix: str = "") -> Column:
    """May a row trigger? It is later than the mark, a row of its own right, and from no infrastructure nor one of the trigger's own runs."""
    tx, contexts = F.col(f"{prefix}tx"), F.col(f"{prefix}contexts")
    barred = F.arrays_overlap(contexts, F.array(*[F.lit(x) for x in (*infrastructure, *own)]))
    return (tx > mark) & is_uuid7(tx) & ~F.coalesce(barred, F.lit(False))


def events_since(claims: DataFrame, mark: str, infrastructure: tuple[str, ...] = INFRASTRUCTURE, own: tuple[str, ...] = ()) -> DataFrame:
    """Rows that may trigger."""
    return claims.where(is_event(mark, infrastructure, own) & (F.col("conf") > 0))


def triggered(spark: SparkSession, claims: DataFrame, premises: list[str], mark: str, constraints: tuple = (), own: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    """Solutions of the premises that cite at least one event row: each premise in turn takes events alone, the others all rows.
    Events are the rows after the mark, or of those only the ones `among` (row_id)."""
    out = None
    for i, text in enumerate(premises):
        if (parse(text) if isinstance(text, str) else text).transitive:
            continue  # transitive premises cite no rows
        rows = joined(spark, claims, premises, only={i: is_event(mark, own=own, prefix="row_")}, among=None if among is None else {i: among})
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise PatternError("a trigger needs a premise of one hop")
    return constrained(out.dropDuplicates([c for c in out.columns if c != "confs"]), constraints)


def armed(claims: DataFrame, name: str, attribute: str = "automation") -> str | None:
    """Where a trigger's events begin: the later of its stored mark and its declaration; None if it isn't declared."""
    rows = claims.where(F.col("subject") == name)
    declared = declarations(rows, attribute).agg(F.max("tx")).first()[0]
    mark = declarations(rows, MARK).agg(F.max("value_text")).first()[0]
    return declared if declared is None or mark is None else max(declared, mark)


def fired(spark: SparkSession, name: str, tx: str) -> DataFrame:
    """The row that records a firing; it is appended before anything is done about it."""
    return attribute_rows(spark, [(name, MARK, tx)], "src:automate")


def reply_rows(claims: DataFrame, rows: DataFrame, source: str) -> DataFrame:
    """What an agent's reply adds: its rows, stamped, without those that are current just so already."""
    stamped = conform(rows.withColumn("contexts", F.array_union(F.coalesce("contexts", F.array().cast("array<string>")), F.array(F.lit(source)))).drop("claim_key"))
    now = current(claims).select("claim_key", F.col("conf").alias("was"), F.col("value_text").alias("had"))
    same = (F.abs(F.col("conf") - F.col("was")) < SAME) & F.col("value_text").eqNullSafe(F.col("had"))
    return stamped.join(now, "claim_key", "left").where(~F.coalesce(same, F.lit(False))).drop("was", "had").select(*stamped.columns)


# --- actions ---


@dataclass(frozen=True)
class Action:
    """A governed change: parameters, preconditions that must have exactly one binding, and effects."""

    name: str
    parameters: tuple[str, ...]
    preconditions: tuple[Pattern, ...]
    effects: tuple[Pattern, ...]


def parse_action(name: str, text: str) -> Action:
    left, _, right = text.partition("=>")
    parts = [p.strip() for p in left.split(",") if p.strip()]
    params = tuple(p[1:] for p in parts if re.fullmatch(r"\?[\w-]+", p))
    return Action(name, params, tuple(parse(p) for p in parts if not re.fullmatch(r"\?[\w-]+", p)), tuple(parse(p.strip()) for p in right.split(",")))


class Rejected(ValueError):
    """An action whose effects would violate expectations that hold now; `violations` has the new ones."""

    def __init__(self, violations: DataFrame):
        super().__init__("the effects add violations of shapes")
        self.violations = violations


def governed(spark: SparkSession, claims: DataFrame, action: Action, arguments: dict[str, str], tx: str | None = None) -> DataFrame:
    """The action's rows that change anything, after the gate: Rejected if they add a violation. Hooks are the caller's to run, once
    it has the rows in its store: see `tenet.store.Store.act`."""
    from tenet.operators import shape

    rows = act(spark, claims, action, arguments)
    new = reply_rows(claims, rows, f"src:action/{action.name}")
    added = shape.added(spark, claims, conform(new.withColumn("tx", F.lit(tx or "f" + "0" * 8))))
    if added.limit(1).count():
        raise Rejected(added)
    return new


def act(spark: SparkSession, claims: DataFrame, action: Action, arguments: dict[str, str]) -> DataFrame:
    """The rows that the action would append. Raises unless its preconditions have exactly one binding."""
    if set(arguments) != set(action.parameters):
        raise ValueError(f"{action.name} takes {action.parameters}")

    def put(p: Pattern) -> Pattern:
        swap = lambda s: arguments[s[1:]] if s and is_variable(s) and s[1:] in arguments else s
        return replace(p, subject=swap(p.subject), obj=swap(p.obj), value=swap(p.value))

    bindings = [{}]
    if action.preconditions:
        rows = joined(spark, claims, [put(p) for p in action.preconditions]).drop("ids", "confs").distinct().limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{action.name}: {'no' if not rows else 'more than one'} binding of its preconditions")
        bindings = [r.asDict() for r in rows]
    values = bindings[0] | arguments
    out = []
    for p in map(put, action.effects):
        fill = lambda s: values[s[1:]] if s and is_variable(s) else s
        found = number(fill(p.value)) if p.value else None
        out.append((fill(p.subject), p.verb, p.negated, fill(p.obj), p.attribute, fill(p.value), found[0] if found else None, found[1] if found else None, [f"src:action/{action.name}", *p.contexts]))
    schema = "subject string, verb string, negated boolean, object string, attribute string, value_text string, value_num double, value_unit string, contexts array<string>"
    return spark.createDataFrame(out, schema)
