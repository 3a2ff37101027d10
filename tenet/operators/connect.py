"""Records to claims: templates, the incremental pass, and reads that store nothing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenet.functions.values import value_columns
from tenet.operators.belief import current
from tenet.plans.pattern import Pattern, is_variable, parse
from tenet.schema import conform


def parse_template(text: str) -> list[Pattern]:
    """Claim lines with ?fields as whole terms; @ctx, #tag and fields in them stay as they are."""
    return [parse(line) for line in text.strip().splitlines() if line.strip() and not line.strip().startswith(";")]


def field_of(name: str, columns: Sequence[str]) -> Column:
    """A field, nested ones by a dot path."""
    head = name.split(".")[0]
    if head not in columns:
        return F.lit(None).cast("string")
    return F.col(name).cast("string")


def term(slot: str | None, columns: Sequence[str], entity: bool = True) -> Column:
    if slot is None:
        return F.lit(None).cast("string")
    if not is_variable(slot):
        m = re.fullmatch(r"(.*/)\?([\w.-]+)", slot)
        if m:
            return F.concat(F.lit(m[1]), F.regexp_replace(F.trim(field_of(m[2], columns)), r"\s+", "-"))
        return F.lit(slot)
    c = field_of(slot[1:], columns)
    return F.regexp_replace(F.trim(c), r"\s+", "-") if entity else c


def mapped(records: DataFrame, template: list[Pattern], source: str, key: Sequence[str]) -> DataFrame:
    """Claims of every record and line; a line with a missing field is left out. `record` is the digest of the record's key.

    Each line is a struct of columns, so a record is read once for all lines."""
    columns, lines = records.columns, []
    for p in template:
        subject, obj, value = term(p.subject, columns), term(p.obj, columns), term(p.value, columns, entity=False)
        parts = value_columns(value)
        present = subject.isNotNull() & (obj.isNotNull() if p.obj is not None else F.lit(True)) & ((value.isNotNull() & (value != "")) if p.value is not None else F.lit(True))
        lines.append(
            F.when(
                present & (subject != ""),
                F.struct(
                    subject.alias("subject"), F.lit(p.verb).alias("verb"), F.lit(p.negated).alias("negated"), obj.alias("object"), F.lit(p.attribute).cast("string").alias("attribute"),
                    value.alias("value_text"), parts["value_num"].alias("value_num"), parts["value_unit"].alias("value_unit"),
                    F.array(F.lit(f"src:{source}"), *[F.lit(c) for c in p.contexts]).alias("contexts"),
                ),
            )
        )
    digest = F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12)
    record = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return records.select(record.alias("record"), digest.alias("digest"), F.explode(F.array_compact(F.array(*lines))).alias("c")).select("record", "digest", "c.*")


def incremental(claims: DataFrame, new: DataFrame, known: DataFrame, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to append, to retract). Unchanged records (record, digest in `known`) are skipped; of changed ones, and with prune of those
    that are gone, the current claims of `claims` (with a `record` column) that no longer follow are retracted."""
    changed = new.join(known.select("record", "digest"), ["record", "digest"], "left_anti")
    append = conform(changed.drop("record", "digest"))
    ids = changed.select("record").distinct()
    held = claims.join(ids, "record", "left_semi")
    if prune:
        held = held.union(claims.join(new.select("record").distinct(), "record", "left_anti"))
    keys = conform(new.drop("record", "digest")).select("claim_key")
    stale = current(held.drop("record")).where("conf > 0").join(keys, "claim_key", "left_anti")
    return append, stale.withColumn("conf", F.lit(0.0))


def federated(spark: SparkSession, claims: DataFrame, records: DataFrame, template: list[Pattern], source: str, key: Sequence[str], text: str, options=None) -> DataFrame:
    """A query over the claims and a source's claims together; nothing is written."""
    from tenet.plans.query import query

    overlay = conform(mapped(records, template, source, key).drop("record", "digest").withColumn("tx", F.concat(F.lit("f"), F.sha2(F.concat_ws("|", "subject", "verb", "attribute", "object"), 256))))
    return query(spark, claims.unionByName(overlay), text, options)
