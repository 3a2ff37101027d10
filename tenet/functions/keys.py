"""Identity: claim keys, group keys and time-ordered ids, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters that JSON writes as a backslash and a letter, and the letters.
SHORT, LETTERS = '\b\f\n\r\t"\\', 'bfnrt"\\'


def json_text(c: Column) -> Column:
    """A string as JSON writes it: quotes, backslashes and control characters escaped. Most strings need nothing."""
    def one(x: Column) -> Column:
        short = F.concat(F.lit("\\"), F.translate(x, SHORT, LETTERS))
        return F.when(x.rlike(r'[\x08\f\n\r\t"\\]'), short).when(x < " ", F.format_string("\\u%04x", F.ascii(x))).otherwise(x)

    inner = F.when(c.rlike(r'[\x00-\x1f"\\]'), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)
    return F.concat(F.lit('"'), inner, F.lit('"'))


def term_kind(c: Column) -> Column:
    """entity, text or code by the delimiters that a stored term keeps."""
    long = F.length(c) >= 2
    return F.when(long & c.startswith('"') & c.endswith('"'), "text").when(long & c.startswith("`") & c.endswith("`"), "code").otherwise("entity")


def is_entity(c: Column) -> Column:
    return term_kind(c) == "entity"


def bare(c: Column) -> Column:
    return F.when(is_entity(c), c).otherwise(F.substring(c, F.lit(2), F.length(c) - 2))


def tagged(c: Column) -> Column:
    """A term with the letter of its kind, as keys hold it."""
    kind = term_kind(c)
    return F.concat(F.when(kind == "entity", "e:").when(kind == "text", "text:").otherwise("code:"), bare(c))


def key_of(contexts: Column) -> Column:
    """The claim key over the columns of a claims table: identity leaves out value, confidence and tags."""
    payload = F.when(F.col("attribute").isNotNull(), F.concat(F.lit("a:"), F.col("attribute"))).when(F.col("object").isNotNull(), F.concat(F.lit("r:"), tagged(F.col("object"))))
    payload = payload.when(F.col("value_text").isNotNull() | F.col("value_num").isNotNull(), "m").otherwise("n")
    held = F.transform(F.array_sort(F.array_distinct(contexts)), json_text)
    parts = [json_text(tagged(F.col("subject"))), json_text(F.col("verb")), F.when(F.col("negated"), "1").otherwise("0"), json_text(payload), F.concat(F.lit("["), F.array_join(held, ","), F.lit("]"))]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def claim_key() -> Column:
    return key_of(F.col("contexts"))


def other_contexts(contexts: Column) -> Column:
    """The contexts that name no source."""
    return F.filter(contexts, lambda c: ~c.startswith("src:"))


def group_key(subject: Column | None = None, obj: Column | None = None) -> Column:
    """The contested group: the claim key without polarity and without source contexts. Other names may stand for its ends."""
    subject, obj = F.col("subject") if subject is None else subject, F.col("object") if obj is None else obj
    payload = F.when(F.col("attribute").isNotNull(), F.concat(F.lit("a:"), F.col("attribute"))).when(F.col("object").isNotNull(), F.concat(F.lit("r:"), obj)).otherwise("m")
    return F.concat_ws("\x1f", subject, F.col("verb"), payload, F.array_join(F.array_sort(F.array_distinct(other_contexts(F.col("contexts")))), "\x1e"))


def uuid7(ms: Column, low: Column) -> Column:
    """A time-ordered id of milliseconds and a number that orders ids of the same millisecond."""
    h, tail = F.lpad(F.lower(F.hex(ms.cast("long"))), 12, "0"), F.lpad(F.lower(F.hex(low.cast("long"))), 12, "0")
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-7000-8000-"), tail)


def uuid7_ms(tx: Column) -> Column:
    return F.conv(F.regexp_replace(F.substring(tx, 1, 13), "-", ""), 16, 10).cast("long")


#: The form of a time-ordered id.
UUID7 = "[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


def is_uuid7(tx: Column) -> Column:
    return tx.rlike(f"^{UUID7}$")


def tx_bound(ms: int) -> str:
    """The least id of a millisecond: ids compare as text."""
    h = f"{ms:012x}"
    return f"{h[:8]}-{h[8:]}-7000-8000-000000000000"


def py_key(subject: str, verb: str, negated: bool, payload: str, contexts: list[str]) -> str:
    """The driver's twin of `claim_key`, for tests and rules; payload as keys hold it."""
    return json.dumps([subject, verb, int(negated), payload, sorted(set(contexts))], ensure_ascii=False, separators=(",", ":"))
