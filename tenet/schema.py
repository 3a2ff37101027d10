"""The shape of a claims table: one row for each appended assertion, side tables held as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
CLAIM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("tx", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("verb", T.StringType()),
        T.StructField("negated", T.BooleanType()),
        T.StructField("object", T.StringType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("value_text", T.StringType()),
        T.StructField("value_num", T.DoubleType()),
        T.StructField("value_unit", T.StringType()),
        T.StructField("value_approx", T.BooleanType()),
        T.StructField("traj_from", T.DoubleType()),
        T.StructField("traj_to", T.DoubleType()),
        T.StructField("delta_num", T.DoubleType()),
        T.StructField("delta_unit", T.StringType()),
        T.StructField("sigma_level", T.DoubleType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("importance", T.BooleanType()),
        T.StructField("comment", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(TAG)),
        T.StructField("claim_key", T.StringType()),
    ]
)
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("parent_id", "role", "child_id")])
DEFAULTS = {"negated": False, "value_approx": False, "sigma_level": 2.0, "conf": 1.0, "importance": False}


def conform(df: DataFrame) -> DataFrame:
    """df with all columns of a claims table, in order; missing ones take their default. Arrays become empty, not null."""
    have, out = set(df.columns), []
    for f in CLAIM.fields:
        if f.name in ("contexts", "tags"):
            empty = F.array().cast(f.dataType)
            c = F.coalesce(F.col(f.name).cast(f.dataType), empty) if f.name in have else empty
        elif f.name in have:
            c = F.col(f.name).cast(f.dataType)
        elif f.name == "claim_key":
            from tenet.functions.keys import claim_key

            c = claim_key()
        elif f.name == "id":
            c = F.col("tx") if "tx" in have else F.lit(None).cast("string")
        else:
            c = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def tag(key: str, value: Column | str | None = None) -> Column:
    v = value if isinstance(value, Column) else F.lit(value).cast("string")
    return F.struct(F.lit(key).alias("key"), v.alias("value"))
