"""JSON of any depth as rows: every member of every object and array, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.shared import cut

CONTAINER = r"^(?:OBJECT|ARRAY)<"
#: What a JSON text that offers links holds at the start of a string.
LINK_START = r"(?i)^(?:https?://|//|/|\.\.?/)"


def containers(v: Column) -> Column:
    return F.schema_of_variant(v).rlike(CONTAINER)


def members(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, parent, name, value): the whole of each row's variant (no parent, no name) and all that lies in it.

    ``parent`` is the object or array that holds the member and ``name`` its key (null in arrays). Only members that hold
    others go on to the next level, so there is one round for each level of depth. A null variant has no members.
    """
    level = cut(rows.select(*by, F.lit(None).cast("variant").alias("parent"), F.lit(None).cast("string").alias("name"), value.alias("value")).where("value is not null"))
    out = level
    while True:
        holders = level.where(containers(F.col("value"))).select(*by, F.col("value").alias("holder"))
        inner = holders.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("holder").outer()))
        level = cut(inner.select(*by, F.col("holder").alias("parent"), F.col("key").alias("name"), "value"))
        if not level.take(1):
            return out
        out = out.unionByName(level)


def text(v: Column) -> Column:
    """A member that is a string; null if it is something else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def json_links(rows: DataFrame, by: list[str], json: Column) -> DataFrame:
    """(by, link): distinct strings anywhere in JSON texts that look like URLs or paths. A text that is no JSON has none."""
    found = members(rows, by, F.try_parse_json(json)).select(*by, text(F.col("value")).alias("link"))
    return found.where(F.col("link").rlike(LINK_START)).distinct()
