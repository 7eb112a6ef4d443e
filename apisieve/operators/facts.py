"""The fact table: one row for each event of a source, in source order.

``args`` holds the effective arguments. Columns that an event has no use for are null,
and null never proves anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARG = "struct<static_string:string,object:map<string,string>,rooted_chain:string,known:boolean>"
COLUMNS = {
    "path": "string", "fact_id": "bigint", "start": "bigint", "end": "bigint", "function_id": "bigint", "kind": "string", "name": "string", "proof": "string",
    "module": "string", "rooted_chain": "string", "syntactic_path": "string", "member": "string", "producer": "string", "class_module": "string", "class_export": "string",
    "text": "string", "role": "string", "receiver": "bigint", "result": "bigint", "args": f"array<{ARG}>", "definite": "boolean",
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def complete(df: DataFrame) -> DataFrame:
    """Adds the fact columns that ``df`` lacks, as nulls, and puts them in order."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def events_as_facts(events: DataFrame) -> DataFrame:
    """An ordered event table as facts: the event type is the global that is called,
    the user the object it is called on, ``props.k`` the first argument."""
    k = F.get_json_object("props", "$.k")
    arg = F.struct(k.alias("static_string"), F.from_json("props", "map<string,string>").alias("object"), F.lit(None).cast("string").alias("rooted_chain"), F.lit(True).alias("known"))
    return complete(
        events.select(
            F.lit("events").alias("path"),
            F.col("event_id").alias("fact_id"),
            F.col("event_id").alias("start"),
            (F.col("event_id") + 1).alias("end"),
            F.lit("call").alias("kind"),
            F.col("event_type").alias("name"),
            F.lit("global").alias("proof"),
            F.col("user_id").alias("receiver"),
            F.array(arg).alias("args"),
            F.lit(True).alias("definite"),
        )
    )
