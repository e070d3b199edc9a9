"""Stored descriptor records and timing metrics as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.functions.scalars import safe_double
from molframe.sources.text import to_int

META = "charge int, spin int, fragments int, n_basis int, n_points bigint, status string"


def parse_results(docs: DataFrame, suffix: str = "vector") -> DataFrame:
    """``(mol_id, readable, snci, scdi, scdi_variance, f, fragments)``; bad JSON is kept as unreadable.

    The vector is the array whose key ends in ``suffix``, so records of other writers can be read too.
    """
    body = F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"})
    vector = F.get(F.map_values(F.map_filter("_m", lambda k, v: k.endswith(suffix))), F.lit(0))
    number = lambda name: safe_double(F.try_element_at("_m", F.lit(name)))
    return (
        docs.withColumn("_m", body)
        .withColumn("_ok", F.col("_m").isNotNull() & F.trim("text").endswith("}"))
        .select(
            "mol_id",
            F.col("_ok").alias("readable"),
            number("SNCI").alias("snci"),
            number("SCDI").alias("scdi"),
            number("SCDI_variance").alias("scdi_variance"),
            F.from_json(vector, "array<double>").alias("f"),
            F.from_json(F.try_element_at("_m", F.lit("metadata")), META)["fragments"].alias("fragments"),
        )
        .select(
            "mol_id",
            "readable",
            *[
                F.when(F.col("readable"), F.col(c)).alias(c)
                for c in ("snci", "scdi", "scdi_variance", "f", "fragments")
            ],
        )
    )


def parse_batches(docs: DataFrame, suffix: str = "vector") -> DataFrame:
    """``(file, entry, mol_id, status, error, readable, snci, scdi, scdi_variance, f)`` of stored batches, a row per record.

    ``docs`` holds ``(file, text)``, a text being one object with a ``records`` array. The text is parsed once, as a
    variant, and its records leave it as rows before any field is taken. A text that is no such object gives one failed
    row without an entry; a record that is no object, or names no molecule, gives a failed row of its own.
    """
    body = F.try_parse_json("text")
    listed = docs.select("file", F.try_variant_get(body, "$.records", "array<variant>").alias("_all"))
    rows = listed.select("file", F.col("_all").isNull().alias("_bad"), F.posexplode_outer("_all").alias("entry", "_v"))
    rows = rows.filter("_bad or entry is not null")
    part = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    fields = F.try_variant_get("_v", "$", "map<string,variant>")
    vector = F.get(F.map_values(F.map_filter(fields, lambda k, v: k.endswith(suffix))), F.lit(0))
    named = F.coalesce(part("input_file", "string") != "", F.lit(False))
    problem = F.when(F.col("_bad"), "unreadable batch").when(fields.isNull(), "unreadable record").when(~named, "record without a molecule")
    stated = F.coalesce(part("status", "string"), F.lit("failed"))
    given = lambda c: F.when(problem.isNull(), c)
    return rows.select(
        "file",
        "entry",
        given(part("input_file", "string")).alias("mol_id"),
        F.when(problem.isNull(), stated).otherwise("failed").alias("status"),
        F.coalesce(problem, part("error", "string")).alias("error"),
        problem.isNull().alias("readable"),
        *[given(safe_double(part(name, "string"))).alias(name.lower()) for name in ("SNCI", "SCDI", "SCDI_variance")],
        given(F.try_variant_get(vector, "$", "array<double>")).alias("f"),
    )


def parse_timings(docs: DataFrame) -> DataFrame:
    """``(file, modified, setting, seconds)`` from metrics keyed by worker count; a bad file gives no row.

    ``docs`` as ``read_documents`` gives them; without ``modified`` it is null.
    """
    modified = F.col("modified") if "modified" in docs.columns else F.lit(None).cast("timestamp")
    entry = "batch_workers_monitor map<string, struct<wall_time_sec: double>>"
    body = F.from_json("text", entry)["batch_workers_monitor"]
    return docs.select(F.col("mol_id").alias("file"), modified.alias("modified"), F.explode(body).alias("_k", "_v")).select(
        "file",
        "modified",
        to_int(F.col("_k")).alias("setting"),
        F.coalesce("_v.wall_time_sec", F.lit(0.0)).alias("seconds"),
    )
