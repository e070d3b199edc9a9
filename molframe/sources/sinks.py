"""Writers. Tables are the primary store; text forms follow the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.scalars import from_bohr


def write_descriptors(records: DataFrame, path: str, replace: bool = False) -> None:
    """Parquet partitioned by solvent variant; ``replace`` overwrites the variants present in ``records``."""
    writer = records.write.partitionBy("solvent")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def record_json(keys: tuple[str, ...] = ("mol_id", "solvent")) -> Column:
    """One descriptor record as JSON text, absent values written as null."""
    body = F.struct(
        F.col("snci").alias("SNCI"),
        F.col("scdi").alias("SCDI"),
        F.col("scdi_variance").alias("SCDI_variance"),
        F.col("f").alias("vector"),
        F.col("meta").alias("metadata"),
        *keys,
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def write_record_json(records: DataFrame, path: str) -> None:
    records.select("solvent", record_json().alias("value")).write.mode("overwrite").partitionBy(
        "solvent"
    ).text(path)


def batch_table(records: DataFrame) -> DataFrame:
    """The batch sheet ``File, f1..f9, SNCI, SCDI, SCDI_variance, SNCI_Norm, SCDI_Norm``, by input path."""
    names = {"snci": "SNCI", "scdi": "SCDI", "scdi_variance": "SCDI_variance",
             "snci_norm": "SNCI_Norm", "scdi_norm": "SCDI_Norm"}
    return records.orderBy("mol_id").select(
        F.element_at(F.split("mol_id", "/"), -1).alias("File"),
        *[F.get("f", F.lit(i)).alias(f"f{i + 1}") for i in range(9)],
        *[F.col(c).alias(n) for c, n in names.items()],
    )


def write_batch_csv(records: DataFrame, path: str) -> None:
    batch_table(records).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_batch_json(records: DataFrame, summary: DataFrame, path: str) -> None:
    """``records`` and ``summary`` as JSON lines; a batch of any size, no nesting of the whole."""
    stamped = summary.select(
        F.lit(1).alias("schema_version"), F.current_timestamp().alias("generated_at_utc"), "*"
    )
    stamped.write.mode("overwrite").json(f"{path}/summary", ignoreNullFields=False)
    records.orderBy("mol_id").write.mode("overwrite").json(f"{path}/records", ignoreNullFields=False)


def write_quadrants(labelled: DataFrame, tally: DataFrame, head: DataFrame, path: str) -> None:
    """Medians and source as one row, counts as one small table, the file list of each quadrant as its own partition."""
    head.coalesce(1).write.mode("overwrite").json(f"{path}/head", ignoreNullFields=False)
    tally.coalesce(1).write.mode("overwrite").json(f"{path}/counts")
    files = labelled.filter("quadrant is not null").select(
        "quadrant", F.element_at(F.split("mol_id", "/"), -1).alias("file")
    )
    files.write.mode("overwrite").partitionBy("quadrant").json(f"{path}/files")


def write_delta(delta: DataFrame, path: str) -> None:
    delta.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_field(field: DataFrame, path: str, unit: str = "bohr") -> None:
    """``x y z sl2rho rdg`` as Parquet, coordinates in ``unit``."""
    place = [from_bohr(F.col(c), unit).alias(c) for c in "xyz"]
    field.select("mol_id", "ix", "iy", "iz", *place, "sl2rho", "rdg").write.mode("overwrite").parquet(path)


def field_lines(field: DataFrame, unit: str = "bohr") -> DataFrame:
    """``(mol_id, value)``: fixed-format text rows in grid order."""
    place = [from_bohr(F.col(c), unit) for c in "xyz"]
    text = F.format_string("%.8f %.8f %.8f %.10e %.10e", *place, F.col("sl2rho"), F.col("rdg"))
    return field.orderBy("mol_id", "ix", "iy", "iz").select("mol_id", text.alias("value"))


def write_field_text(field: DataFrame, path: str, unit: str = "bohr") -> None:
    """One folder of text per molecule."""
    field_lines(field, unit).write.mode("overwrite").partitionBy("mol_id").text(path)


def write_agreement(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
