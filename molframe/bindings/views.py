"""The given tables seen as molecular inputs.

Each view is one SQL text that Spark and DuckDB both run, so a query and its check start from the same
rows. ``{name}`` stands for a table or for another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molframe.session import materialise, task_count, written

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

VIEWS: dict[str, str] = {}

# --- molecules: an order is a molecule, its line numbers are atoms -----------------------------------

VIEWS["raw_atoms"] = """
SELECT l_orderkey AS mol_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_discount, l_tax) - 1 AS INT) AS atom, l_partkey AS pk,
       l_quantity / 5e0 AS x, l_discount * 30e0 AS y, l_tax * 30e0 AS z
FROM {lineitem}"""

VIEWS["atoms"] = """
SELECT mol_id, atom, CASE pk % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'O' WHEN 2 THEN 'N' ELSE 'C' END AS el,
       CASE pk % 4 WHEN 0 THEN 1008e-3 WHEN 1 THEN 15999e-3 WHEN 2 THEN 14007e-3 ELSE 12011e-3 END AS mass,
       x, y, z
FROM {raw_atoms}"""

VIEWS["bonds"] = """
SELECT a.mol_id AS mol_id, a.atom AS a, b.atom AS b
FROM {raw_atoms} a JOIN {raw_atoms} b ON a.mol_id = b.mol_id AND b.atom = a.atom + 1
WHERE (a.pk + b.pk) % 3 <> 0"""

# Large molecules: the line items of a nation's suppliers, thousands of atoms each.
VIEWS["large_atoms"] = """
SELECT s_nationkey AS mol_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY l_orderkey, l_linenumber,
         l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS INT) AS atom, l_partkey AS pk,
       CASE l_partkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'O' WHEN 2 THEN 'N' ELSE 'C' END AS el,
       CASE l_partkey % 4 WHEN 0 THEN 1008e-3 WHEN 1 THEN 15999e-3 WHEN 2 THEN 14007e-3 ELSE 12011e-3 END AS mass,
       l_quantity / 5e0 AS x, l_discount * 30e0 AS y, l_tax * 30e0 AS z
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey"""

VIEWS["large_bonds"] = """
SELECT mol_id, atom - 1 AS a, atom AS b
FROM (SELECT mol_id, atom, pk + lag(pk) OVER (PARTITION BY mol_id ORDER BY atom) AS s FROM {large_atoms})
WHERE s % 3 <> 0"""

VIEWS["wbo"] = """
SELECT l_orderkey AS mol_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_discount, l_tax) - 1 AS INT) AS i, CAST(l_partkey % 7 AS INT) AS j,
       CAST((l_partkey * 7 + l_suppkey * 13) % 1000 AS DOUBLE) / 1e3 AS wbo
FROM {lineitem}"""

# --- surfaces and signed densities ------------------------------------------------------------------

VIEWS["weighted"] = """
SELECT l_partkey AS mol_id, l_quantity - 2e0 AS area, l_discount - l_tax AS charge FROM {lineitem}"""

VIEWS["segments"] = """
SELECT l_partkey AS mol_id, 1e0 AS v0, 2e0 AS v1, 3e0 AS v2, 4e0 AS v3, 5e0 AS v4,
       CASE l_partkey % 3 WHEN 0 THEN l_discount - l_tax WHEN 1 THEN l_quantity ELSE l_tax - 5e-2 END AS v5,
       CASE l_partkey % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_discount - l_tax ELSE l_discount - 5e-2 END AS v6,
       CASE l_partkey % 3 WHEN 0 THEN l_tax - 4e-2 WHEN 1 THEN l_tax - 4e-2 ELSE l_quantity / 1e1 END AS v7
FROM {lineitem}"""

VIEWS["signed"] = """
SELECT l_suppkey AS mol_id, CAST(l_linenumber AS DOUBLE) * 5e-1 AS x, l_quantity * 25e-2 AS y,
       l_tax * 1e1 AS z, l_discount - l_tax AS sl2rho
FROM {lineitem}"""

# --- a batch: orders are runs, those with line items have a result -----------------------------------

VIEWS["runs"] = """
SELECT o_orderkey AS mol_id,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'stopped' END AS status,
       CASE o_orderstatus WHEN 'O' THEN 'solver error' END AS error,
       o_totalprice / 1e3 AS elapsed_seconds, o_orderpriority AS lane
FROM {orders}"""

VIEWS["results"] = """
SELECT l_orderkey AS mol_id, max(l_partkey) % 9 <> 0 AS readable, max(l_quantity) AS snci
FROM {lineitem} GROUP BY l_orderkey"""

VIEWS["records"] = """
SELECT l_partkey AS mol_id, CASE WHEN l_partkey % 10 = 9 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN l_partkey % 17 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE sum(CASE WHEN l_discount < l_tax THEN (l_tax - l_discount) * l_quantity ELSE 0e0 END) END AS snci,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE avg(l_discount) * 1e1 END AS scdi,
       sum(l_quantity * l_tax) / sum(l_quantity) AS scdi_variance
FROM {lineitem} GROUP BY l_partkey"""

VIEWS["vectors"] = """
SELECT l_partkey AS mol_id, min(l_quantity) AS f1, min(l_discount) AS f2, min(l_tax) AS f3, max(l_quantity) AS f4,
       max(l_discount) AS f5, CAST(count(*) AS DOUBLE) AS f6, max(l_tax) AS f7, max(l_extendedprice) AS f8,
       CAST(max(l_orderkey) AS DOUBLE) AS f9
FROM {lineitem} GROUP BY l_partkey"""

# The second run's keys are moved, so that both ends are one-sided and no row is left out.
VIEWS["variant"] = """
SELECT l_suppkey * 3 + l_partkey % 3 + CASE l_linestatus WHEN 'O' THEN 30 ELSE 0 END AS mol_id, l_linestatus AS run, max(l_shipdate) AS seen,
       sum(l_discount) AS "snci", avg(l_tax) AS "scdi", min(l_tax + l_discount) AS "scdi_variance",
       min(l_quantity) AS f1, max(l_quantity) AS f2, avg(l_quantity) AS f3, avg(l_discount) AS f4,
       sum(l_tax) AS f5, CAST(count(*) AS DOUBLE) AS f6, min(l_extendedprice) AS f7,
       max(l_extendedprice) AS f8, avg(l_extendedprice) AS f9,
       max(l_tax) AS "snci_norm", max(l_discount) AS "scdi_norm"
FROM {lineitem}
GROUP BY l_suppkey * 3 + l_partkey % 3 + CASE l_linestatus WHEN 'O' THEN 30 ELSE 0 END, l_linestatus""".replace('"', "")

VIEWS["timing"] = """
SELECT event_type AS method, event_type AS file, ts AS modified, user_id AS setting,
       CASE WHEN event_id % 50 = 0 THEN 0e0 ELSE value END AS seconds, CAST(event_id % 1000 AS DOUBLE) AS points
FROM {events}"""

# --- grids ------------------------------------------------------------------------------------------

VIEWS["grid"] = """
SELECT CAST(floor(p_partkey / 125) AS BIGINT) AS mol_id, CAST(floor((p_partkey % 125) / 25) AS INT) AS ix,
       CAST(floor((p_partkey % 25) / 5) AS INT) AS iy, CAST(p_partkey % 5 AS INT) AS iz,
       p_size * p_retailprice / 1e5 AS rho, 5e-1 AS h
FROM {part}"""

VIEWS["field"] = """
SELECT mol_id, ix, iy, iz, ix * 5e-1 + 1e-1 AS x, iy * 4e-1 - 3e-1 AS y, iz * 3e-1 AS z,
       rho - 25e-2 AS sl2rho, rho * 3e0 AS rdg
FROM {grid}"""

VIEWS["hessian"] = """
SELECT l_orderkey AS mol_id, l_linenumber AS line, l_partkey, l_suppkey, l_quantity - 25e0 AS hxx, l_tax * 1e2 AS hyy,
       l_discount * 1e2 AS hzz, l_tax * 3e1 - l_discount * 2e1 AS hxy, l_quantity * l_tax AS hxz,
       l_discount * 4e1 - 3e0 AS hyz
FROM {lineitem}"""

VIEWS["pairs"] = """
SELECT (l_discount - l_tax) * l_quantity / 5e1 AS sl2_ref,
       (l_discount - l_tax) * l_quantity / 5e1 + (p_size - 25) / 1e4 AS sl2_pred,
       l_extendedprice / 2e4 AS rdg_ref, l_quantity * p_retailprice / 2e4 AS rdg_pred
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

# --- texts: a part is a file ------------------------------------------------------------------------

_FIXED = "lpad(CAST({} AS STRING) || '.' || lpad(CAST({} AS STRING), 4, '0'), 10, ' ')"


def _mol_atom(number: str, element: str) -> str:
    place = [_FIXED.format(f"(p_size + {number}) % 50", f"(p_partkey * {k} + {number}) % 10000") for k in (1, 3, 7)]
    return f"{' || '.join(place)} || ' {element:<3}0  0' || chr(10)"


VIEWS["mol_docs"] = f"""
SELECT p_partkey AS mol_id, p_name || chr(10) || '  made' || chr(10) || chr(10)
       || CASE WHEN p_partkey % 11 = 0 THEN ' xx' ELSE '  3' END || '  2  0  0 V2000' || chr(10)
       || {_mol_atom("1", "O")} || {_mol_atom("2", "H")} || {_mol_atom("3", "Cl")}
       || '  1  2  1  0' || chr(10) || '  3  1  1  0' || chr(10) || 'M  END' || chr(10) || '$$$$' || chr(10)
       || 'second record' || chr(10) AS text
FROM {{part}}"""

VIEWS["log_docs"] = """
SELECT p_partkey AS mol_id, 'start' || chr(10)
  || CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN ' molecular dipole:' || chr(10) || '    x   y   z   tot (Debye)' || chr(10)
       || CASE p_partkey % 5 WHEN 0 THEN '   full:  1.0  2.0  3.0   ' || CAST(p_size AS STRING) || '.25' || chr(10)
                             WHEN 1 THEN '   full:  1.0  2.0  3.0   n/a' || chr(10)
                             ELSE repeat('  -' || chr(10), 8) || '   full: 9.5' || chr(10) END
     ELSE '' END
  || CASE WHEN p_partkey % 5 = 1 THEN 'molecular dipole:' || chr(10) || '  q only: 7.5' || chr(10)
       || '   full: ' || CAST(p_size AS STRING) || '.75' || chr(10) || '   full: 0.5' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 5 IN (2, 4) THEN 'total dipole moment:   ' || CAST(p_size AS STRING) || '.5 Debye' || chr(10) ELSE '' END
  || CASE p_partkey % 7 WHEN 0 THEN 'Mol. alpha /au        :    ' || CAST(p_size AS STRING) || '.125'
                        WHEN 1 THEN 'Mol. α(0) /au  :  ' || CAST(p_size AS STRING) || '.375'
                        WHEN 2 THEN 'nothing'
                        ELSE 'isotropic polarizability:  ' || CAST(p_size AS STRING) || '.625' END || chr(10) AS text
FROM {part}"""

VIEWS["segment_docs"] = """
SELECT p_partkey AS mol_id, '$info' || chr(10) || '1 2 3 4 5 6 7 8' || chr(10) || '  $segment_information ' || chr(10)
  || '# n atom x y z charge area ratio' || chr(10) || chr(10)
  || '  1  1  0.5  1.5  2.5  0.' || CAST(p_size AS STRING) || '  ' || CAST(p_size AS STRING) || '.5  0.25' || chr(10)
  || '  2  1  0.5  1.5  2.5  0.125' || chr(10)
  || '  3  1  0.5  1.5  2.5  bad  1.5  0.25' || chr(10)
  || CASE WHEN p_partkey % 3 = 0 THEN '  4  2  1e-3  1.5  -2.5  -0.5  3.5  0.75  9' || chr(10) ELSE '' END
  || '$end' || chr(10) || '  5  1  0.5  1.5  2.5  0.5  1.5  0.25' || chr(10) AS text
FROM {part}"""

VIEWS["grid_lines"] = """
SELECT p_partkey AS mol_id, CASE p_partkey % 6 WHEN 0 THEN '# comment 1 2 3 4 5' WHEN 1 THEN '  1.0 2.0 3.0 4.0'
    WHEN 2 THEN '1.0 2.0 x 4.0 5.0' WHEN 3 THEN ''
    ELSE '  ' || CAST(p_size AS STRING) || '.5  -0.25 1e-3   -' || CAST(p_size AS STRING) || '.125E-02  2.5 extra' END AS line
FROM {part}"""

VIEWS["wbo_lines"] = """
SELECT l_orderkey AS mol_id, CASE l_partkey % 5 WHEN 0 THEN '1 2' WHEN 1 THEN 'a 2 0.5' WHEN 2 THEN '1.0 2 0.5'
    ELSE '  ' || CAST(l_linenumber AS STRING) || '   ' || CAST(l_partkey % 7 + 1 AS STRING) || '  0.' || CAST(l_suppkey AS STRING) || ' x' END AS line
FROM {lineitem}"""

VIEWS["result_docs"] = """
SELECT p_partkey AS mol_id, CASE WHEN p_partkey % 9 = 0 THEN '{"SNCI": 1.5, "SCDI'
    ELSE '{"SNCI": ' || CAST(p_size AS STRING) || '.5, "SCDI": ' || CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '0.25' END
      || ', "SCDI_variance": 0.125, "a_vector": [1.5, 2, ' || CAST(p_size AS STRING) || '], "metadata": {"fragments": '
      || CAST(p_partkey % 4 AS STRING) || ', "charge": 0}}' END AS text
FROM {part}"""

# A stored batch is an order, its records the line items.
VIEWS["batch_docs"] = """
SELECT l_orderkey AS file, CASE WHEN l_orderkey % 11 = 0 THEN '{"records": [{"SNCI": 1'
    WHEN l_orderkey % 13 = 0 THEN '{"records": "none"}'
    ELSE '{"schema_version": 1, "summary": {"total_files": ' || CAST(count(*) AS STRING) || '}, "records": ['
      || concat_ws(', ', collect_list(entry)) || ']}' END AS text
FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 4 THEN '"no record"'
    ELSE '{"input_file": "' || CASE WHEN l_linenumber = 5 THEN '' ELSE 'in/' || CAST(l_partkey AS STRING) || '.mol' END
      || '", "status": "' || CASE WHEN l_linenumber = 3 THEN 'failed", "error": "stopped early' ELSE 'success' END
      || '", "SNCI": ' || CAST(l_quantity AS STRING) || ', "SCDI": ' || CASE WHEN l_linenumber = 2 THEN 'null' ELSE '"0.25"' END
      || ', "SCDI_variance": ' || CAST(l_suppkey AS STRING) || ', "a_vector": [1, ' || CAST(l_linenumber AS STRING) || '.5]}' END AS entry
  FROM {lineitem}) GROUP BY l_orderkey"""

VIEWS["name_paths"] = """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN url || '.mol' WHEN 1 THEN url || '.XYZ' WHEN 2 THEN url || '.sdf '
    WHEN 3 THEN url || '.pdb' WHEN 4 THEN url || '.mol2' WHEN 5 THEN url || '.log' WHEN 6 THEN url || '.mol.bak'
    ELSE url END AS path
FROM {pages}"""

# --- wavefunctions: a part is a file with two centres and two orbitals -------------------------------


def _coef(mu: str, mo: int) -> str:
    return f"CAST((p_partkey * 7 + ({mu}) * 3 + {mo} * 5) % 19 - 9 AS STRING) || 'E-01'"


def _orbital(mo: int) -> str:
    rows = " || ".join(f"'  {mu + 1}  ' || {_coef(str(mu), mo)} || chr(10)" for mu in range(4))
    last = f"'  5  ' || {_coef('4', mo)} || chr(10)"
    cut = "p_partkey % 7 = 0" if mo == 0 else "p_partkey % 7 = 0 OR p_partkey % 13 = 0"
    shell_d = " || ".join(f"'  {mu + 1}  ' || {_coef(str(mu), mo)} || chr(10)" for mu in range(5, 10))
    sixth = f"'  11  ' || {_coef('10', mo)} || chr(10)"
    occ = "'2.0'" if mo == 0 else "CASE WHEN p_partkey % 4 = 0 THEN '0.0' ELSE '1.0D+00' END"
    return f"""' Sym=  {mo + 1}a' || chr(10) || ' Ene= -0.5' || chr(10) || ' Spin= Alpha' || chr(10)
  || ' Occup= ' || {occ} || chr(10) || {rows}
  || CASE WHEN {cut} THEN '' ELSE {last} END
  || CASE WHEN p_size % 10 = 9 THEN {shell_d} ELSE '' END
  || CASE WHEN p_size % 10 = 9 AND p_partkey % 2 = 0 THEN {sixth} ELSE '' END"""


VIEWS["wave_docs"] = f"""
SELECT p_partkey AS mol_id, '[Molden Format]' || chr(10)
  || CASE WHEN p_partkey % 3 = 0 THEN '[Atoms] old' || chr(10) || 'X 9 9 9.0 9.0 9.0' || chr(10) ELSE '' END
  || '[Title]' || chr(10) || ' none' || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN '[Atoms] AU' ELSE ' [ATOMS] Angs' END || chr(10)
  || ' O 1 8  0.25  -0.5  1.0D-01' || chr(10)
  || ' H 2 1  ' || CAST(p_size AS STRING) || 'D-02  0.5  -0.25' || chr(10) || chr(10)
  || '[GTO]' || chr(10) || '  1 0' || chr(10)
  || ' s   2 1.00' || chr(10) || '  12D-01  5E-01' || chr(10) || '  3E-01  ' || CAST(p_size AS STRING) || 'E-02' || chr(10)
  || ' p   1 ' || CASE WHEN p_partkey % 5 = 0 THEN '2.0' ELSE '' END || chr(10) || '  7E-01  4E-01' || chr(10)
  || chr(10) || '  2 0' || chr(10) || ' sp 1 1.0' || chr(10) || ' s   1 1.00' || chr(10) || chr(10) || '  5E-01  1.0D+00' || chr(10)
  || CASE WHEN p_size % 10 = 9 THEN ' d  1 1.0' || chr(10) || '  4E-01  3E-01' || chr(10) ELSE '' END
  || chr(10) || '[MO]' || chr(10) || {_orbital(0)} || {_orbital(1)} AS text
FROM {{part}}"""


def expand(sql: str, table=lambda name: "{" + name + "}") -> str:
    """Replace view names by their text, and table names by ``table(name)``."""

    def fill(match: re.Match) -> str:
        name = match.group(1)
        return f"({expand(VIEWS[name], table)})" if name in VIEWS else table(name)

    return re.sub(r"\{([a-z_]+)\}", fill, sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables it names."""
    sql = expand(VIEWS[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)


def spread_view(spark: SparkSession, sf_dir: str, name: str, source: str, key: str) -> DataFrame:
    """A view whose rows are texts that are long to read, made from a table that is short.

    A scan makes tasks by bytes, which leaves a million files of a small table to a few of them, so the rows of ``source`` are
    dealt to all tasks before the texts are written.
    """
    rows = table(spark, sf_dir, source).repartition(task_count(spark), key)
    return spark.sql(expand(VIEWS[name]), **{source: rows})


def numbered_view(spark: SparkSession, sf_dir: str, name: str, *dropped: str) -> DataFrame:
    """A stored view whose rows are numbered by ``atom`` within ``mol_id``, without a task per molecule.

    The rows are sorted in ranges of all molecules together. What is numbered are the places in a range; the rows of a molecule in the
    ranges before are added. There is one run of rows for each range and molecule in it, so runs are few.
    """
    number, order = re.search(r"CAST\(row_number\(\) OVER \(PARTITION BY \w+ ORDER BY ([^)]*)\) AS INT\) AS atom", VIEWS[name]).group(0, 1)
    rows = spark.sql(expand(VIEWS[name].replace(number, order), lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))
    order = ["mol_id", *order.replace("\n", " ").replace(" ", "").split(",")]
    rows = rows.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order).drop(*order[1:], *dropped)
    rows = written(rows.withColumn("_place", F.monotonically_increasing_id()))
    run = F.shiftright("_place", 33)
    runs = rows.groupBy("mol_id", run.alias("run")).agg(F.min("_place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("mol_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("mol_id").alias("mol"), "run", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    made = rows.join(F.broadcast(materialise(runs)), F.col("mol_id").eqNullSafe(F.col("mol")) & (run == F.col("run")))
    rest = [c for c in rows.columns if c not in ("mol_id", "_place")]
    return made.select("mol_id", (F.col("_place") + F.col("shift")).cast("int").alias("atom"), *rest)


def duck(sql: str) -> str:
    """A check text for DuckDB, with all views written out."""
    return expand(sql, lambda t: t)
