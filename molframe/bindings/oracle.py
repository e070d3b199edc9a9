"""Check texts for DuckDB, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import math

from molframe.bindings.queries import DENSITY_PADDING, DENSITY_SPACING
from molframe.constants import (
    ANGSTROM_TO_BOHR, BATCH_METRICS, CARTESIAN_POWERS, CONNECT_TOLERANCE, ELEMENTS, SINGLE_METRICS,
)

ORACLE: dict[str, str] = {}


def r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0e0 AS {name}"


# --- sources ----------------------------------------------------------------------------------------

_NAME = "regexp_extract(path, '[^/]*$')"
_EXT = rf"lower(regexp_extract(trim({_NAME}), '^\.*[^.].*(\.[^.]*)$', 1))"
_EXTS = f"""(SELECT *, CASE WHEN regexp_matches(e, '^[a-z0-9.]+$') THEN e
  WHEN regexp_matches(regexp_replace(e, '[^a-z0-9.]', '', 'g'), '^\\.[a-z0-9.]+$')
  THEN regexp_replace(e, '[^a-z0-9.]', '', 'g') ELSE e END AS ext
  FROM (SELECT *, {_EXT} AS e FROM {{name_paths}}))"""

ORACLE["clean_ext"] = f"SELECT page_id, ext FROM {_EXTS}"
ORACLE["corpus_scan"] = f"""SELECT page_id, path, ext FROM {_EXTS}
WHERE ext IN ('.xyz', '.sdf', '.mol', '.pdb', '.mol2')"""


def _mol_atom(atom: int, element: str, an: int, mass: float) -> str:
    place = ", ".join(
        f"CAST((p_size + {atom + 1}) % 50 AS VARCHAR) || '.' || lpad(CAST((p_partkey * {k} + {atom + 1}) % 10000 AS VARCHAR), 4, '0') AS {c}"
        for c, k in zip("xyz", (1, 3, 7))
    )
    return f"""SELECT p_partkey AS mol_id, {atom}::INT AS atom, '{element}' AS el, {an}::INT AS an,
  {mass}::DOUBLE AS mass, {place} FROM part WHERE p_partkey % 11 <> 0"""


_MASS = {el: (an, mass, radius) for el, an, mass, radius in ELEMENTS}
ORACLE["mol_atoms"] = "SELECT mol_id, atom, el, an, mass, " + ", ".join(
    f"{c}::DOUBLE AS {c}" for c in "xyz"
) + " FROM (" + " UNION ALL ".join(
    _mol_atom(i, el, *_MASS[el][:2]) for i, el in enumerate(("O", "H", "Cl"))
) + ")"
ORACLE["mol_bonds"] = """SELECT p_partkey AS mol_id, 0::INT AS a, b::INT AS b
FROM part, (VALUES (1), (2)) t(b) WHERE p_partkey % 11 <> 0"""

_RADIUS = "CASE el " + " ".join(f"WHEN '{e}' THEN {_MASS[e][2]}e0" for e in "HCNO") + " END"
ORACLE["bonds_by_distance"] = f"""WITH t AS (SELECT *, {_RADIUS} AS r FROM {{atoms}})
SELECT a.mol_id, a.atom AS a, b.atom AS b FROM t a JOIN t b ON a.mol_id = b.mol_id AND a.atom < b.atom
WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) < a.r + b.r + {CONNECT_TOLERANCE}"""

# The lines of a wavefunction file, counted from the rules that build it.
_OLD = "CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END"
_D = "p_size % 10 = 9"
_GTO = f"(8 + {_OLD})"
_GTO_LINES = f"(CASE WHEN {_D} THEN 15 ELSE 13 END)"
_MO_AT = f"({_GTO} + {_GTO_LINES} + 1)"
_MO_LINES = f"""(16 + CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END
  + CASE WHEN p_partkey % 7 = 0 OR p_partkey % 13 = 0 THEN 0 ELSE 1 END
  + CASE WHEN {_D} THEN (CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 10 END) ELSE 0 END)"""
ORACLE["molden_sections"] = f"""
SELECT p_partkey AS mol_id, 'molden format' AS name, 1::INT AS start, (1 + {_OLD})::INT AS stop FROM part
UNION ALL SELECT p_partkey, 'title', (2 + {_OLD})::INT, (3 + {_OLD})::INT FROM part
UNION ALL SELECT p_partkey, 'atoms', (4 + {_OLD})::INT, (7 + {_OLD})::INT FROM part
UNION ALL SELECT p_partkey, 'gto', {_GTO}::INT, ({_MO_AT} - 1)::INT FROM part
UNION ALL SELECT p_partkey, 'mo', {_MO_AT}::INT, ({_MO_AT} + {_MO_LINES} + 1)::INT FROM part"""

_READABLE = "NOT (p_partkey % 13 = 0 AND p_partkey % 7 <> 0)"
_UNIT = f"CASE WHEN p_partkey % 2 = 0 THEN 1e0 ELSE {ANGSTROM_TO_BOHR}e0 END"
_CENTERS = f"""(SELECT p_partkey, p_size, 0 AS center, 'O' AS el, 25e-2 * ({_UNIT}) AS x, -5e-1 * ({_UNIT}) AS y, 1e-1 * ({_UNIT}) AS z
  FROM part WHERE {_READABLE}
  UNION ALL SELECT p_partkey, p_size, 1, 'H', (p_size / 1e2) * ({_UNIT}), 5e-1 * ({_UNIT}), -25e-2 * ({_UNIT}) FROM part WHERE {_READABLE})"""
ORACLE["molden_atoms"] = f"""SELECT p_partkey AS mol_id, center::INT AS center, el,
  {r('x', 10, 'x')}, {r('y', 10, 'y')}, {r('z', 10, 'z')} FROM {_CENTERS}"""

# shell, center, l, primitive, exponent, coefficient
_PRIMS = f"""(SELECT p_partkey, p_size, s.* REPLACE (CASE s.coef WHEN -1 THEN p_size / 1e2 WHEN -2 THEN
    (CASE WHEN p_partkey % 5 = 0 THEN 8e-1 ELSE 4e-1 END) ELSE s.coef END AS coef)
  FROM part, (VALUES (0, 0, 0, 0, 12e-1, 5e-1), (0, 0, 0, 1, 3e-1, -1e0), (1, 0, 1, 0, 7e-1, -2e0),
    (2, 1, 0, 0, 5e-1, 1e0), (3, 1, 2, 0, 4e-1, 3e-1)) s(shell, center, l, prim, exp, coef)
  WHERE {_READABLE} AND (s.l < 2 OR {_D}))"""
ORACLE["molden_prims"] = f"""SELECT p_partkey AS mol_id, center::INT AS center, shell::INT AS shell, l::INT AS l,
  prim::INT AS prim, exp::DOUBLE AS exp, round(coef::DOUBLE, 12) AS coef FROM {_PRIMS}"""

_N_BASIS = f"""(CASE WHEN p_partkey % 7 = 0 THEN 4 ELSE 5 END
  + CASE WHEN {_D} THEN (CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5 END) ELSE 0 END)"""
# The printed number of a coefficient, by its position: dropping the fifth shifts the ones behind it.
_NUMBER = "CASE WHEN p_partkey % 7 = 0 AND mu >= 4 THEN mu + 1 ELSE mu END"
_MO = f"""(SELECT p_partkey, mo, mu, CASE WHEN mo = 0 THEN 2e0 WHEN p_partkey % 4 = 0 THEN 0e0 ELSE 1e0 END AS occ,
    CAST(CAST((p_partkey * 7 + ({_NUMBER}) * 3 + mo * 5) % 19 - 9 AS VARCHAR) || 'E-01' AS DOUBLE) AS coef
  FROM part, range(2) m(mo), range(11) u(mu) WHERE {_READABLE} AND mu < {_N_BASIS})"""
ORACLE["molden_mo"] = f"""SELECT p_partkey AS mol_id, mo::INT AS mo, occ, mu::INT AS mu, coef FROM {_MO}"""

_CART = f"(CASE WHEN {_D} THEN 11 ELSE 5 END)"
_SPH = f"(CASE WHEN {_D} THEN 10 ELSE 5 END)"
ORACLE["basis_guard"] = f"""SELECT p_partkey AS mol_id, {_CART}::INT AS n_cart, {_SPH}::INT AS n_sph,
  {_N_BASIS}::INT AS n_basis, CASE WHEN {_N_BASIS} = {_CART} THEN 'ok' WHEN {_N_BASIS} = {_SPH} THEN 'unsupported'
  ELSE 'mismatch' END AS verdict FROM part WHERE {_READABLE}"""
_OK = f"{_READABLE} AND {_N_BASIS} = {_CART}"

_POWER_ROWS = ", ".join(
    f"({l}, {k}, {w[0]}, {w[1]}, {w[2]})" for l, row in enumerate(CARTESIAN_POWERS) for k, w in enumerate(row)
)
_POWERS = f"(VALUES {_POWER_ROWS}) w(l, k, lx, ly, lz)"
_FIRST_MU = "(CASE shell WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 5 END)"
_ODD = "(CASE {0} WHEN 0 THEN 1e0 WHEN 1 THEN 1e0 WHEN 2 THEN 3e0 WHEN 3 THEN 15e0 ELSE 105e0 END)"
_NORM = f"""pow(2e0 * exp / {math.pi!r}, 75e-2) * pow(4e0 * exp, (lx + ly + lz) / 2e0)
  / sqrt({_ODD.format('lx')} * {_ODD.format('ly')} * {_ODD.format('lz')})"""
_FUNCTIONS = f"""(SELECT p.*, {_FIRST_MU} + w.k AS mu, w.lx, w.ly, w.lz FROM {_PRIMS} p JOIN {_POWERS} ON p.l = w.l WHERE {_OK})"""
ORACLE["basis_expand"] = f"""SELECT p_partkey AS mol_id, mu::INT AS mu, center::INT AS center, lx::INT AS lx, ly::INT AS ly,
  lz::INT AS lz, prim::INT AS prim, exp::DOUBLE AS exp, round((coef * {_NORM})::DOUBLE, 9) AS coef FROM {_FUNCTIONS}"""

_H = repr(DENSITY_SPACING * ANGSTROM_TO_BOHR)
_PAD = repr(DENSITY_PADDING * ANGSTROM_TO_BOHR)
_SPECS = "(SELECT p_partkey, " + ", ".join(
    f"min({c}) - {_PAD} AS {c}0, ceil((max({c}) + {_PAD} + {_H} / 2 - (min({c}) - {_PAD})) / {_H})::INT AS n{c}"
    for c in "xyz"
) + f" FROM {_CENTERS} GROUP BY p_partkey)"
_POINTS = "(SELECT p_partkey, " + ", ".join(
    f"i{c}, {c}0 + i{c} * {_H} AS {c}" for c in "xyz"
) + f" FROM {_SPECS} s, LATERAL (SELECT unnest(range(s.nx)) AS ix) gx, LATERAL (SELECT unnest(range(s.ny)) AS iy) gy, LATERAL (SELECT unnest(range(s.nz)) AS iz) gz)"
_CELL = "p_partkey AS mol_id, ix::INT AS ix, iy::INT AS iy, iz::INT AS iz"
ORACLE["grid_points"] = f"""SELECT {_CELL}, {r('x', 9, 'x')}, {r('y', 9, 'y')}, {r('z', 9, 'z')} FROM {_POINTS}"""
_RHO_STEPS = f"""c AS MATERIALIZED {_CENTERS}, f AS MATERIALIZED {_FUNCTIONS}, pt AS MATERIALIZED {_POINTS}, m AS MATERIALIZED {_MO},
phi AS MATERIALIZED (SELECT pt.p_partkey, ix, iy, iz, mu, sum(coef * pow(pt.x - c.x, lx) * pow(pt.y - c.y, ly) * pow(pt.z - c.z, lz)
    * exp(-f.exp * ((pt.x - c.x) * (pt.x - c.x) + (pt.y - c.y) * (pt.y - c.y) + (pt.z - c.z) * (pt.z - c.z)))) AS v
  FROM pt JOIN f ON pt.p_partkey = f.p_partkey JOIN c ON c.p_partkey = f.p_partkey AND c.center = f.center
  GROUP BY ALL),
psi AS MATERIALIZED (SELECT phi.p_partkey, ix, iy, iz, mo, occ, sum(m.coef * v) AS v FROM phi
  JOIN m ON m.p_partkey = phi.p_partkey AND m.mu = phi.mu GROUP BY ALL),
rho AS (SELECT p_partkey, ix, iy, iz, sum(occ * v * v) AS rho FROM psi GROUP BY ALL)"""
ORACLE["density"] = f"""WITH {_RHO_STEPS} SELECT {_CELL}, {r('x', 8, 'x')}, {r('y', 8, 'y')}, {r('z', 8, 'z')}, {r('rho', 8, 'rho')}
FROM rho JOIN pt USING (p_partkey, ix, iy, iz)"""

ORACLE["grid_rows"] = """SELECT p_partkey AS mol_id, p_size + 5e-1 AS x, -25e-2 AS y, 1e-3 AS z,
  CAST('-' || p_size || '.125E-02' AS DOUBLE) AS sl2rho, 25e-1 AS rdg FROM part WHERE p_partkey % 6 > 3"""
ORACLE["grid_required"] = "SELECT mol_id, count(*) AS points, max(rdg) AS top_rdg FROM {field} GROUP BY 1"
ORACLE["segment_rows"] = """SELECT p_partkey AS mol_id, 0::INT AS seg_no, 8::INT AS width,
  CAST('0.' || p_size AS DOUBLE) AS q, p_size + 5e-1 AS a, 25e-2 AS "last" FROM part
UNION ALL SELECT p_partkey, 1::INT, 9::INT, -5e-1, 35e-1, 9e0 FROM part WHERE p_partkey % 3 = 0"""
ORACLE["wbo_rows"] = """SELECT l_orderkey AS mol_id, (l_linenumber - 1)::INT AS i, (l_partkey % 7)::INT AS j,
  CAST('0.' || l_suppkey AS DOUBLE) AS wbo FROM lineitem WHERE l_partkey % 5 > 2"""
ORACLE["results_read"] = """SELECT p_partkey AS mol_id, p_partkey % 9 <> 0 AS readable,
  CASE WHEN p_partkey % 9 <> 0 THEN p_size + 5e-1 END AS snci,
  CASE WHEN p_partkey % 9 <> 0 AND p_partkey % 2 = 1 THEN 25e-2 END AS scdi,
  CASE WHEN p_partkey % 9 <> 0 THEN 125e-3 END AS scdi_variance,
  CASE WHEN p_partkey % 9 <> 0 THEN p_size::DOUBLE END AS f3, NULL::DOUBLE AS f4,
  CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 4)::INT END AS fragments FROM part"""

ORACLE["batch_read"] = """SELECT l_orderkey AS file, CASE WHEN ok THEN 'in/' || l_partkey || '.mol' END AS mol_id,
  CASE WHEN ok AND l_linenumber <> 3 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN l_linenumber = 4 THEN 'unreadable record' WHEN l_linenumber = 5 THEN 'record without a molecule'
    WHEN l_linenumber = 3 THEN 'stopped early' END AS error,
  ok AS readable, CASE WHEN ok THEN l_quantity::DOUBLE END AS snci, CASE WHEN ok AND l_linenumber <> 2 THEN 25e-2 END AS scdi,
  CASE WHEN ok THEN l_suppkey::DOUBLE END AS scdi_variance, CASE WHEN ok THEN 2 END AS width,
  CASE WHEN ok THEN l_linenumber + 5e-1 END AS f2
FROM (SELECT *, l_linenumber NOT IN (4, 5) AS ok FROM lineitem WHERE l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0)
UNION ALL SELECT l_orderkey, NULL, 'failed', 'unreadable batch', false, NULL, NULL, NULL, NULL, NULL
FROM lineitem WHERE l_orderkey % 11 = 0 OR l_orderkey % 13 = 0 GROUP BY l_orderkey"""

# --- scalar work ------------------------------------------------------------------------------------

ORACLE["assemble_vector"] = """SELECT l_partkey AS mol_id, min(l_quantity) AS f1, min(l_discount) AS f2, min(l_tax) AS f3,
  max(l_quantity) AS f4, max(l_discount) AS f5, count(*)::DOUBLE AS f6, max(l_tax) AS f7, max(l_extendedprice) AS f8,
  max(l_orderkey)::DOUBLE AS f9, NULL::DOUBLE AS f10 FROM lineitem GROUP BY 1"""
ORACLE["log_scrape"] = """SELECT *, CASE WHEN dipole IS NULL THEN 'dipole not found'
    WHEN polarizability IS NULL THEN 'polarizability not found' END AS reason
FROM (SELECT p_partkey AS mol_id, CASE p_partkey % 5 WHEN 0 THEN p_size + 25e-2 WHEN 1 THEN p_size + 75e-2
    WHEN 2 THEN p_size + 5e-1 WHEN 4 THEN p_size + 5e-1 END AS dipole,
  CASE p_partkey % 7 WHEN 0 THEN p_size + 125e-3 WHEN 1 THEN p_size + 375e-3 WHEN 2 THEN NULL
    ELSE p_size + 625e-3 END AS polarizability FROM part)"""
_VARIANCE = """(WITH v AS (SELECT * FROM {weighted} WHERE area > 0),
  m AS (SELECT mol_id, sum(area * charge) / sum(area) AS mu FROM v GROUP BY 1),
  t AS (SELECT mol_id, sum(area * (charge - mu) * (charge - mu)) / sum(area) AS variance FROM v JOIN m USING (mol_id) GROUP BY 1)
  SELECT k.mol_id, coalesce(variance, 0e0) AS variance FROM (SELECT DISTINCT mol_id FROM {weighted}) k LEFT JOIN t USING (mol_id))"""
ORACLE["scdi_var"] = f"SELECT mol_id, {r('variance', 10, 'variance')} FROM {_VARIANCE}"
ORACLE["scdi_fixed"] = f"""SELECT mol_id, {r('greatest(0e0, least(1e0, 1e0 - (variance - 5e-4) / (2e-3 - 5e-4)))', 8, 'scdi')},
  NULL::DOUBLE AS unbounded FROM {_VARIANCE}"""

# --- geometry ---------------------------------------------------------------------------------------

_FRAGS = """(WITH s AS (SELECT mol_id, atom, pk, lag(atom) OVER w AS pa, lag(pk) OVER w AS pp FROM {raw_atoms}
    WINDOW w AS (PARTITION BY mol_id ORDER BY atom)),
  b AS (SELECT *, CASE WHEN pa = atom - 1 AND (pk + pp) % 3 <> 0 THEN 0 ELSE 1 END AS brk FROM s),
  g AS (SELECT *, sum(brk) OVER (PARTITION BY mol_id ORDER BY atom) AS run FROM b)
  SELECT mol_id, atom, min(atom) OVER (PARTITION BY mol_id, run) AS frag FROM g)"""
ORACLE["fragments"] = f"SELECT mol_id, atom, frag FROM {_FRAGS}"
_COM = f"""(SELECT mol_id, frag, sum(mass) AS mass, sum(mass * x) / sum(mass) AS x, sum(mass * y) / sum(mass) AS y,
  sum(mass * z) / sum(mass) AS z FROM {{atoms}} JOIN {_FRAGS} USING (mol_id, atom) GROUP BY 1, 2)"""
ORACLE["com"] = "SELECT mol_id, frag, " + ", ".join(r(c, 8, c) for c in ("mass", "x", "y", "z")) + f" FROM {_COM}"
_PAIRS = f"""(WITH c AS {_COM}, p AS (SELECT a.mol_id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d
    FROM c a JOIN c b ON a.mol_id = b.mol_id AND a.frag < b.frag)
  SELECT c.mol_id, count(DISTINCT c.frag)::INT AS fragments, any_value(n) AS n, any_value(m) AS m FROM c
  LEFT JOIN (SELECT mol_id, count(*) AS n, avg(d) AS m FROM p GROUP BY 1) q USING (mol_id) GROUP BY 1)"""
ORACLE["frag_pairs"] = f"SELECT mol_id, coalesce(n, 0) AS pairs, {r('m', 8, 'mean_distance')} FROM {_PAIRS}"
_LARGE = lambda sql: sql.replace("{raw_atoms}", "{large_atoms}").replace("{atoms}", "{large_atoms}")
ORACLE["fragments_large"] = _LARGE(ORACLE["fragments"])
ORACLE["frag_pairs_large"] = _LARGE(f"SELECT mol_id, coalesce(n, 0) AS pairs, {r('m', 7, 'mean_distance')} FROM {_PAIRS}")
_HB = f"""(WITH f AS {_FRAGS}, t AS (SELECT * FROM {{atoms}} JOIN f USING (mol_id, atom)), e AS (SELECT * FROM {{bonds}}),
  two AS (SELECT mol_id FROM f GROUP BY 1 HAVING count(DISTINCT frag) = 2),
  ends AS (SELECT mol_id, a AS h, b AS d FROM e UNION ALL SELECT mol_id, b, a FROM e),
  lone AS (SELECT mol_id, h, min(d) AS d FROM ends GROUP BY 1, 2 HAVING count(*) = 1),
  hit AS (SELECT h.mol_id, h.atom AS h, a.atom AS acc, h.frag AS hf,
      sqrt((h.x-a.x)*(h.x-a.x) + (h.y-a.y)*(h.y-a.y) + (h.z-a.z)*(h.z-a.z)) AS dist,
      (d.x-h.x)*(a.x-h.x) + (d.y-h.y)*(a.y-h.y) + (d.z-h.z)*(a.z-h.z) AS dot,
      sqrt((d.x-h.x)*(d.x-h.x) + (d.y-h.y)*(d.y-h.y) + (d.z-h.z)*(d.z-h.z)) AS dh
    FROM t h JOIN lone l ON l.mol_id = h.mol_id AND l.h = h.atom JOIN t d ON d.mol_id = h.mol_id AND d.atom = l.d
    JOIN t a ON a.mol_id = h.mol_id AND a.frag <> h.frag JOIN two ON two.mol_id = h.mol_id
    WHERE h.el = 'H' AND d.el IN ('N', 'O', 'F') AND a.el IN ('N', 'O', 'F')),
  best AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY dist, hf, h, acc) AS k FROM hit WHERE dist < 35e-1)
  SELECT mol_id, h, acc, dist, CASE WHEN dh * dist = 0 THEN 90e0
    ELSE degrees(acos(greatest(-1e0, least(1e0, dot / sqrt(dh * dh * dist * dist))))) END AS angle FROM best WHERE k = 1)"""
ORACLE["hb_angle"] = f"""SELECT mol_id, h AS donor_h, acc AS acceptor, {r('dist', 6, 'distance')}, {r('angle', 6, 'angle')} FROM {_HB}"""
ORACLE["f1_f2"] = f"""SELECT mol_id, fragments, {r('coalesce(m, 0e0)', 6, 'f1')}, {r('coalesce(angle, 180e0)', 6, 'f2')}
FROM {_PAIRS} LEFT JOIN {_HB} USING (mol_id)"""
ORACLE["f3_wbo"] = f"""WITH f AS {_FRAGS},
t AS (SELECT w.mol_id, max(wbo) AS top FROM {{wbo}} w JOIN f a ON a.mol_id = w.mol_id AND a.atom = w.i
  JOIN f b ON b.mol_id = w.mol_id AND b.atom = w.j WHERE a.frag <> b.frag GROUP BY 1)
SELECT mol_id, greatest(coalesce(top, 0e0), 0e0) AS f3 FROM (SELECT DISTINCT mol_id FROM f) LEFT JOIN t USING (mol_id)"""
ORACLE["frag_override"] = f"SELECT mol_id, atom, CASE WHEN mol_id % 3 = 0 THEN 1::INT ELSE frag END AS frag FROM {_FRAGS}"

# --- surfaces, fields, moments ----------------------------------------------------------------------

_ROLE_ROWS = "(VALUES (0, 6, 5), (1, 5, 6), (2, 7, 5), (3, 5, 7), (4, 6, 7), (5, 7, 6)) k(c, a, q)"
_COLUMN = "CASE {0} WHEN 5 THEN v5 WHEN 6 THEN v6 ELSE v7 END"
_ROLES = f"""(WITH s AS (SELECT mol_id, c, a, q, avg(CASE WHEN {_COLUMN.format('a')} > 0 THEN 1e0 ELSE 0e0 END) AS share,
    avg({_COLUMN.format('a')}) AS mean, avg(abs({_COLUMN.format('q')})) AS size FROM {{segments}}, {_ROLE_ROWS} GROUP BY 1, 2, 3, 4),
  o AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY share DESC, mean DESC, size, abs(a - q), c) AS k
    FROM s WHERE share >= 95e-2 AND mean > 0)
  SELECT m.mol_id, coalesce(a, 6)::INT AS area_col, coalesce(q, 5)::INT AS charge_col
  FROM (SELECT DISTINCT mol_id FROM {{segments}}) m LEFT JOIN o ON o.mol_id = m.mol_id AND o.k = 1)"""
ORACLE["segment_roles"] = f"SELECT mol_id, area_col, charge_col FROM {_ROLES}"
ORACLE["surface_scores"] = f"""WITH v AS (SELECT s.mol_id, {_COLUMN.format('area_col')} AS a, {_COLUMN.format('charge_col')} AS q
  FROM {{segments}} s JOIN {_ROLES} USING (mol_id)),
k AS (SELECT * FROM v WHERE a > 0), m AS (SELECT mol_id, sum(a * q) / sum(a) AS mu FROM k GROUP BY 1),
t AS (SELECT mol_id, sum(a * (q - mu) * (q - mu)) / sum(a) AS w FROM k JOIN m USING (mol_id) GROUP BY 1)
SELECT i.mol_id, {r('coalesce(w, 0e0)', 8, 'scdi_variance')}, {r('greatest(0e0, least(1e0, 1e0 - w / 1e-2))', 8, 'scdi')}
FROM (SELECT DISTINCT mol_id FROM v) i LEFT JOIN t USING (mol_id)"""


def _axis_step(c: str) -> str:
    return f"""(SELECT mol_id, CASE WHEN count(*) < 2 THEN 1e0 ELSE max(v) - min(v) END AS s{c} FROM
  (SELECT mol_id, {c} AS v, row_number() OVER (PARTITION BY mol_id ORDER BY {c}) AS k FROM (SELECT DISTINCT mol_id, {c} FROM {{signed}}))
  WHERE k <= 2 GROUP BY 1)"""


_DV = f"(SELECT mol_id, sx * sy * sz AS dv FROM {_axis_step('x')} JOIN {_axis_step('y')} USING (mol_id) JOIN {_axis_step('z')} USING (mol_id))"
ORACLE["delta_v"] = f"SELECT mol_id, {r('dv', 9, 'dv')} FROM {_DV}"
ORACLE["snci"] = f"""SELECT mol_id, {r('coalesce(sum(CASE WHEN sl2rho < 0 THEN -sl2rho END), 0e0) * any_value(dv)', 8, 'snci')}
FROM {{signed}} JOIN {_DV} USING (mol_id) GROUP BY 1"""
ORACLE["nci_stats"] = f"""WITH m AS (SELECT mol_id, avg(sl2rho) AS mu FROM {{signed}} WHERE sl2rho < 0 GROUP BY 1),
c AS (SELECT mol_id, count(*) AS n, any_value(mu) AS mu, avg(pow(sl2rho - mu, 2)) AS m2, avg(pow(sl2rho - mu, 3)) AS m3
  FROM {{signed}} JOIN m USING (mol_id) WHERE sl2rho < 0 GROUP BY 1)
SELECT mol_id, coalesce(n, 0) AS f6, {r('coalesce(mu, 0e0)', 7, 'f7')}, {r('coalesce(sqrt(m2), 0e0)', 7, 'f8')},
  {r('CASE WHEN m2 > 0 THEN m3 / pow(m2, 15e-1) ELSE 0e0 END', 7, 'f9')}
FROM (SELECT DISTINCT mol_id FROM {{signed}}) LEFT JOIN c USING (mol_id)"""

_SHAPE = """g AS (SELECT *, max(ix) OVER m AS tx, max(iy) OVER m AS ty, max(iz) OVER m AS tz FROM {grid}
  WINDOW m AS (PARTITION BY mol_id))"""


def _window(c: str) -> str:
    rest = ", ".join(f"i{o}" for o in "xyz" if o != c)
    return f"w{c} AS (PARTITION BY mol_id, {rest} ORDER BY i{c})"


_WINDOWS = "WINDOW " + ", ".join(_window(c) for c in "xyz")


def _first(c: str) -> str:
    return f"""CASE WHEN i{c} = 0 THEN (lead(rho) OVER w{c} - rho) / h WHEN i{c} = t{c} THEN (rho - lag(rho) OVER w{c}) / h
    ELSE (lead(rho) OVER w{c} - lag(rho) OVER w{c}) / (2 * h) END AS g{c}"""


def _second(c: str) -> str:
    at = lambda k: f"(lead(rho, {k + 1}) OVER w{c} - 2 * {'rho' if k == 0 else f'lead(rho, {k}) OVER w{c}'} + {'lag(rho) OVER w' + c if k == 0 else ('rho' if k == 1 else '')}) / (h * h)"
    back = f"(rho - 2 * lag(rho) OVER w{c} + lag(rho, 2) OVER w{c}) / (h * h)"
    return f"CASE WHEN t{c} < 2 THEN 0e0 WHEN i{c} = 0 THEN {at(1)} WHEN i{c} = t{c} THEN {back} ELSE {at(0)} END AS h{c}{c}"


def _mixed(a: str, b: str) -> str:
    return f"coalesce((lead(d{a}) OVER w{b} - lag(d{a}) OVER w{b}) / (4 * h * h), 0e0) AS h{a}{b}"


_DIFF = f"""(WITH {_SHAPE},
  d AS (SELECT *, lead(rho) OVER wx - lag(rho) OVER wx AS dx, lead(rho) OVER wy - lag(rho) OVER wy AS dy FROM g {_WINDOWS})
  SELECT *, {", ".join(_first(c) for c in "xyz")}, {", ".join(_second(c) for c in "xyz")},
    {_mixed("x", "y")}, {_mixed("x", "z")}, {_mixed("y", "z")} FROM d {_WINDOWS})"""
_AT = "mol_id, ix, iy, iz"
for _name, _cols in (("first", "gx gy gz"), ("second", "hxx hyy hzz"), ("cross", "hxy hxz hyz")):
    ORACLE[f"stencil_{_name}"] = f"SELECT {_AT}, " + ", ".join(r(c, 8, c) for c in _cols.split()) + f" FROM {_DIFF}"

_L2_STEPS = f"""q AS (SELECT *, (hxx + hyy + hzz) / 3 AS t FROM src),
p AS (SELECT *, sqrt(((hxx-t)*(hxx-t) + (hyy-t)*(hyy-t) + (hzz-t)*(hzz-t) + 2*(hxy*hxy + hxz*hxz + hyz*hyz)) / 6) AS p,
  (hxx-t)*((hyy-t)*(hzz-t) - hyz*hyz) - hxy*(hxy*(hzz-t) - hyz*hxz) + hxz*(hxy*hyz - (hyy-t)*hxz) AS det FROM q),
a AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1e0, least(1e0, det / (2*p*p*p)))) / 3 END AS phi FROM p),
l AS (SELECT *, CASE WHEN p > 0 THEN 3*t - (t + 2*p*cos(phi)) - (t + 2*p*cos(phi + 2*{math.pi!r}/3)) ELSE t END AS l2 FROM a)"""
ORACLE["lambda2"] = f"WITH src AS (SELECT * FROM {{hessian}}), {_L2_STEPS} SELECT mol_id, line, l_partkey, l_suppkey, {r('l2', 7, 'lambda2')} FROM l"
_RDG_SCALE = repr(1.0 / (2.0 * (3.0 * math.pi**2) ** (1.0 / 3.0)))
ORACLE["nci_field"] = f"""WITH src AS (SELECT * FROM {_DIFF}), {_L2_STEPS}
SELECT {_AT}, {r('rho', 8, 'rho')}, {r(f"CASE WHEN rho < 1e-12 THEN 0e0 ELSE {_RDG_SCALE} * sqrt(gx*gx + gy*gy + gz*gz) / pow(rho, 4e0/3e0) END", 8, 'rdg')},
  {r('sign(l2) * rho', 8, 'sl2rho')} FROM l"""

# The density of the wavefunctions through the same differences.
_WAVE_SHAPE = f"""{_RHO_STEPS}, g AS (SELECT r.p_partkey AS mol_id, ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, rho, {_H} AS h,
    nx - 1 AS tx, ny - 1 AS ty, nz - 1 AS tz
  FROM rho r JOIN {_SPECS} s ON s.p_partkey = r.p_partkey WHERE nx > 1 AND ny > 1 AND nz > 1)"""
_WAVE_DIFF = _DIFF.replace(_SHAPE, _WAVE_SHAPE)
ORACLE["wave_field"] = f"""WITH src AS (SELECT * FROM {_WAVE_DIFF})
SELECT {_AT}, {r('rho', 6, 'rho')}, {r(f"CASE WHEN rho < 1e-12 THEN 0e0 ELSE {_RDG_SCALE} * sqrt(gx*gx + gy*gy + gz*gz) / pow(rho, 4e0/3e0) END", 6, 'rdg')}
FROM src"""

# --- batches ----------------------------------------------------------------------------------------

_STATUS = """(SELECT u.mol_id, elapsed_seconds, lane,
    CASE WHEN status = 'success' AND coalesce(readable, false) = false THEN 'failed' ELSE status END AS status,
    CASE WHEN status = 'success' AND readable IS NULL THEN 'Missing result'
         WHEN status = 'success' AND NOT readable THEN 'Failed to read result' ELSE error END AS error,
    CASE WHEN status = 'success' AND readable THEN snci END AS snci
  FROM {runs} u LEFT JOIN {results} s ON u.mol_id = s.mol_id)"""
ORACLE["run_status"] = f"SELECT * FROM {_STATUS}"
_SUMMARY = """count(*) AS total_files, count(*) FILTER (status = 'success') AS successful_files,
  count(*) FILTER (status = 'failed') AS failed_files, count(*) FILTER (status = 'stopped') AS stopped_files,
  coalesce(sum(elapsed_seconds), 0e0) AS seconds"""
_COUNTS = "total_files, successful_files, failed_files, stopped_files"
ORACLE["batch_summary"] = f"SELECT {_COUNTS}, {r('seconds', 2, 'total_time_seconds')} FROM (SELECT {_SUMMARY} FROM {_STATUS})"
ORACLE["throughput"] = f"""SELECT lane, {_COUNTS}, {r('round(seconds, 4)', 4, 'total_time_seconds')},
  {r('CASE WHEN seconds > 0 THEN (total_files - stopped_files) / round(seconds, 4) * 3600 ELSE 0e0 END', 4, 'molecules_per_hour')},
  {r('CASE WHEN total_files > stopped_files THEN round(seconds, 4) / (total_files - stopped_files) ELSE 0e0 END', 4, 'seconds_per_molecule')}
FROM (SELECT lane, {_SUMMARY} FROM {_STATUS} GROUP BY 1)"""
ORACLE["summary_delta"] = f"""WITH s AS (SELECT mol_id % 2 AS side, {_SUMMARY} FROM {_STATUS} GROUP BY 1),
u AS (SELECT side, unnest(['total_files', 'successful_files', 'failed_files', 'stopped_files', 'total_time_seconds']) AS metric,
  unnest([total_files::DOUBLE, successful_files::DOUBLE, failed_files::DOUBLE, stopped_files::DOUBLE, seconds]) AS v FROM s)
SELECT a.metric, {r('a.v', 2, 'reference')}, {r('b.v', 2, 'variant')}, {r('round(b.v, 4) - round(a.v, 4)', 2, 'delta')}
FROM u a JOIN u b ON a.metric = b.metric AND a.side = 0 AND b.side = 1"""

_NORMED = """(WITH s AS (SELECT mol_id, CASE WHEN isnan(snci) THEN NULL ELSE snci END AS s, scdi, scdi_variance AS v
    FROM {records} WHERE status = 'success'),
  e AS (SELECT min(s) AS sl, max(s) AS sh, min(v) AS vl, max(v) AS vh, bool_and(scdi IS NOT NULL) AS full_set FROM s)
  SELECT mol_id, CASE WHEN s IS NULL THEN NULL WHEN abs(sh - sl) <= 1e-12 THEN 5e-1 ELSE greatest(0e0, least(1e0, (s - sl) / (sh - sl))) END AS x,
    CASE WHEN full_set THEN greatest(0e0, least(1e0, scdi)) WHEN v IS NULL THEN NULL WHEN abs(vh - vl) <= 1e-12 THEN 5e-1
      ELSE greatest(0e0, least(1e0, 1e0 - (v - vl) / (vh - vl))) END AS y,
    CASE WHEN full_set THEN 'scdi' ELSE 'inverse_variance' END AS source FROM s, e)"""
ORACLE["normalize"] = f"SELECT mol_id, {r('x', 8, 'snci_norm')}, {r('y', 8, 'scdi_norm')}, source AS scdi_source FROM {_NORMED}"
_QUADRANTS = f"""(WITH n AS {_NORMED}, m AS (SELECT median(x) AS mx, median(y) AS my FROM n WHERE x IS NOT NULL AND y IS NOT NULL)
  SELECT mol_id, CASE WHEN x >= mx AND y >= my THEN 'Q1' WHEN x < mx AND y >= my THEN 'Q2' WHEN x < mx AND y < my THEN 'Q3'
    WHEN x IS NOT NULL AND y IS NOT NULL THEN 'Q4' END AS quadrant FROM n, m)"""
ORACLE["quadrants"] = f"SELECT mol_id, quadrant FROM {_QUADRANTS}"
ORACLE["quadrant_tally"] = f"""SELECT k.quadrant, count(d.mol_id) AS "count" FROM (VALUES ('Q1'), ('Q2'), ('Q3'), ('Q4')) k(quadrant)
LEFT JOIN {_QUADRANTS} d ON d.quadrant = k.quadrant GROUP BY 1"""
ORACLE["quadrant_head"] = f"""SELECT max(source) AS scdi_source,
  {r("median(CASE WHEN y IS NOT NULL THEN x END)", 8, "snci_median")}, {r("median(CASE WHEN x IS NOT NULL THEN y END)", 8, "scdi_median")},
  count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS labelled FROM {_NORMED}"""
ORACLE["pending_inputs"] = """SELECT mol_id, lane FROM {runs} u
WHERE NOT EXISTS (SELECT 1 FROM {results} s WHERE s.mol_id = u.mol_id AND readable)"""


def _run_delta(metrics, join: str, found: str) -> str:
    rows = []
    for key, label, unit in metrics:
        old, new = f"a.{key.lower()}::DOUBLE", f"b.{key.lower()}::DOUBLE"
        rows.append(
            f"SELECT coalesce(a.mol_id, b.mol_id) AS mol_id, {found}'{key}' AS metric, '{label}' AS label, "
            f"{'NULL::VARCHAR' if not unit else repr(unit)} AS unit, {r(old, 6, 'reference')}, {r(new, 6, 'variant')}, "
            f"{r(f'{new} - {old}', 6, 'delta')} FROM a {join} b ON a.mol_id = b.mol_id"
        )
    sides = "WITH a AS (SELECT * FROM {variant} WHERE run = 'F'), b AS (SELECT * FROM {variant} WHERE run = 'O') "
    return sides + " UNION ALL ".join(rows)


ORACLE["delta_long"] = _run_delta(BATCH_METRICS, "FULL OUTER JOIN", "")
ORACLE["delta_single"] = _run_delta(SINGLE_METRICS, "RIGHT JOIN", "a.mol_id IS NOT NULL AS reference_found, ")
ORACLE["best_setting"] = """WITH v AS (SELECT * FROM {timing} WHERE seconds > 0),
f AS (SELECT file FROM v GROUP BY 1 ORDER BY max(modified) DESC, file DESC LIMIT 1)
SELECT file, setting, seconds FROM v JOIN f USING (file) ORDER BY seconds, setting LIMIT 1"""
ORACLE["timing_stats"] = f"""WITH b AS (SELECT avg(seconds) AS m FROM {{timing}} WHERE method = 'click')
SELECT method, count(*) AS runs, {r('avg(seconds)', 6, 'mean')}, {r('min(seconds)', 6, 'lowest')}, {r('max(seconds)', 6, 'highest')},
  {r('stddev_pop(seconds)', 6, 'deviation')}, {r('any_value(b.m) / avg(seconds)', 6, 'speedup')},
  {r('sum(points) / sum(seconds)', 6, 'points_per_second')} FROM {{timing}}, b GROUP BY method"""
ORACLE["resolve_paths"] = r"""WITH l AS (SELECT path, page_id AS pos, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
    regexp_extract(path, '[^/]*$') AS name FROM {name_paths}),
w AS (SELECT DISTINCT CASE pos % 3 WHEN 0 THEN path WHEN 1 THEN parent || '/' || upper(name) ELSE path || '~' END AS path FROM l),
k AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, lower(trim(regexp_extract(path, '[^/]*$'))) AS name FROM w),
c AS (SELECT k.path, arg_min(l.path, l.pos) AS hit FROM k JOIN l ON l.parent = k.parent AND lower(trim(l.name)) = k.name
  WHERE k.name <> '' GROUP BY 1)
SELECT k.path, CASE WHEN e.path IS NOT NULL THEN k.path ELSE coalesce(hit, k.path) END AS resolved,
  CASE WHEN e.path IS NOT NULL THEN 'exact' WHEN hit IS NOT NULL THEN 'matched' ELSE 'unresolved' END AS how
FROM k LEFT JOIN c ON c.path = k.path LEFT JOIN (SELECT DISTINCT path FROM l) e ON e.path = k.path"""

# --- agreement of two grids -------------------------------------------------------------------------

ORACLE["grid_complete"] = f"""WITH x AS (SELECT mol_id, x - lag(x) OVER (PARTITION BY mol_id ORDER BY x) AS d
  FROM (SELECT DISTINCT mol_id, x FROM {{field}})), s AS (SELECT mol_id, coalesce(median(d), 1e0) AS spacing FROM x GROUP BY 1)
SELECT mol_id, count(DISTINCT x)::INT AS nx, count(DISTINCT y)::INT AS ny, count(DISTINCT z)::INT AS nz, count(*) AS points,
  count(DISTINCT x) * count(DISTINCT y) * count(DISTINCT z) = count(*) AS complete, {r('any_value(spacing)', 9, 'spacing')}
FROM {{field}} JOIN s USING (mol_id) GROUP BY 1"""
ORACLE["grid_align"] = f"""SELECT mol_id, ix, iy, iz, {r('x', 8, 'x')}, {r('y', 8, 'y')}, {r('z', 8, 'z')}, {r('sl2rho', 8, 'sl2_ref')},
  {r('rdg', 8, 'rdg_ref')}, {r('rho - 3e-1', 8, 'sl2_pred')}, {r('rho * 2', 8, 'rdg_pred')}
FROM {{field}} JOIN {{grid}} USING (mol_id, ix, iy, iz)"""


def _agree(name: str, ref: str, pred: str) -> str:
    return (
        f"{r(f'corr({ref}, {pred})', 6, f'pearson_{name}')}, {r(f'avg(abs({ref} - {pred}))', 6, f'mae_{name}')}, "
        f"{r(f'sqrt(avg(pow({ref} - {pred}, 2)))', 6, f'rmse_{name}')}"
    )


def _metrics(source: str, masks: dict[str, str]) -> str:
    body = f"count(*) AS n, {_agree('sl2rho', 'sl2_ref', 'sl2_pred')}, {_agree('rdg', 'rdg_ref', 'rdg_pred')}"
    return " UNION ALL ".join(f"SELECT '{k}' AS subset, {body} FROM {source} WHERE {m}" for k, m in masks.items())


_COMPARED = """(SELECT sl2rho AS sl2_ref, rdg AS rdg_ref, rho - 25e-2 + iz / 1e2 AS sl2_pred, rho * 3 + ix / 1e1 AS rdg_pred
  FROM {field} JOIN {grid} USING (mol_id, ix, iy, iz))"""
_EMPTY = {"all": "true", "attractive": "sl2_ref < 0", "trimmed": "false", "low_rdg": "rdg_ref <= 1"}
ORACLE["grid_compare"] = _metrics(_COMPARED, _EMPTY)
_BOUNDS = """(SELECT quantile_cont(rdg_ref, {q}) AS qr, quantile_cont(abs(sl2_ref), {q}) AS qs FROM {{pairs}})"""
ORACLE["trim_mask"] = f"""SELECT rdg_ref <= qr AND abs(sl2_ref) <= qs AS trimmed, count(*) AS n, max(rdg_ref) AS top_rdg,
  round(max(abs(sl2_ref)), 9) AS top_sl2 FROM {{pairs}}, {_BOUNDS.format(q=0.99)} GROUP BY 1"""
_MASKS = {
    "all": "true", "attractive": "sl2_ref < 0", "trimmed": "rdg_ref <= qr AND abs(sl2_ref) <= qs", "low_rdg": "rdg_ref <= 2",
}
_JUDGED = "(SELECT * FROM {pairs}, " + _BOUNDS.format(q=0.999).replace("{{", "{").replace("}}", "}") + ")"
ORACLE["subset_metrics"] = _metrics(_JUDGED, _MASKS)


def _ranks(column: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2e0"


def _spearman(source: str, masks: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{k}' AS subset, {r('corr(a, b)', 7, 'spearman_sl2rho')}, {r('corr(c, d)', 7, 'spearman_rdg')} FROM
  (SELECT {_ranks('sl2_ref')} AS a, {_ranks('sl2_pred')} AS b, {_ranks('rdg_ref')} AS c, {_ranks('rdg_pred')} AS d
   FROM {source} WHERE {m})"""
        for k, m in masks.items()
    )


ORACLE["spearman"] = _spearman(_JUDGED, _MASKS)
ORACLE["agreement"] = f"SELECT * FROM ({ORACLE['subset_metrics']}) m JOIN ({ORACLE['spearman']}) s USING (subset)"
_TRIMMED = f"""(WITH c AS {_COMPARED} SELECT * FROM c,
  (SELECT quantile_cont(rdg_ref, 0.9) AS qr, quantile_cont(abs(sl2_ref), 0.9) AS qs FROM c))"""
_GRID_MASKS = {**_MASKS, "low_rdg": "rdg_ref <= 1"}
ORACLE["grid_agreement"] = f"""SELECT * FROM ({_metrics(_TRIMMED, _GRID_MASKS)}) m
JOIN ({_spearman(_TRIMMED, _GRID_MASKS)}) s USING (subset)"""


def _histogram(source: str, x: str, y: str, bins: int) -> str:
    place = lambda c: f"least(floor(({c} - lo_{c}) * {bins} / (hi_{c} - lo_{c})), {bins - 1})::INT"
    ends = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in (x, y))
    return f"""WITH s AS (SELECT * FROM {source}), e AS (SELECT {ends} FROM s)
SELECT {place(x)} AS bx, {place(y)} AS "by", count(*) AS "count" FROM s, e GROUP BY ALL"""


ORACLE["parity_hist"] = _histogram("{pairs}", "rdg_ref", "rdg_pred", 40)
ORACLE["parity_hist_clipped"] = _histogram(
    """(SELECT p.* FROM {pairs} p, (SELECT quantile_cont(abs(sl2_ref), 0.999) AS a, quantile_cont(abs(sl2_pred), 0.999) AS b,
  quantile_cont(rdg_ref, 0.999) AS c, quantile_cont(rdg_pred, 0.999) AS d FROM {pairs}) q
  WHERE abs(sl2_ref) <= a AND abs(sl2_pred) <= b AND rdg_ref <= c AND rdg_pred <= d)""",
    "sl2_ref", "sl2_pred", 40,
)
ORACLE["sample_points"] = """SELECT event_id AS id, value FROM events
ORDER BY (event_id * 2654435761 + 7) % 4294967296, event_id LIMIT 500"""
ORACLE["overlay_extract"] = f"""SELECT {r('sl2_ref', 9, 'sl2_ref')}, {r('sl2_pred', 9, 'sl2_pred')}, rdg_ref, {r('rdg_pred', 9, 'rdg_pred')}
FROM {{pairs}} WHERE rdg_ref <= 2 AND rdg_pred <= 2"""

# The given texts hold no composed forms and no wrongly decoded ones, so cleaning them is dropping controls and trimming.
ORACLE["clean_names"] = r"""SELECT doc_id, coalesce(trim(regexp_replace(text, '[\p{Cc}\p{Cf}]', '', 'g')), '') AS cleaned FROM documents"""

# --- stored forms -----------------------------------------------------------------------------------

_VECTOR = ", ".join(f"f{i}" for i in range(1, 10))
ORACLE["batch_sheet"] = f"""SELECT n.mol_id || '.mol' AS "File", {_VECTOR},
  {r('CASE WHEN NOT isnan(snci) THEN snci END', 8, '"SNCI"')}, {r('scdi', 8, '"SCDI"')},
  {r('scdi_variance', 8, '"SCDI_variance"')}, {r('x', 8, '"SNCI_Norm"')}, {r('y', 8, '"SCDI_Norm"')}
FROM {_NORMED} n JOIN {{vectors}} USING (mol_id) JOIN (SELECT mol_id, snci, scdi, scdi_variance FROM {{records}}) k USING (mol_id)"""
ORACLE["record_texts"] = """SELECT mol_id, round(scdi, 8) AS scdi, f1, f9, 9::BIGINT AS n, true AS note_kept, 'none' AS solvent
FROM {records} JOIN {vectors} USING (mol_id) WHERE status = 'success'"""
ORACLE["field_texts"] = """SELECT mol_id, printf('%.8f %.8f %.8f %.10e %.10e', x, y, z, sl2rho, rdg) AS "value" FROM {field}"""
