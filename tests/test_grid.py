import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from molframe.bindings import queries
from molframe.bindings.views import view
from molframe.operators import basis, compare, density, grid, moments, stencil
from molframe.plans.compare import checked_reference, compare_wavefunctions
from molframe.sources import molden
from molframe.sources.sinks import field_lines

SHAPES = {"a": (13, 7, 5), "b": (2, 3, 4), "c": (21, 4, 9)}


def points_of(spark, arrays, h=0.3):
    rows = [
        (m, *map(int, i), float(u[i]), h, *u.shape) for m, u in arrays.items() for i in np.ndindex(*u.shape)
    ]
    return spark.createDataFrame(
        rows, "mol_id string, ix int, iy int, iz int, rho double, h double, nx int, ny int, nz int"
    )


def plain_differences(u, h):
    """Point by point, straight from the definitions."""
    out = {d: np.zeros(u.shape) for d in stencil.DERIVATIVES}

    def at(i, axis, k):
        j = list(i)
        j[axis] += k
        return u[tuple(j)]

    for i in np.ndindex(*u.shape):
        for axis, c in enumerate("xyz"):
            n = u.shape[axis]
            if i[axis] == 0:
                g = (at(i, axis, 1) - u[i]) / h
            elif i[axis] == n - 1:
                g = (u[i] - at(i, axis, -1)) / h
            else:
                g = (at(i, axis, 1) - at(i, axis, -1)) / (2 * h)
            out[f"g{c}"][i] = g
            if n >= 3:
                k = min(max(i[axis], 1), n - 2) - i[axis]
                out[f"h{c}{c}"][i] = (at(i, axis, k + 1) - 2 * at(i, axis, k) + at(i, axis, k - 1)) / h**2
        for a, b in ((0, 1), (0, 2), (1, 2)):
            if 0 < i[a] < u.shape[a] - 1 and 0 < i[b] < u.shape[b] - 1:
                def corner(p, q):
                    j = list(i)
                    j[a] += p
                    j[b] += q
                    return u[tuple(j)]

                out[f"h{'xyz'[a]}{'xyz'[b]}"][i] = (corner(1, 1) - corner(1, -1) - corner(-1, 1) + corner(-1, -1)) / (4 * h * h)
    return out


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(4)
    return {m: rng.random(s) for m, s in SHAPES.items()}


@pytest.mark.parametrize("brick", [40, 4])
def test_differences_in_bricks(spark, arrays, brick):
    got = stencil.derivatives(points_of(spark, arrays), brick).collect()
    assert len(got) == sum(u.size for u in arrays.values())
    want = {m: plain_differences(u, 0.3) for m, u in arrays.items()}
    for row in got:
        for d in stencil.DERIVATIVES:
            assert row[d] == pytest.approx(want[row.mol_id][d][row.ix, row.iy, row.iz], abs=1e-9), (row, d)


def test_field_against_eigenvalues(spark, arrays):
    got = stencil.interaction_field(points_of(spark, arrays), brick=5).collect()
    scale = 1 / (2 * (3 * math.pi**2) ** (1 / 3))
    want = {m: plain_differences(u, 0.3) for m, u in arrays.items()}
    for row in got:
        d = {k: v[row.ix, row.iy, row.iz] for k, v in want[row.mol_id].items()}
        hessian = [[d["hxx"], d["hxy"], d["hxz"]], [d["hxy"], d["hyy"], d["hyz"]], [d["hxz"], d["hyz"], d["hzz"]]]
        middle = np.linalg.eigvalsh(hessian)[1]
        rdg = scale * math.sqrt(d["gx"] ** 2 + d["gy"] ** 2 + d["gz"] ** 2) / row.rho ** (4 / 3)
        assert row.rdg == pytest.approx(rdg, rel=1e-9)
        if abs(middle) > 1e-9:
            assert row.sl2rho == math.copysign(row.rho, middle)


def test_sign_of_a_middle_eigenvalue_at_rounding_level():
    """Prices of three given parts: their second difference is zero up to rounding, and with it the middle eigenvalue."""
    rows = (0.17586, 0.175878, 0.17589600000000002)
    u = np.empty((3, 3, 3))
    for i, j, k in np.ndindex(3, 3, 3):
        u[i, j, k] = rows[k] + 0.25 * i * i - 0.125 * j * j
    assert np.array_equal(stencil._second(u, 0.5, 2)[0, 0], np.full(3, (rows[2] - 2 * rows[1] + rows[0]) / 0.25))
    for diagonal in itertools.permutations((0.5, 0.0, -0.25)):
        exact = [np.array([v]) for v in (*diagonal, 0.0, 0.0, 0.0)]
        t = sum(diagonal) / 3
        p = math.sqrt(sum((v - t) * (v - t) for v in diagonal) / 6)
        det = math.prod(v - t for v in diagonal)
        turn = math.acos(max(-1.0, min(1.0, det / (2 * p * p * p)))) / 3
        plain = 3 * t - (t + 2 * p * math.cos(turn)) - (t + 2 * p * math.cos(turn + 2 * math.pi / 3))
        assert stencil.middle_eigenvalues(exact)[0] == plain


def test_eigenvalue_columns(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, rng.normal(size=6))) for _ in range(200)] + [(2.0, 2.0, 2.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "hxx double, hyy double, hzz double, hxy double, hxz double, hyz double")
    for r in stencil.with_middle_eigenvalue(df).collect():
        m = [[r.hxx, r.hxy, r.hxz], [r.hxy, r.hyy, r.hyz], [r.hxz, r.hyz, r.hzz]]
        assert r.lambda2 == pytest.approx(np.linalg.eigvalsh(m)[1], abs=1e-9)


def test_density_values_are_tidied_and_thin_grids_rejected(spark):
    bad = np.array([1.0, math.nan, math.inf, -math.inf, -1.0, 2.0, 3.0, 4.0]).reshape(2, 2, 2)
    points = points_of(spark, {"bad": bad, "thin": np.ones((1, 3, 3))})
    got = {(r.ix, r.iy, r.iz): r.rho for r in stencil.derivatives(points).collect()}
    assert [got[i] for i in np.ndindex(2, 2, 2)] == [1.0, 0.0, 1e20, 0.0, 0.0, 2.0, 3.0, 4.0]
    assert [r.mol_id for r in stencil.too_thin(points).collect()] == ["thin"]


def test_below_the_floor_rdg_is_zero(spark):
    points = points_of(spark, {"m": np.full((3, 3, 3), 1e-13)})
    assert {r.rdg for r in stencil.interaction_field(points).collect()} == {0.0}


def test_grid_follows_arange(spark):
    rng = np.random.default_rng(8)
    ends = [(f"m{i}", *[float(v) for lo in rng.uniform(-3, 3, 3) for v in (lo, lo + rng.uniform(0, 4))]) for i in range(20)]
    names = [f"{c}{e}" for c in "xyz" for e in ("min", "max")]
    specs = grid.grid_specs(spark.createDataFrame(ends, ["mol_id", *names]), 0.5, 1.0)
    h, pad = 0.5 * 1.8897259886, 1.8897259886
    points = grid.grid_points(specs, brick=3).collect()
    for m, *e in ends:
        axes = [np.arange(lo - pad, hi + pad + 0.5 * h, h) for lo, hi in zip(e[::2], e[1::2])]
        own = [r for r in points if r.mol_id == m]
        assert len(own) == math.prod(map(len, axes)) == len({(r.ix, r.iy, r.iz) for r in own})
        for r in own:
            assert (r.x, r.y, r.z) == pytest.approx([a[i] for a, i in zip(axes, (r.ix, r.iy, r.iz))], abs=1e-12)


@pytest.mark.parametrize("options", [(0.0, 1.0), (-0.1, 1.0), (0.2, -1.0)])
def test_bad_grid_options(spark, options):
    with pytest.raises(ValueError):
        grid.grid_specs(spark.range(1), *options)


WAVE = """[Molden Format]
[Atoms] AU
 O 1 8 0.0 0.1 -0.2
 H 2 1 1.5 0.0 0.3
[GTO]
  1 0
 s 2 1.00
  1.2D+00 0.5
  0.3 0.7
 p 1 1.00
  0.8 0.9

  2 0
 d 1 2.0
  0.6 0.4

[MO]
 Sym= 1a
 Ene= -1.0
 Occup= 2.0
{first}
 Sym= 2a
 Occup= 1.0
{second}
 Sym= 3a
 Occup= 0.0
{second}
"""
COEFS = [[0.1 * (i + 1) * (-1) ** i for i in range(10)], [0.3 - 0.05 * i for i in range(10)]]


def wave_text(coefs=COEFS):
    lines = ["\n".join(f"  {i + 1} {c:.6f}" for i, c in enumerate(cs)) for cs in coefs]
    return WAVE.format(first=lines[0], second=lines[1])


def waves(spark, texts):
    return molden.parse_wavefunction(spark.createDataFrame(list(texts.items()), "mol_id string, text string"))


def plain_density(p, normalise=False):
    functions = [((0, 0.1, -0.2), w, [(1.2, 0.5), (0.3, 0.7)]) for w in [(0, 0, 0)]]
    functions += [((0, 0.1, -0.2), w, [(0.8, 0.9)]) for w in [(1, 0, 0), (0, 1, 0), (0, 0, 1)]]
    functions += [((1.5, 0, 0.3), w, [(0.6, 0.8)]) for w in [(2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1)]]
    odd = {0: 1, 1: 1, 2: 3}
    phi = []
    for c, w, prims in functions:
        d = [a - b for a, b in zip(p, c)]
        r2 = sum(v * v for v in d)
        total = 0.0
        for a, k in prims:
            if normalise:
                k = k * (2 * a / math.pi) ** 0.75 * (4 * a) ** (sum(w) / 2) / math.sqrt(math.prod(odd[q] for q in w))
            total += k * math.exp(-a * r2)
        phi.append(math.prod(v**q for v, q in zip(d, w)) * total)
    return sum(o * sum(c * f for c, f in zip(cs, phi)) ** 2 for o, cs in zip((2.0, 1.0), COEFS))


@pytest.mark.parametrize("normalise", [False, True])
def test_density_from_text(spark, normalise):
    wf = waves(spark, {"m": wave_text()})
    got = density.density(wf, 0.7, 0.6, brick=3, normalise=normalise).collect()
    assert len(got) > 30
    for r in got:
        assert r.rho == pytest.approx(plain_density((r.x, r.y, r.z), normalise), rel=1e-10)


def test_wavefunction_texts_are_dealt_to_all_tasks(spark, tmp_path):
    """A short table in one file is not one task: its texts take long to read."""
    spark.range(200).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    docs = queries._wave_docs(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plain = view(spark, str(tmp_path), "wave_docs")
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, plain.collect()))


def test_field_in_one_pass_equals_field_from_points(spark):
    wf = waves(spark, {"m": wave_text()})
    direct = {(r.ix, r.iy, r.iz): r for r in density.field(wf, 0.5, 0.8, brick=4).collect()}
    points = density.density(wf, 0.5, 0.8).withColumn("h", F.lit(0.5 * 1.8897259886))
    for r in stencil.interaction_field(stencil.with_shape(points)).collect():
        d = direct.pop((r.ix, r.iy, r.iz))
        assert (d.rho, d.rdg) == pytest.approx((r.rho, r.rdg), rel=1e-9)
        assert abs(d.sl2rho) == pytest.approx(abs(r.sl2rho), rel=1e-9, abs=1e-15)
    assert not direct


def test_basis_rules(spark):
    short = wave_text([c[:9] for c in COEFS])  # nine coefficients: the count of spherical functions
    texts = {"ok": wave_text(), "spherical": short, "bad": wave_text([c[:5] for c in COEFS]), "uneven": wave_text([COEFS[0], COEFS[1][:9]])}
    wf = waves(spark, texts)
    verdicts = {r.mol_id: r.verdict for r in basis.basis_guard(wf).collect()}
    assert verdicts == {"ok": "ok", "spherical": "unsupported", "bad": "mismatch"}
    assert {r.mol_id: r.reason for r in wf.filter("reason is not null").collect()} == {"uneven": "orbitals of unequal length"}
    assert [r.mol_id for r in basis.usable(wf).collect()] == ["ok"]
    rows = basis.expand_basis(basis.usable(wf)).orderBy("mu").collect()
    assert [(r.lx, r.ly, r.lz) for r in rows[4:]] == [(2, 0, 0), (0, 2, 0), (0, 0, 2), (1, 1, 0), (1, 0, 1), (0, 1, 1)]
    assert rows[4].prims[0].coef == 0.8


def test_moments(spark):
    values = {"mixed": [-1.0, -2.0, -10.0, 3.0, math.nan], "none": [1.0, 2.0], "same": [-0.1] * 7, "one": [-4.0]}
    rows = [(m, float(i), 0.0, 0.0, v) for m, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "mol_id string, x double, y double, z double, sl2rho double")
    got = {r.mol_id: r for r in moments.field_terms(df).collect()}
    v = np.array([-1.0, -2.0, -10.0])
    skew = np.mean((v - v.mean()) ** 3) / v.std() ** 3
    assert (got["mixed"].f6, got["mixed"].f7, got["mixed"].f8) == (3, pytest.approx(v.mean()), pytest.approx(v.std()))
    assert got["mixed"].f9 == pytest.approx(skew) and got["mixed"].snci == 13.0
    assert tuple(got["none"])[1:] == (0.0, 0, 0.0, 0.0, 0.0)
    assert (got["same"].f8, got["same"].f9) == (pytest.approx(0, abs=1e-12), 0.0)
    assert (got["one"].f6, got["one"].f8, got["one"].f9) == (1, 0.0, 0.0)


def test_comparison_on_the_reference_grid(spark):
    wf = waves(spark, {"m": wave_text()})
    own = density.field(wf, 0.5, 0.8)
    stored = own.select("mol_id", *[(F.col(c) / 1.8897259886).alias(c) for c in "xyz"], "sl2rho", "rdg")
    got = {r.subset: r for r in compare_wavefunctions(stored, wf).collect()}
    assert got["all"].n == own.count() and set(got) == set(compare.SUBSETS)
    assert got["all"].pearson_rdg == pytest.approx(1.0, abs=1e-6)
    assert got["trimmed"].n < got["all"].n
    with pytest.raises(ValueError, match="complete"):
        checked_reference(stored.filter("x > 0 or y > 0"))


def test_text_rows(spark):
    df = spark.createDataFrame([("m", 0, 0, 0, 1.8897259886, 0.0, -1.0, -0.25, 2.5)], "mol_id string, ix int, iy int, iz int, x double, y double, z double, sl2rho double, rdg double")
    assert field_lines(df, "angstrom").first().value == "1.00000000 0.00000000 -0.52917725 -2.5000000000e-01 2.5000000000e+00"
