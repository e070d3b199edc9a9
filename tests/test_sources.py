import math

import pytest
from pyspark.sql import functions as F

from molframe.functions import names
from molframe.operators import batch
from molframe.operators.paths import resolve_paths
from molframe.sources import bondorders, corpus, grids, logs, molden, results, structures, surface, text
from molframe.sources.text import read_documents, read_rows


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "mol_id string, text string")


def rows(spark, lines):
    return spark.createDataFrame([("m", x) for x in lines], "mol_id string, line string")


def mol_line(x, y, z, el):
    return f"{x:10.4f}{y:10.4f}{z:10.4f} {el:<3} 0  0"


MOL = "\n".join(
    ["water", "", "", "  3  2  0  0  0  0            999 V2000", mol_line(0, 0, 0, "O"), mol_line(0.96, 0, 0, "H"),
     mol_line(-0.24, 0.93, -1.5, "H"), "  1  2  1  0", "  3  1  4  0", "M  END"]
)


def test_mol_and_sdf(spark):
    bad = MOL.replace("    0.9600", "    0.9x00")
    texts = {"good": MOL, "sdf": MOL + "\n$$$$\n" + MOL.replace("  3  2", "  1  0"), "bad": bad, "short": MOL[:150], "empty": ""}
    parsed = structures.parse_mol(docs(spark, texts))
    atoms = {(r.mol_id, r.atom): r for r in structures.atoms_of(parsed).collect()}
    assert {m for m, _ in atoms} == {"good", "sdf"} and len(atoms) == 6
    assert (atoms["good", 2].el, atoms["good", 2].an, atoms["good", 2].mass) == ("H", 1, 1.008)
    assert (atoms["good", 2].x, atoms["good", 2].z) == (-0.24, -1.5)
    bonds = {tuple(r) for r in structures.bonds_of(parsed).collect()}
    assert bonds == {(m, a, b) for m in ("good", "sdf") for a, b in ((0, 1), (0, 2))}
    reasons = {r.mol_id: r.reason for r in structures.rejects_of(parsed, "structure").collect()}
    assert reasons["bad"] == "unreadable atom line" and set(reasons) == {"bad", "short", "empty"}


def test_xyz(spark):
    texts = {"ok": "2\nnote\nO 0.0 0 0\n  H\t1e0 0 0 9\n", "few": "3\n\nH 0 0 0\n", "bad": "1\n\nH 0 zero 0\n", "none": "x"}
    parsed = structures.parse_xyz(docs(spark, texts))
    assert [(r.el, r.x) for r in structures.atoms_of(parsed).orderBy("atom").collect()] == [("O", 0.0), ("H", 1.0)]
    assert {r.mol_id for r in structures.rejects_of(parsed, "structure").collect()} == {"few", "bad", "none"}


WAVE = """[Title]
 [ATOMS] angs
 O 1 8 1.0 0 0D0
 short row
[GTO]
 1 0
 s 2
 5 1

 2D-01 3
 sp 1 1.0
 p 1 2.0
 0.5 0.25
[MO]
ignored 1 2
Sym= a
Occup= 1.0
Spin= Alpha
 1 0.5
 +2 -1D-1
 three 9
Sym= b
 7 1
 7 2
"""


def test_wavefunction_details(spark):
    texts = {
        "ok": WAVE,
        "dup": "[Atoms] AU\nX 1 1 9 9 9\n" + WAVE,
        "nomo": WAVE.split("[MO]")[0],
        "nocentre": WAVE.replace(" 1 0\n s 2", " s 2"),
        "cut": WAVE.split(" 0.5 0.25")[0] + "[MO]" + WAVE.split("[MO]")[1],
        "uneven": WAVE + " 8 3\n",
    }
    parsed = {r.mol_id: r for r in molden.parse_wavefunction(docs(spark, texts)).collect()}
    assert {m: r.reason for m, r in parsed.items()} == {
        "ok": None, "dup": None, "nomo": "missing section", "nocentre": "shell before centre",
        "cut": "unreadable shell", "uneven": "orbitals of unequal length",
    }
    for m in ("ok", "dup"):
        assert [a.x for a in parsed[m].atoms] == [1.8897259886]
        assert [(s.center, s.l, [tuple(p) for p in s.prims]) for s in parsed[m].shells] == [
            (0, 0, [(5.0, 1.0), (0.2, 3.0)]), (0, 1, [(0.5, 0.5)]),
        ]
        assert [(o.occ, o.coef) for o in parsed[m].orbitals] == [(1.0, [0.5, -0.1]), (0.0, [1.0, 2.0])]


def test_grid_rows_and_required_columns(spark):
    lines = ["# x y z", "", "1 2 3 4", "1 2 3 4 five", " 1 2 3 -4e-2 5 6", "nan 0 0 0 0"]
    got = grids.parse_grid_rows(rows(spark, lines)).collect()
    assert [tuple(r)[1:] for r in got][0] == (1.0, 2.0, 3.0, -0.04, 5.0)
    assert len(got) == 2 and math.isnan(got[1].x)
    with pytest.raises(ValueError, match="rdg.*z"):
        grids.require_field(spark.createDataFrame([(1.0, 2.0, 3.0)], "x double, y double, sl2rho double"))


def test_segments(spark):
    text = "$segment_information\n# c\n1 2 3 4 5 6 7\n1 2 3 4 5 6 7 nan\n1 2 3 4 5 6 7 8d\n1 2 3 4 5 6 7 8 9\n$x\n$segment_information\n9 9 9 9 9 9 9 9\n"
    got = surface.parse_segments(docs(spark, {"m": text, "none": "1 2 3 4 5 6 7 8"})).collect()
    assert [(r.seg_no, len(r.v)) for r in got] == [(0, 8), (1, 9)]


def test_bond_orders(spark):
    got = bondorders.parse_bond_orders(rows(spark, ["1 2 0.5 x", "1 2", "a 2 3", "1.0 2 3", " 3  1  1e-1"])).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1, 0.5), (2, 0, 0.1)]


def test_logs(spark):
    head = "molecular dipole:\n"
    texts = {
        "second": head + " full: 1 2 x\n" + head + " q only: 1\n full: 1 2 3.5\nMol. α(0) /au : 9.5",
        "far": head + "-\n" * 9 + " full: 7\ntotal dipole moment:   2.5 Debye\nisotropic polarizability: 4",
        "last": head + "-\n" * 8 + " full: 7\nMol. alpha /au    :   3.25",
        "none": "isotropic polarizability: 4",
        "half": head + "full: 1",
    }
    got = {r.mol_id: r for r in logs.scrape_logs(docs(spark, texts)).collect()}
    assert (got["second"].dipole, got["second"].polarizability) == (3.5, 9.5)
    assert (got["far"].dipole, got["far"].polarizability) == (2.5, 4.0)
    assert (got["last"].dipole, got["last"].polarizability) == (7.0, 3.25)
    assert got["none"].reason == "dipole not found" and got["half"].reason == "polarizability not found"


def test_results_and_timings(spark):
    texts = {
        "ok": '{"SNCI": 1.5, "SCDI": null, "SCDI_variance": NaN, "my_vector": [1, 2.5], "metadata": {"fragments": 2}}',
        "cut": '{"SNCI": 1.5, "SCDI"',
        "junk": "nothing",
    }
    got = {r.mol_id: r for r in results.parse_results(docs(spark, texts)).collect()}
    assert (got["ok"].readable, got["ok"].snci, got["ok"].scdi, got["ok"].scdi_variance) == (True, 1.5, None, None)
    assert (got["ok"].f, got["ok"].fragments) == ([1.0, 2.5], 2)
    assert not got["cut"].readable and not got["junk"].readable and got["cut"].snci is None
    timing = '{"batch_workers_monitor": {"4": {"wall_time_sec": 2.5}, "8": {}}}'
    rows = results.parse_timings(docs(spark, {"f": timing, "bad": '{"batch_workers_monitor": 7}'}))
    assert {(r.file, r.setting, r.seconds) for r in rows.collect()} == {("f", 4, 2.5), ("f", 8, 0.0)}
    assert batch.best_setting(rows).first().setting == 4


def test_names_on_disk_are_one_key(spark, tmp_path):
    names = ["a b.mol", "a+b.mol", "é.mol", "50%#1.mol"]
    for name in names:
        (tmp_path / name).write_text("x\n")
    whole = {r.mol_id for r in text.read_documents(spark, str(tmp_path)).collect()}
    assert whole == {r.path for r in corpus.list_files(spark, str(tmp_path)).collect()} == {r.mol_id for r in text.read_rows(spark, str(tmp_path)).collect()}
    assert {p.rsplit("/", 1)[1] for p in whole} == set(names)


def test_unknown_elements_and_centres_are_rejected(spark):
    block = lambda e: "\n\n\n  1  0  0  0 V2000\n" + mol_line(0, 0, 0, e) + "\nM  END\n"
    got = {r.mol_id: r.reason for r in structures.parse_mol(docs(spark, {e: block(e) for e in ("Pu", "Qq", "D")})).collect()}
    assert got == {"Pu": None, "Qq": "unknown element", "D": None}
    xyz = {e: f"1\n\n{e} 0 0 0\n" for e in ("Og", "Zz")}
    assert {r.mol_id: r.reason for r in structures.parse_xyz(docs(spark, xyz)).collect()} == {"Og": None, "Zz": "unknown element"}
    gto = "[Atoms] AU\nH 1 1 0 0 0\n[GTO]\n{} 0\n s 1 1.0\n 1.5 1.0\n[MO]\n Sym= A\n Occup= 2.0\n 1 1.0\n"
    wave = {str(n): gto.format(n) for n in (1, 0, 99)}
    got = {r.mol_id: r.reason for r in molden.parse_wavefunction(docs(spark, wave)).collect()}
    assert got["1"] is None and {got["0"], got["99"]} == {"shell centre out of range"}


def test_names(spark):
    broken = "é.mol".encode().decode("latin-1")
    cases = {
        "plain.MOL ": ("plain.MOL", ".mol"), broken: ("é.mol", ".mol"), "ﬁle.x​yz": ("file.xyz", ".xyz"),
        "a\x07b.sdf": ("ab.sdf", ".sdf"), ".hidden": (".hidden", ""), "no": ("no", ""), "x.möl": ("x.möl", ".ml"),
        "Ã©t.pdb": ("ét.pdb", ".pdb"), "é.mol2": ("é.mol2", ".mol2"),
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    got = df.withColumn("c", names.clean_name(F.col("n"))).withColumn("e", names.file_extension(F.col("c"), F.col("n")))
    assert {r.n: (r.c, r.e) for r in got.collect()} == cases


def test_resolve_paths(spark):
    listing = spark.createDataFrame([("/a/B.mol", 0), ("/a/b.MOL", 1), ("/c/b.mol", 2), ("/a/é.xyz", 3)], "path string, pos int")
    asked = ["/a/b.mol", "/a/b.MOL", "/a/zz", "/a/" + "é.xyz".encode().decode("latin-1"), "/d/b.mol"]
    wanted = spark.createDataFrame([(p,) for p in asked], "path string")
    got = {r.path: (r.resolved, r.how) for r in resolve_paths(wanted, listing).collect()}
    assert [got[p] for p in asked] == [
        ("/a/B.mol", "matched"), ("/a/b.MOL", "exact"), ("/a/zz", "unresolved"), ("/a/é.xyz", "matched"), ("/d/b.mol", "unresolved"),
    ]


def test_listing(spark, tmp_path):
    for name in ("b.mol", "a.XYZ", "c.txt", "d.sdf"):
        (tmp_path / name).write_text("x\ny")
    (tmp_path / "sub.mol").mkdir()
    (tmp_path / "sub.mol" / "e.mol").write_text("x")
    got = corpus.scan_corpus(spark, str(tmp_path)).collect()
    assert [(r.file, r.ext, r.length) for r in got] == [("a.XYZ", ".xyz", 3), ("b.mol", ".mol", 3), ("d.sdf", ".sdf", 3)]
    assert read_documents(spark, str(tmp_path / "b.mol")).first().text == "x\ny"
    assert read_rows(spark, str(tmp_path / "b.mol")).count() == 2
