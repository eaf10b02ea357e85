import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lambertlake.operators import methods as m
from lambertlake.plans import pipeline as pl
from lambertlake.storage import results as rs
from lambertlake.storage.project import Project, ProjectError
from tests.test_pipeline import PX, PY, X


@pytest.fixture(scope="module")
def assay(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("project") / "p")
    p = Project.create(spark, root, "demo", "ann")
    heard = []
    p.subscribe(heard.append)
    p.add_compound("X")
    div = p.add_spectrum("Y'", X, 10 * PY, role="divisor", concentrations={"X": 0.0, "Y": 10.0})
    with p.commit() as c:
        std = []
        for a in (4, 8, 12, 16, 20):
            i = c.put("spectra", **p._described(name=f"X{a}", npoints=len(X), role="standard", concentrations={"X": float(a), "Y": 0.0}))
            c.points(i, X, a * PX)
            std.append(i)
        mix = []
        for a, b in ((6, 10), (10, 6), (14, 14)):
            i = c.put("spectra", **p._described(name=f"mix {a} {b}", npoints=len(X), role="mixture", concentrations={"X": float(a), "Y": float(b)}))
            c.points(i, X, a * PX + b * PY)
            mix.append(i)
        c.log("IMPORT", "spectrum", None, "assay", {"outputs": std + mix})
    method = m.Univariate("X", [{"op": "divide", "params": {"reference": div}}], {"kind": "difference", "params": {"w1": 240.0, "w2": 262.0}})
    method.fit(p.spectra(std), pl.Library.of(p.table("points"), method.steps))
    mid = p.save_method("RD", json.loads(json.dumps(method.definition())) | {"calibration_ids": std})
    rid = rs.determine(p, mid, mix, "assay of X")
    return {"p": p, "div": div, "std": std, "mix": mix, "method": mid, "result": rid, "root": root, "heard": heard}


def test_results(assay):
    rows = rs.result_rows(assay["p"], assay["result"]).orderBy("spectrum_id").collect()
    assert [r.recovery for r in rows] == pytest.approx([100] * 3, rel=0.01) and not any(r.stale for r in rows) and all(r.ci is not None for r in rows)
    s = rs.result_summary(assay["p"], assay["result"]).collect()[0]
    assert s.n == 3 and s["mean"] == pytest.approx(100, rel=0.01)
    assert ("CREATE", "result", assay["result"]) in [e for h in assay["heard"] for e in h]


def test_log_and_tampering(spark, assay):
    p = Project.open(spark, assay["root"])
    assert p.verify() == []
    assert p.audit(action="OPEN").count() == 1 and p.audit(text="ASSAY", limit=5).count() >= 1
    assert p.history(assay["div"]).count() >= 2
    import glob

    victim = next(f for f in glob.glob(f"{assay['root']}/points/commit=*/part-*.parquet") if spark.read.parquet(f).count())
    saved = open(victim, "rb").read()
    rows = spark.read.parquet(victim).collect()
    altered = spark.createDataFrame([(r.id, r.x, [v + 1 for v in r.y], r.data_sha256) for r in rows], "id long, x array<double>, y array<double>, data_sha256 string")
    altered.coalesce(1).write.mode("overwrite").parquet(f"{assay['root']}/_alt")
    open(victim, "wb").write(open(glob.glob(f"{assay['root']}/_alt/part-*")[0], "rb").read())
    crc = glob.glob(f"{victim.rpartition('/')[0]}/.*.crc")
    held = {c: open(c, "rb").read() for c in crc}
    import os

    for c in crc:
        os.remove(c)
    assert any("altered" in x for x in p.verify())
    open(victim, "wb").write(saved)
    for c, b in held.items():
        open(c, "wb").write(b)
    assert p.verify() == []


def test_every_alteration_is_reported(spark, tmp_path, monkeypatch):
    p = Project.create(spark, str(tmp_path / "p"), "s")
    with p.commit() as c:
        for i in range(30):
            c.log("NOTE", "audit", None, f"note {i}")
    n = p.state["seq"]
    log = p.table("audit").withColumn("summary", F.concat("summary", F.lit("!")))
    points = spark.range(1, 26).select("id", F.array(F.lit(1.0)).alias("x"), F.array(F.lit(2.0)).alias("y"), F.lit("no").alias("data_sha256"))
    monkeypatch.setattr(p, "table", {"audit": log, "points": points}.__getitem__)
    assert p.verify() == [f"log entry {i} was altered or its predecessor is missing" for i in range(1, n + 1)] + [f"points of spectrum {i} were altered" for i in range(1, 26)]
    assert n >= 30


def test_failed_changes_leave_no_trace(assay):
    p = assay["p"]
    p._load()
    before = p.state["n"], p.table("audit").count()
    with pytest.raises(RuntimeError):
        with p.commit() as c:
            c.put("compounds", name="lost")
            c.log("CREATE", "compound", 1, "lost")
            raise RuntimeError
    assert (p.state["n"], p.table("audit").count()) == before
    with p.commit():
        with pytest.raises(ProjectError, match="another writer"):
            with p.commit():
                pass
    with pytest.raises(ProjectError):
        p.add_compound("X")
    assert p.edit("spectra", assay["div"], {"name": "Y'"}) is False


def test_edits_propagate_and_undo(assay):
    p = assay["p"]
    first, second = p.process([assay["mix"][0]], [{"op": "divide", "params": {"reference": assay["div"]}}]), None
    second = p.process(first, [{"op": "derivative", "params": {}}])
    assert p.lineage(second[0]) == [second[0], first[0], assay["mix"][0]]
    assert p.descendants([assay["div"]]) == [first[0], second[0]]
    assert {r.id: r.reproduced for r in p.replay().collect()} == {first[0]: True, second[0]: True}
    changed = p.set_concentrations({assay["mix"][0]: {"X": 7.0, "Y": 10.0}}, "typing error")
    assert changed == [assay["mix"][0], first[0], second[0]]
    assert rs.stale(p) == [assay["result"]] and p.usage([assay["mix"][0]])["results"] == [assay["result"]]
    entry = next(e for e in p.undoable() if e["entity_id"] == assay["mix"][0])
    p.undo(entry["seq"], "was right before")
    assert rs.stale(p) == []
    with pytest.raises(ProjectError):
        p.undo(entry["seq"], "again")
    mapping = p.revise_processing(first[0], [{"op": "divide", "params": {"reference": assay["div"], "threshold": 1e-3}}], "other threshold")
    assert set(mapping) == {first[0], second[0]} and p.row("spectra", first[0])["archived"]
    assert p.row("spectra", mapping[second[0]])["parent_ids"][0] == mapping[first[0]]
    with pytest.raises(ProjectError, match="reason"):
        p.revise_processing(mapping[first[0]], [], " ")
    revise = next(e for e in p.undoable() if e["action"] == "REVISE")
    p.undo(revise["seq"], "back")
    assert not p.row("spectra", first[0])["archived"] and p.row("spectra", mapping[first[0]])["archived"]
    assert p.verify() == []


def test_recalculation_versions_and_model_files(spark, assay, tmp_path):
    p = assay["p"]
    p.set_concentrations({assay["std"][0]: {"X": 4.2, "Y": 0.0}}, "weighed again")
    done = rs.recalculate(p, [assay["std"][0]])
    assert set(done["methods"]) == {assay["method"]} and set(done["results"]) == {assay["result"]} and not done["skipped"]
    new = done["results"][assay["result"]]
    assert p.versions("results", new) == [assay["result"], new] == p.versions("results", assay["result"])
    assert "revision_of" in p.compare("results", assay["result"], new)
    assert rs.exclude(p, new, [assay["mix"][0]], "spilled")
    document = rs.export_model(p, done["methods"][assay["method"]])
    other = Project.create(spark, str(tmp_path / "q"), "other")
    got = rs.import_model(other, json.loads(json.dumps(document)))
    ident = other.add_spectrum("m", X, 9 * PX + 4 * PY)
    data = json.loads(other.row("results", rs.determine(other, got, [ident], "r"))["data"])
    assert data["found"][0][0] == pytest.approx(9, rel=0.03)
    document["definition"]["compound"] = "Z"
    with pytest.raises(ProjectError, match="altered"):
        rs.import_model(other, document)
    rs.export_workbook(p, str(tmp_path / "r.xlsx"))
    p.export_audit(str(tmp_path / "log.csv"))
    assert "intact" in rs.report(p) and (tmp_path / "log.csv").read_text("utf-8-sig").startswith("seq,")
    assert len(rs.validation_plan("X", 4, 20, 10)) == 6
    other.import_frame(spark.createDataFrame([("b", X.tolist(), (k * PX).tolist()) for k in range(1, 5)], "name string, x array<double>, y array<double>"))
    assert other.records().count() == 6 and other.verify() == [] and np.isfinite(other.spectra().count())
