import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lambertlake.sources import blocks, exchange, reader

X = np.arange(200, 230.5, 2.0)


def made(spark, n, names=None):
    y = F.array(*(F.sin(F.col("id") * 0.1 + float(v)) for v in X))
    name = F.concat(F.lit("s"), F.col("id").cast("string")) if names is None else F.element_at(F.array(*map(F.lit, names)), (F.col("id") + 1).cast("int"))
    return spark.range(n).select(name.alias("name"), F.array(*(F.lit(float(v)) for v in X)).alias("x"), y.alias("y"))


def points(df):
    return sorted((r.name, tuple(r.x), tuple(r.y)) for r in df.select("name", "x", "y").collect())


def parts(path, size):
    found = blocks.files_of(path)
    return [p for i in found for p in blocks.parts_of(i.path, i.size, size)]


def test_one_file_of_ten_thousand_blocks_is_read_by_several_tasks(spark, tmp_path):
    df = made(spark, 10_000).coalesce(1)
    blocks.write(df, str(tmp_path / "j"), per_file=20_000)
    (file,) = blocks.files_of(str(tmp_path / "j"))
    cut = parts(str(tmp_path / "j"), 1 << 18)
    assert len(cut) > 10 and {p.kind for p in cut} == {blocks.JCAMP}
    got = blocks.read(spark, str(tmp_path / "j"), 1 << 18)
    assert got.rdd.getNumPartitions() == len(cut)
    want = points(df)
    assert points(got) == want
    assert points(reader.read_files(spark, file.path)) == want  # read whole


def test_ranges_own_every_block_once(tmp_path):
    texts = [exchange.write_jcamp(f"b{k}", X, X * k) for k in range(40)]
    texts[7] = "##TITLE=outer\n##JCAMP-DX=4.24\n##BLOCKS=2\n" + texts[7]
    texts[9] = texts[9].replace("\n", "\r\n")
    texts[11] = texts[11].replace("##TITLE=", "## title = ")
    path = tmp_path / "f.jdx"
    path.write_text("".join(texts), newline="")
    raw = path.read_bytes()
    want = [f.name for f in reader.parse_file("f.jdx", raw)]
    for size in (1, 7, 100, 333, 5000, len(raw) - 1):
        found = []
        for p in parts(str(path), size) if size > 1 else [blocks.Part(str(path), blocks.JCAMP, k, k + 1) for k in range(len(raw))]:
            with open(path, "rb") as f:
                found += [x.name for _, block in blocks.jcamp_blocks(f, p.start, p.stop) for x in exchange.parse_jcamp(block, "f", none=True)]
        assert found == want, size


@pytest.mark.parametrize("own", [False, True])
def test_subfiles_are_read_by_number(spark, tmp_path, own):
    spectra = [(X + own * k, np.cos(X + k)) for k in range(300)]
    path = tmp_path / "many.spc"
    path.write_bytes(exchange.write_spc(spectra, "note"))
    cut = parts(str(path), 4096)
    assert len(cut) > 5 and {p.kind for p in cut} == {blocks.SPC}
    whole = reader.read_files(spark, str(path))
    got = blocks.read(spark, str(path), 4096)
    assert points(got) == points(whole) and got.first().metadata["COMMENT"] == "note"


@pytest.mark.parametrize("layout,exact", [("jcamp", True), ("rows", True), ("spc", False)])
def test_layouts_round_trip(spark, tmp_path, layout, exact):
    df = made(spark, 100).repartition(3)
    blocks.write(df, str(tmp_path / "o"), layout, per_file=20)
    assert len(blocks.files_of(str(tmp_path / "o"))) >= 6 and not os.path.exists(tmp_path / "o" / blocks.PENDING)
    got = blocks.read(spark, str(tmp_path / "o"))
    if exact:
        assert points(got) == points(df)
    else:
        a, b = (sorted(tuple(np.round(r.y, 5)) for r in d.select("y").collect()) for d in (got, df))
        assert np.allclose(a, b, atol=2e-5)


def test_names_filters_and_plan(spark, tmp_path):
    names = ["a b", "x $$ y", "two\nlines", "ä", ""]
    blocks.write(made(spark, 5, names), str(tmp_path / "n"))
    back = {r.name for r in blocks.read(spark, str(tmp_path / "n")).collect()}
    assert {"a b", "x $ $ y", "two lines", "ä"} < back and len(back) == 5
    blocks.write(made(spark, 500), str(tmp_path / "f"))
    got = blocks.read(spark, str(tmp_path / "f"), 1 << 14)
    for where, n in ((F.col("name") == "s7", 1), (F.col("name").isin("s1", "s2", "none"), 2), (F.col("name").startswith("s49"), 11), ((F.col("name") == "s7") & (F.col("name") == "s8"), 0), (F.col("name").endswith("99"), 5)):
        found = got.where(where)
        assert found.count() == n
    plan = got.where("name = 's7'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "BatchScan" in plan
    first = blocks.files_of(str(tmp_path / "f"))[0].path
    assert {r.source_file for r in got.where(F.col("source_file") == first).collect()} == {first}
    reading = blocks.SpectraReader({"path": str(tmp_path / "f"), "partbytes": "16384"})
    assert list(reading.pushFilters([blocks.EqualTo(("name",), "s7"), blocks.EqualTo(("source_sha256",), "x")])) == [blocks.EqualTo(("source_sha256",), "x")]
    parsed, exchange_parse = [], exchange.parse_jcamp
    try:
        exchange.parse_jcamp = lambda block, *a, **b: parsed.append(1) or exchange_parse(block, *a, **b)
        assert [r[0] for p in reading.partitions() for r in reading.read(p)] == ["s7"]
    finally:
        exchange.parse_jcamp = exchange_parse
    assert len(parsed) == 1


def test_overwrite_append_and_failing_tasks(spark, tmp_path):
    path = str(tmp_path / "w")
    blocks.write(made(spark, 10), path)
    blocks.write(made(spark, 5), path)
    assert blocks.read(spark, path).count() == 15
    blocks.write(made(spark, 7), path, mode="overwrite")
    assert blocks.read(spark, path).count() == 7
    bad = made(spark, 100).withColumn("y", F.when(F.col("name") == "s57", F.array(F.lit(1.0))).otherwise(F.col("y"))).repartition(4)
    with pytest.raises(Exception, match="equally many"):
        blocks.write(bad, path, mode="overwrite")
    # Nothing of the failed write is left, nothing of the earlier one is gone.
    assert blocks.read(spark, path).count() == 7 and not os.path.exists(f"{path}/{blocks.PENDING}")
    with pytest.raises(Exception, match="columns"):
        spark.range(3).write.format("spectra_files").mode("append").save(path)


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("no\n")
    (tmp_path / "_hidden").write_text("no\n")
    blocks.write(made(spark, 3), str(tmp_path))
    with pytest.raises(Exception, match="no spectra"):
        blocks.read(spark, str(tmp_path)).collect()
    got = blocks.read(spark, str(tmp_path), mode="PERMISSIVE").collect()
    assert sorted(r.name or "" for r in got) == ["", "s0", "s1", "s2"]
    assert [os.path.basename(r.source_file) for r in got if r._error] == ["bad.csv"]


def test_hundred_thousand_spectra_without_the_driver(spark, tmp_path):
    df = made(spark, 100_000).repartition(4)
    blocks.write(df, str(tmp_path / "many"), per_file=50_000)
    total = lambda d: d.select(F.round(F.sum(F.aggregate("y", F.lit(0.0), lambda a, b: a + b)), 6).alias("s"), F.count("*").alias("n"), F.countDistinct("name").alias("d")).first()
    assert total(blocks.read(spark, str(tmp_path / "many"), 8 << 20)) == total(df)
