import hashlib
import struct

import numpy as np
import pytest

from lambertlake.sources import blocks, exchange, reader, sheets, text, writer

X = np.arange(200, 230.5, 1.0)
Y = np.exp(-(((X - 215) / 6) ** 2))


def parse(content, name="f.csv"):
    return reader.parse_file(name, content if isinstance(content, bytes) else content.encode())


def test_layouts_and_marks():
    columns = "Instrument: X\nWavelength,PAR 5,CAF 8\n" + "".join(f"{x},{a:.6f},{2 * a:.6f}\n" for x, a in zip(X, Y))
    a, b = parse(columns)
    assert (a.name, b.name) == ("PAR 5", "CAF 8") and a.metadata["Instrument"] == "X" and a.y == pytest.approx(Y, abs=1e-6) and b.y == pytest.approx(2 * Y, abs=1e-6)
    comma = "nm;A\n" + "".join(f"{x:.1f};{a:.5f}\n".replace(".", ",") for x, a in zip(X[::-1], Y[::-1]))
    (c,) = parse(comma)
    assert c.x[0] == 200 and c.y == pytest.approx(Y, abs=1e-5)
    pairs = "S1,,S2,,\n" + "".join(f"{x},{a},{x + 5},{a},\n" for x, a in zip(X, Y))
    p, q = parse(pairs)
    assert (p.name, q.name) == ("S1", "S2") and q.x[0] == 205
    rows = "name\t" + "\t".join(map(str, X)) + "\nM1\t" + "\t".join(map(str, Y)) + "\nM2\t" + "\t".join(map(str, 3 * Y)) + "\n"
    r = parse(rows, "f.tsv")
    assert [f.name for f in r] == ["M1", "M2"]
    (u,) = parse(("# note\n" + "".join(f"{x} {a}\n" for x, a in zip(X, Y))).encode("utf-16"))
    assert u.y == pytest.approx(Y)
    with pytest.raises(text.FormatError):
        parse("nothing here\nat all\n")
    with pytest.raises(text.FormatError):
        parse(b"")


def test_jcamp():
    (f,) = parse(exchange.write_jcamp("one", X, Y), "f.jdx")
    assert f.name == "one" and (f.x == X).all() and (f.y == Y).all()
    packed = "##TITLE=p\n##XFACTOR=1\n##YFACTOR=0.5\n##FIRSTX=200\n##LASTX=206\n##NPOINTS=7\n##DELTAX=1\n##XYDATA=(X++(Y..Y))\n200A0J2KT $$ note\n205C0%%\n##END=\n"
    values, difference = exchange.decode_line("200A0J2KT")
    assert values == [200, 10, 22, 24, 26] and difference
    assert exchange.decode_line("1+2-3 4e1@b2")[0] == [1, 2, -3, 40, 0, -22]
    with pytest.raises(text.FormatError):
        parse("##TITLE=x\n##END=\n", "f.jdx")
    assert parse(packed, "f.jdx")[0].y == pytest.approx(np.array([10, 22, 24, 26, 30, 30][:4] + [30, 30]) * 0.5, abs=20)


def test_spc():
    (f,) = parse(exchange.write_spc([(X, Y)], "hello"), "f.spc")
    assert f.y == pytest.approx(Y, abs=1e-7) and f.metadata["COMMENT"] == "hello" and f.metadata["XUNITS"] == "nm"
    a, b = parse(exchange.write_spc([(X, Y), (X + 1, 2 * Y)]), "f.spc")
    assert b.x[0] == 201 and b.y == pytest.approx(2 * Y, abs=1e-6)
    old = bytearray(256)
    struct.pack_into("<BBhfff", old, 0, 0, 0x4D, 3, len(X), X[0], X[-1])
    ints = np.round(Y * 2.0 ** (32 - 3)).astype("<i4").view("<u2").reshape(-1, 2)[:, ::-1]
    (o,) = parse(bytes(old) + bytes(32) + np.ascontiguousarray(ints).tobytes(), "o.spc")
    assert o.y == pytest.approx(Y, abs=1e-7)


def test_workbooks():
    rows = [["nm", "A 1", "B 2"], *([float(x), float(a), float(2 * a)] for x, a in zip(X, Y))]
    book = sheets.write_xlsx([("Standards", rows), ("Notes", [["only text"]]), ("_hidden", rows), ("Samples", rows)])
    found = parse(book, "b.xlsx")
    assert [f.name for f in found] == ["Standards / A 1", "Standards / B 2", "Samples / A 1", "Samples / B 2"]
    assert found[0].metadata["role"] == "standard" and found[0].y == pytest.approx(Y)
    assert sheets.sheet_name("a/b" * 20, {"a_ba_ba_ba_ba_ba_ba_ba_ba_ba_ba"}) != "a_ba_ba_ba_ba_ba_ba_ba_ba_ba_ba"
    with pytest.raises(text.FormatError):
        parse(b"PKbroken", "b.xlsx")


def compound(streams):
    """A compound file of large streams."""
    size, none, end = 512, 0xFFFFFFFF, 0xFFFFFFFE
    streams = {n: d + bytes(max(0, 4096 - len(d))) for n, d in streams.items()}
    fat, place = [0xFFFFFFFD, end], {}
    for n, d in streams.items():
        place[n] = len(fat)
        count = -(-len(d) // size)
        fat += [len(fat) + i + 1 for i in range(count - 1)] + [end]

    def entry(name, kind, right, child, start, length):
        e = bytearray(128)
        e[: 2 * len(name)] = name.encode("utf-16-le")
        struct.pack_into("<HB", e, 64, 2 * len(name) + 2, kind)
        struct.pack_into("<III", e, 68, none, right, child)
        struct.pack_into("<II", e, 116, start, length)
        return bytes(e)

    names = list(streams)
    directory = entry("Root", 5, none, 1, end, 0) + b"".join(entry(n, 2, i + 2 if i + 1 < len(names) else none, none, place[n], len(streams[n])) for i, n in enumerate(names))
    head = bytearray(size)
    head[:8] = sheets.OLE_MAGIC
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<II", head, 44, 1, 1)
    struct.pack_into("<IIII", head, 56, 4096, end, 0, end)
    struct.pack_into("<I", head, 68, end)
    struct.pack_into("<109I", head, 76, 0, *[none] * 108)
    pad = lambda b: b + bytes(-len(b) % size)
    return bytes(head) + np.array(fat + [none] * (size // 4 - len(fat)), "<u4").tobytes() + pad(directory)[:size] + b"".join(map(pad, streams.values()))


def test_compound_file():
    x, y = np.asarray(np.arange(200, 800, 1.0), "<f8").tobytes(), np.asarray(np.linspace(0, 1, 600), "<f8").tobytes()
    (f,) = parse(compound({"X Data": x, "Y Data": y}), "f.bsw")
    assert f.x[0] == 200 and f.y[-1] == 1
    with pytest.raises(text.FormatError):
        parse(sheets.OLE_MAGIC + bytes(40), "f.bsw")


def test_binary_workbook():
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    texts = ["nm", "Probe é"]
    sst = struct.pack("<II", 2, 2) + b"".join(struct.pack("<HB", len(t), 1) + t.encode("utf-16-le") for t in texts)
    cells = record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1))
    for i, (a, b) in enumerate(zip(X, Y), 1):
        cells += record(0x27E, struct.pack("<HHHI", i, 0, 0, (int(a) << 2) | 2)) + record(0x203, struct.pack("<HHHd", i, 1, 0, b))
    name = b"Standards"
    globals_ = lambda at: record(0x809, bytes(16)) + record(0x85, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name) + record(0xFC, sst) + record(0x0A, b"")
    book = globals_(len(globals_(0))) + record(0x809, bytes(16)) + cells + record(0x0A, b"")
    (f,) = parse(compound({"Workbook": book}), "w.xls")
    assert f.name == "Probe é" and f.metadata["role"] == "standard" and (f.x == X).all() and (f.y == Y).all()
    assert sheets._rk((12345 << 2) | 3) == 123.45


def test_files_as_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a 1", X.tolist(), Y.tolist()), (2, "a,2", X.tolist(), (2 * Y).tolist())], "id int, name string, x array<double>, y array<double>")
    for name in ("t.csv", "t.xlsx", "t.spc", "t.jdx"):
        writer.write_spectra(df, str(tmp_path / name))
    (tmp_path / "bad.csv").write_text("no\n")
    got = reader.read_files(spark, str(tmp_path), strict=False).collect()
    assert sum(r["_error"] is not None for r in got) == 1
    good = [r for r in got if r["_error"] is None]
    assert len(good) == 8 and all(min(abs(np.array(r.y) - k * Y).max() for k in (1, 2)) < 1e-6 for r in good)
    assert next(r for r in got if r.source_file.endswith("bad.csv")).source_sha256 == hashlib.sha256(b"no\n").hexdigest()
    with pytest.raises(Exception, match="no spectra"):
        reader.read_files(spark, str(tmp_path), glob="bad.csv").collect()
    blocks.register(spark)
    assert spark.read.format("spectra_files").load(str(tmp_path / "t.csv")).count() == 2
    digest = writer.data_sha256(df.where("id = 1")).collect()[0].data_sha256
    assert digest == hashlib.sha256(X.astype("<f8").tobytes() + Y.astype("<f8").tobytes()).hexdigest()
