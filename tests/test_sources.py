from __future__ import annotations

import io
import json
import zipfile

import pytest

from hopweave.sources import readers, sinks
from hopweave.sources.catalog import Catalog, fingerprint, history, with_overrides
from hopweave.streaming import hops


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c"))
    df = spark.createDataFrame([(1, "a", ["x"]), (2, " NaN ", [])], "i int, s string, l array<string>")
    assert c.entries().count() == 0
    a = c.save(df, "one", "processed", owner="o")
    b, new = c.save_unless_known(df, "two", "raw", ["i"])
    again, newer = c.save_unless_known(df.repartition(3), "three", "raw", ["i"])
    assert new and not newer and again == b
    assert c.load(a).count() == 2 and c.entry(a)["owner"] == "o"
    loaded = {r.i: (r.s, r.l) for r in c.load_processed([a, b], ["i"]).collect()}
    assert loaded == {1: ("a", ["x"]), 2: ("", [])}
    j = c.save_json({"k": 1}, "run", "prediction", extra={"title": "T"})
    assert c.load_json(j) == {"k": 1} and [r.id for r in c.artifacts().collect()] == [j]
    assert [tuple(r)[:3] for r in history(c.entries(), {"prediction": "Run"}).collect()] == [("Run", j, "T")]
    c.rename(a, "uno")
    c.update(a, extra={"raw_id": b})
    assert c.entry(a)["name"] == "uno" and c.load_raw([a]).count() == 2
    over = spark.createDataFrame([(a, "eins", False), (b, None, True)], "id string, name string, deleted boolean")
    assert {r.name for r in with_overrides(c.entries(), over).collect()} == {"eins", "run"}
    c.activate(a, "processed")
    assert c.active("processed") == a and c.active("none") is None
    c.delete(b)
    with pytest.raises(KeyError):
        c.entry(b)
    assert fingerprint(df, ["i"]) == fingerprint(df.repartition(2), ["i"]) != fingerprint(df.limit(1), ["i"])


def test_writers_do_not_lose_changes(spark, tmp_path):
    """Of two writers that have read the same version one comes second, and makes its change to what the first has left."""
    c = Catalog(spark, str(tmp_path / "c"))
    a = c.save_text("t", "one", "raw")
    stale = c._entry(a)
    c.update(a, extra={"first": 1})
    assert not c._put(stale | {"name": "lost"}, stale["version"] + 1)  # the version is taken
    put, seen = c._put, []

    def interleaved(entry, version=1):
        if not seen:
            seen.append(version)
            assert put(c._entry(a) | {"owner": "other"}, version)
        return put(entry, version)

    c._put = interleaved
    c.update(a, name="two", extra={"second": 2})
    c._put = put
    e = c.entry(a)
    assert (e["name"], e["owner"], e["extra"], e["version"]) == ("two", "other", {"first": "1", "second": "2"}, 4)
    assert c.entries().count() == 1
    b = c.save_text("t", "b", "gazetteer")
    d = c.save_text("t", "d", "gazetteer")
    assert c.active() == d
    for x in (b, d, b):
        c.activate(x)
        assert c.active() == x
    c.delete(b)
    assert c.active() == d and {r.id for r in c.entries().collect()} == {a, d}
    with pytest.raises(KeyError):
        c.update(b, name="gone")


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>"""


def workbook(path, rows: str, strings: str = "", target: str = "worksheets/sheet1.xml"):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId7"/><sheet name="T" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId8" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/other.xml", SHEET.format('<row r="1"><c r="A1" t="inlineStr"><is><t>wrong</t></is></c></row>'))
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{strings}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format(rows))


def test_excel(spark, tmp_path):
    """Several workbooks, all rows: shared and inline strings, numbers, dates, gaps, repeated and missing headers."""
    folder = tmp_path / "in"
    folder.mkdir()
    strings = "<si><t>Unique  ID</t></si><si><t>x</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb=\"0\" eb=\"1\"><t>no</t></rPh></si>"
    rows = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>1</v></c></row>
    <row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" s="1"><v>43831</v></c></row>
    <row r="4"><c r="A4"><v>0.25</v></c><c r="D4" s="2"><v>43831.5</v></c></row><row r="5"><c r="B5" s="3"><v>3</v></c><c r="F5" t="str"><v>é</v></c></row>"""
    workbook(folder / "a.xlsx", rows, strings)
    many = "".join(f'<row><c t="inlineStr"><is><t>r{i}</t></is></c></row>' for i in range(5000))
    workbook(folder / "b.xlsx", '<row><c t="inlineStr"><is><t>y</t></is></c></row>' + many)
    df = readers.read_excel(spark, str(folder), position=True)
    assert df.columns == ["file", "row", "Unique  ID", "x", "Unnamed: 2", "x.1", "Unnamed: 4", "Unnamed: 5", "y"]
    a = {r.row: tuple(r)[2:] for r in df.where("file like '%a.xlsx'").collect()}
    assert a == {0: ("7", "rich", "True", "2020-01-01 00:00:00", None, None, None), 2: ("0.25", None, None, "2020-01-01 12:00:00", None, None, None), 3: (None, "3", None, None, None, "é", None)}
    b = {r.row: r.y for r in df.where("file like '%b.xlsx'").collect()}
    assert b == {i: f"r{i}" for i in range(5000)}
    assert readers.read_any(spark, str(folder / "b.xlsx")).columns == ["y"]
    assert readers.normalize_headers(readers.read_files(spark, [str(folder / "a.xlsx")])).columns[0] == "Unique ID"
    workbook(folder / "c.xlsx", "", target="/xl/worksheets/sheet1.xml")
    assert readers.read_excel(spark, str(folder / "c.xlsx")).count() == 0


def test_positions(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.csv").write_text("k,v\n" + "".join(f'{n}{i},"x\ny"\n' for i in range(50)))
    got = readers.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], position=True).collect()
    assert sorted((r.file[-5], r.row) for r in got) == [(n, i) for n in "ab" for i in range(50)]
    assert all(r.k == f"{r.file[-5]}{r.row}" for r in got)


def test_archive_stays_on_the_executors(spark, tmp_path):
    """Archives of many lines become rows without passing the driver: lines are only counted."""
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"g{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "small")
            z.writestr("all.txt", "\n".join(f"{i}\tP{a}-{i}\t\t\t1.5\t2.5" + "\t" * 8 + f"\t{i}\t\t\t\t" for i in range(30_000)))
        with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
            z.writestr("x.csv", "a")
    assert readers.archive_lines(spark, str(tmp_path / "*.zip")).groupBy("member").count().collect()[0]["count"] == 60_000
    assert readers.read_geonames_zip(spark, str(tmp_path / "g0.zip"), 29_000).count() == 1000
    assert readers.read_geonames_zip(spark, str(tmp_path / "none.zip")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Unique  ID,x\n1,"a\nb"\n')
    (tmp_path / "b.jsonl").write_text('{"x": "q", "y": 2}\n')
    (tmp_path / "c.json").write_text(json.dumps([{"x": "z"}, {"x": "w"}], indent=1))
    df = readers.normalize_headers(readers.read_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.jsonl", "c.json")]))
    assert df.columns == ["Unique ID", "x", "y"] and df.count() == 4
    (tmp_path / "g.csv").write_text("City;Latitude;Lng;pop\nTripoli;32,9;13.2;5\nbad\n")
    assert [tuple(r)[:3] for r in readers.read_gazetteer_csv(spark, str(tmp_path / "g.csv")).collect()] == [("Tripoli", 32.9, 13.2)]
    line = "\t".join(["1", "Rome", "Rome", "Roma,Rom", "41.9", "12.5", "P", "PPLC", "IT", "", "", "", "", "", "2000", "", "", "", ""])
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("r.txt", "x")
        z.writestr("IT.txt", line + "\n")
    got = readers.read_geonames_zip(spark, str(tmp_path / "g.zip"), 1000).collect()
    assert [(r.name, r.lat, r.alt_list) for r in got] == [("Rome", 41.9, ["Roma", "Rom"])]
    (tmp_path / "t.txt").write_text("['A' 'B']\n[A]\n")
    assert {r.token for r in readers.read_tokens(spark, str(tmp_path / "t.txt")).collect()} == {"A", "B"}
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "x"}\n{"qid": "2", "text": "y"}\n')
    assert sorted((r.qid, r.text) for r in readers.read_queries(spark, str(tmp_path / "q.jsonl")).collect()) == [("1", "x"), ("2", "y")]
    assert readers.template(spark).columns == list(readers.REQUIRED)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", None, "b"])], "i int, l array<string>")
    sinks.write_csv(df, str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).first().l == "a;b"
    z = zipfile.ZipFile(io.BytesIO(sinks.report_archive({"x": 1}, {"f": df})))
    assert sorted(z.namelist()) == ["f.csv", "report.json"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select 1 v, timestamp'2020-01-01 01:00:00' t, 'A' p union all select 1, timestamp'2020-01-01 02:00:00', 'B' union all select 2, timestamp'2020-01-05 00:00:00', 'A'").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    for name, f, mode in (
        ("v", lambda d: hops.visits(d, "t", "p"), "complete"),
        ("s", lambda d: hops.stays(d, "t", "v"), "append"),
        ("l", lambda d: hops.last_places(d, "v", "t", "p"), "update"),
    ):
        q = f(hops.read(spark, str(src), schema)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {(r.p, r.n) for r in spark.sql("select p, n from v").collect()} == {("A", 1), ("B", 1)}
    assert {(r.v, r.p) for r in spark.sql("select v, p from l").collect()} == {(1, "B"), (2, "A")}
