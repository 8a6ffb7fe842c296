import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from conftest import SMALL
from regmart.operators import metrics
from regmart.plans import bridge
from regmart.sources import store, workbooks
from regmart.streaming import fronts


def book(sheets: dict[str, list[list]], extra: dict[str, str] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = "".join(f'<c r="{chr(64 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row, 1) if v is not None)
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        for name, content in (extra or {}).items():
            z.writestr(name, content)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    (at / "a.xlsx").write_bytes(book({"Notes": [["x"]], "Data": [["Entity", "Amt."], ["North", 5], [None, None], ["South", "n/a"], ["West", 2.5]]}))
    (at / "b.xlsx").write_bytes(book({"Data": [["Entity"], ["North"]]}, {"xl/vbaProject.bin": "m", "big": "0" * 500_000}))
    (at / "c.xlsx").write_bytes(b"plain text")
    return at


def test_screening(spark, folder):
    stats = workbooks.archive_stats(workbooks.scan(spark, str(folder)))
    issues = workbooks.screen(stats, F.col("file"), F.lit("application/octet-stream"))
    assert {(r.file[-6:], r.code) for r in issues.collect()} == {("b.xlsx", "SECURITY_MACRO_DETECTED"), ("b.xlsx", "SECURITY_ZIP_BOMB_RATIO"), ("c.xlsx", "SECURITY_MAGIC_BYTES")}


def test_records_from_cells(spark, folder):
    table = workbooks.cells(workbooks.scan(spark, str(folder))).withColumn("file", F.element_at(F.split("file", "/"), -1))
    aliases = spark.createDataFrame([("AMT", "old", 1), ("AMT", "amount", 2), ("ENTITY", "entity", 3)], "header_key string, canonical string, position int")
    heads = workbooks.headers(table, aliases)
    chosen = workbooks.choose_sheet(heads, ["entity", "amount"], ["Data"])
    assert [(r.file, r.sheet) for r in chosen.collect()] == [("a.xlsx", "Data")]
    rows = workbooks.records(table, heads, chosen, ["entity", "amount"])
    assert {(r.source_row, r.entity, r.amount) for r in rows.collect()} == {(2, "North", "5"), (4, "South", "n/a"), (5, "West", "2.5")}
    good, bad = workbooks.conform(rows, StructType([StructField("entity", StringType(), False), StructField("amount", DoubleType())]))
    assert {(r.entity, r.amount) for r in good.collect()} == {("North", 5.0), ("West", 2.5)}
    assert [(r.source_row, r.column, r.value) for r in bad.collect()] == [(4, "amount", "n/a")]


def test_control_totals_take_the_last_of_a_key(spark):
    table = spark.createDataFrame([("f", 0, "S", 2, 1, "north"), ("f", 0, "S", 2, 2, "South"), ("f", 0, "S", 2, 3, "North"), ("f", 0, "S", 9, 1, "1"), ("f", 0, "S", 9, 2, "2"), ("f", 0, "S", 9, 3, "3")], workbooks.CELLS)
    layout = spark.createDataFrame([("S", 2, 9, 1, 3, "flow")], "sheet string, header_row int, value_row int, col_from int, col_to int, measure string")
    assert {(r.key, r.expected) for r in workbooks.control_totals(table, layout).collect()} == {("NORTH", 3000.0), ("SOUTH", 2000.0)}


def test_classification(spark):
    scores = spark.createDataFrame([("a", "flow", 96.0), ("a", "balance", 0.0), ("b", "balance", 79.0), ("b", "result", 72.0), ("c", "flow", 12.0)], "file string, kind string, score double")
    got = {r.file: r for r in workbooks.classify(scores).collect()}
    assert got["a"].kind == "flow" and got["a"].confidence == 1.0 and got["a"].candidates == ["flow"]
    assert got["b"].kind is None and got["b"].candidates == ["balance", "result"] and got["c"].kind is None
    assert workbooks.classification_issues(workbooks.classify(scores)).count() == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.active() is None and s.pointer("side") == "side" and s.artifact("facts") is None and s.runs().count() == 0
    facts = spark.range(3)
    one = s.publish("r1", "ann", {"facts": facts}, "publishable", "dataset-1")
    two = s.publish("r2", "ann", {"facts": facts.limit(1)}, "warningOnly", "dataset-2")
    assert (one, two) == ("dataset-1", "dataset-2") and s.active() == two and s.artifact("facts").count() == 1
    with pytest.raises(store.PublishBlocked):
        s.publish("r3", "ann", {"facts": facts}, "blocked", "dataset-3")
    s.rollback(one, "bob")
    assert s.active() == one and s.artifact("facts").count() == 3 and s.active_artifacts(["facts"])["facts"].count() == 3
    with pytest.raises(KeyError):
        s.rollback("dataset-9", "bob")
    s.activate(None)
    assert s.pointer("side") is None and s.repair_pointer() == two
    assert [r.action for r in s.audit_events().collect()] == ["ROLLBACK", "PUBLISH", "PUBLISH"]
    assert {r.area: r.n for r in s.counts().collect()} == {"quarantine": 0, "staging": 2, "published": 2, "audit": 3}


def test_streams(spark, folder, tmp_path):
    q = fronts.arriving_files(spark, str(folder)).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.stored_name for r in spark.table("arrivals").collect()} == {"a.xlsx", "b.xlsx", "c.xlsx"}
    at = datetime.datetime(2024, 1, 1, 10, 0)
    rows = [("/a", 10.0, 200, 5, at), ("/a", 20.0, 500, 7, at + datetime.timedelta(minutes=1))]
    spark.createDataFrame(rows, "route string, duration double, status int, bytes long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = fronts.route_metrics(spark.readStream.schema("route string, duration double, status int, bytes long, ts timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").outputMode("complete").queryName("routes").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    row = spark.table("routes").first()
    assert (row.n, row.errors, row.avg_duration, row.last_duration, row.last_status) == (2, 1, 15.0, 20.0, 500)


def test_broken_files_give_an_issue_and_no_cells(spark, tmp_path):
    good = {"Data": [["Day"], [46053], [46053.5], [7]]}
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    styles = f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="[$-40A]dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0 &quot;dmy&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    dated = f'<worksheet {ns}><sheetData><row><c s="1"><v>46053</v></c><c s="2"><v>46053.5</v></c><c s="3"><v>7</v></c></row><row><c r="B2" t="n"><v>5</v></c><c><v>6</v></c></row></sheetData></worksheet>'

    def changed(path: str, content: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(book(good))) as old, zipfile.ZipFile(out, "w") as new:
            for name in old.namelist():
                new.writestr(name, content if name == path else old.read(name))
            if path not in old.namelist():
                new.writestr(path, content)
            if path == "xl/worksheets/sheet1.xml":
                new.writestr("xl/styles.xml", styles)
        return out.getvalue()

    sheet = "xl/worksheets/sheet1.xml"
    files = {
        "good": book(good), "dated": changed(sheet, dated), "text": b"no archive", "cut": book(good)[:200], "xml": changed(sheet, f"<worksheet {ns}><sheetData><row r='1'><c r='A1'><v>1</v></c></row>"),
        "shared": changed(sheet, f"<worksheet {ns}><sheetData><row r='1'><c r='A1' t='s'><v>9</v></c></row></sheetData></worksheet>"), "row": changed(sheet, f"<worksheet {ns}><sheetData><row r='x'><c r='A1'><v>1</v></c></row></sheetData></worksheet>"),
    }
    for name, content in files.items():
        (tmp_path / f"{name}.xlsx").write_bytes(content)
    scan = workbooks.scan(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    found = {(r.file, r.row, r.col, r.value) for r in workbooks.cells(scan).collect()}
    assert found == {("good.xlsx", i, 1, v) for i, v in enumerate(["Day", "46053", "46053.5", "7"], 1)} | {("dated.xlsx", 1, 1, "2026-01-31"), ("dated.xlsx", 1, 2, "2026-01-31T12:00:00"), ("dated.xlsx", 1, 3, "7"), ("dated.xlsx", 2, 2, "5"), ("dated.xlsx", 2, 3, "6")}
    assert {r.file[:-5] for r in workbooks.unreadable(scan).collect()} == {"text", "cut", "xml", "shared", "row"}
    assert workbooks.archive_stats(scan).count() == len(files)


def test_arrivals_into_the_store_survive_a_restart(spark, tmp_path):
    inbox, s = tmp_path / "inbox", store.Store(spark, str(tmp_path / "store"))
    put = lambda run, name, content=b"x": ((inbox / run).mkdir(parents=True, exist_ok=True), (inbox / run / name).write_bytes(content))
    put("run1", "a b.xlsx"), put("run1", "blob"), put("run2", "a.xlsx", b"yy")
    done = lambda: fronts.register_arrivals(spark, str(inbox), s, str(tmp_path / "cp")).awaitTermination(120)
    done()
    first = {(r.run_id, r.stored_name, r["size"]) for r in s.files().collect()}
    assert first == {("run1", "a_b.xlsx", 1), ("run2", "a.xlsx", 2)} and s.files().count() == 2
    put("run2", "c.xlsx"), put("run3", "d.xlsx")
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    commits[-1].unlink()  # as if the driver was lost after the batch was written, before it was noted
    done()
    names = sorted((r.run_id, r.stored_name) for r in s.files().collect())
    assert names == [("run1", "a_b.xlsx"), ("run2", "a.xlsx"), ("run2", "c.xlsx"), ("run3", "d.xlsx")]
    done()  # nothing new
    assert s.files().count() == 4 and {r.run_id: r.status for r in s.runs().collect()} == {"run1": "received", "run2": "received", "run3": "received"}
    s.write_run("run1", "staged", created_at=datetime.datetime(2020, 1, 1))
    assert {r.run_id: r.status for r in s.runs().collect()}["run1"] == "staged" and {r.area: r.n for r in s.counts().collect()} == {"quarantine": 4, "staging": 3, "published": 0, "audit": 0}


def test_route_totals_of_a_stream_equal_the_batch(spark, tmp_path):
    requests = bridge.requests(spark, SMALL)
    requests.withColumn("part", F.pmod(F.hash("ts"), F.lit(5))).repartition(5, "part").drop("part").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fronts.route_totals(stream).writeStream.format("memory").outputMode("complete").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert len(q.recentProgress) > 1
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, requests.groupBy("route").agg(*metrics.route_metrics()).collect()))


def test_sheets_are_units_of_work(spark, tmp_path):
    rows = [["n", "t"], *[[i, f"text {i}"] for i in range(60_000)]]
    (tmp_path / "large.xlsx").write_bytes(book({"One": [["a"]], "Large": rows, "Three": [["b"]]}))
    broken = zipfile.ZipFile(io.BytesIO(book({"Fine": [["a"]], "Cut": [["b"]]})))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in broken.namelist():
            content = broken.read(name)
            new.writestr(name, content[: len(content) - 20] if name.endswith("sheet2.xml") else content)
    (tmp_path / "broken.xlsx").write_bytes(out.getvalue())
    bad = bytearray(book({"Fine": [["a"]], "Bits": [["b"] * 50]}))
    bad[bad.index(b"xl/worksheets/sheet2.xml") + len("xl/worksheets/sheet2.xml") + 20] ^= 0xFF
    (tmp_path / "bits.xlsx").write_bytes(bytes(bad))
    files = workbooks.scan(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    units = workbooks.sheets(files).select("file", "sheet_index", "sheet").collect()
    assert sorted((u.file, u.sheet) for u in units) == [("bits.xlsx", "Bits"), ("bits.xlsx", "Fine"), ("broken.xlsx", "Cut"), ("broken.xlsx", "Fine"), ("large.xlsx", "Large"), ("large.xlsx", "One"), ("large.xlsx", "Three")]
    table, issues = workbooks.read(files)
    found = table.groupBy("file", "sheet").agg(F.count("*").alias("n"), F.max("row").alias("last")).collect()
    assert {(r.file, r.sheet): (r.n, r["last"]) for r in found} == {("large.xlsx", "One"): (1, 1), ("large.xlsx", "Large"): (120_002, 60_001), ("large.xlsx", "Three"): (1, 1)}
    assert table.filter("sheet = 'Large' AND row = 60001").orderBy("col").select("value").collect() == [("59999",), ("text 59999",)]
    assert {r.file for r in issues.collect()} == {"broken.xlsx", "bits.xlsx"}


def test_streamed_elements_hold_nothing_back():
    body = b"<w><sheetData>" + b"".join(b"<row r='%d'><c><v>%d</v></c></row>" % (i, i) for i in range(1, 2001)) + b"</sheetData></w>"
    seen = [(e.get("r"), len(e)) for e in workbooks._elements((body[i : i + 7] for i in range(0, len(body), 7)), "row")]
    assert seen == [(str(i), 1) for i in range(1, 2001)]
