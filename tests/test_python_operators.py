"""Operators that SQL can't express: alignment, packages and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from stratadoc.operators import alignment
from stratadoc.plans import telemetry_queries
from stratadoc.sources import docx
from stratadoc.streaming import runs

SF = "/root/testdata/sf0.001"


def test_alignment(spark):
    gold = spark.createDataFrame([(1, i, t) for i, t in enumerate(["first line here", "second one", "", "third is longer than that", "gone"])], "doc_id long, block long, text string")
    actual = spark.createDataFrame([(1, i, t) for i, t in enumerate(["new start", "first  line here", "second one", "", "third is longer then that"])], "doc_id long, block long, text string")
    got = {r.block: (r.actual_block, round(r.similarity, 2)) for r in alignment.align_paragraphs(gold, actual).collect()}
    assert got[0] == (1, 0.96) and got[1] == (2, 1.0) and got[2] == (3, 0.62) and got[3][0] == 4 and got[4] == (None, 0.0)
    score, method = alignment.paragraph_similarity(F.col("a"), F.col("b"))
    pairs = spark.createDataFrame([("x", "x"), ("ab c", "abc"), ("", ""), ("abcdefgh", "xabcdefghx"), ("abcdefghij", "abcdefghxj"), ("abc", "xyz")], "a string, b string")
    assert [(r.m, round(r.s, 2)) for r in pairs.select(score.alias("s"), method.alias("m")).collect()] == [("exact_text", 1.0), ("normalized_text", 0.96), ("empty_context", 0.62), ("gold_text_contained", 0.86), ("fuzzy_text", 0.81), ("no_evidence", 0.0)]


def test_docx(spark, tmp_path):
    spaces = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    box = f"<w:r><w:txbxContent><w:p>{t('in a box')}</w:p><w:p>{t('second')}</w:p></w:txbxContent></w:r>"
    rows = f"<w:tr><w:tc><w:p>{t('a')}</w:p></w:tc><w:tc><w:p>{t('b')}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{t('c')}</w:p><w:tbl><w:tr><w:tc><w:p>{t('deep')}</w:p></w:tc></w:tr></w:tbl></w:tc></w:tr>"
    body = (
        f'<w:document {spaces}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>{t("One")}{t("Two")}{box}</w:p><w:p><w:pPr><w:sectPr/></w:pPr></w:p><w:tbl>{rows}</w:tbl>'
        f'<w:p>{t("see ")}<w:sdt><w:sdtPr><w:alias w:val="A"/><w:tag w:val="inline"/></w:sdtPr><w:sdtContent>{t("here")}</w:sdtContent></w:sdt><w:fldSimple w:instr="PAGE"/><m:oMath><m:t>x=1</m:t></m:oMath><a:blip r:embed="r1"/></w:p>'
        f'<w:sdt><w:sdtPr><w:tag w:val="title"/></w:sdtPr><w:sdtContent><w:p>{t("block")}</w:p></w:sdtContent></w:sdt></w:body></w:document>'
    )
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="image" Target="media/a.png"/><Relationship Id="r2" Type="link" Target="../gone/./b.xml"/><Relationship Id="r3" Type="link"/><Relationship Id="r4" Type="link" Target="http://x" TargetMode="External"/><Relationship Id="r5" Type="x" Target="/word/header1.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {spaces}><w:p>{t('top')}</w:p></w:hdr>")
        z.writestr("word/footer1.xml", "<w:ftr")
        z.writestr("word/_rels/document.xml.rels", rels)
        z.writestr("word/_rels/header1.xml.rels", "<Relationships")
        z.writestr("word/media/a.png", b"png")
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no package")
    tables = docx.ingest_docx(spark, str(tmp_path))
    got = lambda kind, *columns: sorted(map(tuple, tables[kind].select(*columns).collect()), key=str)
    assert got("paragraph", "story", "seq", "text", "style", "section", "table_index", "row", "cell") == sorted(
        [
            ("body", 1, "OneTwo", "Heading1", 0, None, None, None), ("textbox", 1, "in a box", None, 0, None, None, None), ("textbox", 2, "second", None, 0, None, None, None), ("body", 2, "", None, 0, None, None, None),
            ("body", 3, "a", None, 1, 0, 0, 0), ("body", 4, "b", None, 1, 0, 0, 1), ("body", 5, "c", None, 1, 0, 1, 0), ("body", 6, "deep", None, 1, 1, 0, 0),
            ("body", 7, "see here", None, 1, None, None, None), ("body", 8, "block", None, 1, None, None, None), ("header", 1, "top", None, 0, None, None, None),
        ],
        key=str,
    )
    assert [r for r in got("run", "story", "parent", "seq", "start", "stop") if r[:2] == ("body", 1)] == [("body", 1, 1, 0, 3), ("body", 1, 2, 3, 6), ("body", 1, 3, 6, 6)]
    assert got("control", "style", "alias", "text", "block", "seq", "start", "stop") == [("inline", "A", "here", False, 7, 4, 8), ("title", None, "block", True, 8, 0, 5)]
    assert got("cell", "table_index", "row", "cell", "text") == [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 1, 0, "cdeep"), (1, 0, 0, "deep")]
    assert got("object", "style", "text", "target", "parent") == [("field", "PAGE", None, 7), ("formula", "x=1", None, 7), ("image", "", "r1", 7)]
    assert {t for (t,) in got("relationship", "target")} == {"../gone/./b.xml", "/word/header1.xml", None, "http://x", "media/a.png"}
    wrong = {(r.path[-6:], r.code, r.part) for r in docx.check_packages(tables).collect()}
    assert wrong == {
        ("b.docx", "invalid_docx_package", None), ("a.docx", "invalid_package_xml", "word/footer1.xml"), ("a.docx", "invalid_package_xml", "word/_rels/header1.xml.rels"), ("a.docx", "missing_package_parts", "[Content_Types].xml"),
        ("a.docx", "missing_package_parts", "_rels/.rels"), ("a.docx", "relationship_without_target", "word/_rels/document.xml.rels"), ("a.docx", "dangling_relationship", "gone/b.xml"),
    }
    assert got("error", "part", "text") == sorted([("word/_rels/header1.xml.rels", "xml_invalid"), ("word/footer1.xml", "xml_invalid"), (None, "package_invalid")], key=str)
    assert "mapInPandas" not in tables["cell"]._jdf.queryExecution().toString() and "kind" in tables["cell"]._jdf.queryExecution().toString()


def test_streams_equal_batches(spark, tmp_path):
    events = telemetry_queries.events(spark, SF).withColumn("at", F.timestamp_millis(F.col("observed_at").cast("long")))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    runs.write_events(stream(), f"{tmp_path}/out", f"{tmp_path}/c1", "at").awaitTermination()
    accepted, _ = runs.validated(events)
    want = accepted.drop("at").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/out").count() == want
    runs.run_states(stream()).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("states").select("run_id", "event_count", "status").collect())) == sorted(map(tuple, runs.T.run_state(events).select("run_id", "event_count", "status").collect()))


def test_a_batch_played_again_is_there_once(spark, tmp_path):
    events = telemetry_queries.events(spark, SF).withColumn("at", F.timestamp_millis(F.col("observed_at").cast("long"))).limit(300)
    events.write.parquet(f"{tmp_path}/in")
    play = lambda check: runs.write_events(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/{check}", "at").awaitTermination()
    play("first")
    once = spark.read.parquet(f"{tmp_path}/out").count()
    play("lost")  # a checkpoint that knows of no batch
    assert spark.read.parquet(f"{tmp_path}/out").count() == once > 0
