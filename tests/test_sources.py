"""Discovery, fingerprints and readers of files."""

import hashlib
import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lodefall.functions import text as tx
from lodefall.operators import facts, paths
from lodefall.sources import files, sinks


W, A = 'xmlns:w="urn:w"', 'xmlns:a="urn:a"'


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:document>")
    return out.getvalue()


def test_discovery_and_extraction(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("# A\nx\n\n# B\ny")
    (tmp_path / "a" / "two.docx").write_bytes(docx("hello &amp; bye"))
    (tmp_path / "a" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "a" / "skip" / "three.txt").write_text("z")
    (tmp_path / "a" / "m.eml").write_text("Subject: s\nContent-Type: text/plain\n\nbody")
    found = files.discover(spark, [str(tmp_path)], exclude_dirs=("skip",))
    assert {r["path"].split("/")[-1] for r in found.collect()} == {"one.txt", "two.docx", "bad.docx", "m.eml"}
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "a"))
    got = {(r["path"].split("/")[-1], r["ref"]): r["text"] for r in files.extracted(raw).collect()}
    assert got[("one.txt", "sec01")] == "# A\nx" and got[("one.txt", "sec02")] == "# B\ny"
    assert got[("two.docx", "sec01")] == "hello & bye" and got[("m.eml", "body")].strip() == "body"
    assert not any(k[0] == "bad.docx" for k in got)


def test_fingerprints(spark):
    data = bytes(range(256)) * 400
    row = spark.createDataFrame([(bytearray(data),), (bytearray(b"ab"),)], "c binary").select(files.fingerprint(F.col("c")), files.fingerprint(F.col("c"), sampled=True)).collect()
    assert row[0][0] == hashlib.sha256(data).hexdigest()
    assert row[0][1] == "sampled:" + hashlib.sha256(data[:65536] + data[-65536:]).hexdigest()
    assert row[1][1] == "sampled:" + hashlib.sha256(b"ab").hexdigest()


def test_path_and_text_functions(spark):
    df = spark.createDataFrame([("/x/Issued/A_rev12_2024-02-30.pdf",), ("/x/b-v3 20240229.dwg",), ("noext",)], "p string")
    rows = df.select(paths.file_name(F.col("p")), paths.extension(F.col("p")), paths.lane(paths.extension(F.col("p")))).collect()
    assert [tuple(r) for r in rows] == [("A_rev12_2024-02-30.pdf", "pdf", "TEXT_EXTRACTABLE"), ("b-v3 20240229.dwg", "dwg", "METADATA_ONLY"), ("noext", "", "METADATA_ONLY")]
    rows = facts.facts(df, "p").collect()
    assert [(r["revision"], r["file_date"] and str(r["file_date"]), r["is_issued"]) for r in rows] == [(12, None, 1), (3, "2024-02-29", 0), (None, None, 0)]
    t = spark.createDataFrame([("CafÉ a_b",), (None,)], "t string")
    assert [r[0] for r in t.select(tx.tokens(F.col("t"))).collect()] == [["cafÉ", "a", "b"], []]
    assert tx.query_terms("Find the a plan", frozenset(["the"])) == ["find", "plan"]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_formats():
    p = lambda t, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>'
    doc = zipped({"word/document.xml": f"<w:body {W}>" + p("pre") + p("One", '<w:pStyle w:val="Heading1"/>') + p("a &lt; b") + p(" ") + p("Two", '<w:pStyle w:val="Heading2"/>') + p("c") + p("d", '<w:pStyle w:val="Heading4"/>') + "</w:body>"})
    assert files.whole_parts("x.docx", doc) == files.whole_parts("x.DOC", doc) == [("sec01", "pre"), ("sec02", "One\na < b"), ("sec03", "Two\nc\nd")]
    slides = zipped({f"ppt/slides/slide{k}.xml": f"<x {A}>" + (f"<a:p><a:r><a:t>s{k}</a:t></a:r></a:p><a:p/>" if k != 2 else "") + "</x>" for k in (10, 2, 1)})
    assert files.whole_parts("x.pptx", slides) == [("s01", "s1"), ("s02", ""), ("s03", "s10")]
    sheet = '<sheet><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1"/><c r="C1"><v>2.5</v></c></row><row r="2"/><row><c t="inlineStr"><is><t>in</t></is></c></row></sheet>'
    book = zipped({"xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><t>one &amp; two</t></si></sst>", "xl/worksheets/sheet1.xml": "<sheet/>", "xl/worksheets/sheet2.xml": sheet})
    assert files.whole_parts("x.xlsx", book) == [("sheet02", "one & two\t2.5\nin")]
    assert files.whole_parts("x.ppt", slides) == files.whole_parts("x.doc", b"old") == files.whole_parts("x.docx", b"") == files.whole_parts("none", b"") == []


def test_paragraphs_inside_others_and_entities():
    inner = "<w:p><w:r><w:t>inner</w:t></w:r></w:p>"
    body = f"<w:body {W}><w:p><w:r><w:t>a&#233;<![CDATA[<b>]]></w:t><w:tab/><w:t>c</w:t><w:br/><w:t>d</w:t></w:r><w:txbx>{inner}</w:txbx></w:p></w:body>"
    assert files.whole_parts("x.docx", zipped({"word/document.xml": body})) == [("sec01", "aé<b>\tc\nd\ninner")]
    assert files.whole_parts("x.docx", zipped({"word/document.xml": "<w:p>"})) == []


def test_candidates_of_roots(spark, tmp_path):
    for name in ("a/one.txt", "a/two.pdf", "a/cache/three.txt", "a/big.txt", "a/tmp.x/four.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (100 if "big" in name else 3))
    assert files.folder_names(["**/cache/**", "*.pdf", "a b/v1.0/[x]", "**/.git/**"]) == ("cache", "a b")
    with pytest.warns(UserWarning, match="none"):
        found = files.candidates(spark, [str(tmp_path / "none"), str(tmp_path / "a")], ["**/*.txt", "*.pdf"], ["**/cache/**", "four*"], 50).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in found] == ["one.txt", "two.pdf"]
    with pytest.warns(UserWarning):
        assert files.candidates(spark, [str(tmp_path / "a/one.txt")]).count() == 0
    chunks = spark.createDataFrame([(1, "p2", "b"), (1, "p1", "a"), (2, "p1", None)], "k int, ref string, text string")
    assert {r["k"]: r["text"] for r in files.whole_texts(chunks, "k", "ref", "text").collect()} == {1: "a\nb", 2: ""}


def test_files_of_settings(spark, tmp_path):
    path = str(tmp_path / "x.json")
    assert sinks.loaded(path, {}) == {} and sinks.directories(path, ["/a", "/b"])[1] == {"id": "1", "path": "/b", "enabled": True, "status": "active"}
    sinks.put(path, '[{"query": "q", "expected_paths": ["http://x"]}, // a comment\n {"query": "r", "expected_paths": []}]')
    assert sinks.loaded(path, {})[0]["expected_paths"] == ["http://x"]
    assert sinks.fixture(spark, path, "query string, expected_paths array<string>").count() == 2
    time.sleep(0.05)
    sinks.put(path, '["plain"]')
    assert sinks.fixture(spark, path, "query string, expected_paths array<string>").first()["query"] == "plain"
    sinks.put(path, "{")
    assert sinks.loaded(path, 5) == 5
    sinks.put(path, "one")
    first = sinks.snapshot(path, str(tmp_path / "h"))
    sinks.put(path, "two!")
    second = sinks.snapshot(path, str(tmp_path / "h"))
    assert [x["version"] for x in sinks.versions(str(tmp_path / "h"))] == [second, first] and sinks.versions(str(tmp_path / "none")) == []
    sinks.rolled_back(path, str(tmp_path / "h"), first)
    assert (tmp_path / "x.json").read_text() == "one" and len(sinks.versions(str(tmp_path / "h"))) == 3
    rows = spark.createDataFrame([(1, "q")], "k int, query string")
    sinks.report_json(rows, {"recall": 0.5}, path)
    assert sinks.loaded(path, {})["queries"] == [{"k": 1, "query": "q"}]
    assert "1 of 3 rows" in sinks.report_html(spark.range(3).toDF("k"), "t", 1)


def test_splitting(spark):
    made = {"a.txt": "# H\n" + "word " * 1000 + "\n\nlast", "b.md": "", "c.md": " \n#a\n#b", "d.txt": "one\r\n \r\ntwo\x0cthree\u2028\u2028four", "e.txt": "x" * 7000, "f.txt": "a b " * 9000}
    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in made.items()], "path string, content binary")
    got = {}
    for r in sorted(files.extracted(rows).collect()):
        got.setdefault(r["path"], []).append((r["ref"], r["text"]))
    assert [r for r, _ in got["a.txt"]] == ["sec01a", "sec01b", "sec02"] and all(len(t) <= files.TEXT_MOST for _, t in got["a.txt"])
    assert got["b.md"] == [("sec01", "")] and got["c.md"] == [("sec01", "#a"), ("sec02", "#b")]
    assert got["d.txt"] == [("sec01", "one"), ("sec02", "two\nthree"), ("sec03", "four")]
    assert [(r, len(t)) for r, t in got["e.txt"]] == [("sec01a", 3000), ("sec01b", 3000), ("sec01c", 1000)]
    assert " ".join(t for _, t in got["f.txt"]) == ("a b " * 9000).strip()


def test_mail_records(spark):
    raw = b"""From: =?utf-8?q?J=C3=B6?= <jo@ura.gov.sg>\nTo: a@own.example, b@other.example\nCc: \nSubject: Re: Waiver\nDate: today\nMIME-Version: 1.0
Content-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain\n\n body\n--X\nContent-Type: text/plain\nContent-Disposition: attachment; filename=f.txt\n\nno\n--X--\n"""
    df = spark.createDataFrame([("/m.eml", bytearray(raw)), ("/e.eml", None)], "path string, content binary")
    m, e = sorted(files.mails(df, ("own.example",)).collect(), key=lambda r: r["path"], reverse=True)
    assert (m["sender"], m["sender_email"], m["recipients"], m["body"], m["attachments"]) == ("Jö", "jo@ura.gov.sg", ["a@own.example", "b@other.example"], "body", ["f.txt"])
    assert (m["thread_subject"], m["direction"], m["parties"], m["tags"]) == ("Waiver", "inbound", ["other.example", "own.example", "ura.gov.sg"], ["waiver_correspondence", "authority_correspondence"])
    assert (e["subject"], e["direction"], e["recipients"], e["body"]) == ("", "unknown", [], "")


def test_command_line(spark, tmp_path, capsys):
    from lodefall.__main__ import main

    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    data = "/root/testdata/sf0.001"
    assert main(["run", "knn_topk", data, "--out", str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert main(["search", data, "What is the lyer of threst?", "--top", "2"]) == 0 and "snippet" in capsys.readouterr().out
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("x")
    assert main(["candidates", str(tmp_path / "a")]) == 0 and "txt" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing", data])
