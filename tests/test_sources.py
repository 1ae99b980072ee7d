import io
import os
import zipfile

import pytest

from tessella.sources import parsers as P
from tessella.sources import sink
from tessella.sources.reader import parse_files, read_blocks, register


def package(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx():
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Part A</w:t></w:r></w:p><w:sdt><w:sdtContent><w:p><w:r><w:t>Text</w:t><w:tab/><w:t>more</w:t></w:r></w:p></w:sdtContent></w:sdt><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc/></w:tr></w:tbl>'
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def xlsx(cell='<c r="B2"><v>2.0</v></c>', extra=None):
    return package(
        {
            "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {S}><si><t>head</t></si></sst>",
            "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2">{cell}<c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>',
        }
        | (extra or {})
    )


def test_text_sections():
    blocks = P.parse_text(b"\xef\xbb\xbfSECTION One\r\n\r\nfirst\nline\n \nsecond\n\n\n")
    assert [(b["text"], b["section"]) for b in blocks] == [("SECTION One", ["SECTION One"]), ("first\nline", ["SECTION One"]), ("second", ["SECTION One"])]


def test_csv():
    assert P.parse_csv(b'a,"b,\n1"\nc\n')[0]["rows"] == [["a", "b,\n1"], ["c"]]
    assert P.parse_csv(b"") == []
    for bad in (b"a\0b", b'"a', b"\xff"):
        with pytest.raises(P.SourceFault):
            P.parse_csv(bad)


def test_markdown():
    blocks = P.parse_markdown(b"# One\ntext\nmore\n\n| a | b\\|c |\n|---|:-:|\n| `x|y` | 2 |\nafter\n")
    assert [b["kind"] for b in blocks] == ["text", "text", "table", "text"]
    assert blocks[2]["rows"] == [["a", "b|c"], ["`x|y`", "2"]] and blocks[1]["section"] == ["One"]


def test_html():
    page = b"<title>T</title><script>no</script><h2>Head</h2><p>a <b>b</b></p><table><tr><th>x<td>y</td></tr><tr><td><table><tr><td>in</td></tr></table></td><td>z</td></tr></table><div>end"
    blocks = P.parse_html(page)
    assert [b["text"] for b in blocks if b["kind"] == "text"] == ["T", "Head", "a b", "end"]
    assert blocks[-1]["section"] == ["Head"] and [b["kind"] for b in blocks].count("table") == 1
    assert P.parse_html(b"a<embed>b") == [P.text_block("a")]


def test_office_packages():
    assert [b["kind"] for b in P.parse_document(docx(), "a.docx")] == ["text", "text", "table"]
    assert P.parse_document(docx(), "a.docx")[1] == P.text_block("Text\tmore", ["Part A"])
    table = P.parse_document(xlsx(), "b.XLSX")[0]
    assert table["rows"] == [["head", "", ""], ["", "2", "TRUE"]] and table["sheet"] == "One"


@pytest.mark.parametrize(
    "name, content, code",
    [
        ("a.pdf", b"%PDF-1.7", "SOURCE_DEPENDENCY_MISSING"), ("a.pdf", b"no", "SOURCE_FORMAT_INVALID"), ("a.zzz", b"", "SOURCE_FORMAT_UNSUPPORTED"), ("a", b"", "SOURCE_FORMAT_UNSUPPORTED"), ("a.docx", b"PK\x03\x04", "SOURCE_FORMAT_INVALID"),
        ("a.xlsx", xlsx('<c r="B2"><f>1+1</f><v>2</v></c>'), "SOURCE_UNSAFE"), ("a.xlsx", xlsx(extra={"xl/vbaProject.bin": "x"}), "SOURCE_UNSAFE"), ("a.xlsx", xlsx(extra={"word/document.xml": "<a/>"}), "SOURCE_FORMAT_AMBIGUOUS"),
        ("a.xlsx", docx(), "SOURCE_FORMAT_INVALID"), ("a.docx", package({"../x": "1", "word/document.xml": "<a/>"}), "SOURCE_UNSAFE"), ("a.txt", b"\xff\xfe", "SOURCE_FORMAT_INVALID"),
    ],
)
def test_faults(name, content, code):
    with pytest.raises(P.SourceFault) as fault:
        P.parse_document(content, name)
    assert fault.value.code == code


def test_reader(spark, tmp_path):
    for name, content in {"a.txt": b"one\n\ntwo", "b.csv": b"x,y\n", "c.docx": docx(), "d.pdf": b"%PDF-", "e.csv": b""}.items():
        (tmp_path / name).write_bytes(content)
    rows = read_blocks(spark, str(tmp_path)).collect()
    assert sorted((r.source_name, r.kind or "", r.fault or "") for r in rows) == [("a.txt", "text", ""), ("a.txt", "text", ""), ("b.csv", "table", ""), ("c.docx", "table", ""), ("c.docx", "text", ""), ("c.docx", "text", ""), ("d.pdf", "", "SOURCE_DEPENDENCY_MISSING")]
    register(spark)
    again = spark.read.format("tessella_documents").load(str(tmp_path)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    files = spark.createDataFrame([("d", "a.txt", None)], "doc_id string, source_name string, content binary")
    assert parse_files(files).count() == 0


def test_publishing(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(5)
    first = sink.publish({"numbers": df}, root, "Survey_1")
    folder, manifest = sink.active(root, "Survey_1")
    assert folder.endswith(first) and spark.read.parquet(os.path.join(folder, "numbers")).count() == 5 and manifest["files"]
    with pytest.raises(sink.PublishError):
        sink.publish({"numbers": df}, root, "Survey_1")
    with pytest.raises(sink.PublishError):
        sink.publish({"numbers": df}, root, "survey_1", overwrite=True)
    second = sink.publish({"numbers": df.limit(2)}, root, "Survey_1", overwrite=True)
    assert second != first and sink.active(root, "Survey_1")[0].endswith(second)
    os.makedirs(os.path.join(root, "survey_1", "cutoff"))
    open(os.path.join(root, "survey_1", "lock"), "w").close()
    with pytest.raises(sink.PublishError):
        sink.publish({"numbers": df}, root, "Survey_1", overwrite=True)
    assert sink.recover(root, "Survey_1") == ["cutoff"]
    sink.publish({"numbers": df}, root, "Survey_1", overwrite=True)
    for bad in ("", "con", "a/b", "../x", "x.", "nul.txt"):
        with pytest.raises(sink.PublishError):
            sink.portable(bad)


def test_what_a_parser_stumbles_over_is_a_row(spark):
    from tessella.sources.reader import parse_files

    def broken(content):
        raise ZeroDivisionError

    files = spark.createDataFrame([("1", "a.odd", b"x"), ("2", "b.txt", b"fine")], "doc_id string, source_name string, content binary")
    out = {r.doc_id: (r.fault, r.text) for r in parse_files(files, {"odd": broken, "txt": __import__("tessella.sources.parsers", fromlist=["x"]).parse_text}).collect()}
    assert out == {"1": ("SOURCE_FORMAT_INVALID", None), "2": (None, "fine")}
