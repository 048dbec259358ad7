"""Extraction of each format, from bytes made here."""

import io
import zipfile

from corvidex.sources import files


def packed(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return buf.getvalue()


def test_packages():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>"
    assert files.extract(".docx", packed(word__document_dot_xml=doc))[0] == "one\ttwo\n\nthree"
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="p"'
    slide = lambda *shapes: f"<p:sld {a}>" + "".join(f"<p:txBody>{''.join(f'<a:p><a:r><a:t>{x}</a:t></a:r></a:p>' for x in s)}</p:txBody>" for s in shapes) + "</p:sld>"
    deck = packed(ppt__slides__slide10_dot_xml=slide(["last"]), ppt__slides__slide2_dot_xml=slide(["a", "b"], ["c"], [" "]))
    assert files.extract(".pptx", deck)[0] == "a\nb\n\nc\n\nlast"
    t = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    sheet = f"<o {t}><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell><text:p>b</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell/></table:table-row></o>"
    assert files.extract(".ods", packed(content_dot_xml=sheet))[0] == "a\tb"
    book = packed(z_dot_xhtml="<p>first</p>", a_dot_html="<p>second</p>", style_dot_css="x")
    assert files.extract(".epub", book)[0] == "first\n\nsecond"


def test_workbook():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = packed(
        xl__sharedStrings_dot_xml=f"<sst {s}><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        xl__workbook_dot_xml=f'<workbook {s}><sheets><sheet name="B" r:id="r2"/><sheet name="A" r:id="r1"/></sheets></workbook>',
        xl___rels__workbook_dot_xml_dot_rels='<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></R>',
        xl__worksheets__sheet1_dot_xml=f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row><row r="2"/></sheetData></worksheet>',
        xl__worksheets__sheet2_dot_xml=f'<worksheet {s}><sheetData><row r="1"><c r="B1" t="s"><v>1</v></c><c r="C1" t="b"><v>1</v></c><c r="D1" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    )
    assert files.extract(".xlsx", data)[0] == "two runs\tTrue\tin\nname\t\t2"


def test_rich_text():
    rtf = rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}{\*\generator x;}Caf\'e9 \b bold\b0  \u8364? {\i in}\par next\tab\{x\}}"
    assert files.extract(".rtf", rtf)[0] == "Café bold € in\nnext\t{x}"
    assert files.extract(".rtf", b"")[0] == ""


def test_html_and_mail():
    page = "<title>T</title><script>a<b</script><p>x &amp; y<br>z<br/>w</p>\n\n\n\n<div>q</div><!-- c -->"
    assert files.html_text(page) == "Tx & yz\nw\n\nq" and files.html_text("") == ""
    mail = b"Subject: S\nContent-Type: text/html; charset=utf-8\n\n<p>caf\xc3\xa9</p>"
    assert files.extract(".eml", mail)[0] == "Subject: S\n\ncafé"


def test_registry():
    assert files.supported()[".md"] == "markdown" and ".py" not in files.supported() and files.supported(True)[".py"] == "code"
    assert (".pdf" in files.unavailable()) == (".pdf" not in files.supported())
    assert files.extract(".txt", b"a\r\nb\rc\xff")[0] == "a\nb\nc�"


def test_scan_rules(spark, tmp_path):
    (tmp_path / ".corvidexignore").write_text("private/\n")
    for name in ("a.py", "b.txt", "private/c.txt", ".corvidex/d.txt", "e.srt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("1\n00:01 --> 00:02\nsaid" if name.endswith("srt") else "text")
    got = {r["path"]: (r["type"], r["text"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"b.txt": ("text", "text"), "e.srt": ("text", "said")}
    assert "a.py" in {r["path"] for r in files.scan(spark, str(tmp_path), [], code=True).collect()}
    assert {r["ext"]: r["n"] for r in files.counts_by_suffix(spark, str(tmp_path)).collect()}[".py"] == 1
