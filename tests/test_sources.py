import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.sources import email, files, office, sinks, snapshots

MIME = (
    b"From: A <a@x.com>\r\nSubject: long\r\n  folded line\r\nSubject: second\r\nTo: b@y.com\r\nDate: Mon, 2 Mar 2026 10:00:00 +0000\r\n"
    b'Content-Type: multipart/mixed; boundary="BB"\r\n\r\n--BB\r\nContent-Type: text/html\r\n\r\n<p>rich</p>\r\n'
    b"--BB\r\nContent-Type: text/plain\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\nsoft =\r\nbreak =3D ok\r\n"
    b'--BB\r\nContent-Type: image/png; name="Logo.PNG"\r\nContent-ID: <id1>\r\nContent-Disposition: inline; filename=" Logo.PNG"\r\n'
    b"Content-Transfer-Encoding: base64\r\n\r\nAAECAw==\r\n--BB--\r\n"
)
HTML = b"Subject: h\n\nfirst\n".replace(b"\n\nfirst", b"\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\nPGI+aGk8L2I+PHA+eW91PC9wPg==")


def box(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(t, pr="", extra=""):
    return f"<w:r><w:rPr>{pr}</w:rPr>{extra}<w:t>{t}</w:t></w:r>"


YELLOW, GREEN = '<w:highlight w:val="yellow"/>', '<w:shd w:fill="00FF00"/>'
DOCX = box(**{"word__document.xml": (
    f"<w:document {W}><w:body><w:p>{run('plain ')}{run('one ', YELLOW)}{run('two', YELLOW)}{run('three', GREEN)}{run('end')}{run('four', YELLOW)}</w:p>"
    f"<w:p>{run('x', '', '<w:lastRenderedPageBreak/>')}{run(' ', YELLOW)}{run('last', YELLOW, chr(60) + 'w:br w:type=' + chr(34) + 'page' + chr(34) + '/>')}</w:p></w:body></w:document>")})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
PPTX = box(**{f"ppt__slides__slide{i}.xml": f"<s {A}><a:t>slide {i}</a:t><a:t> &amp; more </a:t></s>" for i in (10, 2, 1)})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = box(**{
    "xl__workbook.xml": f'<workbook {S} {R}><sheets><sheet name="First" r:id="r1"/></sheets></workbook>',
    "xl___rels__workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl__sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>",
    "xl__worksheets__sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>',
})


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    made = {
        "a.txt": b"plain t\xc3\xa9xt", "sub/mail.eml": MIME, "sub/html.EML": HTML, "sub/x.docx": DOCX, "deck.pptx": PPTX, "book.xlsx": XLSX,
        "page.html": b"<b>bold</b>", "bad.docx": b"not a zip", ".hidden": b"h", "sub/.dot/y.txt": b"y", "node_modules/z.txt": b"z",
        "1/2/3/4/5/6/7/8/ok.md": b"deep", "1/2/3/4/5/6/7/8/9/no.md": b"deeper", "pic.bin": b"\x00\x01",
    }
    for name, data in made.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_scan(spark, tree):
    rows = files.scan_files(spark, [tree + "/", tree + "/a.txt", tree + "/missing"]).collect()
    names = sorted(r.path[len(tree) + 1:] for r in rows if r.root_no == 0)
    near = ["a.txt", "sub/mail.eml", "sub/html.EML", "sub/x.docx", "deck.pptx", "book.xlsx", "page.html", "bad.docx", "1/2/3/4/5/6/7/8/ok.md", "pic.bin"]
    assert names == sorted([*near, "1/2/3/4/5/6/7/8/9/no.md"])
    cut = files.scan_files(spark, [tree], max_depth=8).collect()
    assert sorted(r.path[len(tree) + 1:] for r in cut) == sorted(near)
    assert [r.path for r in rows if r.root_no == 1] == [tree + "/a.txt"]
    assert files.scan_files(spark, [tree + "/missing"]).isEmpty()
    assert "content" not in files.scan_files(spark, [tree]).columns


def test_plain_text_and_skeleton(spark, tree):
    rows = files.plain_text(files.scan_files(spark, [tree], True))
    got = {r["name"]: r.text for r in rows.collect()}
    assert got["a.txt"] == "plain téxt" and got["pic.bin"] == "" and got["mail.eml"] == "" and got["page.html"] == "<b>bold</b>"
    web = files.plain_text(files.scan_files(spark, [tree], True), "web").filter("name = 'page.html'").first()
    assert web.text == "bold"
    kinds = {r["name"]: (r.kind, r.title) for r in files.skeleton(files.scan_files(spark, [tree])).collect()}
    assert kinds["html.EML"] == ("email", None) and kinds["a.txt"] == ("doc", "a")
    whole = "plain téxt\n\ndeeper\n\ndeep\n\n<b>bold</b>"
    for size in (1, 7, 100):
        chunks = files.source_chunks(rows.withColumn("matter", F.lit(1)), size=size).orderBy("chunk").collect()
        assert [r.text for r in chunks] == [whole[k:k + size] for k in range(0, len(whole), size)]
    assert files.source_chunks(rows.withColumn("matter", F.lit(1)).filter("text = ''")).collect() == []
    kept = {r["name"] for r in files.indexable(rows, "web").collect()}
    assert "pic.bin" not in kept and {"a.txt", "mail.eml", "html.EML", "deck.pptx"} <= kept


def test_emails(spark, tree):
    mails = files.scan_files(spark, [tree + "/sub"], True).filter("lower(name) like '%.eml'")
    got = {r.path.rsplit("/", 1)[1]: r for r in email.parse_emails(mails).collect()}
    m = got["mail.eml"]
    assert (m["from"], m.to, m.subject, m.body) == ("A <a@x.com>", "b@y.com", "long folded line", "soft break = ok")
    assert got["html.EML"].body == "hiyou"
    att = email.attachment_rows(email.parse_attachments(mails)).collect()
    assert [(a["name"], a.size, a.img, a.content_id) for a in att] == [("logo.png", 4, True, "id1")]
    raw = mails.filter("name = 'mail.eml'").select(email.header_fields(F.decode("content", "ISO-8859-1")).alias("h")).first().h
    assert raw["subject"] == "long folded line" and raw["from"] == "A <a@x.com>"


def test_inline_images(spark):
    body = 'a <img src="cid:one"> b <img src="cid:two"> <IMG alt=x src="cid:gone">'
    ids = spark.range(1).select(email.cid_references(F.lit(body)).alias("r")).first().r
    assert ids == ["one", "two", "gone"]
    refs = spark.createDataFrame([("p", i, r) for i, r in enumerate(ids)], "path string, ref_no int, cid string")
    atts = spark.createDataFrame([("p", 0, ""), ("p", 1, "two"), ("p", 2, "other")], "path string, att_idx int, content_id string")
    assert {r.cid: r.att_idx for r in email.resolve_inline(refs, atts).collect()} == {"two": 1, "one": 0, "gone": 2}
    dropped = spark.range(1).select(email.drop_inline_images(F.lit(body + " url(cid:two)"), F.lit("two")).alias("b")).first().b
    assert "<img src=\"cid:two\">" not in dropped and f"url({email.PIXEL})" in dropped and "cid:one" in dropped
    uri = 'x <img src="data:image/png;base64,AAECAw=="> AAECAw== y'
    out = spark.createDataFrame([(uri, bytearray([0, 1, 2, 3]))], "b string, c binary").select(
        email.strip_data_uri(F.col("b"), F.col("c")).alias("o")).first().o
    assert out == f'x <img src="{email.PIXEL}">  y'


def test_office(spark, tree):
    rows = files.scan_files(spark, [tree], True)
    parts = office.office_parts(rows)
    assert [r.path.rsplit("/", 1)[1] for r in parts.filter("error <> ''").collect()] == ["bad.docx"]
    got = {r.path.rsplit("/", 1)[1]: r.text for r in office.office_text(parts.filter("error = ''")).collect()}
    assert got["deck.pptx"] == "slide 1\n& more\n\nslide 2\n& more\n\nslide 10\n& more"
    assert got["book.xlsx"] == "# Sheet: First\nname\t\t5\n"
    assert got["x.docx"].startswith("plain one twothreeendfour\n\n")


def test_highlights(spark, tree):
    runs = office.highlight_runs(files.scan_files(spark, [tree + "/sub"], True).filter("name = 'x.docx'"))
    got = [(r.text, r.color, r.page) for r in office.highlight_passages(runs).orderBy("para", "run").collect()]
    assert got == [("one two", "yellow", 1), ("three", "#00FF00", 1), ("four", "yellow", 1), ("last", "yellow", 2)]


def read(path):
    data = b""
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), "rb") as f:
                data += f.read()
    return data.decode("utf-8")


def test_load_file_formats(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi"', "a,b"), (1, "line\r\nbreak", "þx\u0014"), (3, None, "z")], "k int, `A 1` string, B string")
    out = str(tmp_path / "o")
    sinks.write_lines(df, out, "csv", ["k"])
    assert read(out) == '﻿A 1,B\r\n"line\r\nbreak",þx\u0014\r\n"say ""hi""","a,b"\r\n,z\r\n'
    sinks.write_lines(df, out, "dat", ["k"])
    assert read(out) == "﻿þA 1þ\u0014þBþ\r\nþline breakþ\u0014þxþ\r\nþsay \"hi\"þ\u0014þa,bþ\r\nþþ\u0014þzþ\r\n"
    sinks.write_lines(df, out, "opt", ["k"], single_file=True)
    assert read(out) == 'line break,þx\u0014\r\nsay "hi",a b\r\n,z\r\n'
    sinks.write_lines(df.filter("k = 1"), out, "dat", ["k"], variant="web")
    assert read(out).endswith("þline\r\nbreakþ\u0014þx\u0014þ\r\n") and not read(out).startswith("﻿")


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert snapshots.current_version(spark, root, "c1") is None
    for n in (5, 8):
        snapshots.save_snapshot(root, "c1", {"docs": spark.range(n), "postings": spark.range(n).withColumn("term", F.lit("t"))}, {"postings": ["term", "id"]})
    assert snapshots.current_version(spark, root, "c1") == 2
    assert snapshots.load_snapshot(spark, root, "c1", "docs").count() == 8
    with pytest.raises(FileNotFoundError):
        snapshots.load_snapshot(spark, root, "nope", "docs")
