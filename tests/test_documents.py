"""Segmentation, extraction, the Word decoder and diagnostics on whole documents."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from prosopon.functions import markup
from prosopon.operators import extract
from prosopon.plans.synth import FORMS, PROFILE
from prosopon.sources import corpus, docx, schemas

VITALS = "VOS, Jan (Jan), Dutch poet and first Head of the Sea Office (SO) 1920-1925, was born 2 May 1880"


def para(text, bold=False, kind="paragraph", level=None):
    return (kind, level, text, [(text, bold, False, False)], None)


def section(label, text):
    return ("paragraph", None, f"{label}: {text}", [(label, True, False, False), (":", True, False, False), (f" {text}", False, False, False)], None)


DOCS = {
    "full": [
        para(VITALS), para(" Named Vosje. "), para(""), para("Source: Sea museum"), para("On film: reel"), para("x" * 501), para("Text one", kind="heading", level=3),
        para("Life & <work>"), para("  "), para("written by ANN LEE"), section("ARCHIVES", "Box 1; Box 2"), para("Box 3 (all websites accessed 1 May 2020)"),
        section("LITERATURE", "A life"), para("Version 1 May 2020", True), para("How to Cite this Lives Register entry", True),
        para(f"Ann Lee, ‘VOS, Jan’ {PROFILE.citation_marker}"),
    ],
    "bare": [para("no vitals")],
    "empty": [],
    # A tail that is not bold belongs to the last section; a heading led by bold text ends one.
    "tail": [para(VITALS), para(""), section("PUBLICATIONS", "P"), para("tail one"), para(""), para("tail two")],
    "no_blank": [para(VITALS), para("Source: here"), para("note"), para(""), para("body")],
    # An earlier section's head lost its bold label, so a later-placed one does not stop the search.
    "swapped": [para(VITALS), para(""), section("LITERATURE", "L"), section("ARCHIVES", "A"), para("Version 1", True)],
    "source_only_label": [para(VITALS), para(""), para("Source:"), para("kept")],
}


@pytest.fixture(scope="module")
def bios(spark):
    rows = [(k, v, [("image", "", "", b""), ("p.png", None, "image/png", b"x")] if k == "full" else []) for k, v in DOCS.items()]
    docs = spark.createDataFrame(rows, f"doc_id string, blocks {schemas.BLOCKS}, attachments {schemas.ATTACHMENTS}")
    return {r.doc_id: r for r in extract.extract_all(docs, PROFILE, FORMS + [("Dutch", "Netherlands")]).collect()}


def codes(row):
    return {d.code for d in row.diagnostics}


def test_full_document(bios):
    b = bios["full"]
    assert (b.first_name, b.last_name, b.known_as, b.nationality, b.country) == ("Jan", "Vos", "Jan", "Dutch", "Netherlands")
    assert b.intro_notes == ["Named Vosje.", "On film: reel"]
    assert (b.image_source, b.version, b.authors) == ("Sea museum", "Version 1 May 2020", "Ann Lee")
    assert [i.raw for i in b.archives["items"]] == ["Box 1", "Box 2 Box 3"] and b.archives.websites_accessed_on == "1 May 2020"
    assert [i.raw for i in b.literature["items"]] == ["A life"]
    assert b.image_attachment.name == "p.png" and b.image_attachment.extension == "png"
    assert b.body == f"<p>{'x' * 501}</p><h3>Text one</h3><p>Life &#x26; &#x3C;work></p>"
    assert "<p> Box 1; Box 2</p>" in b.html and "ARCHIVES" not in b.html and "<p></p>" in b.html
    assert codes(b) == {"apl_publications_missing"}


def test_poor_documents(bios):
    assert codes(bios["bare"]) >= {"name_unparsed", "summary_unparsed", "life_unparsed", "roles_missing_input", "nationality_missing_input", "version_missing", "citation_missing", "image_source_missing"}
    assert "intro_missing" in codes(bios["empty"]) and "name_unparsed" not in codes(bios["empty"])
    assert bios["empty"].html == "" and bios["empty"].roles == []


def test_section_bounds(bios):
    assert [i.raw for i in bios["tail"].publications["items"]] == ["P tail one tail two"]
    assert bios["tail"].body == ""
    assert [i.raw for i in bios["swapped"].literature["items"]] == ["L ARCHIVES: A"]
    assert [i.raw for i in bios["swapped"].archives["items"]] == ["A"]


def test_source_next_to_the_vitals(bios):
    assert bios["no_blank"].intro_notes == ["Source: here", "note"] and bios["no_blank"].body == "<p>body</p>"
    b = bios["source_only_label"]
    assert b.image_source is None and "image_source_missing" not in codes(b) and b.body == "<p>Source:</p><p>kept</p>"


def test_claims_and_residual_cover_everything(spark):
    rows = [(k, v, []) for k, v in DOCS.items()]
    docs = spark.createDataFrame(rows, f"doc_id string, blocks {schemas.BLOCKS}, attachments {schemas.ATTACHMENTS}")
    found = extract.sections(extract.labelled_fields(extract.anchors(docs, PROFILE), PROFILE), PROFILE)
    flags = {r.doc_id: r.f for r in found.select("doc_id", F.transform("blocks", lambda b, i: extract.claimed(i)).alias("f")).collect()}
    assert {k: len(v) for k, v in flags.items()} == {k: len(v) for k, v in DOCS.items()}
    assert all(x is not None for v in flags.values() for x in v)


def word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>ARCHIVES</w:t></w:r><w:r><w:t xml:space='preserve'> one &amp; two</w:t></w:r></w:p>"
        "<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Life</w:t></w:r></w:p>"
        "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:rPr><w:i/><w:b w:val='0'/></w:rPr><w:t>item</w:t></w:r></w:p>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/media/image1.PNG", b"img")
    return out.getvalue()


def test_word_decoder(spark, tmp_path):
    (tmp_path / "Sub Dir").mkdir()
    (tmp_path / "Sub Dir" / "Vos-J 2020.docx").write_bytes(word_file())
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_bytes(b"x")
    files = corpus.scan(spark, str(tmp_path))
    identity = {r.doc_id: r for r in files.drop("content").collect()}
    assert set(identity) == {"sub-dir/vos-j-2020", "bad"}
    assert identity["sub-dir/vos-j-2020"].title == "Vos-J 2020" and identity["sub-dir/vos-j-2020"].image_key == "vos-j-2020"
    decoded = docx.decode(files)
    docs = {r.doc_id: r for r in decoded.collect()}
    assert docs["bad"].problem.startswith("BadZipFile") and docs["bad"].blocks == []
    good = docs["sub-dir/vos-j-2020"]
    assert [b.kind for b in good.blocks] == ["paragraph", "heading", "list", "table", "paragraph"]
    assert good.blocks[0].spans[0].bold and not good.blocks[2].spans[0].bold and good.blocks[2].spans[0].italic
    assert good.attachments[0].name == "image1.PNG" and bytes(good.attachments[0].data) == b"img"
    bios = {r.doc_id: r for r in extract.extract_all(decoded, PROFILE, FORMS).collect()}
    assert [d.code for d in bios["bad"].diagnostics] == ["document_unreadable"]
    assert bios["sub-dir/vos-j-2020"].html == "<p> one &#x26; two</p><h2>Life</h2><li><em>item</em></li><table><tbody><tr><td><p>c1</p></td></tr></tbody></table><p></p>"
    rows = corpus.blocks_table(decoded).where("lead_bold").collect()
    assert [(r.idx, r.text) for r in rows] == [(0, "ARCHIVES one & two")]
    assert corpus.attachments_table(decoded).count() == 1


def test_missing_folder_gives_warning(spark, tmp_path):
    found, warnings = corpus.scan_or_empty(spark, str(tmp_path / "nowhere"))
    assert found.count() == 0 and "does not exist" in warnings[0]
    (tmp_path / "a.txt").write_text("x")
    found, warnings = corpus.scan_or_empty(spark, str(tmp_path))
    assert found.count() == 0 and "No files found" in warnings[0]


def test_markup(apply):
    html = '<a class=x href="/a">1</a><a href=\'/base/b\'>2</a><a href="//h/c">3</a><a href="http://d">4</a><a href="#e">5</a><a href="/base">6</a><a href="/basement">7</a>'
    want = '<a class=x href="/base/a">1</a><a href=\'/base/b\'>2</a><a href="//h/c">3</a><a href="http://d">4</a><a href="#e">5</a><a href="/base">6</a><a href="/base/basement">7</a>'
    assert apply(lambda c: markup.prefix_links(c, "/base/"), [html]) == [want]
    assert apply(lambda c: markup.prefix_links(c, "/"), [html]) == [html]
    assert apply(markup.demote_headings, ["<h1>a</h1><H5 id=x>b</H5><h6>c</h6><header>"]) == ["<h2>a</h2><H6 id=x>b</H6><h6>c</h6><header>".replace("H6", "H6").replace("<H6", "<H6")]


def test_heading_anchors(spark):
    page = spark.createDataFrame([("p", "<h1>Über uns</h1><p>x</p><h2>Über uns</h2><h2>Q&amp;A</h2><!-- <h2>no</h2> -->")], "id string, html string")
    rows = corpus.heading_anchors(corpus.from_html(page, "id", "html")).orderBy("idx").collect()
    assert [r.anchor for r in rows] == ["über-uns", "über-uns-1", "qa"]


def docx_file(body, names=(), relations=""):
    import io
    import zipfile

    spaces = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {spaces}><w:body>{body}</w:body></w:document>")
        for name in names:
            archive.writestr(f"word/media/{name}", b"x")
        if relations:
            archive.writestr("word/_rels/document.xml.rels", f"<Relationships>{relations}</Relationships>")
    return out.getvalue()


def test_word_files_lose_nothing():
    from prosopon.sources.docx import read_docx

    line = lambda text: f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = f"<w:tbl><w:tr><w:tc>{line('in')}</w:tc></w:tr></w:tbl>"
    boxes = f"<w:p><w:r><mc:AlternateContent><mc:Choice>{line('box')}</mc:Choice><mc:Fallback>{line('box')}</mc:Fallback></mc:AlternateContent></w:r></w:p>"
    body = f"<w:sdt><w:sdtContent>{line('one')}</w:sdtContent></w:sdt><w:tbl><w:tr><w:tc>{line('out')}{cell}</w:tc></w:tr></w:tbl>{boxes}"
    blocks, _ = read_docx(docx_file(body))
    assert [b["text"] for b in blocks] == ["one", "outin", "box"]
    assert "<td><p>in</p></td>" in blocks[1]["html"]


def test_images_come_as_the_document_shows_them():
    from prosopon.sources.docx import read_docx

    names = ["image10.png", "image2.png", "image1.png"]
    assert [a["name"] for a in read_docx(docx_file("", names))[1]] == ["image1.png", "image2.png", "image10.png"]
    shown = docx_file('<w:p><w:r><w:drawing r:embed="x"/></w:r></w:p>', names, '<Relationship Id="x" Target="media/image2.png"/>')
    assert [a["name"] for a in read_docx(shown)[1]] == ["image2.png", "image1.png", "image10.png"]


def test_any_bad_file_is_a_row(spark):
    import struct

    from prosopon.sources import docx

    good = docx_file("<w:p><w:r><w:t>x</w:t></w:r></w:p>")
    locked = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag that says encrypted
        place = locked.index(mark) + at
        locked[place : place + 2] = struct.pack("<H", 1)
    odd = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):  # an unknown compression
        place = odd.index(mark) + at
        odd[place : place + 2] = struct.pack("<H", 77)
    files = [("good", bytearray(good)), ("locked", locked), ("odd", odd), ("cut", bytearray(good[:60])), ("none", None)]
    rows = {r.doc_id: r.problem for r in docx.decode(spark.createDataFrame(files, "doc_id string, content binary")).collect()}
    assert rows.pop("good") is None and all(rows.values()) and len(rows) == 4


def test_anchors_are_unique(spark):
    from prosopon.sources import corpus

    pages = spark.createDataFrame([(1, "".join(f"<h2>{h}</h2>" for h in ("A", "A-1", "A", "A", "B")))], "page_id long, html string")
    anchors = [r.anchor for r in corpus.heading_anchors(corpus.from_html(pages, "page_id", "html")).orderBy("idx").collect()]
    assert anchors == ["a", "a-1", "a-2", "a-3", "b"]


def test_an_empty_dictionary_finds_nothing(spark):
    from prosopon.functions.nationality import nationality

    row = spark.createDataFrame([("a French officer",)], "s string").select(nationality(F.col("s"), []).alias("n")).first()
    assert row.n.nationality is None and row.n.country is None


STYLES = (
    '<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:docDefaults><w:rPrDefault><w:rPr>{defaults}</w:rPr></w:rPrDefault></w:docDefaults>'
    '<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:rPr/></w:style>'
    '<w:style w:type="paragraph" w:styleId="Strong"><w:rPr><w:b/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Head"><w:basedOn w:val="Strong"/><w:rPr><w:u w:val="single"/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Plain"><w:basedOn w:val="Head"/><w:rPr><w:b w:val="0"/></w:rPr></w:style>'
    '<w:style w:type="paragraph" w:styleId="Loop"><w:basedOn w:val="Loop2"/></w:style><w:style w:type="paragraph" w:styleId="Loop2"><w:basedOn w:val="Loop"/></w:style>'
    '<w:style w:type="character" w:styleId="Toggle"><w:rPr><w:b/><w:i/></w:rPr></w:style></w:styles>'
)


def styled(body, defaults=""):
    import io

    from prosopon.sources.docx import read_docx

    plain = io.BytesIO(docx_file(body))
    with zipfile.ZipFile(plain, "a") as archive:
        archive.writestr("word/styles.xml", STYLES.format(defaults=defaults))
    return read_docx(plain.getvalue())[0]


def paragraph(text, style="", run=""):
    return f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>'


def test_bold_by_style():
    cases = [
        ("", "", (False, False, False)), ("Strong", "", (True, False, False)), ("Head", "", (True, False, True)), ("Plain", "", (False, False, True)), ("Loop", "", (False, False, False)),
        ("Unknown", "", (False, False, False)), ("Head", '<w:b w:val="false"/>', (False, False, True)), ("Head", '<w:u w:val="none"/>', (True, False, False)),
        ("", '<w:rStyle w:val="Toggle"/>', (True, True, False)), ("Head", '<w:rStyle w:val="Toggle"/>', (False, True, True)), ("Head", '<w:rStyle w:val="Toggle"/><w:b/>', (True, True, True)),
    ]
    blocks = styled("".join(paragraph(str(i), s, r) for i, (s, r, _) in enumerate(cases)))
    flags = [tuple(b["spans"][0][k] for k in ("bold", "italic", "underline")) for b in blocks]
    assert flags == [f for _, _, f in cases]
    (block,) = styled(paragraph("x", "Head", '<w:rStyle w:val="Toggle"/>'), "<w:b/>")
    assert block["spans"][0]["bold"]


def test_a_head_that_is_bold_by_style_ends_a_section(spark):
    import io

    from prosopon.operators.extract import extract_all

    body = paragraph("VOS, Jan, Danish poet, was born") + paragraph("ARCHIVES: One; Two.", "Plain") + paragraph("more of it", "Plain") + paragraph("Next", "Head") + paragraph("other text")
    out = io.BytesIO(docx_file(body))
    with zipfile.ZipFile(out, "a") as archive:
        archive.writestr("word/styles.xml", STYLES.format(defaults=""))
    files = spark.createDataFrame([("d", bytearray(out.getvalue()))], "doc_id string, content binary")
    (row,) = extract_all(docx.decode(files, partitions=2), PROFILE, FORMS).collect()
    assert [i.raw for i in row.archives["items"]] == ["One", "Two. more of it"]


def test_many_small_files_go_to_few_tasks(spark, tmp_path):
    """Spark by itself takes 32 files a task, however small; a caller's own setting holds."""
    for n in range(1200):
        (tmp_path / f"{n}.txt").write_text(str(n))
    files = corpus.scan(spark, str(tmp_path), "*.txt")
    assert files.rdd.getNumPartitions() <= 16
    assert {r.title: bytes(r.content) for r in files.select("title", "content").collect()} == {str(n): str(n).encode() for n in range(1200)}
    assert corpus.listing(spark, str(tmp_path), "*.txt").rdd.getNumPartitions() <= 16
    own = spark.newSession()
    own.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    assert corpus.scan(own, str(tmp_path), "*.txt").rdd.getNumPartitions() == 1200


def test_scanned_files_lie_in_few_folders(spark, tmp_path, monkeypatch):
    """A file per row, also for rows of one id or none, and no folder per document."""
    import hashlib

    from prosopon.plans import corpus as plans

    texts = [(n, f"text {n}") for n in range(-3, 600)] + [(7, "text 7"), (7, "other"), (None, "lost"), (8, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(plans, "new_folder", lambda spark, label: str(tmp_path / label))
    got = sorted(map(str, ((r.doc_id, r.length, r.digest) for r in plans.scanned_files(spark, str(tmp_path)).collect())))
    said = [(i, ("" if s is None else s).encode() + b"\n") for i, s in texts]
    assert got == sorted(str((i, len(s), hashlib.sha256(s).hexdigest())) for i, s in said)
    assert len(list((tmp_path / "files").iterdir())) <= 256


_NAMES = (
    "a.txt", "b c.txt", "100%25.txt", "plus+x.txt", "_h.txt", "_h=1.txt", ".dot.txt", "z.txt._COPYING_", "_metadata.txt", "empty.txt", "ü#1.txt", "br[1].txt", "{x}.txt", "UP.TXT", "other.md",
    "s1/one.txt", "_s2/two.txt", ".s3/three.txt", "s4=1/four.txt", "_s5=1/five.txt", "s6._COPYING_/six.txt", "_metadata/seven.txt", "s1/deep/er/eight.txt", "folder.txt/in.txt",
)


def test_tasks_find_the_files_that_sparks_reader_finds(spark, tmp_path):
    """Names that are passed over, patterns, links and empty files; the driver knows the tables of names only, not a file of the folder."""
    base = tmp_path / "a b%20+c"
    for name in _NAMES:
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text("" if name == "empty.txt" else name)
    (base / "link.txt").symlink_to(base / "a.txt")
    (base / "lost.txt").symlink_to(base / "nothing")
    columns = ("path", "modificationTime", "length", "content")
    for at in (str(base), f"file:{base}/"):
        for pattern in ("*", "*.txt", "{a,b*}.txt", "[^ab]*.txt", "br\\[1\\].txt", "nothing"):
            want = sorted(map(str, corpus._files_of_driver(spark, at, pattern).collect()))
            files = corpus.scan(spark, at, pattern)
            assert sorted(map(str, files.select(*columns).collect())) == want
            assert not any(str(base.name) in name for name in files.inputFiles())
            listed = corpus.listing(spark, at, pattern)
            assert sorted((r.path, r.modified, r.length) for r in listed.collect()) == sorted((r.relative_path, r.modificationTime, r.length) for r in files.collect())
            assert not any(str(base.name) in name for name in listed.inputFiles())
    inside = corpus.scan(spark, f"{tmp_path}/a*/s1", "*.txt")  # a pattern in the folder is left to Spark's reader
    assert {r.title for r in inside.select("title").collect()} == {"one", "eight"}


def test_content_comes_in_parts_and_only_where_it_is_asked_for(spark, tmp_path, monkeypatch):
    """Files larger than a batch, files that go after they were listed, and some files among others."""
    for n in range(40):
        (tmp_path / f"{n}.txt").write_bytes(bytes([n]) * (n * 50 + 1))
    monkeypatch.setattr(corpus, "BATCH_BYTES", 1000)
    files = corpus.scan(spark, str(tmp_path), "*.txt")
    assert {r.title: bytes(r.content) for r in files.collect()} == {str(n): bytes([n]) * (n * 50 + 1) for n in range(40)}
    some = corpus.listing(spark, str(tmp_path), "*.txt").where("path < '2'")
    among = corpus.scan(spark, str(tmp_path), "*.txt", among=some)
    assert among.columns == files.columns
    want = {str(n): n * 50 + 1 for n in range(40) if str(n) < "2"}
    assert {r.title: len(r.content) for r in among.collect()} == want
    by_driver = corpus.scan(spark, f"{tmp_path}*", "*.txt", among=some)
    assert by_driver.columns == files.columns and by_driver.count() == 0  # its paths are below another name
    (tmp_path / "7.txt").unlink()
    assert files.select("title").count() == 40 and {r.title: len(r.content) for r in among.collect()} == want
    with pytest.raises(Exception, match="7.txt"):
        files.select("digest").collect()
    own = spark.newSession()
    own.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    (tmp_path / "8.txt").unlink()
    assert corpus.scan(own, str(tmp_path), "*.txt").count() == 38


def test_scanned_files_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    """Spark's reader of files would hold them all in the driver."""
    from pyspark.sql.readwriter import DataFrameReader

    from prosopon.plans import corpus as plans

    spark.createDataFrame([(n, f"text {n}") for n in range(300)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    formats, ask = [], DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda reader, source: formats.append(source) or ask(reader, source))
    files = plans.scanned_files(spark, str(tmp_path))
    assert {(r.doc_id, r.length) for r in files.collect()} == {(n, len(f"text {n}") + 1) for n in range(300)}
    assert "binaryFile" not in formats and not any(name.endswith(".txt") for name in files.inputFiles())
