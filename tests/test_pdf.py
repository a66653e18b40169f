"""PDF text through fonts' own code tables."""

import zlib

from siltstone.sources import notes, pdf

CMAP = b"""/CIDInit /ProcSet findresource begin begincmap
1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0003> <0020> <0105> <00660069> endbfchar
2 beginbfrange <0024> <003D> <0041> <0200> <0202> [<03B1> <D835DC00> <00DF>] endbfrange
endcmap"""
SMALL = b"begincmap 1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <61> <7A> <0041> endbfrange endcmap"


def stream(body, deflate=True):
    data = zlib.compress(body) if deflate else body
    return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" * deflate, data)


def document(objects):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + b"%%EOF"


def two_pages():
    """Two pages that call different fonts F1, the second by its parent's resources; page objects out of order; a form."""
    packed = {5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", 7: b"<< /Type /Font /ToUnicode 8 0 R >>"}
    heads, bodies = [], b""
    for n, body in packed.items():
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b" "
    head = b" ".join(heads) + b" "
    return document(
        {
            1: b"<< /Type /Catalog /Pages 2 0 R >>",
            2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 /Resources << /Font << /F1 7 0 R >> >> >>",
            3: b"<< /Type /Page /Parent 2 0 R /Contents [11 0 R 12 0 R] >>",
            4: b"<< /Type /Page /Parent 2 0 R /Resources 9 0 R /Contents 10 0 R >>",
            6: stream(CMAP),
            8: stream(SMALL, False),
            9: b"<< /Font << /F1 5 0 R /F2 99 0 R >> >>",
            10: stream(b"BT /F1 12 Tf <002400250003> Tj <0105> Tj 0 -14 Td [<0200> -20 <02010202>] TJ /F2 9 Tf (x) Tj ET"),
            11: stream(b"BT /F1 10 Tf (abc) Tj"),
            12: stream(b"(z!) Tj T* (\\141) Tj ET", False),
            13: stream(b"BT (form text) Tj ET"),
            20: b"<< /Type /ObjStm /N 2 /First %d" % len(head) + stream(head + bodies)[2:],
        }
    )


def test_fonts_of_each_page():
    assert pdf.pdf_strings(two_pages()) == "AB fi\nα\U0001d400ßx\nABCZ!\nA\nform text"


def test_code_map_intervals():
    found = pdf.CodeMap(CMAP)
    assert found.width == 2 and found.firsts == [0x03, 0x24, 0x105, 0x200, 0x201, 0x202]
    assert found.text(bytes.fromhex("0024003D003E0203")) == "AZ" and found.text(b"") == ""


def test_odd_files(spark, tmp_path):
    whole = two_pages()
    files = {"whole": whole, "cut": whole[: len(whole) // 2], "none": b"", "noise": bytes(range(256)) * 20, "loop": document({1: b"<< /Type /Pages /Kids [1 0 R 2 0 R] /Parent 1 0 R >>", 2: b"<< /Type /Page /Parent 1 0 R /Contents 9 0 R >>"})}
    df = spark.createDataFrame([(k, v) for k, v in files.items()] + [("null", None)], "path string, content binary")
    got = {r.path: r.text for r in pdf.pdf_text(df).collect()}
    assert got["whole"].startswith("AB fi") and got["none"] == got["null"] == got["loop"] == ""
    (tmp_path / "a.pdf").write_bytes(whole)
    (row,) = notes.extracted(notes.files(spark, str(tmp_path))).collect()
    assert row.method == "pdf" and "ABCZ!" in row.text
