import struct
import zlib

import numpy as np
import pytest

from tessera.sources import binary, parsers


def compound(**streams):
    """A compound file of streams of 4096 bytes or more, in sectors of 512."""
    names = list(streams)
    bodies = [s + bytes(max(4096, -(-len(s) // 512) * 512) - len(s)) for s in streams.values()]
    fat, sectors, starts = [0xFFFFFFFD, 0xFFFFFFFE], [], []
    for b in bodies:
        starts.append(len(fat))
        count = len(b) // 512
        fat += [*range(len(fat) + 1, len(fat) + count), 0xFFFFFFFE]
        sectors += [b[k : k + 512] for k in range(0, len(b), 512)]
    assert len(fat) <= 128
    entry = lambda name, kind, start, size: (name.encode("utf-16-le") + bytes(64))[:64] + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + bytes(48) + struct.pack("<IQ", start, size)
    directory = b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *(entry(n, 2, at, len(b)) for n, at, b in zip(names, starts, bodies))])
    assert len(directory) <= 512
    head = binary.OLE_MAGIC + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<8I", 1, 1, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    table = struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    fat_sector = struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat)))
    return head + table + fat_sector + directory.ljust(512, b"\0") + b"".join(sectors)


def test_compound_streams():
    got = binary.compound(compound(A=b"x" * 5000, B=b"yy"))
    assert got["A"][:5000] == b"x" * 5000 and got["B"].rstrip(b"\0") == b"yy"
    with pytest.raises(ValueError):
        binary.compound(b"PK")


def test_legacy_word():
    first, second = "First\rA \x13 HYPERLINK \"x\" \x14link\x15 here\r", "Zweiter – Absatz\r"
    main = bytearray(2048)
    struct.pack_into("<H", main, 10, 0x200)
    at = len(main)
    main += first.encode("cp1252")
    wide = len(main)
    main += second.encode("utf-16-le")
    plc = struct.pack("<3I", 0, len(first), len(first) + len(second)) + struct.pack("<HIH", 0, 0x40000000 | at * 2, 0) + struct.pack("<HIH", 0, wide, 0)
    clx = b"\x01\x02\x00zz\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<2I", main, 0x1A2, 0, len(clx))
    data = compound(**{"WordDocument": bytes(main), "1Table": clx})
    assert parsers.parse("docx", "a.doc", data) == ("First\n\nA link here\n\nZweiter – Absatz", None)


def test_legacy_sheet():
    record = lambda kind, body: struct.pack("<2H", kind, len(body)) + body
    string = lambda s: struct.pack("<HB", len(s), 0) + s.encode("latin-1")
    # the second string goes on, in two-byte letters, in a continuation
    sst = struct.pack("<2I", 3, 3) + string("name") + struct.pack("<HB", 4, 0) + b"va"
    more = b"\x01" + "lü".encode("utf-16-le") + string("end")
    head = record(0x809, bytes(16))
    bound = lambda at: record(0x85, struct.pack("<IBB", at, 0, 0) + b"\x02\x00S1")
    size = len(head + bound(0) + record(0xFC, sst) + record(0x3C, more) + record(0x0A, b""))
    cell = lambda r, c: struct.pack("<3H", r, c, 0)
    sheet = record(0x809, bytes(16)) + record(0xFD, cell(0, 0) + struct.pack("<I", 0)) + record(0xFD, cell(0, 1) + struct.pack("<I", 1))
    sheet += record(0x203, cell(1, 0) + struct.pack("<d", 2.5)) + record(0x27E, cell(1, 1) + struct.pack("<I", 300 << 2 | 2)) + record(0x27E, cell(1, 3) + struct.pack("<I", 1234 << 2 | 3))
    sheet += record(0xBD, struct.pack("<2H", 2, 0) + struct.pack("<HI", 0, 7 << 2 | 2) * 2 + struct.pack("<H", 1))
    sheet += record(0x06, cell(3, 0) + b"\0" * 6 + b"\xff\xff" + bytes(6)) + record(0x207, struct.pack("<HB", 2, 0) + b"ok") + record(0x0A, b"")
    data = compound(Workbook=head + bound(size) + record(0xFC, sst) + record(0x3C, more) + record(0x0A, b"") + sheet)
    assert parsers.parse("xlsx", "a.xls", data) == ("name | valü\n2.5 | 300 |  | 12.34\n7 | 7\nok", None)


def test_legacy_slides():
    atom = lambda kind, body, inst=0, ver=0: struct.pack("<2HI", inst << 4 | ver, kind, len(body)) + body
    listed = atom(4080, atom(1011, bytes(20)) + atom(3999, bytes(4)) + atom(4000, "Title – 1".encode("utf-16-le")) + atom(1011, bytes(20)) + atom(4008, b"Second"), 0, 15)
    notes = atom(4080, atom(1011, bytes(20)) + atom(4008, b"note"), 2, 15)
    slides = atom(1006, atom(1036, atom(0xF00D, atom(4008, b"Box one\rline"), 0, 15), 0, 15), 0, 15) + atom(1006, b"", 0, 15)
    data = compound(**{"PowerPoint Document": atom(1000, listed + notes, 0, 15) + slides})
    assert parsers.parse("pptx", "a.ppt", data) == ("## Slide 1\nTitle – 1\nBox one\nline\n\n## Slide 2\nSecond", None)


def pdf(pages, extra=b""):
    """Pages (content, compressed) with two fonts: F1 plain, F2 two-byte with a ToUnicode map."""
    cmap = b"1 beginbfchar <0001> <4E2D> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    out = [b"%PDF-1.4", b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj"]
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages)))
    out.append(f"2 0 obj << /Type /Pages /Kids [{kids}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> /XObject << /I 6 0 R >> >> >> endobj".encode())
    out.append(b"3 0 obj << /Type /Font /Subtype /Type1 >> endobj 4 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >> endobj")
    out.append(b"5 0 obj << /Length %d >> stream\n%s\nendstream endobj" % (len(cmap), cmap))
    out.append(b"6 0 obj << /Subtype /Image /Filter /DCTDecode /Length 4 >> stream\nJPEG\nendstream endobj")
    for k, (content, packed) in enumerate(pages):
        body = zlib.compress(content) if packed else content
        flags = b"/Filter /FlateDecode " if packed else b""
        out.append(b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj %d 0 obj << %s/Length %d >> stream\r\n%s\r\nendstream endobj" % (10 + 2 * k, 11 + 2 * k, 11 + 2 * k, flags, len(body), body))
    return b"\n".join(out) + extra


def test_pdf():
    one = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* (third\\040x) Tj ET"
    two = b"q BT /F2 9 Tf 1 0 0 1 5 5 Tm <000100020003> Tj ET Q BI /W 1 ID (junk EI BT /F1 1 Tf 0 0 Td (after) ' ET"
    body, error = parsers.parse("pdf", "a.pdf", pdf([(one, True), (two, False)]))
    assert error is None and body == "## Page 1\nHello (world)\nsecond line\nthird x\n\n## Page 2\n中ab\nafter"
    seen = []

    class Reader:
        def recognise(self, image):
            seen.append(image)
            return "seen"

    long = b"BT /F1 9 Tf 0 0 Td (" + b"word " * 40 + b") Tj ET"
    body, _ = parsers.parse("pdf", "a.pdf", pdf([(long, True), (b"", True)]), Reader())
    assert "## Page 2\nseen" in body and "word word" in body and seen == [b"JPEG"]
    assert parsers.parse("pdf", "a.pdf", b"no pdf") == ("", None)
    assert "encrypted" in parsers.parse("pdf", "a.pdf", pdf([], b"trailer << /Encrypt 9 0 R >>"))[1]


def test_pdf_object_streams():
    inner = b"7 0 8 29 << /Type /Catalog /Pages 8 0 R >><< /Type /Pages /Kids [9 0 R] >>"
    first = inner.index(b"<<")
    inner = b"7 0 8 %d " % (inner.index(b"<<", first + 2) - first) + inner[first:]
    packed = zlib.compress(inner)
    data = b"%%PDF-1.5\n1 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (inner.index(b"<<"), len(packed), packed)
    data += b"9 0 obj << /Type /Page /Contents 10 0 R >> endobj 10 0 obj << /Length 99 >> stream\nBT (hidden) Tj ET\nendstream endobj"
    assert parsers.parse("pdf", "a.pdf", data) == ("## Page 1\nhidden", None)


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_images_are_brought_to_size(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (20, 1600, 3)).astype(np.uint8)
    plain = binary.png_of(pixels)
    # the same image under each line filter
    flat, lines = pixels.reshape(20, -1).astype(int), []
    for y in range(20):
        above = flat[y - 1] if y else np.zeros(4800, int)
        left, corner = np.concatenate([[0] * 3, flat[y, :-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        near = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(0)
        guess = [0, left, above, (left + above) // 2, np.choose(near, [left, above, corner])][kind]
        lines.append(bytes([kind]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes())
    at = plain.index(b"IDAT") - 4
    body = zlib.compress(b"".join(lines))
    data = plain[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + plain[-12:]
    assert np.array_equal(binary.png_pixels(data), pixels)
    small = binary.png_pixels(parsers.fit(data))
    assert small.shape == (10, 800, 3) and np.array_equal(small[0, 0], pixels[:2, :2].reshape(-1, 3).astype(int).sum(0) // 4)
    assert parsers.fit(small_png := binary.png_of(pixels[:5, :7])) == small_png and parsers.fit(b"JPEG") == b"JPEG"
