import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.pdf import page_count
from ledgerloom.sources import files


def body(*objects, head=b"%PDF-1.7\n"):
    return head + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, text) for n, text in objects)


def plain(pages, count=True):
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(pages))
    node = b"<< /Type /Pages /Kids [" + kids + b"]" + (b" /Count %d" % pages if count else b"") + b" >>"
    own = [(10 + i, b"<< /Type /Page /Parent 2 0 R >>") for i in range(pages)]
    return body((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, node), *own) + b"xref\n0 1\ntrailer << /Size 9 /Root 1 0 R >>\nstartxref\n9\n%%EOF"


def packed(pages, flate=True, first=None):
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Count %d/Kids[]>>" % pages)]
    texts, places, at = [], [], 0
    for n, text in inner:
        places.append(b"%d %d" % (n, at))
        texts.append(text)
        at += len(text) + 1
    head = b" ".join(places) + b" "
    raw = head + b" ".join(texts)
    data = zlib.compress(raw) if flate else raw
    stream = b"<< /Type /ObjStm /N 2 /First %d%s /Length %d >>\nstream\n%s\nendstream" % (len(head) if first is None else first, b" /Filter /FlateDecode" if flate else b"", len(data), data)
    return body((5, stream), (6, b"<< /Type /XRef /Root 1 0 R /Size 7 >>\nstream\n\x00\x01\nendstream"))


@pytest.mark.parametrize(
    "data, pages",
    [
        (plain(3), 3), (plain(0), 0), (plain(2, count=False), 2), (packed(12), 12), (packed(7, flate=False), 7),
        (plain(3) + body((2, b"<< /Type /Pages /Count 4 /Kids [] >>"), head=b"\n"), 4),  # an update
        (body((1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Count 9 0 R>>"), (9, b"6")), 6),  # no trailer, count elsewhere
        (body((1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids [2 0 R]>>")), -1),  # a tree that bites its tail
        (body((1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids [3 0 R]>>")), -1),
        (body((1, b"<</Type/Catalog>>")), -1), (packed(4)[:-120], -1), (packed(4).replace(b"/FlateDecode", b"/LZWDecode  "), -1),
        (b"%PDF-1.4 no objects", -1), (b"nothing", -1), (b"", -1), (None, -1), (b"%PDF-1.4" + b"1 0 obj " * 20_000, -1),
    ],
)
def test_page_counts(data, pages):
    assert page_count(data) == pages


def test_ingest_counts_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(packed(12))
    (tmp_path / "b.pdf").write_bytes(b"damaged")
    rows = files.ingest(spark.read.format("binaryFile").load(str(tmp_path)), now="2025-01-01")
    assert {r.source_pdf_name: r.page_count for r in rows.collect()} == {"a.pdf": 12, "b.pdf": -1}
    encoded = rows.select("source_pdf_name", F.base64("content").alias("text"))
    assert encoded.select(files.decoded(F.col("text")).alias("b")).where("b IS NOT NULL").count() == 2
