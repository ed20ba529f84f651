"""The number of pages of a PDF, from its page tree.

Objects are found in the body and inside object streams; of an object number the
last definition counts, as after an incremental update.  The tree starts at the
``/Root`` of the last trailer or cross-reference stream; its ``/Pages`` node names
the ``/Count`` of all its leaves.  A count that is missing is taken from the tree
itself.  Files that are damaged, encrypted in their structure, or no PDF give -1.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})\s+([0-9]{1,5})\s+obj\b")
_REF = rb"\s+([0-9]+)\s+[0-9]+\s+R\b"
_ROOT, _PAGES = re.compile(rb"/Root" + _REF), re.compile(rb"/Pages" + _REF)
_COUNT, _COUNT_REF = re.compile(rb"/Count\s+(-?[0-9]+)(?!\s+[0-9]+\s+R\b)"), re.compile(rb"/Count" + _REF)
_KIDS = re.compile(rb"/Kids\s*\[([^\]]*)\]")
_NUMBER = re.compile(rb"\s*(-?[0-9]+)")
_STREAM = re.compile(rb"stream\r?\n")
#: Bytes that all object streams of a file may unpack to.
MOST_UNPACKED = 256 << 20
MOST_NODES = 1_000_000


def _unpacked(body: bytes, room: int) -> bytes | None:
    """The content of a stream object, or None for other filters and damage."""
    begin = _STREAM.search(body)
    if not begin:
        return None
    head, raw = body[: begin.start()], body[begin.end() :]
    end = raw.rfind(b"endstream")
    raw = raw if end < 0 else raw[:end]
    if b"/Filter" not in head:
        return raw
    if not re.search(rb"/Filter\s*\[?\s*/FlateDecode\s*\]?", head) or b"/Predictor" in head:
        return None
    try:
        return zlib.decompressobj().decompress(raw, room)
    except zlib.error:
        return None


def objects(data: bytes) -> tuple[dict[int, bytes], bytes]:
    """Object number -> its text, and the text of trailers in file order."""
    found: dict[int, bytes] = {}
    tops, room = [], MOST_UNPACKED
    marks = list(_OBJECT.finditer(data))
    for mark, after in zip(marks, [*(m.start() for m in marks[1:]), len(data)]):
        body = data[mark.end() : after]
        end = body.rfind(b"endobj")
        trailer = body.find(b"trailer", max(end, 0))
        if trailer >= 0:
            tops.append(body[trailer:])
        body = body if end < 0 else body[:end]
        found[int(mark[1])] = body
        head = body[: begin.start()] if (begin := _STREAM.search(body)) else body
        if re.search(rb"/Type\s*/XRef\b", head):
            tops.append(head)
        if re.search(rb"/Type\s*/ObjStm\b", head) and room > 0:
            text, first = _unpacked(body, room), re.search(rb"/First\s+([0-9]+)", head)
            if text is None or first is None:
                continue
            room -= len(text)
            start = int(first[1])
            numbers = [int(x) for x in re.findall(rb"[0-9]+", text[:start])]
            places = [start + x for x in numbers[1::2]]
            for number, lo, hi in zip(numbers[::2], places, [*places[1:], len(text)]):
                found[number] = text[lo:hi]
    return found, b"\n".join(tops)


def _leaves(found: dict[int, bytes], node: int) -> int:
    """Pages below a node, counted one by one; every node once."""
    seen, waiting, pages = set(), [node], 0
    while waiting:
        at = waiting.pop()
        if at in seen or at not in found or len(seen) > MOST_NODES:
            return -1
        seen.add(at)
        kids = _KIDS.search(found[at])
        if kids:
            waiting += [int(x) for x in re.findall(rb"([0-9]+)\s+[0-9]+\s+R\b", kids[1])]
        elif re.search(rb"/Type\s*/Page\b", found[at]):
            pages += 1
        else:
            return -1
    return pages


def page_count(data: bytes | None) -> int:
    """Pages of a file; -1 where they cannot be told."""
    if not data or b"%PDF-" not in data[:1024]:
        return -1
    found, tops = objects(data)
    roots = _ROOT.findall(tops)
    root = found.get(int(roots[-1])) if roots else next((b for b in found.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    pages = _PAGES.search(root) if root else None
    node = int(pages[1]) if pages else -1
    if node not in found:
        return -1
    own = found[node]
    if ref := _COUNT_REF.search(own):
        value = _NUMBER.match(found.get(int(ref[1]), b""))
        return int(value[1]) if value and int(value[1]) >= 0 else -1
    count = _COUNT.search(own)
    return int(count[1]) if count and int(count[1]) >= 0 else _leaves(found, node)


def counted_pages(content: Column) -> Column:
    """``page_count`` of a column of bytes."""

    @lambda run: F.arrow_udf(run, "int")
    def run(files: pa.Array) -> pa.Array:
        return pa.array([page_count(x.as_py()) for x in files], pa.int32())

    return run(content)
