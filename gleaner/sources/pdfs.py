"""PDF files as rows of bytes: drawn from lines of text, padded to a least size, and verified.

Verifying goes from the end as a strict reader does: the pointer to the cross-reference table must be near the end, the table must be where it points, each object where the table
says, and the pages are counted through the tree from the catalog.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.layout import FLOOR, MARGIN

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that no executor needs this package

#: Lines of a page, and bytes at the end of a file within which a strict reader looks for the pointer.
LINES, REACH = 50, 1024
_LATIN = "ISO-8859-1"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of the PDF files under a folder, through Spark's reader of whole files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def pad(content: Column, floor: int = FLOOR, margin: int = MARGIN) -> Column:
    """A file below the floor with a comment before its last pointer, so that all offsets stay and the pointer stays near the end; a file without a pointer stays as it is."""
    text = F.decode(content, _LATIN)
    at = F.length(text) - F.instr(F.reverse(text), "ferxtrats") - 8  # characters before the last startxref
    found = F.instr(F.reverse(text), "ferxtrats") > 0
    filler = F.concat(F.lit("%"), F.repeat(F.lit("X"), F.lit(floor + margin) - F.octet_length(content)), F.lit("\n"))
    whole = F.concat(F.substring(text, F.lit(1), at), filler, F.substring(text, at + 1, F.length(text)))
    return F.when((F.octet_length(content) < floor) & found, F.encode(whole, _LATIN)).otherwise(content)


def document(lines: list[str | None]) -> bytes:
    """A plain file of A4 pages with these lines, LINES of them a page; of none, one empty page. Characters beyond Latin-1 are drawn as question marks."""
    pages = [lines[i : i + LINES] for i in range(0, len(lines), LINES)] or [[]]
    first = 4  # objects 1 to 3 are the catalog, the tree and the font; each page has two
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    bodies = [x.encode() for x in objects]
    for i, page in enumerate(pages):
        shown = b"".join(b"(" + re.sub(rb"([\\()])", rb"\\\1", (x or "").replace("\r", " ").encode("latin-1", "replace")) + b") Tj T*\n" for x in page)
        stream = b"BT /F1 10 Tf 14 TL 50 790 Td\n" + shown + b"ET"
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {first + 2 * i + 1} 0 R >>".encode())
        bodies.append(f"<< /Length {len(stream)} >>\nstream\n".encode() + stream + b"\nendstream")
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        offsets.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{o:010d} 00000 n \n".encode() for o in offsets)
    return bytes(out + f"trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def _table(data: bytes, start: int) -> tuple[dict[int, int], bytes]:
    """Offsets of objects by number and the last trailer, through all tables that earlier ones name; raises ValueError with what is wrong."""
    found: dict[int, int] = {}
    last, seen = b"", set()
    while start is not None:
        if start in seen:
            raise ValueError("tables go round in a circle")
        seen.add(start)
        head = re.compile(rb"xref\s+").match(data, start)
        if not head:
            raise ValueError("no table where the pointer points")
        at = head.end()
        while section := re.compile(rb"(\d+) (\d+)\s*\n?").match(data, at):
            number, count, at = int(section[1]), int(section[2]), section.end()
            entries = data[at : at + 20 * count]
            if len(entries) < 20 * count or not re.fullmatch(rb"(\d{10} \d{5} [nf][ \r][\r\n])*", entries):
                raise ValueError("a broken table")
            for i in range(count):
                if entries[20 * i + 17 : 20 * i + 18] == b"n":
                    found.setdefault(number + i, int(entries[20 * i : 20 * i + 10]))
            at += 20 * count
        trailer = re.compile(rb"\s*trailer\s*<<(.*?)>>\s*(?:%[^\r\n]*\s*)*startxref", re.S).match(data, at)
        if not trailer:
            raise ValueError("no trailer")
        last = last or trailer[1]
        before = re.search(rb"/Prev (\d+)", trailer[1])
        start = int(before[1]) if before else None
    return found, last


def _verified(data: bytes) -> tuple[str | None, int | None]:
    """(what is wrong or None, number of pages)."""
    if not data.startswith(b"%PDF-"):
        return "no header", None
    end = data[-REACH:]
    pointer = re.search(rb"startxref\s+(\d+)\s+%%EOF\s*", end[end.rfind(b"startxref") :] if b"startxref" in end else b"")
    if not pointer:
        return "no pointer near the end", None
    try:
        table, trailer = _table(data, int(pointer[1]))
        for number, at in table.items():
            if not re.compile(rb"%d \d+ obj\b" % number).match(data, at):
                raise ValueError(f"object {number} is not where the table says")

        def body(ref: bytes | None, what: str) -> bytes:
            if ref is None or int(ref) not in table:
                raise ValueError(f"no {what}")
            at = table[int(ref)]
            stop = data.find(b"endobj", at)
            if stop < 0:
                raise ValueError(f"no end of the {what}")
            return data[at:stop].split(b"stream", 1)[0]

        def of(pattern: bytes, text: bytes) -> bytes | None:
            hit = re.search(pattern, text, re.S)
            return hit and hit[1]

        top = of(rb"/Pages (\d+) \d+ R", body(of(rb"/Root (\d+) \d+ R", trailer), "catalog"))
        pages, left, seen = 0, [top], set()
        told = of(rb"/Count (\d+)", body(top, "page tree"))
        while left:
            ref = left.pop()
            if ref in seen:
                raise ValueError("pages go round in a circle")
            seen.add(ref)
            node = body(ref, "page")
            if re.search(rb"/Type\s*/Pages\b", node):
                left += re.findall(rb"(\d+) \d+ R", of(rb"/Kids\s*\[(.*?)\]", node) or b"")
            else:
                pages += 1
        if told is not None and int(told) != pages:
            raise ValueError("another number of pages than the tree says")
        return None, pages
    except ValueError as e:
        return str(e), None


def _per_row(df: DataFrame, kept: list[str], columns: str, made) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):  # a few files at a time
                batch = whole.slice(i, 64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made(batch)], [*kept, *[c.split()[0] for c in columns.split(", ")]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept)
    return df.mapInArrow(each, f"{kinds}, {columns}")


def drawn(rows: DataFrame, name: str, lines: Column) -> DataFrame:
    """name and content: a file for each row, of an array of lines; null is none."""
    made = lambda batch: [pa.array([document(x or []) for x in batch.column("lines").to_pylist()], pa.binary())]
    return _per_row(rows.select(F.col(name), lines.cast("array<string>").alias("lines")), [name], "content binary", made)


def verified(files: DataFrame, name: str, floor: int = FLOOR) -> DataFrame:
    """name, opens, problem (what is wrong, the first thing found), pages, bytes and above_floor of each file (name, content).

    A null or empty content has no header. Comments before the pointer are fine; anything of more than a kilobyte after it puts it out of reach. Only tables are followed, not cross-reference
    streams. A task holds a few files at a time.
    """

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [_verified(x or b"") for x in batch.column("content").to_pylist()]
        return [pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())]

    out = _per_row(files.select(F.col(name), "content", F.coalesce(F.octet_length("content"), F.lit(0)).alias("bytes")), [name, "bytes"], "problem string, pages int", made)
    return out.select(name, F.col("problem").isNull().alias("opens"), "problem", "pages", "bytes", (F.col("bytes") >= floor).alias("above_floor"))
