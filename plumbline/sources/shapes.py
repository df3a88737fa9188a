"""Bytes of shapefile records, headers and attribute rows."""

from __future__ import annotations

import struct

POLYGON, TEXT_WIDTH, NUMBER_WIDTH, DIGITS = 5, 254, 18, 3
Box = tuple[float, float, float, float]


def polygon(number: int, ring: list[tuple[float, float]]) -> tuple[bytes, Box]:
    """Record of one ring, closed and clockwise, and its extent; ``number`` counts from 1."""
    ring = ring + (ring[:1] if ring[0] != ring[-1] else [])
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) > 0:
        ring = ring[::-1]
    xs, ys = zip(*ring)
    box = (min(xs), min(ys), max(xs), max(ys))
    body = struct.pack("<i4d3i", POLYGON, *box, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    return struct.pack(">2i", number, len(body) // 2) + body, box


def joined(a: Box | None, b: Box) -> Box:
    return b if a is None else (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def header(words: int, extent: Box | None) -> bytes:
    """Head of a file of so many 16-bit words, itself included."""
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, POLYGON, *(extent or (0.0,) * 4), 0, 0, 0, 0)


def table_header(rows: int, columns: list[tuple[str, bool]]) -> bytes:
    """Head of the attribute table; a column is its name and whether it holds numbers."""
    widths = [NUMBER_WIDTH if numeric else TEXT_WIDTH for _, numeric in columns]
    fields = b"".join(struct.pack("<11sc4xBB14x", name.encode()[:10], b"N" if numeric else b"C", width, DIGITS if numeric else 0) for (name, numeric), width in zip(columns, widths))
    return struct.pack("<B3BIHH20x", 3, 124, 1, 1, rows, 33 + 32 * len(columns), 1 + sum(widths)) + fields + b"\r"


def table_row(values: list, columns: list[tuple[str, bool]]) -> bytes:
    """One row: numbers with three digits, texts cut to their width without splitting a character."""
    def cell(v, numeric: bool) -> bytes:
        if numeric:
            return ("" if v is None or v != v else f"{v:.{DIGITS}f}").rjust(NUMBER_WIDTH).encode()[:NUMBER_WIDTH]
        return str("" if v is None else v).encode()[:TEXT_WIDTH].decode("utf-8", "ignore").encode().ljust(TEXT_WIDTH)

    return b" " + b"".join(cell(v, numeric) for v, (_, numeric) in zip(values, columns))
