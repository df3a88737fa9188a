"""Boundaries in legal descriptions: text to closing call lists, as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import patterns as P
from ..sources.session import spread
from . import search

_WORD, _SYMBOL, _DISTANCE, _CURVE = (re.compile(p, re.I) for p in (P.WORD_BEARING, P.SYMBOL_BEARING, P.LEGAL_DISTANCE, P.CURVE_WORDS))
_START, _AREA = re.compile(P.POINT_OF_BEGINNING, re.I), re.compile(r"CONTAINING\s+(\d[\d,]*\.?\d*)\s*(acres?|ac\.?)", re.I)
NEAR = 80  # characters between the end of a boundary and its acreage


def _bearings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, canonical text) of word and symbol bearings in order, without overlaps."""
    found = sorted((m.start(), m.end(), m.groups()) for p in (_WORD, _SYMBOL) for m in p.finditer(text))
    out, last = [], -1
    for a, b, (ns, deg, minutes, seconds, ew) in found:
        if a >= last:
            out.append((a, b, f"{ns[0].upper()} {int(deg):02d}°{int(minutes):02d}'{seconds or '0'}\" {ew[0].upper()}"))
            last = b
    return out


def boundary_calls(segment: str) -> list[dict]:
    """Calls of a segment; none at all if a bearing has no distance before the next one."""
    marks = _bearings(segment)
    ends = [a for a, _, _ in marks[1:]] + [len(segment)]
    out = []
    for (_, b, text), stop in zip(marks, ends):
        d = _DISTANCE.search(segment, b, stop)
        if not d:
            return []
        out.append({"bearing": text, "distance": d[1].replace(",", "") + "'"})
    return out


def legal_descriptions(text: str | None) -> list[tuple[list[dict], str | None]]:
    """(calls, acres) of every boundary that closes to 1:2000, from each POINT OF BEGINNING to the next or to CONTAINING.

    Segments with curves are left alone; the acreage counts if it follows within 80 characters.
    """
    text, out = text or "", []
    starts = list(_START.finditer(text))
    for i, s in enumerate(starts):
        area = _AREA.search(text, s.end())
        stops = [m.start() for m in starts[i + 1 :]] + ([area.start()] if area else [])
        end = min(stops, default=len(text))
        if _CURVE.search(text, s.end(), end):
            continue
        calls = boundary_calls(text[s.end() : end])
        if len(calls) < 3 or any(search.vector(c) is None for c in calls):
            continue
        pts = search.points(calls)
        gap = search.closure(pts)
        if gap > 0 and search.perimeter(pts) / gap < search.MIN_PRECISION:
            continue
        acres = area[1].replace(",", "") if area and area.start() - end < NEAR else None
        if calls not in [c for c, _ in out]:
            out.append((calls, acres))
    return out


def parse_legal_descriptions(texts: DataFrame) -> DataFrame:
    """document_id, desc_pos, calls, stated_area_acres of every boundary in ``texts`` (document_id, text)."""
    kind = texts.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, calls, acres) for d, t in zip(pdf["document_id"], pdf["text"]) for k, (calls, acres) in enumerate(legal_descriptions(t))]
            yield pd.DataFrame(rows, columns=["document_id", "desc_pos", "calls", "stated_area_acres"])

    return spread(texts.select("document_id", "text")).mapInPandas(run, f"document_id {kind}, desc_pos int, calls array<struct<bearing:string,distance:string>>, stated_area_acres string")


_PASTED = re.compile(r"""([NS])\s*(\d{1,3})\s*[°oO*]\s*(\d{1,2})\s*['’′]\s*(\d{1,2}(?:\.\d+)?)\s*["”″]\s*([EW])""", re.I)
_FIELD = re.compile(r"^(arc|delta|radius|direction|turn|start tangent|start_tangent_bearing|tangent)\s*[:=]?\s*(.+)$", re.I)
_NAMES = {"arc": "arc_length", "delta": "delta", "radius": "radius", "start tangent": "start_tangent_bearing", "start_tangent_bearing": "start_tangent_bearing", "tangent": "start_tangent_bearing"}


def pasted_calls(text: str | None) -> tuple[list[dict], tuple[str, str] | None]:
    """Calls and an anchor from pasted lines: bearings with distances, ANCHOR blocks (two numbers) and CURVE blocks (fields)."""
    lines, out, anchor, i = [x.strip() for x in (text or "").splitlines() if x.strip()], [], None, 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if line.lower() == "anchor":
            pair = [re.search(r"-?\d{1,3}\.\d+", x) for x in lines[i : i + 2]]
            if len(pair) == 2 and all(pair):
                anchor, i = (pair[0][0], pair[1][0]), i + 2
        elif line.lower() == "curve":
            curve = {"call_type": "curve", "turn": "R"}
            while i < len(lines) and (m := _FIELD.match(lines[i])):
                name, value = m[1].lower(), m[2].strip()
                if name in ("direction", "turn"):
                    curve["turn"] = "L" if value[:1].lower() == "l" else "R"
                else:
                    curve[_NAMES[name]] = value
                i += 1
            if curve.get("radius") and curve.get("delta"):
                out.append(curve)
        elif m := _PASTED.search(line):
            if d := re.search(r"(\d[\d,]*\.?\d*)\s*'?", line[m.end() :]):
                out.append({"call_type": "line", "bearing": f"{m[1].upper()} {m[2]}°{m[3]}'{m[4]}\"{m[5].upper()}", "distance": d[1].replace(",", "") + "'"})
    return out, anchor
