"""Read structures: which bases of a read are template, molecular barcode, sample barcode, cell barcode or skipped."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = "TBMCS"


@dataclass(frozen=True)
class Segment:
    kind: str
    length: int | None  # None: all that is left
    offset: int  # from the read's begin, or (below 0) from its end


def parse(text: str) -> list[Segment]:
    """Segments of e.g. `5M5S+T`: one of them may have + for a length; those after it count from the read's end."""
    got = re.findall(r"(\d+|\+)([A-Z])", text.replace(" ", "").upper())
    if "".join(a + b for a, b in got) != text.replace(" ", "").upper() or not got:
        raise ValueError(f"not a read structure: {text!r}")
    if any(b not in KINDS or a == "0" for a, b in got) or sum(a == "+" for a, _ in got) > 1:
        raise ValueError(f"a read structure has kinds {KINDS}, lengths above 0 and + once at most: {text!r}")
    open_ = next((i for i, (a, _) in enumerate(got) if a == "+"), len(got))
    out = []
    for i, (a, kind) in enumerate(got):
        before = sum(int(x) for x, _ in got[: min(i, open_)])
        out.append(Segment(kind, None if a == "+" else int(a), before if i <= open_ else -sum(int(x) for x, _ in got[i:])))
    return out


def pieces(read: Column, segments: list[Segment], kind: str) -> list[Column]:
    """The read's segments of a kind, in order."""
    rest = sum(s.length or 0 for s in segments)
    length = F.length(read)
    out = []
    for s in segments:
        if s.kind == kind:
            start = F.lit(s.offset + 1) if s.offset >= 0 else F.greatest(length + s.offset + 1, F.lit(1))
            out.append(F.substring(read, start, F.lit(s.length) if s.length else F.greatest(length - rest, F.lit(0))))
    return out
