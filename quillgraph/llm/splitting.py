"""Splitting oversized texts at natural boundaries, with overlap.

Word offsets are a prefix-sum array; the natural boundaries of a text are a sorted array of word positions per
strength. The end of each piece is found by binary search: the last boundary within the capacity, stronger kinds
first as long as they leave the piece well filled, and a hard cut where no boundary fits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.unicode import PY_WORD
from quillgraph.plans.runtime import ship

#: Boundary kinds from strong to weak, and how full of the capacity a piece must be to be cut at one.
KINDS = ("paragraph", "line", "sentence", "clause")
LEAST_FILL = (0.5, 0.5, 0.3, 0.3)

# fixed values: abbreviations whose full stop ends no sentence
_SHORT = frozenset("art. arts. no. nos. nr. cf. e.g. i.e. approx. abs. para. paras. p. pp. vs. z.b. d.h. bzw. ca. sec. ch. fig. vol. etc. núm. pág. dr. mr. mrs. ms. st.".split())
_PARAGRAPH = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85 ])[^\S\n\r]*(?:\r\n|[\n\r\x0b\x0c\x85 ])| ")
_LINE = re.compile(r"[\n\r\x0b\x0c\x85  ]")


def boundaries(text: str, spans: list[tuple[int, int]]) -> tuple[list[int], ...]:
    """Per kind the sorted word positions k such that a piece may naturally end before word k. Stronger kinds are not repeated."""
    out: tuple[list[int], ...] = ([], [], [], [])
    for k in range(1, len(spans)):
        a, b = spans[k - 1]
        gap = text[b : spans[k][0]]
        if _PARAGRAPH.search(gap):
            out[0].append(k)
        elif _LINE.search(gap):
            out[1].append(k)
        else:
            last = text[b - 1]
            if last in ".?!…\"'”’»)]":
                word = text[a:b]
                bare = word.rstrip("\"'”’»)]")
                nxt = text[spans[k][0]]
                if bare[-1:] in ".?!…" and bare.lower().lstrip("(\"'“„«[") not in _SHORT and not (nxt.islower() or (nxt.isdigit() and len(bare) < 4)):
                    out[2].append(k)
            elif last in ";:,–—":
                out[3].append(k)
    return out


def pieces(text: str, capacity: int, overlap: int, spans: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """``(first word, end word, kind)`` of each piece; one piece of kind ``whole`` if the text fits. spans are the words' places, if known.

    Every piece but the first starts exactly ``overlap`` words before the previous one ends.
    """
    if capacity < 1 or not 0 <= overlap < capacity:
        raise ValueError("overlap must be at least 0 and less than the capacity")
    spans = [m.span() for m in PY_WORD.finditer(text)] if spans is None else spans
    n = len(spans)
    if n <= capacity:
        return [(0, n, "whole")] if n else []
    marks = boundaries(text, spans)
    out, start = [], 0
    while start + capacity < n:
        end, kind = start + capacity, "hard"
        for name, at, fill in zip(KINDS, marks, LEAST_FILL, strict=True):
            i = bisect_right(at, start + capacity) - 1
            # a piece must get beyond the overlap, or the next one would start no later
            if i >= 0 and at[i] - start >= max(fill * capacity, overlap + 1):
                end, kind = at[i], name
                break
        out.append((start, end, kind))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def split_texts(texts: DataFrame, key: str, text: str, capacity: int, overlap: int) -> DataFrame:
    """``key, piece, pieces, first_word, n_words, boundary, text`` for every text with a word.

    A piece's text is the exact slice from its first to its last word, so without the overlaps the pieces hold every
    word once and in order. Texts within the capacity come out as one ``whole`` piece; null, empty and blank texts
    have none. Repeated rows are split alike. Stale counts in other columns are not read.
    """
    ship(texts.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows: list[list] = [[] for _ in range(7)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = [m.span() for m in PY_WORD.finditer(t)] if t else []
                cuts = pieces(t, capacity, overlap, spans) if spans else []
                for i, (first, end, kind) in enumerate(cuts):
                    for column, v in zip(rows, (k, i, len(cuts), first, end - first, kind, t[spans[first][0] : spans[end - 1][1]]), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], b.schema.field(0).type), *(pa.array(r, pa.int32()) for r in rows[1:5]), pa.array(rows[5], pa.string()), pa.array(rows[6], pa.string())], names=["key", "piece", "pieces", "first_word", "n_words", "boundary", "text"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"key {kind}, piece int, pieces int, first_word int, n_words int, boundary string, text string").withColumnRenamed("key", key)


def limit(size_limits: DataFrame, name: str) -> tuple[int, int]:
    """Capacity and overlap of a named limit."""
    r = size_limits.where(F.col("limit_name") == name).select("capacity", "overlap").first()
    if r is None:
        raise ValueError(f"no limit named {name}")
    return r.capacity, r.overlap
