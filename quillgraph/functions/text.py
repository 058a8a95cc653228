"""Column functions over names, labels and prose; all stay in the JVM except ``normalised`` (NFKD has no built-in)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import filterfalse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.plans.runtime import cut

# fixed values: short names of instruments
ABBREVIATIONS = {"aia": "AI Act", "ai act": "AI Act", "eu ai act": "AI Act", "gdpr": "GDPR", "led": "LED", "eudpr": "EUDPR"}
LABEL = r"\b(?:AIA|GDPR)\s+(?:Art\.\s*\d+|Annex\s+[IVXLC]+)(?:\([A-Za-z0-9]{1,4}\))*"


def name_key(name: Column) -> Column:
    """Names compare without case, quotes, outer punctuation, and with dashes and white space as one space."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), r"[\"'`‘’“”]", ""), r"[\s\-‐-―]+", " ")
    return F.btrim(clean, F.lit(" .,;:"))


_EDGE = " .,;:"
_FOLD = str.maketrans({c: None for c in "\"'`‘’“”"} | {chr(c): " " for c in (0x2D, *range(0x2010, 0x2016))})


def unwrapped(name: str) -> str:
    """The name without outer ``.,;:`` and without outer brackets beyond those that have a partner somewhere in it."""
    spare = {b: n for pair in ("()", "[]") for d in [name.count(pair[0]) - name.count(pair[1])] for b, n in zip(pair, (d, -d), strict=True)}

    def inner(positions: Iterable[int], brackets: str) -> int:
        for at in positions:
            c = name[at]
            if c in brackets and spare[c] > 0:
                spare[c] -= 1
            elif c not in _EDGE:
                return at
        return -1

    first, last = inner(range(len(name)), "(["), inner(reversed(range(len(name))), ")]")
    return name[first : last + 1] if 0 <= first <= last else ""


def normalise(name: str) -> str:
    """The key of a name: no accents, quotes or case, dashes and white space as one space, unwrapped, short names of acts spelled out."""
    marked = unicodedata.normalize("NFKD", name).lower()
    letters = filterfalse(unicodedata.combining, marked.translate(_FOLD))
    key = unwrapped(" ".join("".join(letters).split()))
    return ABBREVIATIONS.get(key, key)


@F.pandas_udf(T.StringType())
def normalised(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``normalise`` as an Arrow UDF; meant for distinct names, not for fact rows (see ``name_keys``)."""
    for s in parts:
        yield s.map(normalise, na_action="ignore")


def name_keys(*names: DataFrame) -> DataFrame:
    """``raw, key`` of the distinct names in the first columns of the tables; nulls have no key."""
    each = [n.select(F.col(n.columns[0]).alias("raw")).where(F.col("raw").isNotNull()).distinct() for n in names]
    return cut(reduce(DataFrame.unionByName, each).distinct().select("raw", normalised("raw").alias("key")))


def words(text: Column) -> Column:
    """Number of runs without white space; none in an empty text."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def query_terms(text: Column) -> Column:
    """Distinct tokens of three letters or more, joined by OR in a full-text query."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: F.length(t) >= 3)


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def labels_in(text: Column) -> Column:
    """Citation labels in prose, white space collapsed, in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({LABEL})"), F.lit(1)), lambda x: F.regexp_replace(x, r"\s+", " ")))


def parse_route(answer: Column) -> Column:
    """The route a model named, if its answer is exactly one; never searched for."""
    t = F.btrim(F.lower(F.trim(answer)), F.lit(" .\"'`"))
    return F.when(t.isin("vector", "graph", "both"), t)


def redact(text: Column, secrets: list[str]) -> Column:
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("***"))
    return text


def json_object(text: Column) -> Column:
    """The span from the first brace to the last, fences and trailing commas gone; null if there is none."""
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.nullif(F.regexp_replace(span, r",(\s*[}\]])", "$1"), F.lit(""))
