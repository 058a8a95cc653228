"""Consolidated legal acts as XHTML: articles, paragraphs, definitions and annex points.

A file's XML events are flattened once into a table of blocks: one row per direct child of an article or annex, with
its kind, its text and, for tables, its rows. Everything else is relational: points are runs of blocks numbered by a
running count of openers, sections the last section heading above, so acts spread over the executors by unit.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.plans.runtime import cut

# fixed values: ids and classes of the published format
_UNIT = re.compile(r"(art|anx)_(\d+|[IVXLC]+)")
_NUMBERED = re.compile(r"\d{3}\.(\d{3})")
_KINDS = {"oj-ti-art": "label", "eli-title": "label", "oj-doc-ti": "caption", "oj-ti-grseq-1": "heading", "oj-enumeration-spacing": "item", "oj-normal": "prose"}
_TITLE, _FOOTNOTE = "oj-sti-art", "oj-note-tag"
_APART = frozenset("div p table tbody thead tfoot tr td th br".split())
#: Annexes that are one point however they are laid out.
WHOLE_ANNEXES = ("II",)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def body(content: str) -> str:
    """The <body> alone, which is well-formed where the head is not."""
    at, end = content.find("<body"), content.rfind("</body>")
    if at < 0 or end < at:
        raise ValueError("no body")
    return content[at : end + len("</body>")]


class _Flatten:
    """Target of an XML parser. rows: unit, number, at, kind, id_number, text, table."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.depth = self.unit_depth = self.at = self.muted = self.tables = 0
        self.unit: tuple[str, str] | None = None
        self.kind, self.id_number = "", None
        self.text: list[str] = []
        self.marks: list[tuple[int, str, int]] = []  # open cells and titles: depth, what, where their text begins
        self.table: list[list[str]] = []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        name, classes, ident = tag.rpartition("}")[2], attrs.get("class", "").split(), attrs.get("id", "")
        self.depth += 1
        if self.unit is None:
            if name == "div" and (m := _UNIT.fullmatch(ident)):
                self.unit, self.unit_depth, self.at = (m[1], m[2]), self.depth, 0
            return
        level = self.depth - self.unit_depth
        if level == 1:
            numbered = _NUMBERED.fullmatch(ident) if name == "div" else None
            self.kind = "table" if name == "table" else "numbered" if numbered else next((_KINDS[c] for c in classes if c in _KINDS), "other")
            self.id_number = int(numbered[1]) if numbered else None
            self.text, self.table, self.marks, self.tables, self.muted = [], [], [], 0, 0
        elif self.muted or (name == "span" and _FOOTNOTE in classes):
            self.muted += 1
        if name in _APART:
            self.text.append(" ")
        if level == 2 and name == "p" and _TITLE in classes:
            self.marks.append((self.depth, "title", len(self.text)))
        self.tables += name == "table"
        if self.kind == "table" and self.tables == 1:
            if name == "tr":
                self.table.append([])
            elif name in ("td", "th") and self.table:
                self.marks.append((self.depth, "cell", len(self.text)))

    def data(self, text: str) -> None:
        if self.unit and not self.muted and self.depth > self.unit_depth:
            self.text.append(text)

    def end(self, tag: str) -> None:
        name = tag.rpartition("}")[2]
        level = self.depth - self.unit_depth
        if self.unit and level > 0:
            if self.marks and self.marks[-1][0] == self.depth:
                _, what, begin = self.marks.pop()
                inner = squeeze("".join(self.text[begin:]))
                if what == "cell":
                    self.table[-1].append(inner)
                else:
                    self.rows.append((*self.unit, self.at, "title", None, squeeze(inner.replace("`", "")), None))
            self.tables -= name == "table"
            self.muted -= self.muted > 0
            if name in _APART:
                self.text.append(" ")
            if level == 1:
                self.rows.append((*self.unit, self.at, self.kind, self.id_number, squeeze("".join(self.text)), self.table if self.kind == "table" else None))
                self.at += 1
        elif self.unit:
            self.unit = None
        self.depth -= 1

    def close(self) -> list[tuple]:
        return self.rows


def blocks(files: DataFrame) -> DataFrame:
    """files(path, content) -> ``path, unit, number, at, kind, id_number, text, cells``: the children of every article and annex, in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                parser = ET.XMLParser(target=_Flatten())
                parser.feed(body(content))
                rows += [(path, *r) for r in parser.close()]
            yield pd.DataFrame(rows, columns=["path", "unit", "number", "at", "kind", "id_number", "text", "cells"]).astype({"id_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, unit string, number string, at int, kind string, id_number int, text string, cells array<array<string>>")


def _digits(text: Column, pattern: str) -> Column:
    """The number a pattern captures, or null."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def _in_order(text: str, *order: str) -> Column:
    """Texts of a group joined by their order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return F.trim(F.array_join(F.filter(F.transform(packed, lambda x: x["_t"]), lambda t: t != ""), " "))


def paragraphs(flat: DataFrame) -> DataFrame:
    """``path, article, n, text``: numbered paragraphs, the printed number before the id's; an article without any is its paragraph 1."""
    own = flat.where((F.col("unit") == "art") & ~F.col("kind").isin("label", "title"))
    marker = r"^(\d+)\.\s+"
    numbered = own.where(F.col("kind") == "numbered").select("path", F.col("number").alias("article"), F.coalesce(_digits(F.col("text"), marker), "id_number").alias("n"), F.regexp_replace("text", marker, "").alias("text"))
    whole = own.groupBy("path", F.col("number").alias("article")).agg(F.max((F.col("kind") == "numbered").cast("int")).alias("any"), _in_order("text", "at").alias("text")).where("any = 0")
    return numbered.unionByName(whole.select("path", "article", F.lit(1).alias("n"), "text"))


def definitions(flat: DataFrame) -> DataFrame:
    """``path, article, n, text``: a table per entry, numbered ``(n)`` in the first cell of its last row, its text in the last cell."""
    row = F.try_element_at("cells", F.lit(-1))
    entry = flat.where((F.col("unit") == "art") & (F.col("kind") == "table") & (F.size("cells") > 0)).select("path", F.col("number").alias("article"), row.alias("row")).where(F.size("row") > 1)
    return entry.select("path", "article", _digits(F.col("row")[0], r"^\((\d+)\)$").alias("n"), F.try_element_at("row", F.lit(-1)).alias("text")).where("n is not null")


def annex_points(flat: DataFrame) -> DataFrame:
    """``path, annex, section, n, text``.

    Numbered headings, spaced items and numbered table rows open a point; unnumbered rows above the first of these
    open one each, counted on. What follows belongs to the last point opened. A section is named only where the
    annex uses a point number twice.
    """
    inside = flat.where((F.col("unit") == "anx") & (F.col("kind") != "caption"))
    whole = inside.where(F.col("number").isin(*WHOLE_ANNEXES)).groupBy("path", F.col("number").alias("annex")).agg(_in_order("text", "at").alias("text"))
    whole = whole.select("path", "annex", F.lit(None).cast("string").alias("section"), F.lit(1).alias("n"), "text")

    lines = inside.where(~F.col("number").isin(*WHOLE_ANNEXES) & F.col("kind").isin("heading", "item", "table", "prose"))
    # a table is its rows, another block one line without cells
    lines = lines.select("path", F.col("number").alias("annex"), "at", "kind", "text", F.posexplode_outer("cells").alias("row", "cell"))
    lines = lines.where((F.col("kind") != "table") | (F.size("cell") > 0)).withColumn("row", F.coalesce("row", F.lit(0)))
    before = F.slice("cell", 1, F.size("cell") - 1)
    mark = F.coalesce(F.get(F.filter(before, lambda c: c != ""), F.lit(0)), F.lit(""))
    last = F.try_element_at("cell", F.lit(-1))
    is_row = F.col("kind") == "table"
    lead = r"^(\d+)\.\s*"
    printed = F.when(is_row, _digits(mark, r"^(\d+)\.$")).when(F.col("kind").isin("heading", "item"), _digits(F.col("text"), lead))
    section = F.when(F.col("kind") == "heading", F.nullif(F.regexp_extract("text", r"^Section\s+(\w+)\b", 1), F.lit("")))
    content = F.when(is_row, F.when(printed.isNotNull(), last).otherwise(F.trim(F.concat_ws(" ", mark, last)))).when(F.col("kind") == "prose", F.col("text")).otherwise(F.regexp_replace("text", lead, ""))
    lines = lines.select("path", "annex", "at", "row", "kind", printed.alias("printed"), section.alias("section"), content.alias("content"))
    above = Window.partitionBy("path", "annex").orderBy("at", "row")
    sure = F.col("printed").isNotNull() | (F.col("kind") == "item")
    lines = lines.withColumn("taken", F.coalesce(F.max(sure).over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    lines = lines.withColumn("opens", sure | ((F.col("kind") == "table") & ~F.col("taken")))
    lines = lines.withColumn("point", F.sum(F.col("opens").cast("int")).over(above)).withColumn("section", F.last("section", ignorenulls=True).over(above))
    held = lines.where((F.col("point") > 0) & (F.col("opens") | F.col("kind").isin("table", "prose")))
    first = lambda c: F.max(F.when(F.col("opens"), F.col(c)))
    points = held.groupBy("path", "annex", "point").agg(F.coalesce(first("printed"), "point").cast("int").alias("n"), first("section").alias("section"), _in_order("content", "at", "row").alias("text"))
    repeated = points.groupBy("path", "annex").agg((F.count_distinct("n") < F.count("*")).alias("repeated"))
    points = points.join(repeated, ["path", "annex"]).select("path", "annex", F.when(F.col("repeated"), F.col("section")).alias("section"), "n", "text")
    return points.unionByName(whole)


_COLUMNS = {"article": "int", "article_title": "string", "paragraph": "int", "definition": "int", "annex": "string", "annex_title": "string", "section": "string", "point": "int", "text": "string"}


def _shaped(rows: DataFrame, **given: Column) -> DataFrame:
    return rows.select("path", *(given.get(c, F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items()))


def from_blocks(flat: DataFrame, definition_articles: tuple[int, ...] = ()) -> DataFrame:
    """One row per paragraph, definition or annex point; an article listed for definitions without any keeps its paragraphs."""
    titles = flat.where((F.col("unit") == "art") & (F.col("kind") == "title")).groupBy("path", F.col("number").alias("article")).agg(F.min_by("text", "at").alias("title"))
    # the first caption is the annex's number, the second its title
    names = flat.where((F.col("unit") == "anx") & (F.col("kind") == "caption")).groupBy("path", F.col("number").alias("annex")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("c"))
    entries = definitions(flat).where(F.col("article").cast("int").isin(*definition_articles)) if definition_articles else definitions(flat).where(F.lit(False))
    prose = paragraphs(flat).join(entries.select("path", "article").distinct(), ["path", "article"], "left_anti")
    c, title = F.col, F.coalesce("title", F.lit(""))
    out = _shaped(prose.join(titles, ["path", "article"], "left"), article=c("article"), article_title=title, paragraph=c("n"), text=c("text"))
    out = out.unionByName(_shaped(entries.join(titles, ["path", "article"], "left"), article=c("article"), article_title=title, definition=c("n"), text=c("text")))
    points = annex_points(flat).join(names, ["path", "annex"], "left")
    return out.unionByName(_shaped(points, annex=c("annex"), annex_title=F.coalesce(F.get("c", F.lit(1))["text"], F.lit("")), section=c("section"), point=c("n"), text=c("text")))


def parse_acts(files: DataFrame, definition_articles: tuple[int, ...] = ()) -> DataFrame:
    """files(path, content) -> one row per paragraph, definition or annex point."""
    return from_blocks(cut(blocks(files)), definition_articles)


def read_acts(spark: SparkSession, path: str, definition_articles: tuple[int, ...] = ()) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return parse_acts(files, definition_articles)
