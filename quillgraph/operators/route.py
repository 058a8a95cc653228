"""Linking of questions to nodes, rule-based routing and template selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import name_key
from quillgraph.operators.graph import validate
from quillgraph.operators.resolve import plural_map
from quillgraph.plans.runtime import cut, join_sized
from quillgraph.schemas import ANCHOR_TYPES, INTERACTING, TERM_TYPES

MOST_CALLS = 3
# fixed values: shapes of questions
ENUMERATIVE = r"(?i)\blist\b|\bwhich .{0,40}\b(are|fall|apply)\b|\bwhat are\b"
SECOND_ASK = r"(?i),? and (who|what|how|where|does|is|are|against)\b"
PRONOUN_TAIL = r"(?i),? and (is|does|was|can|must|will) it\b"
ENUMERATES = r"(?i)^\s*list\b|\beach\b|\bannex\s+[ivx]+\b.{0,40}\b(cover|covers|areas|list)\b"
ENUMERATES_WIDE = ENUMERATES + r"|\b(what|which)\b.{0,40}\b(obligations|rights|requirements|tiers|categories|areas|mechanisms|grounds|cases|conditions|principles)\b"
DEFINITIONAL = r"(?i)\bdefinition of\b|\bdefined\b|\bwhat (does|is) .{0,60}\bmean\b|\bmeaning of\b"
CROSS_INSTRUMENT = r"(?i)\bgdpr\b|\bgeneral data protection\b|\bregulation \(eu\) 2016/679\b"


def surfaces(nodes: DataFrame) -> DataFrame:
    """``surface, rank, names``: canonical names, then aliases (of several nodes all), then their attested plurals."""
    canonical = nodes.select(name_key(F.col("canonical_name")).alias("surface"), F.col("canonical_name").alias("name"), F.lit(0).alias("r"))
    alias = nodes.select(F.explode("aliases").alias("a"), F.col("canonical_name").alias("name")).select(name_key(F.col("a")).alias("surface"), "name", F.lit(2).alias("r"))
    plain = canonical.unionByName(alias)
    fold = plural_map(plain.select(F.col("surface").alias("key")))
    folded = fold.join(plain.withColumnRenamed("surface", "singular"), "singular").select(F.col("plural").alias("surface"), "name", (F.col("r") + 1).alias("r"))
    every = plain.unionByName(folded).where(F.col("surface") != "")
    return every.groupBy("surface", "r").agg(F.array_sort(F.collect_set("name")).alias("names")).groupBy("surface").agg(F.min(F.struct("r", "names")).alias("m")).select("surface", F.col("m.r").alias("rank"), "m.names")


def link(questions: DataFrame, nodes: DataFrame, most_words: int | None = None) -> DataFrame:
    """questions(qid, question) -> ``qid, at, span, name, type, display, via, ambiguous``, leftmost-longest, one row per node.

    Word spans that begin like a surface meet the list by an equi-join; a fold over a question's few hits keeps the
    leftmost longest and moves on behind it.
    """
    list_ = cut(surfaces(nodes))
    # a span is worth spelling out only from a word some surface begins with, and only as long as its longest one
    firsts = list_.select(F.element_at(F.split("surface", " "), 1).alias("first"), F.size(F.split("surface", " ")).alias("n")).groupBy("first").agg(F.max("n").alias("longest"))
    w = F.filter(F.split(F.regexp_replace("question", "[?!]", ""), r"\s+"), lambda x: x != "")
    q = questions.select("qid", w.alias("w")).where(F.size("w") > 0)
    starts = q.select("qid", "w", F.posexplode("w").alias("at", "word"))
    own = "['’]s$|['’]$"
    # a mark standing alone is no word of a key: any surface may follow it
    word = F.col("word")  # alone, before other words (then its punctuation stays), and without a genitive
    begins = F.array_distinct(F.array(*(F.element_at(F.split(name_key(x), " "), 1) for x in (word, F.concat(word, F.lit(" a")), F.regexp_replace(word, own, "")))))
    starts = starts.select("qid", "w", "at", F.explode(begins).alias("first"))
    most = firsts.agg(F.max("longest").alias("longest")).select(F.lit("").alias("first"), "longest")
    starts = join_sized(starts, cut(firsts.unionByName(most.where("longest is not null"))), ["first"])
    room = F.size("w") - F.col("at")
    spans = starts.select("qid", "w", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(most_words) if most_words else F.col("longest") + 2, room))).alias("len"))
    text = F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ")
    spans = spans.select("qid", "at", "len", text.alias("span"))
    plain = name_key(F.col("span"))
    bare = F.when((F.col("len") == 1) & F.col("span").rlike(own), name_key(F.regexp_replace("span", own, "")))
    forms = spans.select("qid", "at", "len", "span", F.posexplode(F.array_compact(F.array(plain, bare))).alias("form", "surface"))
    hits = join_sized(forms, list_, ["surface"])
    one = hits.groupBy("qid", "at", "len").agg(F.min(F.struct("form", "rank", "names", "span")).alias("h"))
    packed = one.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("len")).alias("neg"), "h"))).alias("all"))
    start = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<struct<at:int,rank:int,names:array<string>,span:string>>)").alias("kept"))
    take = lambda acc, x: F.when(
        x["at"] >= acc["end"], F.struct((x["at"] - x["neg"]).alias("end"), F.array_append(acc["kept"], F.struct(x["at"].alias("at"), x["h"]["rank"].alias("rank"), x["h"]["names"].alias("names"), x["h"]["span"].alias("span"))).alias("kept"))
    ).otherwise(acc)
    chosen = packed.select("qid", F.inline(F.aggregate("all", start, take)["kept"]))
    each = chosen.select("qid", "at", "span", F.when(F.col("rank") < 2, "canonical").otherwise("alias").alias("via"), (F.size("names") > 1).alias("ambiguous"), F.explode("names").alias("name"))
    first = each.groupBy("qid", "name").agg(F.min(F.struct("at", "span", "via", "ambiguous")).alias("m")).select("qid", "m.at", "m.span", "name", "m.via", "m.ambiguous")
    return join_sized(first, nodes.select(F.col("canonical_name").alias("name"), "type", F.col("display_name").alias("display")), ["name"])


def enumeration_target(question: Column) -> Column:
    """The provision a question names outright: an annex before an article, GDPR if named, else AIA."""
    q = F.lower(question)
    reg = F.when(q.rlike(r"\bgdpr\b"), "GDPR").otherwise("AIA")
    annex, art = F.regexp_extract(q, r"\bannex\s+([ivx]+)\b", 1), F.regexp_extract(q, r"\barticles?\s+(\d+)\b", 1)
    return F.when(annex.isin("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii"), F.concat(reg, F.lit(" annex "), F.upper(annex))).when(art != "", F.concat(reg, F.lit(" article "), art))


def route(questions: DataFrame, linked: DataFrame) -> DataFrame:
    """``qid, route, rule, enumerates, target``: five rules, the first match wins; enumeration is a flag beside them."""
    types = linked.groupBy("qid").agg(F.collect_set("type").alias("types"))
    j = questions.join(types, "qid", "left")
    q = F.col("question")
    anchored = F.arrays_overlap("types", F.array(*map(F.lit, ANCHOR_TYPES)))
    rules = [
        ("vector", "R1-no-links", F.col("types").isNull()),
        ("vector", "R2-no-anchor", ~anchored),
        ("graph", "R3-enumerate-role", q.rlike(ENUMERATIVE) & ~q.rlike(SECOND_ASK) & F.array_contains("types", "ActorRole")),
        ("both", "R4-second-ask", q.rlike(SECOND_ASK) & ~q.rlike(PRONOUN_TAIL)),
    ]
    way, rule = F.lit("vector"), F.lit("R5-default")
    for r, name, hit in reversed(rules):
        way, rule = F.when(hit, r).otherwise(way), F.when(hit, name).otherwise(rule)
    return j.select("qid", way.alias("route"), rule.alias("rule"), q.rlike(ENUMERATES).alias("enumerates"), F.when(q.rlike(ENUMERATES), enumeration_target(q)).alias("target"))


_CALLS = "array<struct<template:string,a:string,b:string,rule:string>>"


def select_templates(questions: DataFrame, linked: DataFrame) -> DataFrame:
    """``qid, calls(template, a, b, rule)``: up to three template calls, in the order of the rules; two linked nodes without any make a bridge."""
    seen = linked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "name", "type"))).alias("l"))
    j = questions.join(seen, "qid", "left").withColumn("l", F.coalesce("l", F.expr("cast(array() as array<struct<at:int,name:string,type:string>>)")))
    q = F.col("question")
    first = lambda allowed: F.get(F.filter("l", lambda x: x["type"].isin(*allowed)), F.lit(0))["name"]
    call = lambda template, a, b, rule: F.struct(F.lit(template).alias("template"), a.alias("a"), b.alias("b"), F.lit(rule).alias("rule"))
    none = F.lit(None).cast("string")
    offers = [
        ("definition_of", "S1-definitional", first(TERM_TYPES), q.rlike(DEFINITIONAL)),
        ("enforcement_chain", "S2-obligation", first(("Obligation",)), F.lit(True)),
        ("cross_regulation", "S3-cross-instrument", first(INTERACTING), q.rlike(CROSS_INSTRUMENT)),
        ("obligations_for_role", "S4-role", first(("ActorRole",)), F.lit(True)),
        ("obligations_for_system", "S5-system", first(("SystemType",)), F.lit(True)),
    ]
    ruled = F.slice(F.array_compact(F.array(*(F.when(a.isNotNull() & c, call(t, a, none, r)) for t, r, a, c in offers))), 1, MOST_CALLS)
    bridge = F.array(call("path_between", F.get("l", F.lit(0))["name"], F.get("l", F.lit(1))["name"], "S6-bridge"))
    return j.select("qid", F.when(F.size(ruled) > 0, ruled).when(F.size("l") >= 2, bridge).otherwise(F.array()).cast(_CALLS).alias("calls"))


def single_calls(offers: DataFrame) -> DataFrame:
    """offers(qid, name, type) -> ``qid, call, template, a``: every template with one parameter that a node's type may fill."""
    fits = {"definition_of": TERM_TYPES, "enforcement_chain": ("Obligation",), "cross_regulation": INTERACTING, "obligations_for_role": ("ActorRole",), "obligations_for_system": ("SystemType",)}
    each = F.array_compact(F.array(*(F.when(F.col("type").isin(*types), F.lit(t)) for t, types in fits.items())))
    return offers.select("qid", F.col("name").alias("a"), F.explode(each).alias("template")).distinct().withColumn("call", F.xxhash64("template", "a")).select("qid", "call", "template", "a")


def plan_calls(plans: DataFrame) -> DataFrame:
    """Plans as rows ``qid, call, template, a, b, rule``, numbered in their order."""
    return plans.select("qid", F.posexplode("calls").alias("call", "c")).select("qid", "call", "c.template", "c.a", "c.b", "c.rule")


def plan_text(plans: DataFrame) -> DataFrame:
    """``qid, plan, rule``: the calls as ``template(anchor)`` and the rules that chose them, S0-none without any."""
    shown = F.transform("calls", lambda c: F.concat(c["template"], F.lit("("), F.concat_ws(",", c["a"], c["b"]), F.lit(")")))
    rules = F.array_join(F.transform("calls", lambda c: c["rule"]), "+")
    return plans.select("qid", F.array_join(shown, "; ").alias("plan"), F.when(F.size("calls") > 0, rules).otherwise("S0-none").alias("rule"))


def parse_plan(text: str) -> tuple[list[tuple[str, dict[str, str]]], list[str]]:
    """A model's plan, one ``template name=value ...`` per line: the first three valid calls, and the lines refused before them.

    Values may have several words; a line ``none`` is no call and no mistake.
    """
    calls: list[tuple[str, dict[str, str]]] = []
    rejected = []
    for line in (x.strip().strip("-* `") for x in text.splitlines()):
        if not line or line.casefold() == "none" or len(calls) == MOST_CALLS:
            continue
        name, _, rest = line.partition(" ")
        params = {m[1]: m[2].strip() for m in re.finditer(r"(\S+?)=(.*?)(?=\s+\S+?=|$)", rest)}
        try:
            if rest.strip() and not re.match(r"\s*\S+?=", rest):
                raise ValueError("a value before any name")
            validate(name, params)
            calls.append((name, params))
        except ValueError:
            rejected.append(line)
    return calls, rejected
