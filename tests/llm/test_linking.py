from __future__ import annotations

import random

import pytest

from quillgraph.llm import linking
from quillgraph.llm.linking import NONE, Names, link_candidates, link_spans, provision, unmatched_spans

LIST = [
    ("ActorRole", "appointed deployer", "appointed deployer", ["the appointed deployer", "this system"]),
    ("SystemType", "agricultural scoring system", "agricultural scoring system", ["AGSS", "this system"]),
    ("Obligation", "maintain tamper proof oversight protocol", "maintain tamper-proof oversight protocol", ["MTPOP"]),
    ("Penalty", "upper market ban", "upper market ban", []),
    ("Penalty", "lower publicity order", "lower publicity order", ["same word"]),
    ("Right", "right to erasure of workers", "right to erasure of workers", ["same word"]),
    ("Regulation", "ai act", "AI Act", ["AIA", "Artificial Intelligence Act"]),
    ("Regulation", "gdpr", "GDPR", ["General Data Protection Regulation"]),
    ("Article", "aia art. 12(3)", "AIA Art. 12(3)", []),
    ("Article", "gdpr art. 12", "GDPR Art. 12", []),
    ("Annex", "aia annex xii(1)", "AIA Annex XII(1)", []),
]
NAMES = Names(LIST)


@pytest.mark.parametrize(
    ("span", "name"),
    [
        ("Appointed  Deployer.", "appointed deployer"), ("app0inted deployer", "appointed deployer"), ("аppоintеd dеplоyer", "appointed deployer"), ("any such appointed deployer", "appointed deployer"), ("appointed deployers", "appointed deployer"), ("the appointed deployer concerned", "appointed deployer"), ("appointed deployer (see above)", "appointed deployer"),
        ("system, agricultural scoring", "agricultural scoring system"), ("system for agricultural scoring", "agricultural scoring system"), ("scoring agricultural system", "agricultural scoring system"), ("agri. scor. system", "agricultural scoring system"), ("agriculturalscoring system", "agricultural scoring system"), ("agrciultural scorng system", "agricultural scoring system"),
        ("maintain tamper-­proof oversight protocol", "maintain tamper proof oversight protocol"), ("MTPOP", "maintain tamper proof oversight protocol"), ("main tamp proo over prot", "maintain tamper proof oversight protocol"), ("UMB", "upper market ban"),
        ("Artikel 12 Absatz 3 AIA", "aia art. 12(3)"), ("paragraph 3 of Article 12, the AI Act", "aia art. 12(3)"), ("AIA ART.12.3", "aia art. 12(3)"), ("Art. 12 § 3 AIA", "aia art. 12(3)"), ("article 12 general data protection regulation", "gdpr art. 12"), ("AI Act annex 12 pt 1", "aia annex xii(1)"), ("Anhang XII Nr. 1 AIA", "aia annex xii(1)"),
        ("AIA Art. 275(3)", NONE), ("AIA Art. 12(4)", NONE), ("Article 12(3) of the Orrell treaty", NONE), ("AIA Annex XXIV(4)", NONE), ("lower market ban", NONE), ("upper chess ban", NONE), ("choral kite catalogue", NONE), ("this system", NONE), ("shushulo", NONE), ("???", NONE),
    ],
)
def test_link(span, name):
    assert NAMES.link(span) == name


def test_hint_settles_shared_alias():
    assert NAMES.link("same word") == NONE and NAMES.link("Same word", "Right") == "right to erasure of workers"


def test_provision_parts():
    assert provision("gdpr art 48 4") == ("gdpr", "art", 48, 4) and provision("no provision") is None


def _brute(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i or j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_finds_what_brute_force_finds():
    rng = random.Random(2)
    words = sorted(NAMES.vocabulary)
    for _ in range(150):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("abcdest")) if rng.random() < 0.5 else w and w.pop(rng.randrange(len(w)))
        t = "".join(w)
        for most in (0, 1, 2, 3):
            assert sorted(NAMES.near(t, most)) == sorted((_brute(t, x), x) for x in words if _brute(t, x) <= most)


def test_tables(spark):
    nodes = spark.createDataFrame([(*e, 1) for e in LIST] + [("X", None, None, None, 1)], "type string, canonical_name string, display_name string, aliases array<string>, span int")
    rows = [(1, "upper market ban", None, "wrong"), (1, "upper market ban", None, "wrong"), (2, None, "Penalty", None), (3, "  ", None, None), (4, "x" * 100_000, None, None), (5, "GDPR", "nonsense", None)]
    spans = spark.createDataFrame(rows, "span_id bigint, span string, type string, canonical_name string")
    assert {r.span_id: r.canonical_name for r in link_spans(spans, nodes).collect()} == {1: "upper market ban", 4: NONE, 5: "gdpr"}
    assert link_spans(spans.limit(0), nodes).count() == 0
    assert {r.canonical_name for r in link_spans(spans, nodes.limit(0)).collect()} == {NONE}


SPANS = ["app0inted deployer", "upper market ban", "uper market bann", "market upper bann", "this system", "same word", "scoring agricultral system", "agri. scor. system", "main tamp proo over prot", "Art. 12 § 3 AIA", "paragraph 3 of Article 12, the AI Act", "AIA Art. 275(3)", "lower market ban", "general data protecton regulation", "UMB", "choral kite catalogue", "article 12 general data protection regulatio"]
NODES = "type string, canonical_name string, display_name string, aliases array<string>"


def test_a_list_in_parts_links_like_one_list(spark, monkeypatch):
    nodes = spark.createDataFrame(LIST, NODES)
    spans = spark.createDataFrame([(i, s, t) for i, s in enumerate(SPANS) for t in (None, "Right")], "span_id bigint, span string, type string")
    spans = spans.selectExpr("span_id * 2 + int(type is null) AS span_id", "span", "type")
    whole = {(r.span, r.type): (r.entries, r.canonical_name) for r in link_candidates(spans.selectExpr("span", "coalesce(type, '') AS type"), nodes).collect()}
    assert whole["this system", ""] == (["agricultural scoring system", "appointed deployer"], NONE) and whole["same word", "Right"][1] == "right to erasure of workers"
    assert {(s, ""): NAMES.link(s) for s in SPANS} == {k: v[1] for k, v in whole.items() if not k[1]}
    for bound in (4, 2):
        monkeypatch.setattr(linking, "MOST_ENTRIES", bound)
        parts = {(r.span, r.type): (r.entries, r.canonical_name) for r in link_candidates(spans.selectExpr("span", "coalesce(type, '') AS type"), nodes).collect()}
        assert parts == whole
    assert link_spans(spans, nodes).count() == 2 * len(SPANS)


def test_ties_are_told_from_spans_without_entry(spark):
    nodes = spark.createDataFrame(LIST, NODES)
    spans = spark.createDataFrame([(1, "this system", None), (2, "this system", None), (3, "zzz", None), (4, "GDPR", None), (5, None, None)], "span_id bigint, span string, type string")
    got = {r.span: (r.why, r.entries, r.n_spans) for r in unmatched_spans(spans, nodes).collect()}
    assert got == {"this system": ("tie", "agricultural scoring system|appointed deployer", 2), "zzz": ("none", "", 1)}


def test_prefix_walk():
    assert sorted(NAMES._begun_by("pro")) == sorted(w for w in NAMES.vocabulary if w.startswith("pro")) and not list(NAMES._begun_by("zz"))
