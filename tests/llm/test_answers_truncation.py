from __future__ import annotations

import random

import numpy as np
import pytest

from quillgraph.llm import answers as A
from quillgraph.llm.endings import closers, ending_scores, strip_closers, visible_end
from quillgraph.llm.truncation import censoring, fit_censored, truncation


@pytest.mark.parametrize("a", [None, "", "  ", "...", "```\n```", "<p></p>", "&nbsp;", "null", "[]", "​", "**", "N/A", "—", "Answer:"])
def test_empty_answers(a):
    assert A.is_empty(a)


@pytest.mark.parametrize("a", ["No.", "30 days", "Art. 9(2)", "Ja.", "5"])
def test_brief_answers_are_none_of_these(a):
    assert not A.is_empty(a) and not A.copies("Who has to keep the log?", a) and not A.foreign("Who has to keep the log?", a) and A.declines(a) == (False, False)


def test_copies():
    q = "Who has to keep the updated log under Art. 86(4)?"
    for a in (q, q.upper(), f"You asked: {q}", f"{q}\n\nAnswer:", f"> {q} {q}", "Who has to the keep updated log Art. 86(4)", f"{q} (Article 47)"):
        assert A.copies(q, a), a
    assert not A.copies(q, f"{q} The deployer shall keep it for ten years after market entry.")


def test_foreign():
    q = "What must the provider do with the log?"
    de = "Der Betreiber muss das Protokoll auf Verlangen der Aufsicht löschen und die Liste dem Amt geben."
    en = "The provider shall keep the log for ten years after it was placed on the market."
    assert A.foreign(q, de) and not A.foreign("Was muss der Anbieter mit dem Protokoll tun?", de)
    assert not A.foreign(q, f"{en} The German text reads: “{de}”") and A.foreign(q, f"{en} {de} {de}") and not A.foreign("", de)


@pytest.mark.parametrize(
    ("a", "last"),
    [
        ("I'm sorry, but I am unable to help with that in this form.", True), ("Unfortunately, no answer can be given here. Please contact a qualified adviser.", True), ("Leider kann ich nicht weiterhelfen. Das tut mir leid.", True), ("The fee is due. None of this says what you want to know, so the question stays unanswered.", True), ("Pass.", True), ("Lo siento, prefiero no contestar; los pasajes tratan otras obligaciones.", True), ("Désolé, il m'est impossible d'apporter une réponse.", True),
        ("I cannot give legal advice, but the text is clear on this. The deployer shall keep it.", False), ("No answer can be given in one word; in short: The deployer keeps it.", False), ("Although I am unable to see the file, the rule is as follows. The deployer keeps it.", False), ("I can't assist with filing, yet the duty itself is plain. The deployer keeps it.", False), ("Sorry for the delay. The deployer keeps it.", False),
    ],
)
def test_declines(a, last):
    assert A.declines(a)[1] is last


NOUNS = ["audit trail", "risk register", "model card", "data sheet", "event log", "fee statement"]
WHO = ["provider", "deployer", "importer", "distributor", "agency"]


def sentence(rng):
    return rng.choice([f"The {rng.choice(WHO)} shall keep the {rng.choice(NOUNS)} for {rng.randrange(2, 90)} days at the request of the panel.", f"Where the {rng.choice(WHO)} fails to keep the {rng.choice(NOUNS)}, Art. {rng.randrange(1, 99)}({rng.randrange(1, 9)}) applies without undue delay.", f"A fee of {rng.randrange(5, 900)} units is due for each {rng.choice(NOUNS)} filed in Velmora."])


def corpus(n=900, seed=4):
    """Texts of three sources, with the ids of the cut ones."""
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        source = ("prose", "lines", "mail")[i % 3]
        parts = [sentence(rng) for _ in range(rng.randrange(2, 9))]
        t = "\n".join("- " + p.rstrip(".") for p in parts) if source == "lines" else " ".join(parts) + (" kind regards" if source == "mail" else "")
        if i % 4 == 0:
            t = f"Notes on the {rng.choice(NOUNS)}\n" + t
        if source == "prose" and len(t) > 400:
            whole, t = t, t[:400]
            if whole[399] not in ".":
                cut.add(i)
        elif rng.random() < 0.05:
            at = rng.randrange(60, len(t) - 15)
            if t[at - 1] not in ". \n-" and not t[at - 1].isdigit() and t[at] not in ".\n":
                t = t[:at]
                cut.add(i)
        if i % 10 == 0:
            t += "\n\n© Ostrand commission, sheet 12"
        rows.append((i, t, source if i % 40 else source.upper() + " "))
    rows += [(10_000, None, "prose"), (10_001, "", None), (10_002, " \n", "prose"), (10_003, "Notes on the model card", "prose"), (10_004, "word " * 60_000, "prose")]
    return rows, cut


def test_truncation_on_planted_cuts(spark):
    rows, cut = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:5]], "doc_id bigint, text string, source string, key string")
    out = truncation(df).collect()
    got = {r.doc_id for r in out if r.truncated}
    assert len(cut) > 60 and len(got & cut) / len(cut) > 0.9 and len(got & cut) / len(got - {10_004}) > 0.9
    assert not got & {10_000, 10_001, 10_002, 10_003}
    assert {r.source for r in out} == {"prose", "lines", "mail", "(none)"}
    at = [r for r in out if r.source == "prose" and r.at_limit]
    assert len(at) > 50


def test_truncation_empty(spark):
    assert truncation(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_censored_fit_recovers_parameters():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(6, 0.8, 20_000))
    limit = 700
    free = x[x < limit]
    mu, sd = fit_censored(free, np.ones(len(free)), np.array([limit]), np.array([(x >= limit).sum()]))
    assert abs(mu - 6) < 0.02 and abs(sd - 0.8) < 0.02
    import pandas as pd

    v, n = np.unique(np.minimum(x, limit).astype(int), return_counts=True)
    c = censoring(pd.DataFrame({"source": "s", "unit": "chars", "length": v, "n": n}))
    assert c.limit.tolist() == [limit] and c.posterior[0] > 0.95


def test_ends():
    assert visible_end("a b&nbsp;</p> ") == ("a b", False) and visible_end("a &am") == ("a ", True) and visible_end("x <a hre") == ("x ", True)
    assert strip_closers("One. Two. kind regards\n\n© X, sheet 9", frozenset({"kind regards", "© X, sheet 0"})) == ("One. Two.", True, False)


def test_defects_end_to_end(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        rows.append((i, f"Which duty has the {rng.choice(WHO)} number {i} regarding the {rng.choice(NOUNS)}?", " ".join(sentence(rng) for _ in range(3)), "COMPLETE", "two-hop", "x"))
    q = rows[0][1]
    rows += [(1000, q, None, "COMPLETE", "two-hop", "x"), (1001, q, q, None, "two-hop", "x"), (1002, q, "Unfortunately, no answer can be given here.", "COMPLETE", "two-hop", "x"), (1003, q, "Unfortunately, no answer can be given here.", "COMPLETE", "Out-of-Scope", "x")]
    rows += [(1004, q, "Der Betreiber muss das Protokoll auf Verlangen der Aufsicht löschen und dem Amt geben.", "COMPLETE", "two-hop", "x"), (1005, q, rows[3][2] + " The provider shall keep the aud", "MAX_TOKENS", "two-hop", "x"), (1006, q, "30 days", "COMPLETE", "two-hop", "x"), (1007, rows[1][1], "30 days", "COMPLETE", "two-hop", "x"), (1008, rows[2][1], "30 days", None, None, "x"), (1009, None, "x" * 50_000 + ".", "MAX_TOKENS", "two-hop", "x")]
    rows.append(rows[-4])
    df = spark.createDataFrame(rows, "answer_id bigint, question string, answer string, finish_reason string, stratum string, key string")
    got = {r.answer_id: r.defect for r in A.defects(df).collect()}
    assert {k: v for k, v in got.items() if 1000 <= k < 1009} == {1000: "empty", 1001: "copies_question", 1002: "refusal", 1004: "other_language", 1005: "truncated"}
    assert len([k for k in got if k < 1000]) <= 3
    assert A.defects(df.limit(0)).count() == 0


def test_templates_link_similar_openings(spark):
    long = "with regret this assistant cannot answer the question you put to it"
    rows = [(i, f"p{i}", o, d) for i, (o, d) in enumerate([(long, True), (long, True), (" ".join(long.split()[:11]), False), ("yes", False), ("yes", False)])]
    df = spark.createDataFrame(rows, "key int, prompt string, opening string, first boolean")
    t = {r.opening: (r.prompts, round(r.declining, 2)) for r in A.opening_templates(df).collect()}
    assert t[long] == (3, 0.67) == t[" ".join(long.split()[:11])] and t["yes"] == (2, 0.0)


def test_refusals_in_words_no_lexicon_has(spark):
    rng = random.Random(5)
    rows = [(i, f"Which duty has the {rng.choice(WHO)} number {i} regarding the {rng.choice(NOUNS)}?", " ".join(sentence(rng) for _ in range(3))) for i in range(200)]
    ask = lambda i: rows[i][1]
    starts, stops = ("", "Sadly, ", "To my regret, ", "As things are, "), ("", " just now", " in such a case", " on this basis")
    refused = [f"{a}my hands are tied and nothing useful comes to mind{b}." for a in starts for b in stops]
    assert not any(any(A.declines(a)) for a in refused)
    rows += [(1000 + i, ask(i), a) for i, a in enumerate(refused)]
    rows += [(2000 + i, ask(20 + i), f"This one is easy once you look. {sentence(rng)} {sentence(rng)}") for i in range(12)]  # a bare opening with an answer behind it
    rows += [(3000 + i, ask(40 + i), a) for i, a in enumerate(["30 days"] * 4 + ["Only if agreed."] * 4)]
    rows.append((4000, ask(60), "That would be a matter of taste."))  # bare, but no template
    df = spark.createDataFrame([(*r, "COMPLETE", "two-hop") for r in rows], "answer_id bigint, question string, answer string, finish_reason string, stratum string")
    assert {r.answer_id for r in A.defects(df).collect() if r.defect == "refusal"} == {1000 + i for i in range(len(refused))}


def test_openings_differing_at_both_ends_link(spark):
    core = "i am not in a position to say anything useful"
    texts = [f"With regret, {core}.", f"{core} at present.", f"To be candid, {core} in this form.", "Three things count here: the log, the file and the reply."]
    df = spark.createDataFrame([(i, "one question" if i < 2 else f"p{i}", A.opening(t), False, True) for i, t in enumerate(texts)], "key int, prompt string, opening string, first boolean, alone boolean")
    t = {r.opening: (r.prompts, r.alone) for r in A.opening_templates(df).collect()}
    assert [t[A.opening(x)] for x in texts] == [(2, 1.0)] * 3 + [(1, 1.0)]


def test_ending_scores_repeat_keys(spark):
    df = spark.createDataFrame([(1, "The end of it."), (1, "The end of it."), (2, None)], "k int, t string")
    assert {(r.key, r.ends) for r in ending_scores(df, "k", "t").collect()} == {(1, "stop"), (2, "none")}
    assert closers(spark.createDataFrame([("x",)], "tail string"), 1) == frozenset()


def test_long_contexts_count_in_mid_line(spark):
    six = "must file it by the panel"
    rows = [(i, f"note n{chr(97 + i % 26)} says alpha {six} and then it goes on.\nnote n{chr(97 + i % 26)} says beta {six}\nMore follows here.") for i in range(20)]
    rows += [(100, f"Some other text here has alpha {six}"), (101, f"Some other text here has beta {six}")]
    got = {r.key: r for r in ending_scores(spark.createDataFrame(rows, "k int, t string"), "k", "t").where("key >= 100").collect()}
    assert got[100].width == got[101].width == 6 and got[100].whole < 0.1 and got[101].whole > 0.9


def test_long_padding_is_no_part_of_a_text(spark):
    rows = [(i, f"The log number {i} is kept by the panel.") for i in range(40)]
    rows += [(100, rows[0][1] + " \n\t\u00a0" * 300), (101, rows[0][1] + "\n"), (102, "\n " * 900), (103, rows[0][1])]
    got = {r.key: r for r in ending_scores(spark.createDataFrame(rows, "k int, t string"), "k", "t").where("key >= 100").collect()}
    assert got[100].ends == got[101].ends == "stop" and got[102].ends == "none" and got[100].whole == got[103].whole
    assert (got[100].chars, got[101].chars, got[103].chars) == (len(rows[0][1]) + 2, len(rows[0][1]) + 1, len(rows[0][1]))


def test_closing_phrases_in_brackets_and_long_ones_are_no_cuts(spark):
    rows, cut = corpus()
    rng = random.Random(2)
    tail = {5: " (sent while away from my desk)", 6: " this note was typed on a small machine by the night crew"}
    closed = [(i, t if i in cut else t.rstrip(".") + "." + tail[i % 7] if i % 7 in tail and s == "prose" and t else t, s) for i, t, s in rows if i < 10_000]
    behind = [(20_000 + i, (x := sentence(rng))[: x.index(" ", 20) + 3] + tail[5], "prose") for i in range(12)]  # the text stops in a word before its closing phrase
    out = truncation(spark.createDataFrame(closed + behind, "doc_id bigint, text string, source string")).where("truncated").collect()
    got = {r.doc_id for r in out}
    whole = {i for i, t, s in closed if t.endswith(tuple(tail.values()))}
    assert len(whole) > 20 and not got & whole and len([i for i in got if i >= 20_000]) >= 10


def test_templates_that_cite_nothing_decline_without_a_lexicon(spark):
    rng = random.Random(11)
    rows = [(i, f"Which duty has the {rng.choice(WHO)} number {i} regarding the {rng.choice(NOUNS)}?", " ".join(sentence(rng) for _ in range(3)), rng.choice([0, 1, 2, 3, 4, 5, 6, 7])) for i in range(300)]
    ask = lambda i: rows[i][1]
    said = ["Nope, next please.", "Zilch.", "My lips are sealed on that matter."]
    assert not any(A.declines(s)[1] for s in said)
    rows += [(1000 + 20 * k + i, ask(20 * k + i), s, 0 if i else 2) for k, s in enumerate(said) for i in range(8)]
    rows += [(2000 + i, ask(100 + i), f"{sentence(rng)} That is all there is and it settles nothing for you.", 0 if i else 1) for i in range(9)]  # declining at the end
    rows += [(3000 + i, ask(150 + i), s, i % 8) for s in ("Only if agreed.",) for i in range(16)]  # as brief, but cited
    rows += [(3100 + i, ask(180 + i), f"{sentence(rng)} This holds without any exception at all.", 1 + i) for i in range(9)]
    rows += [(3200 + i, ask(200 + i), f"My lips are sealed on that matter. {sentence(rng)} {sentence(rng)}", 3) for i in range(2)]  # answers after all
    df = spark.createDataFrame([(*r, "COMPLETE", "two-hop") for r in rows], "answer_id bigint, question string, answer string, n_citations int, finish_reason string, stratum string")
    got = {r.answer_id for r in A.defects(df).collect() if r.defect == "refusal"}
    want = {r[0] for r in rows if 1000 <= r[0] < 3000}
    assert want <= got and not {i for i in got - want if i >= 1000} and len(got - want) <= 3


def test_empty_and_foreign_read_whole_texts():
    assert A.is_empty("null" + "-" * 300) and not A.is_empty("null " * 60 + "duty")
    de = "Betreiber müssen Protokolle rechtzeitig aufbewahren, prüfen, ordnen, melden und vollständig übermitteln lassen. "
    assert A.foreign("What must the provider do with the log of the plan?", "It is the law of the land. " + de * 4)
