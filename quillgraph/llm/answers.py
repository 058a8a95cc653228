"""Defective question-answer pairs: empty, copied, refused, foreign or cut answers.

First and last sentences that hardly name what the questions are about are clustered by MinHash over three-word
shingles and verified (Jaccard of 0.5). A cluster recurring over several unrelated questions is a template. Whether it
declines, its answers tell: they mostly cite nothing, where other answers mostly do, or nothing of substance follows
in most of them. An answer is a refusal when it ends in such a template, or opens with one and nothing of substance
follows. A lexicon is left for sentences that do not recur. Copy, language and termination checks label the rest.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.endings import HEADING_WORDS, SHORT_TEXTS, ending_scores
from quillgraph.llm.truncation import _posteriors
from quillgraph.operators.graph import components
from quillgraph.plans.runtime import cut, join_sized, spread

#: A refusal varies in a phrase of two to four words before and after its core of four to eight ("With regret, ... at
#: present"): two such sentences share about half of their shingles of three, hardly any of five, and never 0.8 of them.
SHINGLE, SIMILAR = 3, 0.5
#: Pairs at SIMILAR meet in a band with a probability of 0.9999.
BANDS, ROWS = 32, 2
#: An opening shorter than this cannot be told from a brief answer; a word is topical if this share of the questions, and so many, use it; a sentence without numbers is bare up to this share of topical words, and may be a template up to this one.
OPENING_LEAST, TOPIC_SHARE, TOPIC_LEAST, BARE_SHARE, TEMPLATE_SHARE = 4, 0.0005, 3, 0.15, 0.3
#: A closing sentence of so few words may be a template although it has numbers.
SHORT_WORDS = 8
#: Unrelated questions a template must answer before it counts as one.
TEMPLATE_PROMPTS = 3

# fixed values: common function words of each language
FUNCTION_WORDS = {
    "en": "the of and to in is that for be has or not by with any shall must which who under was on a an it this can from had if each where when unless are as at may",
    "de": "der die das und zu den dem des ist nicht mit für wer wann wenn hat eine einer ein nach auf von dass im oder darf kann muss sich bei ob zum zur wurden vor bis wird hatte",
    "fr": "le la les des du de et est en que qui pour dans un une pas lorsque doit au aux par sur ne avec sans peut cas où il elle avait ont sont après avant toute",
    "es": "el la los las de del y en que para un una no con por se cuando debe al es quién qué lo sin podrá deberá tras antes su caso a salvo más",
}
# fixed values: what an answer without content may consist of
EMPTY_WORDS = {"null", "none", "nan", "undefined", "n/a", "na", "nil", "empty", "answer", "a", "antwort", "réponse", "respuesta", "nbsp", "p", "br"}
# fixed values: labels put before a repeated question or before an answer that never comes
LABELS = {"answer", "a", "q", "question", "user", "you", "asked", "antwort", "frage", "réponse", "respuesta", "pregunta", "assistant", "ok", "sure"}
# fixed values: how answers decline, by language
DECLINES = re.compile(
    r"""(?ix)
    \b(?:
      (?:unable|not\ able)\ to\ (?:help|assist|answer|respond|reply|say|tell|provide|comment)
    | (?:cannot|can't|can\ not|won't|will\ not|could\ not|couldn't)\ (?:answer|help|assist|say|respond|reply|discuss|comment|provide\ an\ answer|guess)
    | (?:must|have\ to|need\ to|would)\ (?:respectfully\ )?(?:decline|refuse) | (?:request|question)\ declined | rather\ not\ (?:comment|answer|say|respond)
    | no\ (?:answer|reply|response)\ (?:can\ be\ given|is\ possible|follows|can\ be\ offered) | leave\ this\ one\ open | not\ something\ (?:i|we)\ can
    | something\ (?:i|we)\ (?:can't|cannot)\ assist | outside\ (?:my|our)\ remit | falls?\ outside\ what | do\ not\ take\ up\ requests | not\ let\ me\ (?:reply|answer|say)
    | does\ not\ settle\ the\ matter | nothing\ here\ on\ which\ a\ reply | (?:i|we)\ (?:don't|do\ not)\ know | need\ more\ than\ these | no\ comment | insufficient\ context
    | (?:stays|remains|goes)\ unanswered | keep\ us\ from\ (?:responding|answering) | against\ (?:our|my)\ (?:rules|policy)
    | nicht\ (?:weiterhelfen|beantworten|antworten) | von\ einer\ antwort\ ab(?:sehen|gesehen) | antwort\ nicht\ möglich | keine\ (?:auskunft|antwort)\ (?:geben|erteilen|möglich)
    | préfère\ m['’]abstenir | (?:pas|impossible)\ (?:en\ mesure\ )?(?:de|d['’])\ ?(?:répondre|apporter\ une\ réponse) | reste\ sans\ réponse | dépasse\ ce\ que\ cet\ assistant | ne\ (?:peux|puis)\ pas\ (?:vous\ )?(?:répondre|aider)
    | prefiero\ no\ contestar | no\ (?:me\ es\ posible|puedo)\ (?:dar|responder|contestar|ayudar) | queda\ sin\ respuesta | excede\ lo\ que\ este\ asistente
    )\b | ^\W*pass\W*$"""
)
# fixed values: what may follow a refusal without being an answer
ASIDE = re.compile(
    r"""(?ix)\b(?:please\ contact|kindly\ consult|please\ consult|rephrase\ the\ question|passages\ concern\ other|(?:bitte\ )?wenden\ sie\ sich|consulte\ el|veuillez\ consulter
    |pasajes\ tratan\ otras|passages\ visent\ d|stellen\ betreffen\ andere|tut\ mir\ leid|thank\ you\ for|i['’]m\ sorry|we\ regret|try\ again)\b"""
)
_CONCEDES = re.compile(r"(?i)^\W*(?:although|while|obwohl|bien que|aunque)\b")
_TURNS = re.compile(r"(?i)\b(?:but|yet|however|in one word|in short|nevertheless)\b")
_SENTENCE = re.compile(r"(?<=[.?!:])\s+|\n+")
_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]{30,}\"|„[^“”]*[“”]")
_MARK = re.compile(r"(?:\s*(?:\[\d{1,3}\]|(?<=[.?!\]”\"])\s*\([^()\n]{0,60}(?:\([^()]{0,8}\)[^()\n]{0,20})*\)))+\s*$")
_NOTE = re.compile(r"(?<=\S)\s\([^()]{0,40}(?:\([^()]{0,8}\))?\)\s*$")
_MARKUP = re.compile(r"<[^<>]{0,80}>|&(?:[a-z]{2,8}|#\w{2,6});|[`*_#>~|]", re.IGNORECASE)
# fixed values: format characters that are not drawn
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_SPOKEN = {w: tuple(k for k, s in _SETS.items() if w in s) for w in frozenset().union(*_SETS.values())}


def plain(text: str) -> str:
    """Lower case, compatibility forms folded, markup and invisible characters gone."""
    text = _MARKUP.sub(" ", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).replace("’", "'").lower()
    return _INVISIBLE.sub("", text)


def language(text: str) -> tuple[str | None, int]:
    """The language whose function words the text has most of, and the number of its words; None for a tie or too few."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    hits = sorted(((sum(w in s for w in words), k) for k, s in _SETS.items()), reverse=True)
    return (hits[0][1] if hits[0][0] >= max(1, 0.08 * len(words)) and hits[0][0] > hits[1][0] else None), len(words)


def is_empty(answer: str | None) -> bool:
    text = plain(answer or "")
    words = [m[0] for m in islice(_WORD.finditer(text), 4)]
    if len(words) > 3:
        return False
    return not words or all(w in EMPTY_WORDS for w in words) or "/".join(words) in EMPTY_WORDS or text.strip(" .:\"'[](){}") in EMPTY_WORDS


def copies(question: str, answer: str) -> bool:
    """Whether the answer repeats most of the question and adds hardly a word."""
    q = _WORD.findall(plain(question))
    if len(q) < 3:
        return False
    known, said, new, most = set(q), set(), 0, max(1, len(q) // 12)
    for m in _WORD.finditer(plain(_MARK.sub("", _NOTE.sub("", answer)))):
        said.add(w := m[0])
        new += w not in known and w not in LABELS
        if new > most:
            return False
    return len(known & said) >= 0.6 * len(known)


def foreign(question: str, answer: str) -> bool:
    """Whether most words of the answer, quotations apart, stand in sentences of another language than the question's."""
    asked, _ = language(question)
    if asked is None:
        return False
    body = _QUOTED.sub(" ", answer)
    own = other = 0
    for s in _SENTENCE.split(body if body.strip() else answer):
        spoken, n = language(s)
        if spoken == asked:
            own += n
        elif spoken is not None and n >= 3:
            other += n
    return other > own and other >= 4


def declines(answer: str) -> tuple[bool, bool]:
    """Whether the first sentence declines, and whether the last telling sentence of the answer does."""
    sentences = _SENTENCE.split(answer.replace("’", "'"))

    def first_telling(some: Iterable[str]) -> bool:
        for s in some:
            if not re.search(r"[^\W\d_]{2}", s):
                continue
            cue = DECLINES.search(s)
            if not cue and (ASIDE.search(s) or len(_WORD.findall(s)) < 3):
                continue
            return bool(cue) and not _CONCEDES.search(s) and not _TURNS.search(s, cue.end())
        return False

    return first_telling(sentences), first_telling(reversed(sentences))


def _masked(words: list[str]) -> str:
    return " ".join(re.sub(r"\d+", "0", w) for w in words)


def opening(answer: str) -> str:
    """The first sentence, and the next ones until it has four words, digits masked."""
    return _ends(_SENTENCE.split(plain(answer)))[0]


def _ends(sentences: list[str]) -> tuple[str, str, list[str]]:
    """The opening, the last sentence of three words or more behind it (or nothing), and all sentences behind the opening."""
    words: list[str] = []
    i = 0
    for i, s in enumerate(sentences, 1):  # noqa: B007
        words += _WORD.findall(s)
        if len(words) >= OPENING_LEAST:
            break
    rest = sentences[i:]
    last = next((w for s in reversed(rest) if len(w := _WORD.findall(s)) >= 3), [])
    return _masked(words), _masked(last), rest


def is_bare(sentence: str, topics: frozenset[str], share: float = BARE_SHARE) -> bool:
    """Whether the sentence has no number and hardly a word that questions are about."""
    return not any(c.isdigit() for c in sentence) and topical_share(sentence, topics) <= share


def topical_share(sentence: str, topics: frozenset[str]) -> float:
    words = _WORD.findall(sentence)
    return sum(w in topics for w in words) / max(1, len(words))


def topical_words(questions: DataFrame) -> frozenset[str]:
    """Words a share of TOPIC_SHARE of the questions use, function words apart; so at most a question's words / TOPIC_SHARE."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in parts:
            for q in b.column(0).to_pylist():
                n.update({w for w in _WORD.findall(plain(q or "")) if len(w) > 3 and w not in _SPOKEN})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    least = max(TOPIC_LEAST, TOPIC_SHARE * questions.count())
    return frozenset(r.word for r in questions.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())


def _brief(answer: str) -> bool:
    """Up to four words, the last of which may end a phrase."""
    words = [w.lower() for w in _WORD.findall(answer)]
    return 0 < len(words) <= 4 and not any(words[-1] in s for s in _SETS.values())


_CHECKS = {c: "boolean" for c in ("empty", "copied", "foreign", "first", "last", "bare", "alone", "plain", "brief", "ended", "opens", "closes")} | {"opening": "string", "closing": "string"}


def _checked(parts: Iterator[pa.RecordBatch], topics: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Of key, question and answer: the checks of a pair by itself, and its opening and closing sentence.

    alone: a bare opening, and nothing of substance with it; plain: nothing of substance behind the opening; ended: with a
    full stop; opens and closes: the opening or closing may be part of a template, which a sentence that breaks off is not.
    """
    for b in parts:
        out: dict[str, list] = {c: [] for c in _CHECKS}
        for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            q, a = q or "", a or ""
            empty = is_empty(a)
            first, last = declines(a)
            sentences = _SENTENCE.split(plain(a))
            start, end, rest = _ends(sentences)
            tells = lambda s: len(_WORD.findall(s)) >= 3 and not is_bare(s, topics) and not ASIDE.search(s)
            bare, brief = start.count(" ") >= OPENING_LEAST - 1 and is_bare(start, topics), _brief(a)
            text = plain(_MARK.sub("", a)).rstrip(" \t\r\n\"'”’»)]")
            ended = text.endswith((".", "!", "?")) and not text.endswith("..")
            row = {
                "empty": empty, "copied": not empty and copies(q, a), "foreign": not empty and foreign(q, a), "first": first, "last": last, "bare": bare,
                "alone": bare and not any(map(tells, sentences)), "plain": not any(map(tells, rest)), "brief": brief, "ended": ended,
                "opens": brief or first or (start != "" and is_bare(start, topics, TEMPLATE_SHARE)), "closes": ended and end != "" and (is_bare(end, topics, TEMPLATE_SHARE) or (len(end.split()) <= SHORT_WORDS and topical_share(end, topics) <= TEMPLATE_SHARE)),
                "opening": start, "closing": end,
            }
            for c, v in row.items():
                out[c].append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[c], pa.string() if t == "string" else pa.bool_()) for c, t in _CHECKS.items())], names=["key", *out])


def _shingles(text: str) -> list[int]:
    w = text.split()
    return [int.from_bytes(hashlib.blake2b(" ".join(w[i : i + SHINGLE]).encode(), digest_size=8).digest(), "little") for i in range(max(1, len(w) - SHINGLE + 1))]


def _signed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(7)
    mul = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    for b in parts:
        sets, bands = [], []
        for t in b.column(0).to_pylist():
            s = np.unique(np.array(_shingles(t), np.uint64))
            sig = (s[:, None] * mul + add).min(axis=0).reshape(BANDS, ROWS)
            sets.append(s.astype(np.int64))
            bands.append([int.from_bytes(hashlib.blake2b(bytes([i]) + row.tobytes(), digest_size=8).digest(), "little", signed=True) for i, row in enumerate(sig)])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["opening", "shingles", "bands"])


def opening_templates(checked: DataFrame) -> DataFrame:
    """``opening, prompts, declining, alone, n, uncited``: of each opening's cluster the distinct prompts, the share that declines by the lexicon, the share after which nothing of substance follows (null without a column ``alone``), its answers, and those of them that cite nothing (null without a column ``uncited``).

    One row per distinct opening, so equal openings are never paired; links between different openings are all kept.
    """
    alone = F.sum(F.col("alone").cast("int")) if "alone" in checked.columns else F.lit(None).cast("bigint")
    uncited = F.sum(F.col("uncited").cast("int")) if "uncited" in checked.columns else F.lit(None).cast("bigint")
    checked = checked.where(F.col("opening") != "")
    each = checked.groupBy("opening").agg(F.count("*").alias("n"), F.sum(F.col("first").cast("int")).alias("d"), alone.alias("x"), uncited.alias("u"))
    signed = each.join(each.select("opening").mapInArrow(_signed, "opening string, shingles array<bigint>, bands array<bigint>"), "opening")
    signed = cut(signed.withColumn("id", F.monotonically_increasing_id()))
    # pairs that meet in any band are found by number and verified once each
    banded = signed.select("id", F.explode("bands").alias("band"))
    a, b = (banded.select(F.col("id").alias(x), "band") for x in ("a", "b"))
    met = a.join(b, "band").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    sets = [signed.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in ("a", "b")]
    both = F.size(F.array_intersect("s_a", "s_b"))
    alike = both >= SIMILAR * (F.size("s_a") + F.size("s_b") - both)
    links = cut(met.join(sets[0], "a").join(sets[1], "b").where(alike).select(F.col("a").alias("head"), F.col("b").alias("tail")))
    clusters = components(links).select(F.col("name").alias("id"), "component")
    label = cut(signed.select("id", "opening").join(clusters, "id", "left").select("opening", F.coalesce("component", "id").alias("label")))
    sums = signed.join(label, "opening").groupBy("label").agg((F.sum("d") / F.sum("n")).alias("declining"), (F.sum("x") / F.sum("n")).alias("alone"), F.sum("n").alias("n"), F.sum("u").alias("uncited"))
    # a question answered with two openings of a cluster counts once
    prompts = checked.select("opening", "prompt").join(label, "opening").groupBy("label").agg(F.countDistinct("prompt").alias("prompts"))
    return label.join(sums, "label").join(prompts, "label").select("opening", "label", "prompts", "declining", "alone", "n", "uncited")


def citing_nothing(templates: DataFrame, base: float) -> Column:
    """Whether a template's answers (n, uncited) cite nothing as those of declining templates do rather than as all answers do.

    The rates of the two kinds are read from the templates themselves, beginning with those of which most cite
    nothing; a template is then judged by its likelihood under both and by how many of each kind there are.
    """
    clusters = cut(templates.where(F.col("uncited").isNotNull()).groupBy("label").agg(F.max("n").alias("n"), F.max("uncited").alias("u")))
    n, u = F.col("n"), F.col("u")
    declines_: Column = u > n / 2
    low, high, odds = base, None, 1.0
    for _ in range(3):
        r = {x.d: x for x in clusters.groupBy(declines_.alias("d")).agg(F.sum("n").alias("n"), F.sum("u").alias("u")).collect()}
        if True not in r:
            return F.lit(False)
        high = (r[True].u + 1) / (r[True].n + 2)
        low = (r[False].u + base) / (r[False].n + 1) if False in r else base
        odds = r[True].n / (r[False].n if False in r else 1)
        if high <= low:
            return F.lit(False)
        declines_ = u * math.log(high / low) + (n - u) * math.log((1 - high) / (1 - low)) + math.log(odds) > 0
    n, u = F.col("n"), F.col("uncited")
    return F.coalesce(u * math.log(high / low) + (n - u) * math.log((1 - high) / (1 - low)) + math.log(odds) > 0, F.lit(False))


def finish_class(reason: str = "finish_reason"):
    """Uneven spellings of why generation ended: complete, limit, failed or unknown."""
    r = F.lower(F.coalesce(F.col(reason), F.lit("")))
    return F.when(r.contains("max_tokens") | r.contains("length"), "limit").when(r.contains("error") | r.contains("timeout"), "failed").when(r.contains("complete") | r.contains("stop"), "complete").otherwise("unknown")


def defects(answers: DataFrame) -> DataFrame:
    """``answer_id, defect`` for every defective pair; at most one defect each, repeated rows once.

    Order: empty, copies_question, refusal, other_language, truncated. A null question has no language and cannot be
    copied; a null answer is empty. stratum out-of-scope and unanswerable may be declined. An empty table gives an
    empty result; further columns are not read.
    """
    cited = F.col("n_citations") if "n_citations" in answers.columns else F.lit(None)
    chosen = answers.select(F.col("answer_id").alias("key"), "question", "answer", "stratum", finish_class().alias("finish"), cited.cast("int").alias("cited"))
    # of differing rows of one id the least counts
    rows = chosen.groupBy("key").agg(F.min(F.struct("question", "answer", "stratum", "finish", "cited")).alias("r")).select("key", "r.*")
    rows = spread(cut(rows))
    topics = topical_words(rows.select("question"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in _CHECKS.items())
    marks = rows.select("key", "question", "answer").mapInArrow(lambda parts: _checked(parts, topics), schema)
    marks = cut(marks.join(rows.select("key", F.xxhash64(F.lower(F.coalesce("question", F.lit("")))).alias("prompt"), F.coalesce(F.lower(F.trim("stratum")), F.lit("")).alias("stratum"), "finish", (F.col("cited") == 0).alias("uncited")), "key"))
    # an empty answer or a copied question opens with no template of its own; brief ones tell which short answers recur
    units = marks.where(~F.col("empty") & ~F.col("copied"))
    units = units.where("opens").select("opening", "prompt", "first", "alone", "uncited").unionByName(units.where("closes").select(F.col("closing").alias("opening"), "prompt", F.lit(False).alias("first"), F.lit(False).alias("alone"), "uncited"))
    recurring = cut(opening_templates(units).where(F.col("prompts") >= TEMPLATE_PROMPTS))
    base = marks.where(~F.col("empty") & F.col("uncited").isNotNull()).agg(F.avg(F.col("uncited").cast("int")).alias("u")).first().u
    silent = citing_nothing(recurring, base) if base else F.lit(False)
    templates = cut(recurring.select("opening", silent.alias("silent"), (F.col("alone") >= 0.5).alias("stands"), F.lit(True).alias("recurs")))
    judged = join_sized(marks, templates, ["opening"], "left")
    closers = templates.select(F.col("opening").alias("closing"), F.lit(True).alias("closes"), F.col("silent").alias("shuts"), F.lit(True).alias("shut"))
    judged = join_sized(judged, closers, ["closing", "closes"], "left")
    # marks of citations behind the last sentence are no part of its end
    bare = rows.where(F.col("answer").isNotNull()).select("key", F.regexp_replace("answer", r"(?:\s*(?:\[\d{1,3}\]|(?<=[.?!\]”\"])\s*\([^()\n]{0,60}(?:\([^()]{0,8}\)[^()\n]{0,20})*\)))+\s*$", "").alias("text"))
    ends = ending_scores(bare, "key", "text", SHORT_TEXTS).where(F.col("ends") != "none")
    w = F.col("whole")
    ends = ends.join(rows.select("key", "finish"), "key").withColumn("open", F.col("ends").isin("open", "dots", "half") | (w < 0.5)).withColumn("cut_word", F.col("cut_word") | (F.col("ends") == "half"))
    ends = cut(ends.withColumn("bin", F.round(F.log((1 - w) / w) * 2) / 2).withColumn("group", F.when(F.col("words") <= HEADING_WORDS, F.concat(F.lit("short "), "finish")).otherwise(F.col("finish"))))
    bins = ends.groupBy(F.col("group").alias("source"), "open", "cut_word", "bin", F.lit(None).cast("double").alias("prior")).agg(F.count("*").alias("n"))
    post = bins.groupBy("source").applyInPandas(lambda g: _posteriors(g), "source string, open boolean, cut_word boolean, bin double, prior double, posterior double, theta double, alpha double")
    post = cut(post.select(F.col("source").alias("group"), "open", "cut_word", "bin", "posterior"))
    stops = join_sized(ends, post, ["group", "open", "cut_word", "bin"]).select("key", "posterior")
    # templates judge by citations and content; the lexicon is asked only where neither end of the answer recurs
    yes = lambda c: F.coalesce(c, F.lit(False))
    alone = F.col("last") & ~yes("recurs") & ~yes("shut")
    declined = yes("shuts") | (yes("silent") & F.col("plain") & (F.col("ended") | F.col("brief"))) | (yes("stands") & F.col("alone")) | alone
    stopped = (F.col("posterior") >= 0.5) & ~(F.col("brief") & F.coalesce("recurs", F.lit(False)))  # a brief answer given to many questions is whole
    excused = F.regexp_replace("stratum", r"[^a-z]+", "").isin("outofscope", "unanswerable")
    defect = F.when(F.col("empty"), "empty").when(F.col("copied"), "copies_question").when(declined, F.when(~excused, "refusal").otherwise("(excused)")).when(F.col("foreign"), "other_language").when(stopped, "truncated")
    return judged.join(stops, "key", "left").select(F.col("key").alias("answer_id"), defect.alias("defect")).where(F.col("defect").isNotNull() & (F.col("defect") != "(excused)"))
