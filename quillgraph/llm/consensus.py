"""Consensus of several annotators' labels by iteratively reweighted voting.

Each round weighs every vote by what it tells of the item (the smoothed reliability of its annotator for that vote,
estimated without the annotator's own say), discounts annotators whose mistakes coincide more than chance allows,
and takes the consensus again, until it is stable. Agreement is Krippendorff's alpha, which allows missing ratings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.runtime import cut, join_sized

LABELS = ("correct", "partially_correct", "wrong", "correct_refusal")
SMOOTH, ROUNDS, STABLE = 1.0, 40, 2e-3
#: Items two annotators must share before their agreement, and before the coincidence of their mistakes, is looked at.
SHARED, SHARED_MISTAKES = 20, 30
#: Agreement beyond that of independent annotators, as a share of what is possible, that counts as copying.
COPYING = 0.5


@dataclass
class Consensus:
    """items(id, verdict, confidence, n_votes) and annotators(run_tag, n_votes, reliability, independence); alpha; rounds taken, and whether the last one moved nothing."""

    items: DataFrame
    annotators: DataFrame
    alpha: float | None
    n_items: int
    n_votes: int
    rounds: int
    converged: bool


def label_index(verdict: str = "verdict"):
    """The index of a verdict however it is spelled; null if it is none."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.col(verdict)), "[^a-z]+", "_"), "^_+|_+$", "")
    out = F.lit(None).cast("int")
    for i, x in enumerate(LABELS):
        out = F.when(clean == x, F.lit(i)).otherwise(out)
    return out


def _alpha(votes: DataFrame) -> tuple[float | None, int, int]:
    """Krippendorff's alpha for nominal labels over items with two votes or more; null if nothing can disagree."""
    per = votes.groupBy("id").agg(*(F.sum((F.col("vote") == i).cast("int")).alias(f"n{i}") for i in range(len(LABELS))), F.count("*").alias("m"))
    n = [F.col(f"n{i}") for i in range(len(LABELS))]
    same = sum((x * (x - 1) for x in n), F.lit(0)) / (F.col("m") - 1)
    r = per.agg(F.sum("m").alias("votes"), F.count("*").alias("items"), *(F.sum(F.when(F.col("m") > 1, x)).alias(f"t{i}") for i, x in enumerate(n)), F.sum(F.when(F.col("m") > 1, same)).alias("same")).first()
    t = [r[f"t{i}"] or 0 for i in range(len(LABELS))]
    total = sum(t)
    if total < 2 or (expected := sum(x * (total - x) for x in t) / (total * (total - 1))) == 0:
        return None, r["items"], r["votes"] or 0
    return 1 - (1 - r["same"] / total) / expected, r["items"], r["votes"] or 0


def _log_posterior(b: pa.RecordBatch, weights: np.ndarray, trust: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    stratum = b.column(1).to_numpy()
    lists = b.column(2)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy()
    item = np.repeat(np.arange(len(stratum)), np.diff(offsets))
    tag, vote = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    said = weights[tag, vote] * trust[tag][:, None]
    score = prior[stratum].copy()
    np.add.at(score, item, said)
    return stratum, item, tag, vote, said, score


def _same_item(b: pa.RecordBatch, *values: Callable[[np.ndarray, np.ndarray], np.ndarray], nt: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(pair codes, sums)`` of the votes cast on the same item: column 0 counts pairs, then come values(first, second) functions."""
    lists = b.column(2)
    offsets = lists.offsets.to_numpy()
    item = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    flat = lists.flatten()
    tag = flat.field(0).to_numpy().astype(np.int64)
    for lag in range(1, int(np.diff(offsets).max(initial=0))):
        at = np.flatnonzero(item[:-lag] == item[lag:])
        yield tag[at] * nt + tag[at + lag], np.stack([np.ones(len(at)), *(v(at, at + lag) for v in values)])


class _PairSums:
    """Sums per pair of annotators, kept sparse."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.held = 0

    def add(self, codes: np.ndarray, sums: np.ndarray) -> None:
        self.codes.append(codes)
        self.sums.append(sums)
        self.held += len(codes)
        if self.held > 4_000_000:
            self.pack()

    def pack(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros((1, 0))
        codes, where = np.unique(np.concatenate(self.codes), return_inverse=True)
        sums = np.stack([np.bincount(where, weights=x, minlength=len(codes)) for x in np.concatenate(self.sums, axis=1)])
        self.codes, self.sums, self.held = [codes], [sums], len(codes)
        return codes, sums


def _kappas(codes: np.ndarray, both: np.ndarray, agree: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of annotators whose agreement can be corrected for chance: ``(codes, kappa, both)``."""
    nt = len(margin)
    m = margin / np.maximum(margin.sum(axis=1, keepdims=True), 1)
    e = (m[codes // nt] * m[codes % nt]).sum(axis=1)
    ok = e < 0.999
    return codes[ok], (agree[ok] / both[ok] - e[ok]) / (1 - e[ok]), both[ok]


def _skill(a: int, nt: int, codes: np.ndarray, kappa: np.ndarray) -> float:
    """An annotator's skill from the agreements of all its partners, before there is any consensus.

    Corrected for chance, two independent annotators agree as the product of their skills; the median over triples of
    sqrt(k_ab * k_ac / k_bc) is a's skill as long as copies of each other are a minority.
    """
    first, second = codes // nt, codes % nt
    mine = (first == a) | (second == a)
    near = np.where(first[mine] == a, second[mine], first[mine])
    order = np.argsort(near)
    near, own = near[order], np.clip(kappa[mine][order], 0.0, 1)
    values = []
    for i in range(len(near) - 1):
        pair = near[i] * nt + near[i + 1 :]
        at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
        k = np.where(codes[at] == pair, np.clip(kappa[at], 0.02, 1), 0.0)
        told = k > 0.05  # two that hardly agree tell nothing of a third
        values.append(np.sqrt(own[i] * own[i + 1 :][told] / k[told]))
    every = np.concatenate(values) if values else np.zeros(0)
    return float(np.clip(np.median(every), 0.0, 0.98)) if len(every) else 0.5


def copying(nt: int, codes: np.ndarray, kappa: np.ndarray, both: np.ndarray, skill: np.ndarray) -> np.ndarray:
    """Trust in each annotator: what a pair agrees beyond the product of its skills is dependence, and shares its say."""
    a, b = codes // nt, codes % nt
    product = skill[a] * skill[b]
    excess = (kappa - product) / (1 - product)
    excess = np.where(excess > np.maximum(COPYING, 4 / np.sqrt(both)), excess, 0.0)
    return 1 / (1 + np.bincount(a, excess, nt) + np.bincount(b, excess, nt))


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def consensus(verdicts: DataFrame, hand: DataFrame | None = None) -> Consensus:
    """Consensus of verdicts(run_tag, id, stratum, verdict, graded_at), a hand's labels(id, verdict) being one more annotator.

    One vote per id and run_tag: the verdict of the latest grading, of equal times the first in order of spelling;
    repeated rows count once. Null, blank and unknown verdicts are no votes, two differing hand labels none either.
    Every id of ``verdicts`` gets one row; without votes it gets the likeliest label of its stratum. Of differing
    strata the least counts; a null one is a stratum. Empty tables give empty results. Other columns are not read.
    There is no bound on annotators: their pairs are counted sparsely, and only pairs with SHARED items leave Spark.
    """
    spark = verdicts.sparkSession
    k = len(LABELS)
    v = verdicts.select("id", F.coalesce("run_tag", F.lit("(none)")).alias("run_tag"), F.coalesce("stratum", F.lit("(none)")).alias("stratum"), label_index().alias("vote"), "graded_at")
    one = v.where(F.col("vote").isNotNull()).groupBy("id", "run_tag").agg(F.max_by("vote", F.struct(F.coalesce("graded_at", F.lit("0001-01-01").cast("timestamp")), -F.col("vote"))).alias("vote"))
    if hand is not None:
        h = hand.select("id", label_index().alias("vote")).where(F.col("vote").isNotNull()).groupBy("id").agg(F.min("vote").alias("vote"), F.max("vote").alias("other")).where(F.col("vote") == F.col("other"))
        one = one.unionByName(h.join(v.select("id").distinct(), "id", "left_semi").select("id", F.lit("(hand)").alias("run_tag"), "vote"))
    one = cut(one)
    # annotators and strata are numbered; the driver keeps k * k numbers of an annotator and k of a stratum
    tags, strata = (sorted(r[0] for r in d.distinct().collect()) for d in (one.select("run_tag"), v.select("stratum")))
    number = lambda names, c, as_: spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{c} string, {as_} int")
    voted = join_sized(one, number(tags, "run_tag", "tag"), ["run_tag"])
    lists = voted.select("id", F.struct("tag", F.col("vote").cast("int").alias("vote")).alias("v")).groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("votes"))
    items = join_sized(v.groupBy("id").agg(F.min("stratum").alias("name")), number(strata, "name", "stratum"), ["name"]).join(lists, "id", "left")
    items = cut(items.select("id", "stratum", F.coalesce("votes", F.array().cast("array<struct<tag:int,vote:int>>")).alias("votes")))
    nt, ns = max(1, len(tags)), max(1, len(strata))

    def gathered(run, size: int) -> np.ndarray:
        """Sums over all partitions of a vector of so many numbers per annotator or stratum."""
        t = items.select("id", "stratum", "votes").mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros(size)
        sums[t.column("at").to_numpy()] = t.column("x").to_numpy()
        return sums

    def paired(run, *names: str) -> DataFrame:
        """``code, both, names...`` summed over all partitions; a row per pair of annotators with items in common."""
        columns = ("both", *names)
        each = items.select("id", "stratum", "votes").mapInArrow(run, "code bigint, " + ", ".join(f"{c} double" for c in columns))
        return each.groupBy("code").agg(*(F.sum(c).alias(c) for c in columns))

    def margins(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(nt * k)
        for b in parts:
            flat = b.column(2).flatten()
            n += np.bincount(flat.field(0).to_numpy().astype(np.int64) * k + flat.field(1).to_numpy(), minlength=nt * k)
        yield _sparse(n)

    def agreeing(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _PairSums()
        for b in parts:
            vote = b.column(2).flatten().field(1).to_numpy()
            for codes, x in _same_item(b, lambda i, j, vote=vote: vote[i] == vote[j], nt=nt):
                sums.add(codes, x)
        codes, x = sums.pack()
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes), *map(pa.array, x)], names=["code", "both", "agree"])

    margin = gathered(margins, nt * k).reshape(nt, k)
    t = paired(agreeing, "agree").where(F.col("both") >= SHARED).orderBy("code").toArrow()
    known = _kappas(*(t.column(c).to_numpy() for c in ("code", "both", "agree")), margin)
    pairs = spark.sparkContext.broadcast(known[:2])

    def skills(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            own = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_skill(a, nt, *pairs.value) for a in own], pa.float64())], names=["at", "x"])

    skill = np.full(nt, 0.5)
    for r in spark.range(0, nt, 1, max(1, min(nt // 20, 2_000))).mapInArrow(skills, "at bigint, x double").collect():
        skill[r["at"]] = r["x"]
    first_trust = copying(nt, *known, skill)
    hit = np.clip(skill + (1 - skill) / k, 0.02, 0.98)[:, None, None]
    weights = np.log(np.eye(k) * hit + (1 - np.eye(k)) * (1 - hit) / (k - 1))  # [annotator, vote, label]
    trust, prior = first_trust, np.zeros((ns, k))
    rounds, discounted, converged = 0, False, False
    said_by = np.ones((nt, k, k))
    for rounds in range(1, ROUNDS + 1):
        state = spark.sparkContext.broadcast((weights, trust, prior))

        def tally(parts: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            w, tr, pr = state.value
            said_by, in_stratum = np.zeros((nt, k, k)), np.zeros((ns, k))
            for b in parts:
                if not b.num_rows:
                    continue
                stratum, item, tag, vote, said, score = _log_posterior(b, w, tr, pr)
                np.add.at(in_stratum, stratum, _soft(score))
                if len(item):
                    np.add.at(said_by, (tag, vote), _soft(score[item] - said))  # the others' view of the item
            yield _sparse(np.concatenate([said_by.ravel(), in_stratum.ravel()]))

        said_by, in_stratum = np.split(gathered(tally, nt * k * k + ns * k), [nt * k * k])
        said_by, in_stratum = said_by.reshape(nt, k, k) + SMOOTH, in_stratum.reshape(ns, k) + SMOOTH
        new_weights = np.log(said_by / said_by.sum(axis=1, keepdims=True))
        new_prior = np.log(in_stratum / in_stratum.sum(axis=1, keepdims=True))
        moved = float(np.abs(np.exp(new_weights) - np.exp(weights)).max())
        if (moved < STABLE or rounds == ROUNDS // 2) and not discounted:
            # mistakes are known only once the consensus is stable; then dependent annotators share one say
            def mistaken(parts: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                sums = _PairSums()
                for b in parts:
                    if not b.num_rows:
                        continue
                    _, item, _, vote, _, score = _log_posterior(b, *state.value)
                    miss = 1 - _soft(score)[item, vote] > 0.5
                    for codes, x in _same_item(b, lambda i, j, m=miss: m[i], lambda i, j, m=miss: m[j], lambda i, j, m=miss: m[i] & m[j], nt=nt):
                        sums.add(codes, x)
                codes, x = sums.pack()
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array(codes), *map(pa.array, x)], names=["code", "both", "a", "b", "ab"])

            p, q, j = (F.col(c) / F.col("both") for c in ("a", "b", "ab"))
            corr = F.try_divide(j - p * q, F.sqrt(p * (1 - p) * q * (1 - q)))
            noise = F.greatest(3 / F.sqrt("both"), F.lit(0.05))  # coincidences of chance stay below this
            linked = paired(mistaken, "a", "b", "ab").where(F.col("both") >= SHARED_MISTAKES).select("code", corr.alias("corr"), noise.alias("noise")).where(F.col("corr") > F.col("noise"))
            per = linked.select("corr", F.explode(F.array(F.floor(F.col("code") / nt), F.col("code") % nt)).alias("at")).groupBy("at").agg(F.sum("corr").alias("x")).collect()
            shared = np.zeros(nt)
            for r in per:
                shared[int(r["at"])] = r["x"]
            trust, discounted = np.minimum(first_trust, 1 / (1 + shared)), True
        elif moved < STABLE:
            converged = True
        weights, prior = new_weights, new_prior
        state.unpersist()
        if converged:
            break
    final = spark.sparkContext.broadcast((weights, trust, prior))

    def decide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            post = _soft(_log_posterior(b, *final.value)[-1]) if b.num_rows else np.zeros((0, k))
            best = post.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([LABELS[i] for i in best], pa.string()), pa.array(post.max(axis=1) if len(post) else [], pa.float64()), pa.array(np.diff(b.column(2).offsets.to_numpy()), pa.int32())], names=["id", "verdict", "confidence", "n_votes"])

    decided = items.mapInArrow(decide, "id string, verdict string, confidence double, n_votes int")
    votes_of = margin.sum(axis=1)
    # reliability: how often the others' consensus would give the annotator's label, smoothed
    right = said_by[:, np.arange(k), np.arange(k)].sum(axis=1)
    rows = [(t, int(votes_of[i]), float(right[i] / said_by[i].sum()), float(trust[i]), rounds, converged) for i, t in enumerate(tags)]
    annotators = spark.createDataFrame(rows, "run_tag string, n_votes bigint, reliability double, independence double, rounds int, converged boolean")
    alpha, n_items, n_votes = _alpha(one.where(F.col("run_tag") != "(hand)"))
    return Consensus(decided, annotators, alpha, n_items, n_votes, rounds, converged)


def _sparse(x: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(x)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(x[at])], names=["at", "x"])
