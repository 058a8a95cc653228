"""Texts cut off by field limits: right-censored lengths per source, combined with how the texts end."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.endings import HEADING_WORDS, ending_scores
from quillgraph.plans.runtime import cut, join_sized

#: A length is a candidate limit if it holds this many times the texts its neighbours do, at least so many, and this share of the source.
SPIKE, SPIKE_LEAST, SPIKE_SHARE = 4.0, 6, 0.004
_BINS = 24

_erf = np.vectorize(math.erf)


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(x / math.sqrt(2)))


def fit_censored(x: np.ndarray, n: np.ndarray, limits: np.ndarray, held: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood of a log-normal length by EM: x with counts n is seen whole, held texts only reach limits.

    A censored text's log length has the mean and variance of the normal above its limit, so each step is closed.
    """
    lx = np.log(np.maximum(x, 1.0))
    lc = np.log(np.maximum(limits, 1.0))
    mu, sd = float(np.average(lx, weights=n)), max(0.2, float(np.sqrt(np.average((lx - np.average(lx, weights=n)) ** 2, weights=n))))
    for _ in range(60):
        z = (lc - mu) / sd
        tail = np.maximum(1 - _cdf(z), 1e-9)
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        m1 = mu + sd * hazard
        m2 = sd * sd * (1 + z * hazard - hazard * hazard) + m1 * m1
        total = n.sum() + held.sum()
        new = float((n @ lx + held @ m1) / total)
        var = float((n @ (lx * lx) + held @ m2) / total) - new * new
        new_sd = max(0.05, math.sqrt(max(var, 0.0)))
        done = abs(new - mu) + abs(new_sd - sd) < 1e-6
        mu, sd = new, new_sd
        if done:
            break
    return mu, sd


def censoring(lengths: pd.DataFrame) -> pd.DataFrame:
    """One source and unit: (length, n) -> its candidate limits with the posterior of being censored there."""
    g = lengths.groupby("length", as_index=False)["n"].sum().sort_values("length")
    x, n = g["length"].to_numpy(float), g["n"].to_numpy(float)
    keep = x > 8
    x, n = x[keep], n[keep]
    none = pd.DataFrame({"source": [], "unit": [], "limit": [], "posterior": [], "mu": [], "sigma": []}).astype({"source": object, "unit": object})
    if n.sum() < 20:
        return none
    cum = np.concatenate([[0.0], np.cumsum(n)])
    near = np.maximum(2.0, 0.04 * x)
    lo, hi = np.searchsorted(x, x - near), np.searchsorted(x, x + near, side="right")
    local = (cum[hi] - cum[lo] - n) / (2 * near)
    at = (n >= max(SPIKE_LEAST, SPIKE_SHARE * n.sum())) & (n > SPIKE * np.maximum(local, 0.25))
    if not at.any():
        return none
    mu, sd = fit_censored(x[~at], n[~at], x[at], n[at]) if (~at).any() else (float(np.log(x).mean()), 1.0)
    lx, step = np.log(x[at]), 0.5 / x[at]
    natural = n.sum() * (_cdf((lx + step - mu) / sd) - _cdf((lx - step - mu) / sd))
    natural = np.maximum(natural, local[at])
    post = np.clip(1 - natural / n[at], 0.02, 0.98)
    return pd.DataFrame({"source": lengths["source"].iloc[0], "unit": lengths["unit"].iloc[0], "limit": x[at].astype("int64"), "posterior": post, "mu": mu, "sigma": sd}).astype({"source": object, "unit": object})


def _posteriors(g: pd.DataFrame) -> pd.DataFrame:
    """EM for one group of texts: rate of cut texts and share of open endings among whole ones.

    Rows are bins (open or not, cut word or not, log odds of the ending, prior at a limit or null) with counts.
    """
    n = g["n"].to_numpy(float)
    is_open = g["open"].to_numpy(bool)
    limit = g["prior"].to_numpy(float)
    at = ~np.isnan(limit)
    ratio = np.exp(g["bin"].to_numpy(float)) * 0.1  # ends are rarer than other places by about this
    ratio[g["cut_word"].to_numpy(bool)] = 500.0
    theta, alpha = 0.05, 0.2
    post = np.zeros(len(n))
    for _ in range(40):
        prior = np.where(at, limit, theta)
        cut_like = prior * np.where(is_open, 0.95 * ratio, 0.05 * ratio)
        whole_like = (1 - prior) * np.where(is_open, alpha, 1 - alpha)
        post = cut_like / np.maximum(cut_like + whole_like, 1e-300)
        free = ~at
        theta = float(np.clip(((n * post)[free].sum() + 0.5) / (n[free].sum() + 10), 1e-3, 0.5))
        alpha = float(np.clip(((n * (1 - post))[is_open].sum() + 0.05) / ((n * (1 - post)).sum() + 1), 5e-4, 0.98))
    return g.assign(posterior=post, theta=theta, alpha=alpha)[["source", "open", "cut_word", "bin", "prior", "posterior", "theta", "alpha"]].astype({"source": object})


def source_name(source: Column) -> Column:
    """Sources differ in case, outer blanks and hyphens only by carelessness."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(source)), "[-\\s]+", "_"), F.lit("")), F.lit("(none)"))


def truncation(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, at_limit, whole, posterior, truncated`` for every row.

    Null and blank texts are never truncated (posterior 0). Repeated rows are judged alike. A null source is the
    source ``(none)``. Sources of under 20 texts have no limits of their own and are judged by their endings. An
    empty table gives an empty result; further columns are not read.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), source_name(F.col(source)).alias("source"))
    scores = cut(ending_scores(rows, "key", "text").join(rows.select("key", "source").dropDuplicates(["key"]), "key", "left"))
    judged = scores.where(F.col("ends") != "none")
    sizes = judged.select("source", F.inline(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))).groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    limits = cut(sizes.groupBy("source", "unit").applyInPandas(lambda g: censoring(g), "source string, unit string, limit long, posterior double, mu double, sigma double"))
    by = {u: limits.where(F.col("unit") == u).select("source", F.col("limit").alias(u), F.col("posterior").alias(f"p_{u}")) for u in ("chars", "bytes")}
    placed = join_sized(join_sized(judged, by["chars"], ["source", "chars"], "left"), by["bytes"], ["source", "bytes"], "left")
    placed = placed.withColumn("prior", F.round(F.greatest("p_chars", "p_bytes"), 2))
    w = F.col("whole")
    is_open = F.col("ends").isin("open", "dots", "half") | (w < 0.5)
    placed = placed.withColumn("open", is_open).withColumn("cut_word", F.col("cut_word") | (F.col("ends") == "half"))
    placed = placed.withColumn("bin", F.round(F.log((1 - w) / w) * 2) / 2)
    # short texts without a stop are mostly headings wherever they come from
    placed = placed.withColumn("group", F.when((F.col("words") <= HEADING_WORDS) & F.col("prior").isNull(), F.lit("(short)")).otherwise(F.col("source")))
    bins = placed.groupBy(F.col("group").alias("source"), "open", "cut_word", "bin", "prior").agg(F.count("*").alias("n"))
    post = cut(bins.groupBy("source").applyInPandas(lambda g: _posteriors(g), "source string, open boolean, cut_word boolean, bin double, prior double, posterior double, theta double, alpha double"))
    post = post.select(F.col("source").alias("group"), "open", "cut_word", "bin", F.coalesce("prior", F.lit(-1.0)).alias("at"), "posterior")
    done = join_sized(placed.withColumn("at", F.coalesce("prior", F.lit(-1.0))), post, ["group", "open", "cut_word", "bin", "at"], "left")
    done = done.select("key", F.col("prior").isNotNull().alias("at_limit"), "whole", "posterior")
    out = scores.select("key", "source").join(done, "key", "left")
    p = F.coalesce("posterior", F.lit(0.0))
    return out.select(F.col("key").alias(key), "source", F.coalesce("at_limit", F.lit(False)).alias("at_limit"), "whole", p.alias("posterior"), (p >= 0.5).alias("truncated"))
