"""Does a text stop where its author stopped? Evidence from how the corpus itself ends its sentences.

For the last words of every text the corpus is asked: where these words stand elsewhere, does a sentence, line or
text end there, or does it go on? Counts cover all texts. Only contexts that some text ends in are counted: a
Bloom bitmap of bounded size keeps the others from being shuffled (without it the result is the same).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.unicode import WHITE_SPACE
from quillgraph.plans.runtime import cut, join_sized

#: Context lengths in tokens, and the uses a context needs before it is believed.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9)
LEAST = 4
#: Widths counted at every position for short texts such as answers, the others only from a line's beginning: there
#: the longer ones took 64 whole answers without a full stop for cut ones.
SHORT_TEXTS = (1, 2, 3, 4, 6)
#: A closing line or phrase (signature, page footer) recurs in this share of all texts, and at least so often.
CLOSER_SHARE, CLOSER_LEAST, CLOSER_WORDS = 0.001, 5, 9
#: A single line of so few words may be a heading, whose colon says nothing.
HEADING_WORDS = 9
#: Bits of the largest bitmap of wanted contexts (16 MB).
MOST_BITS = 1 << 27

#: Characters of a text's end that are looked at for how it ends, and tokens hashed at a time.
TAIL, CHUNK = 700, 200_000
#: White space behind a whole text is no part of it; so much of it still counts as length: a limit may fall on a blank or a paragraph break.
_PADDING, PADDING_COUNTED = WHITE_SPACE + "\x1c\x1d\x1e\x1f", 2

_TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,]*(?<=\d)|\n|[^\w\s]|_")
_ENTITY = re.compile(r"(?:\s|&(?:[a-zA-Z]{2,8}|#\d{2,6}|#x[0-9a-fA-F]{2,5});|</?[a-zA-Z][^<>]{0,80}>|[​‌‍⁠﻿*_~|])+$")
_HALF = re.compile(r"(?:&[a-zA-Z]{0,8}|&#\w{0,6}|</?[a-zA-Z][^<>\n]{0,40}|�+)$")
_MOJIBAKE = re.compile("[\u00c3\u00c2][\u0080-\u00bf\u0152-\u0178\u2013-\u203a\u20ac\u2122]|\u00e2\u20ac")
_STOP = ".?!"
# fixed values: phrases that end a list without naming the rest; a text ending in one is whole
_AND_SO_ON = re.compile(r"\b(?:etc|usw|and so on|and so forth|and the like|et ainsi de suite|y así sucesivamente|und so weiter|und dergleichen|e così via)\W*$", re.IGNORECASE)
_CLOSE = "\"'»”’)]"
_M, _MIX, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1
#: Low bits of a token's id: it opens a sentence, ends one, closes a bracket or quotation, is a line break, ends the text.
_UP, _STOPS, _SHUTS, _LINE, _END = 1, 2, 4, 8, 16


class _Ids(dict):
    def __missing__(self, token: str) -> int:
        kind = _UP if token[0].isupper() or token in "\"“«„[*•-–\n\x00" else 0
        kind |= (_STOPS if token in _STOP else 0) | (_SHUTS if token in _CLOSE else 0) | (_LINE if token == "\n" else 0) | (_END if token == "\x00" else 0)
        name = "0" if token[0].isdigit() else token
        h = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[token] = v = (h & ~31) | kind
        return v


def _hashes(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each width the hash of the window ending at every position, counted back from it; windows cross no array start."""
    h, power = ids.copy(), 1
    for width in WIDTHS:
        if width > len(ids):
            return
        if width > 1:
            power = power * _M & _ALL
            h[width - 1 :] += ids[: len(ids) - width + 1] * np.uint64(power)
        yield width, (h ^ (h >> np.uint64(29))) * np.uint64(_MIX) + np.uint64(width)


def _tail_hashes(ids: list[int]) -> list[int]:
    """The same hashes for the last position alone, as signed integers."""
    h, power, out = 0, 1, []
    for width, x in zip(WIDTHS, reversed(ids), strict=False):
        if width > 1:
            power = power * _M & _ALL
        h = h + x * power & _ALL
        v = ((h ^ (h >> 29)) * _MIX + width) & _ALL
        out.append(v - (1 << 64) if v >> 63 else v)
    return out


def visible_end(text: str) -> tuple[str, bool]:
    """The text without trailing white space and whole entities or tags, and whether an entity, tag or character is cut."""
    head, text = text[:-120], text[-120:]
    if _MOJIBAKE.search(text):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    text = _ENTITY.sub("", text)
    if half := _HALF.search(text, max(0, len(text) - 50)):
        return head + text[: half.start()], True
    return head + text if text else head.rstrip(), False


def _last_piece(text: str) -> str:
    """What follows the last line break or sentence end, digits masked; empty if long."""
    line = text[max(text.rfind("\n") + 1, len(text) - 300) :]
    at = max((line.rfind(s + " ") + 1 for s in (".", "?", "!")), default=0)
    piece = line[at:].strip()
    return "" if len(piece) > 120 or not 0 < len(piece.split()) <= CLOSER_WORDS else re.sub(r"\d+", "0", piece)


def strip_closers(text: str, closers: frozenset[str]) -> tuple[str, bool, bool]:
    """The text before its closing lines and phrases; whether it had any; whether an entity or tag is cut before them."""
    found = False
    for _ in range(5):
        text, half = visible_end(text)
        piece = _last_piece(text)
        if half or not piece or piece not in closers:
            break
        masked = len(re.split(r"\n|(?<=[.?!]) ", text[-700:])[-1].strip())
        text, found = re.sub(r"\s-+$", "", text[: len(text.rstrip()) - masked].rstrip()).rstrip(), True
    return text, found, half


def _tail_tokens(text: str) -> list[str]:
    """The last tokens, as many as the widest context has; the first of a slice may be half a word and is not one of them."""
    n = 200
    while n < len(text):
        if len(found := _TOKEN.findall(text[-n:])) > max(WIDTHS):
            return found[-max(WIDTHS) :]
        n *= 4
    return _TOKEN.findall("\n" + text)[-max(WIDTHS) :]


def closers(ends: DataFrame, n: int) -> frozenset[str]:
    """Closing lines and phrases of n texts. At most 1 / CLOSER_SHARE of them can exist, so the driver may hold them."""

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = [p for t in b.column(0).to_pylist() if t and (p := _last_piece(visible_end(t)[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["piece"])

    counted = ends.select("tail").mapInArrow(pieces, "piece string").groupBy("piece").count()
    least = max(CLOSER_LEAST, CLOSER_SHARE * n)
    return frozenset(r.piece for r in counted.where(F.col("count") >= least).collect() if not _opens(r.piece))


def _opens(piece: str) -> bool:
    """Whether a recurring piece looks like a sentence of its own (ends in a full stop) or a citation rather than a closer."""
    if re.fullmatch(r"\([^()\d]+\)", piece):
        return False  # words in a pair of brackets behind the last sentence
    return piece[-1] in ".?!,;:" or bool(re.search(r"[\d)]\)+$", piece)) or bool(re.match(r"0?\(", piece))


def tails(ends: DataFrame, known: frozenset[str]) -> DataFrame:
    """``key, ends, closed, words, chars, bytes, hashes`` of (key, tail, chars, bytes): how each text ends, and its last contexts.

    ends is ``none`` (null or blank), ``half`` (a cut entity, tag or character), ``dots``, ``stop`` or ``open``.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for b in parts:
            kinds, hashes, words, closed, chars, octets = [], [], [], [], [], []
            for t, n_chars, n_bytes in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                t = t or ""
                rest, had, half = strip_closers(t, known)
                if had and not rest.strip():
                    rest, had = visible_end(t)[0], False
                if had:
                    n_chars -= len(t) - len(rest)
                    n_bytes -= len(t[len(rest) :].encode("utf-8", "surrogatepass"))
                blank = not half and not rest.strip() and (n_chars or 0) <= TAIL
                bare = rest.rstrip(_CLOSE + " ")
                few = len(rest.split(None, HEADING_WORDS + 1)) if (n_chars or 0) <= TAIL else TAIL
                if few <= HEADING_WORDS and "\n" not in rest.strip():
                    rest = rest.rstrip(" :")
                if _AND_SO_ON.search(rest[-60:]):
                    rest = bare = "."
                ellipsis = rest.endswith(("…", "..."))
                if ellipsis:
                    rest = rest.rstrip("….").rstrip()
                kinds.append("none" if blank else "half" if half else "dots" if ellipsis else "stop" if bare[-1:] in _STOP and bare else "open")
                closed.append(had)
                words.append(few)
                chars.append(n_chars)
                octets.append(n_bytes)
                hashes.append(_tail_hashes([ids[k] for k in _tail_tokens(rest)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds), pa.array(closed), pa.array(words, pa.int32()), pa.array(chars, pa.int64()), pa.array(octets, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "ends", "closed", "words", "chars", "bytes", "hashes"])

    kind = ends.schema["key"].dataType.simpleString()
    return ends.select("key", "tail", "chars", "bytes").mapInArrow(run, f"key {kind}, ends string, closed boolean, words int, chars bigint, bytes bigint, hashes array<bigint>")


def _bits(wanted: DataFrame, n: int) -> np.ndarray:
    """A bitmap of n bits with the wanted hashes set, built as bitmaps of ranges and never longer than MOST_BITS."""
    span = 32768
    at = F.col("hash").bitwiseAND(F.lit(n - 1).cast("bigint"))  # n is a power of two
    rows = wanted.groupBy(F.floor(at / span).cast("long").alias("r")).agg(F.bitmap_construct_agg(at % span).alias("b")).collect()
    out = np.zeros(n // 8, np.uint8)
    for r in rows:
        out[r.r * span // 8 : (r.r + 1) * span // 8] = np.frombuffer(r.b, np.uint8)
    return out


def _summed(h: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    u, where = np.unique(h, return_inverse=True)
    return u, *(np.bincount(where, weights=x, minlength=len(u)).astype(np.int64) for x in sums)


def context_counts(texts: DataFrame, text: str, wanted: DataFrame, known: frozenset[str], everywhere: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``hash, uses, ended``: how often each wanted context stands inside a text and how often something ends there.

    Closers are taken off first, as what stands before them may be cut.
    """
    spark = texts.sparkSession
    n = 1 << 20
    count = wanted.count()
    while n < min(MOST_BITS, 32 * count):
        n *= 2
    bitmap = spark.sparkContext.broadcast(_bits(wanted, n))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, ids, low = bitmap.value, _Ids(), np.uint64(n - 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tokens: list[str] = []

        def count() -> None:
            x = np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))
            tokens.clear()
            kind = (x & np.uint64(31)).astype(np.uint8)
            line, stop, shut, eot = ((kind & k) > 0 for k in (_LINE, _STOPS, _SHUTS, _END))
            up = (kind & (_UP | _LINE | _END)) > 0
            nxt = lambda a, k=1: np.concatenate([a[k:], np.zeros(k, bool)])
            opens = nxt(up) | (nxt(shut) & nxt(up, 2))
            after_stop = stop & opens  # a stop here, and a new sentence, line or end behind it
            ended = nxt(line) | np.where(stop, opens, nxt(after_stop)) | (shut & nxt(after_stop))
            inner = ~eot & ~nxt(eot) & ~line  # the end of a text tells nothing: it may be the cut
            inner |= stop & nxt(eot)
            every = np.flatnonzero(inner)
            for width, h in _hashes(x):
                at = every[np.searchsorted(every, width - 1) :] if width in everywhere else np.flatnonzero(inner[width - 1 :] & line[: len(x) - width + 1]) + width - 1
                h = h[at]
                slot = (h & low).astype(np.int64)
                keep = ((mask[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                held.append(_summed(h[keep].astype(np.int64), np.ones(int(keep.sum()), np.int64), ended[at[keep]].astype(np.int64)))
            if len(held) > 40 * len(WIDTHS):
                held[:] = [_summed(*(np.concatenate(c) for c in zip(*held, strict=True)))]

        for b in parts:
            for t in b.column(0).to_pylist():
                if t:
                    tail = t[-TAIL:]
                    rest = strip_closers(tail, known)[0]
                    tokens.append("\n")
                    tokens += _TOKEN.findall(t[: len(t) - len(tail)] + rest if len(rest) < len(tail) else t)
                    tokens.append("\x00")
                    if len(tokens) > CHUNK:
                        count()
        if tokens:
            count()
        if held:
            h, u, e = _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (h, u, e)], names=["hash", "uses", "ended"])

    return texts.select(text).mapInArrow(run, "hash bigint, uses bigint, ended bigint").groupBy("hash").agg(F.sum("uses").alias("uses"), F.sum("ended").alias("ended"))


def ending_scores(texts: DataFrame, key: str, text: str, everywhere: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``key, ends, closed, words, chars, bytes, width, cut_word, whole``: the probability that a text of the corpus may end where this one ends.

    The longest context with LEAST uses decides; a last word the corpus never uses in the middle of a text, or one
    it never uses after the word before it, speaks for a cut word, unless so many different texts end in these two
    words that no limit can have cut them all there. Null or blank texts get ``ends`` = none and a null ``whole``.
    Repeated keys give repeated rows. Other columns are not read.
    """
    bare = F.rtrim(F.col(text), F.lit(_PADDING))
    counted = F.substring(F.col(text), F.lit(1), F.char_length(bare) + PADDING_COUNTED)
    ends = texts.select(F.col(key).alias("key"), F.right(bare, F.lit(TAIL)).alias("tail"), F.char_length(counted).alias("chars"), F.octet_length(counted).alias("bytes"))
    texts = texts.select(bare.alias(text))
    n = texts.count()
    known = closers(ends, n)
    ends = cut(tails(ends, known))
    # full stops are nearly always real; the last two tokens tell an abbreviation
    each = ends.where(F.col("ends").isin("open", "stop", "dots")).select("key", "ends", F.posexplode("hashes").alias("w", "hash")).where((F.col("ends") != "stop") | (F.col("w") <= 2))
    wanted = each.select("hash").distinct()
    counts = cut(context_counts(texts, text, wanted, known, everywhere))
    # pairs of words that different texts end in over and over; copies of a text have its length and count once
    pairs = ends.where(F.col("ends").isin("open", "dots")).select(F.get("hashes", F.lit(1)).alias("hash"), "chars").where(F.col("hash").isNotNull()).distinct()
    shared = pairs.groupBy("hash").agg(F.count("*").alias("enders"))
    counts = counts.join(shared.where(F.col("enders") >= max(CLOSER_LEAST, CLOSER_SHARE * n)), "hash", "full")
    seen = join_sized(each.withColumnRenamed("key", "k"), counts, ["hash"], "left")
    uses, ended = F.coalesce(F.col("uses"), F.lit(0)), F.coalesce(F.col("ended"), F.lit(0))
    per = seen.groupBy("k").agg(
        F.sort_array(F.collect_list(F.when(uses >= LEAST, F.struct("w", ended.alias("e"), uses.alias("u"))))).alias("used"),
        F.max(F.when(F.col("w") == 0, uses)).alias("one"),
        F.max(F.when(F.col("w") == 1, uses)).alias("two"),
        F.max(F.when(F.col("w") == 1, F.col("enders"))).isNotNull().alias("shared"),
        F.max(F.when(uses >= LEAST, F.col("w"))).alias("width"),
    )
    out = ends.drop("hashes").dropDuplicates(["key"]).join(per.withColumnRenamed("k", "key"), "key", "left")
    # each context is smoothed towards the next shorter one, so a few uses that agree with many do not weaken them
    last = F.try_element_at("used", F.lit(-1))
    rate: Column = (last["e"] + 0.02) / (last["u"] + 0.2) if everywhere != WIDTHS else F.when(F.size("used") > 0, F.aggregate("used", F.lit(0.1), lambda shorter, x: (x["e"] + 0.2 * shorter) / (x["u"] + 0.2)))
    one, two, width = (F.coalesce(F.col(c), F.lit(d)) for c, d in (("one", 0), ("two", 0), ("width", -1)))
    # the corpus never or hardly uses the last word, or never after the word before it
    cut_word = F.col("ends").isin("open", "dots") & ~F.coalesce("shared", F.lit(False)) & ((one < LEAST) | ((two == 0) & (width < 1) & (F.col("words") > HEADING_WORDS)))
    whole = F.when(F.col("ends") == "none", F.lit(None).cast("double")).when(F.col("ends") == "half", F.lit(0.01))
    whole = whole.when(F.col("ends") == "stop", F.coalesce(rate, F.lit(0.99))).when(cut_word, F.lit(0.01)).otherwise(F.coalesce(rate, F.lit(0.3)))
    return out.select("key", "ends", "closed", "words", "chars", "bytes", width.alias("width"), cut_word.alias("cut_word"), F.least(F.lit(0.995), F.greatest(F.lit(0.0002), whole)).alias("whole"))
