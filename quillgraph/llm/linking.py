"""Mapping freely typed names to a canonical list.

All spellings of the entries (names, aliases, and paths derived from them) stand in one character trie. A typed name
walks it with a Levenshtein automaton (adjacent swaps cost one) and gets every entry within a distance that depends
on its length. Candidates are then verified word by word: digits must agree, and a word the list knows stands only
for itself, so a name that merely resembles an entry stays unmatched. Provisions are compared by their parts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.unicode import DASHES, WHITE_SPACE
from quillgraph.plans.runtime import cut, spread

NONE = "(none)"
#: Entries a task holds as tries; a longer list is read in parts.
MOST_ENTRIES = 50_000

# fixed values: words that may stand around a name without changing it
BEFORE = "the any such said this that an a each every of relevant respective der die das den dem des le la les l el los las un una une il lo dieser diese".split()
AFTER = ("concerned", "in question", "at issue", "as defined", "as such", "mentioned above", "referred to above", "aforementioned", "see above", "above", "etc", "under the act", "of this kind", "and similar", "or similar")
# fixed values: how provisions are called
ARTICLE = r"(?:articles?|artikels?|art[ií]culos?|articolo|artigo|arts?)"
ANNEX = r"(?:annex(?:es|e)?|anhang|anexo|allegato|appendix)"
SUB = r"(?:paragraphs?|paragraphe|parag|paras?|par|absatz|abs|apartado|apdo|points?|punkt|punto|pts?|nr|no|num|ziffer|ziff|section|sec|al)"
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
# fixed values: Cyrillic and Greek letters drawn like Latin ones
_HOMOGLYPHS = str.maketrans("авекмнорстухіѕјһԁԛԝоηικνορτυχ", "abekmhopctyxisjhdqwonikvoptux")
_LOOKALIKE = str.maketrans("013457@$|", "oieastasl")


def fold(text: str) -> str:
    """Lower case without accents, quotes and invisible characters; dashes and underscores are spaces."""
    kept = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ß", "ss")) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    out = []
    for c in kept.casefold().translate(_HOMOGLYPHS):
        kind = unicodedata.category(c)
        out.append(" " if c in DASHES or kind == "Pd" or c in WHITE_SPACE or c == "_" else "" if kind in ("Pi", "Pf") or c in "'\"`´" else c)
    return " ".join("".join(out).split())


def _words(folded: str) -> list[str]:
    return re.findall(r"[^\W_]+", folded)


def to_number(text: str) -> int | None:
    if text.isdigit():
        return int(text)
    if not text or not _ROMAN.match(text):
        return None
    total, values = 0, [dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)[c] for c in text]
    for v, nxt in zip(values, [*values[1:], 0], strict=True):
        total += -v if v < nxt else v
    return total


def provision(folded: str) -> tuple[str, str, int, int | None] | None:
    """``(rest, kind, number, sub-number)`` of a name that cites an article or annex; the rest should name the act."""
    t = re.sub(r"[§¶]+", " par ", folded)
    t = re.sub(r"(?<=\w)\.(?=\w)", " . ", t)
    tokens = re.findall(r"[^\W\d_]+|\d+|[().]", t)
    kind = at = None
    for i, w in enumerate(tokens):
        if re.fullmatch(ARTICLE, w):
            kind, at = "art", i
        elif re.fullmatch(ANNEX, w):
            kind, at = "annex", i
        if kind:
            break
    if kind is None:
        return None
    rest, number, sub, pending = [], None, None, False
    for i, w in enumerate(tokens):
        if i == at or w in "().":
            continue
        is_sub = bool(re.fullmatch(SUB, w))
        value = to_number(w) if w.isdigit() or (i > at and number is None and kind == "annex" and i - at <= 2) else None
        if is_sub and i + 1 < len(tokens):
            pending = True
        elif value is not None and i > at and number is None:
            number, pending = value, False
        elif value is not None:
            if sub is not None:
                return None
            sub, pending = value, False
        elif w not in BEFORE and w not in ("von", "der", "del", "de", "du", "in", "to", "under"):
            rest.append(w)
    return (" ".join(rest), kind, number, sub) if number is not None else None


def most_edits(length: int) -> int:
    return 0 if length <= 4 else 1 if length <= 7 else 2 if length <= 12 else 3 if length <= 17 else 4 if length <= 26 else 5


def _word_edits(length: int) -> int:
    return 0 if length <= 2 else 1 if length <= 5 else 2 if length <= 9 else 3


class Names:
    """The list's spellings: a character trie, a trie of words, the provisions and the acts they belong to."""

    def __init__(self, entries: Iterable[tuple[str | None, str | None, str | None, list[str] | None]]) -> None:
        """entries: type, canonical name, display name, aliases."""
        self.kind: dict[str, str] = {}
        canonical: dict[str, set[str]] = defaultdict(set)
        alias: dict[str, set[str]] = defaultdict(set)
        derived: dict[str, set[str]] = defaultdict(set)
        initials: dict[str, set[str]] = defaultdict(set)
        acts: dict[str, set[str]] = defaultdict(set)
        for kind, name, display, aliases in entries:
            if not name or not name.strip():
                continue
            self.kind[name] = fold(kind or "")
            f = fold(name)
            canonical[self._key(f)].add(name)
            for a in [display, *(aliases or [])]:
                if a and a.strip():
                    alias[self._key(fold(a))].add(name)
            w = _words(f)
            if len(w) > 2 and not any(c.isdigit() for c in f):
                initials["".join(x[0] for x in w)].add(name)
                initials["".join(x[0] for x in w if x not in BEFORE and x not in ("to", "in", "for", "and", "on"))].add(name)
            if len(w) > 1 and not provision(f):
                derived[" ".join(sorted(w))].add(name)
        #: spelling -> entries; a canonical name beats an alias, an alias beats a derived path; several entries are kept
        self.paths: dict[str, tuple[int, set[str]]] = {}
        for rank, part in enumerate((canonical, alias)):
            for s, names in part.items():
                self.paths.setdefault(s, (rank, names))
        self.sorted = {s: n for s, n in derived.items()}
        self.initials = initials
        self.provisions: dict[tuple[str, str, int, int | None], str] = {}
        prefixes: set[str] = set()
        for name in self.kind:
            if p := provision(fold(name)):
                self.provisions[p] = name
                prefixes.add(p[0])
        of_act = {s: names for s, (_, names) in self.paths.items()}
        for prefix in prefixes:
            for owner in of_act.get(prefix, ()):
                for s, names in of_act.items():
                    if owner in names:
                        acts[s].add(prefix)
            acts[prefix].add(prefix)
        self.acts = {s: next(iter(p)) for s, p in acts.items() if len(p) == 1}
        self.compact: dict[str, set[str]] = defaultdict(set)
        #: the words of all spellings as a character trie, and the spellings as a trie of words above it
        self.words: dict = {}
        self.vocabulary: set[str] = set()
        self.word_trie: dict = {}
        for s in self.paths:
            node = self.word_trie
            for w in _words(s):
                node = node.setdefault(w, {})
                if w not in self.vocabulary:
                    self.vocabulary.add(w)
                    self._add(self.words, w)
            node.setdefault("", []).append(s)
            self.compact["".join(_words(s))].add(s)
        self.act_trie: dict = {}
        for spelling in self.acts:
            self._add(self.act_trie, spelling)
        #: words the whole list knows, of those a span asks about; empty where the whole list is here
        self.known: frozenset[str] = frozenset()
        self._seen: dict[str, list[tuple[float, str]]] = {}

    def read(self, known: list[str]) -> None:
        """What other parts of the list know, for the next span."""
        if known or self.known:
            self.known = frozenset(known)
            self._seen.clear()

    @staticmethod
    def _key(folded: str) -> str:
        return folded.strip(" .,;:!?()[]{}*<>/\\|")

    @staticmethod
    def _add(node: dict, spelling: str) -> None:
        for c in spelling:
            node = node.setdefault(c, {})
        node[""] = spelling

    def near(self, text: str, most: int, trie: dict | None = None) -> list[tuple[int, str]]:
        """Every word of a trie within most edits of text: the trie is walked with the Levenshtein automaton of text.

        The automaton's states are bits of one number, a field per number of edits: bit j of a field stands for "the
        first j characters of text are read". A second number holds the first halves of swaps of neighbours.
        """
        n, wide = len(text), len(text) + 3
        field = (1 << (n + 1)) - 1
        every = sum(1 << (wide * e) for e in range(most + 1))
        full = field * every
        at: dict[str, int] = {}
        for j, c in enumerate(text):
            at[c] = at.get(c, 0) | 1 << j
        reads = {c: (m * every, (m >> 1) * every) for c, m in at.items()}
        accept = [(e, 1 << (wide * e + n)) for e in range(most + 1)]
        cascade = range(most)
        found: list[tuple[int, str]] = []
        stack = [(self.words if trie is None else trie, sum((((1 << (e + 1)) - 1) & field) << (wide * e) for e in range(most + 1)), 0)]
        while stack:
            node, states, swaps = stack.pop()
            more = states << wide  # one edit more without reading; with reading, one bit further
            for c, child in node.items():
                if c == "":
                    found += next(([(e, child)] for e, bit in accept if states & bit), [])
                    continue
                if c in reads:
                    m, after = reads[c]
                    x = ((states & m) << 1) | more | (more << 1) | ((swaps & m) << 2)
                    begun = (more & (after << wide)) & full
                else:
                    x, begun = more | (more << 1), 0
                x &= full
                for _ in cascade:  # dropped characters of text; fewer edits count as more
                    x |= ((x << wide) | (x << (wide + 1))) & full
                if x or begun:
                    stack.append((child, x, begun))
        return found

    def _begun_by(self, word: str) -> Iterator[str]:
        """Words of the list that begin with word."""
        node = self.words
        for c in word:
            if (node := node.get(c)) is None:
                return
        stack = [node]
        while stack:
            node = stack.pop()
            for c, child in node.items():
                if c == "":
                    yield child
                else:
                    stack.append(child)

    def _alternatives(self, word: str) -> list[tuple[float, str]]:
        """Words of the list a typed word may stand for, with their cost: itself or its plural if the list knows it, else near ones."""
        if (known := self._seen.get(word)) is not None:
            return known
        out = [(0.0 if f == word else 0.1, f) for f in _forms(word) if f in self.vocabulary]
        if not out and not any(f in self.known for f in _forms(word)) and not word.isdigit():
            plain = word.translate(_LOOKALIKE)
            if plain != word and (plain in self.vocabulary or plain in self.known):
                out = [(1.0, plain)] * (plain in self.vocabulary)
            else:
                n = len(word)
                out = [(float(d), w) for d, w in self.near(plain, _word_edits(n)) if not w.isdigit() and d <= _word_edits(min(n, len(w)) + 1)]
                out += [(1.5, w) for w in self._begun_by(word) if len(w) - n > _word_edits(n)] if n >= 3 else []
        if len(self._seen) > 200_000:
            self._seen.clear()
        self._seen[word] = out
        return out

    def _spelled(self, typed: list[str], most: float) -> list[tuple[float, str]]:
        """Spellings whose words are alternatives of the typed ones in order, at a total cost of at most most."""
        level = [(0.0, self.word_trie)]
        for w in typed:
            alternatives = self._alternatives(w)
            level = [(c + d, node[a]) for c, node in level for d, a in alternatives if a in node and c + d <= most]
            if not level:
                return []
        return [(c, s) for c, node in level for s in node.get("", ())]

    def _abbreviated(self, typed: list[str], dotted: list[bool]) -> list[tuple[float, str]]:
        """Spellings each word of which the typed word begins or equals, most of them cut to three letters or more."""
        level = [(self.word_trie, 0)]
        for w, dot in zip(typed, dotted, strict=True):
            level = [
                (child, cut_off + (c not in (w, w + "s")))
                for node, cut_off in level
                for c, child in node.items()
                if c and (c == w or (c.startswith(w) and not w.isdigit() and (dot or len(w) >= 3)))
            ]
        return [(6.0 - cut_off / len(typed), s) for node, cut_off in level if 2 * cut_off >= len(typed) for s in node.get("", ())]

    def choose(self, names: Iterable[str], hint: str) -> str:
        """The single entry of those that fit equally well; a hint of the right type settles a tie."""
        return chosen({n: self.kind[n] for n in names}, hint)

    def _variants(self, key: str) -> list[str]:
        out = [key]
        k = re.sub(r"\s*\([^()]*\)?\s*$", "", key)
        for _ in range(3):
            for a in AFTER:
                k = k.removesuffix(" " + a).rstrip(" ,.(")
            first, _, rest = k.partition(" ")
            if first in BEFORE and rest:
                k = rest
            if k != out[-1]:
                out.append(k)
        for v in list(out):
            if "," in v:
                a, _, b = v.partition(",")
                out.append(f"{b.strip()} {a.strip()}")
            w = v.split()
            if len(w) > 2 and w[1] in ("for", "of", "to", "on"):
                out.append(" ".join([*w[2:], w[0]]))
            if len(w) > 2:
                out.append(" ".join([*w[1:], w[0]]))
        return list(dict.fromkeys(out))

    def _reordered(self, bag: str) -> list[tuple[float, set[str]]]:
        """Entries whose words in any order are alternatives of the bag's, at a total cost within its length's."""
        level: dict[tuple[str, ...], float] = {(): 0.0}
        most = most_edits(len(bag))
        for w in bag.split():
            new: dict[tuple[str, ...], float] = {}
            for words, c in level.items():
                for d, a in self._alternatives(w):
                    if c + d <= most and new.get(k := tuple(sorted((*words, a))), most + 1) > c + d:
                        new[k] = c + d
            if not (level := new):
                return []
        return [(c, self.sorted[k]) for words, c in level.items() if len(words) > 1 and (k := " ".join(words)) in self.sorted]

    def meant(self, span: str) -> tuple[float, frozenset[str]] | None:
        """``(cost, entries)``: the entries within the distance that fit best, several if they tie; None if there are none.

        The whole part of the cost is the way of reading, surer ways first; a way that settles the matter without an
        entry (a provision the list lacks) gives no entries.
        """
        f = fold(span)
        key = self._key(f)
        if not key:
            return None
        if hit := self.paths.get(key) or self.paths.get(f):
            return 0.0, frozenset(hit[1])
        if p := provision(key):
            if p[0] in self.acts:
                acts = {self.acts[p[0]]}
            else:
                acts = {self.acts[s] for _, s in self.near(p[0], 1, self.act_trie)} if len(p[0]) > 4 else set()
            return 1.0, frozenset(self.provisions[a, *p[1:]] for a in acts if (a, *p[1:]) in self.provisions)
        variants = [self._key(v) for v in self._variants(key)]
        for i, v in enumerate(variants[1:]):
            if hit := self.paths.get(v):
                return 2 + i / 100, frozenset(hit[1])
        bags = [" ".join(sorted(w for w in _words(v) if w not in ("for",))) for v in variants]
        for i, b in enumerate(bags):
            if b in self.sorted and " " in b:
                return 3 + i / 100, frozenset(self.sorted[b])
        compact = re.sub(r"[\s.]", "", key)
        if len(compact) >= 3 and compact.isalpha() and (span.strip().isupper() or re.fullmatch(r"(?:\w\.\s*)+\w?", key)):
            if hit := self.paths.get(compact):
                return 4.0, frozenset(hit[1])
            if len(compact) <= 7 and compact in self.initials:
                return 5.0, frozenset(self.initials[compact])
        found: list[tuple[float, set[str]]] = []
        for penalty, v in enumerate(variants):
            typed = _words(v)
            if len(v) >= 4 and typed:
                found += [(6 + (c + 0.01 * min(penalty, 1) + 0.001 * self.paths[s][0]) / 100, self.paths[s][1]) for c, s in self._spelled(typed, most_edits(len(v)))]
        for v in variants if not found else ():
            found += [(7.0, self.paths[s][1]) for s in self.compact.get("".join(_words(v)), ())]
        for b in bags if not found else ():
            found += [(8 + c / 100, names) for c, names in self._reordered(b)]
        for v in variants if not found else ():
            parts = re.findall(r"([^\W_]+)(\.?)", v)
            if len(parts) > 1:
                found += [(9 + c / 100, self.paths[s][1]) for c, s in self._abbreviated([w for w, _ in parts], [bool(d) for _, d in parts])]
        if not found:
            return None
        least = min(c for c, _ in found)
        return least, frozenset().union(*(n for c, n in found if c == least))

    def link(self, span: str, hint: str | None = None) -> str:
        """The canonical name meant, or ``(none)``."""
        m = self.meant(span)
        return self.choose(m[1], fold(hint or "")) if m else NONE


def chosen(kinds: dict[str, str], hint: str) -> str:
    """The one entry of name -> type, or the one of the hinted type; else ``(none)``."""
    of_type = [n for n, k in kinds.items() if k == hint] if hint else []
    best = of_type if len(kinds) > 1 and of_type else list(kinds)
    return best[0] if len(best) == 1 else NONE


def _forms(word: str) -> list[str]:
    """The word, its plural and its possible singulars."""
    return [word, word + "s", word[:-1] if word.endswith("s") else "", word[:-2] if word.endswith("es") else "", word[:-3] + "y" if word.endswith("ies") else ""]


def probes(span: str) -> set[str]:
    """The words whose being known to the list decides how a span is read."""
    typed = {w for v in Names([])._variants(Names._key(fold(span))) for w in _words(v)}
    return {f for w in typed for f in (*_forms(w), w.translate(_LOOKALIKE)) if f}


def _homes(name: str, display: str | None, aliases: list[str] | None) -> set[str]:
    """Keys by which entries that need each other meet in a part: a provision at its act, other entries at each spelling."""
    f = fold(name)
    if p := provision(f):
        return {p[0]}
    return {Names._key(x) for x in (f, *(fold(a) for a in [display, *(aliases or [])] if a))}


_ENTRY = "type string, canonical_name string, display_name string, aliases array<string>"


def _parts(listed: DataFrame, n: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The list in parts that fit a task, entries that need each other together, and the words of the whole list.

    A list within MOST_ENTRIES is one part, and its words are all in it.
    """
    if n <= MOST_ENTRIES:
        return [listed], None
    count = -(-n // (MOST_ENTRIES // 2))

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = [(r, h) for r in b.to_pylist() if r["canonical_name"] and r["canonical_name"].strip() for h in {zlib.crc32(x.encode("utf-8", "surrogatepass")) % count for x in _homes(r["canonical_name"], r["display_name"], r["aliases"])}]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r, _ in rows], b.schema.field(c).type) for c in b.schema.names), pa.array([h for _, h in rows], pa.int32())], names=[*b.schema.names, "part"])

    def spelled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            words = {w for r in b.to_pylist() for x in (r["canonical_name"], r["display_name"], *(r["aliases"] or [])) if x for w in _words(Names._key(fold(x)))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])

    home = cut(listed.mapInArrow(placed, f"{_ENTRY}, part int"))
    return [home.where(F.col("part") == i).drop("part") for i in range(count)], cut(listed.mapInArrow(spelled, "word string").distinct())


def link_candidates(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """spans(span, type) -> ``span, type, entries, canonical_name``: all entries that fit a distinct span best, and the one meant.

    entries is empty where nothing lies within the distance; several that tie are settled by the type hint or give
    ``(none)``. A list beyond MOST_ENTRIES is read part by part, each over all spans, and the best of all parts counts.
    """
    spark = spans.sparkSession
    listed = entries.select("type", "canonical_name", "display_name", "aliases")
    parts, vocabulary = _parts(listed, listed.count())
    asked = spread(cut(spans.select("span", "type").distinct()))
    if vocabulary is None:
        asked = asked.withColumn("known", F.array().cast("array<string>"))
    else:

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(s, w) for s in b.column(0).to_pylist() for w in probes(s)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string())], names=["span", "word"])

        met = asked.select("span").distinct().mapInArrow(probed, "span string, word string").join(vocabulary, "word")
        known = met.groupBy("span").agg(F.collect_set("word").alias("known"))
        asked = cut(asked.join(known, "span", "left").select("span", "type", F.coalesce("known", F.array().cast("array<string>")).alias("known")))
    found = None
    for part in parts:
        names = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            index = None
            for b in batches:
                index = index or Names(names.value)
                cost, fits, kinds = [], [], []
                for s, known in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    index.read(known)
                    m = index.meant(s) or (99.0, frozenset())
                    cost.append(m[0])
                    fits.append(sorted(m[1]))
                    kinds.append([index.kind[n] for n in fits[-1]])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cost, pa.float64()), pa.array(fits, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.string()))], names=["span", "type", "cost", "entries", "kinds"])

        each = asked.mapInArrow(run, "span string, type string, cost double, entries array<string>, kinds array<string>")
        found = each if found is None else found.unionByName(each)
    if len(parts) > 1:
        least = found.groupBy("span", "type").agg(F.collect_list(F.struct("cost", "entries", "kinds")).alias("all"))  # a row per part
        best = F.filter("all", lambda x: x["cost"] == F.array_min(F.transform("all", lambda y: y["cost"])))
        both = F.array_sort(F.array_distinct(F.flatten(F.transform(best, lambda x: F.arrays_zip(x["entries"].alias("n"), x["kinds"].alias("k"))))))
        found = least.select("span", "type", both.alias("b")).select("span", "type", F.transform("b", lambda x: x["n"]).alias("entries"), F.transform("b", lambda x: x["k"]).alias("kinds"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            one = [chosen(dict(zip(fits, kinds, strict=True)), fold(hint or "")) for hint, fits, kinds in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(one, pa.string())], names=["span", "type", "entries", "canonical_name"])

    return found.select("span", "type", "entries", "kinds").mapInArrow(decide, "span string, type string, entries array<string>, canonical_name string")


def typed_spans(spans: DataFrame) -> DataFrame:
    """``span_id, span, type`` of the spans that are neither null nor only white space; of differing rows of one id the least span decides."""
    blank = "^[" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE) + "]*$"
    typed = spans.where(F.col("span").isNotNull() & ~F.col("span").rlike(blank))
    return typed.groupBy("span_id").agg(F.min(F.struct("span", F.coalesce("type", F.lit("")).alias("type"))).alias("s")).select("span_id", "s.span", "s.type")


def link_spans(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """``span_id, canonical_name``: one row per span_id whose span is neither null nor only white space.

    canonical_name is the entry of ``entries`` meant, or ``(none)``. Each distinct (span, type) is linked once, so a
    hot spelling costs no more than a rare one. Of differing rows of one span_id the least span decides. Aliases that
    stand for several entries are settled by the type hint, else ``(none)``. An empty list links nothing; an empty
    span table gives an empty result. Other columns, an earlier linker's included, are not read.
    """
    one = cut(typed_spans(spans))
    return one.join(link_candidates(one, entries), ["span", "type"]).select("span_id", "canonical_name")


def unmatched_spans(spans: DataFrame, entries: DataFrame) -> DataFrame:
    """``span, why, entries, n_spans``: each distinct span that means no entry (``none``) or fits several alike (``tie``), these, and how many ids typed it."""
    one = cut(typed_spans(spans))
    lost = one.join(link_candidates(one, entries).where(F.col("canonical_name") == NONE), ["span", "type"])
    return lost.groupBy("span", F.when(F.size("entries") > 1, "tie").otherwise("none").alias("why"), F.array_join("entries", "|").alias("entries")).agg(F.count("*").alias("n_spans"))
