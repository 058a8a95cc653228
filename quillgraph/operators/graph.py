"""The typed property graph: build, checks, templates over pre-aggregated legs, paths, components, statements."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import name_keys
from quillgraph.plans.runtime import cut, join_sized, small_enough
from quillgraph.schemas import ENDPOINTS, TEMPLATES, TYPE_PRIORITY

MOST_HOPS, SHOWN = 4, 3


@dataclass(frozen=True)
class Graph:
    """nodes(name, type, display) and edges(type, head, tail, source_chunk_id, confidence, head_type, tail_type, violation, derived)."""

    nodes: DataFrame
    edges: DataFrame
    skipped: DataFrame


def resolve_names(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``raw, key, name, type`` of the distinct names in a table's first column; name and type are null where no node has the key.

    A canonical name owns its key before any alias; an alias of several nodes goes to the least name.
    """
    spelled = F.concat(F.array(F.struct(F.lit(0).alias("r"), F.col("canonical_name").alias("raw"))), F.transform(F.coalesce("aliases", F.array()), lambda a: F.struct(F.lit(1).alias("r"), a.alias("raw"))))
    each = nodes.select("type", F.col("canonical_name").alias("name"), F.inline(spelled))
    keys = name_keys(names, each.select("raw"))
    owners = each.join(keys, "raw").groupBy("key").agg(F.min(F.struct("r", "name", "type")).alias("b")).select("key", "b.name", "b.type")
    return keys.join(owners, "key", "left").select("raw", "key", "name", "type")


def allowed(edge: str, head_type: str, tail_type: str) -> Column:
    """Whether both endpoint types suit the relation; an unknown relation allows all."""
    ok = F.lit(True)
    for relation, (heads, tails) in ENDPOINTS.items():
        ok = F.when(F.col(edge) == relation, F.col(head_type).isin(heads.split()) & F.col(tail_type).isin(tails.split())).otherwise(ok)
    return ok


def usable(confidence: str = "confidence") -> Column:
    """A confidence from 0 to 1, else null: NaN and values out of range are none."""
    c = F.col(confidence)
    return F.when(c.between(0, 1) & ~F.isnan(c), c)


def build(relationships: DataFrame, nodes: DataFrame) -> Graph:
    """Edges keyed (type, head, tail, chunk) between resolved nodes; the last loaded confidence wins; the rest is skipped.

    Names are normalised and resolved once each, whatever their number of edges. A confidence that is NaN or outside
    0..1 is null, and a usable one beats it.
    """
    r = relationships.select("rel_id", "type", "head", "tail", "source_chunk_id", usable().alias("confidence"), "loaded_at")
    known = cut(resolve_names(r.select(F.explode(F.array("head", "tail"))), nodes).where(F.col("name").isNotNull()))
    h = known.select(F.col("raw").alias("head"), F.col("name").alias("hn"), F.col("type").alias("head_type"))
    t = known.select(F.col("raw").alias("tail"), F.col("name").alias("tn"), F.col("type").alias("tail_type"))
    small = small_enough(known)
    r = join_sized(join_sized(r, h, ["head"], "left", small=small), t, ["tail"], "left", small=small)
    missing = F.filter(F.array(F.when(F.col("hn").isNull(), F.col("head")), F.when(F.col("tn").isNull(), F.col("tail"))), lambda x: x.isNotNull())
    skipped = r.where(F.col("hn").isNull() | F.col("tn").isNull()).select("rel_id", "type", F.array_join(missing, "|").alias("missing"))
    edges = r.where(F.col("hn").isNotNull() & F.col("tn").isNotNull() & F.col("source_chunk_id").isNotNull())
    edges = edges.groupBy("type", F.col("hn").alias("head"), F.col("tn").alias("tail"), "source_chunk_id").agg(F.max_by("confidence", F.struct(F.col("confidence").isNotNull(), "loaded_at", "rel_id")).alias("confidence"), F.first("head_type").alias("head_type"), F.first("tail_type").alias("tail_type"))
    edges = edges.withColumn("violation", ~allowed("type", "head_type", "tail_type")).withColumn("derived", F.lit(False))
    plain = nodes.select(F.col("canonical_name").alias("name"), "type", F.col("display_name").alias("display"))
    return Graph(plain, edges, skipped)


def regulation_prefix(name: str) -> Column:
    """The regulation a provision's canonical name begins with; lower case only."""
    return F.nullif(F.regexp_extract(F.col(name), r"^(aia|gdpr|led|eudpr)\b", 1), F.lit(""))


def bridges(edges: DataFrame) -> DataFrame:
    """INTERACTS_WITH edges derived from references between provisions of two known regulations, where none exists."""
    provision = F.col("head_type").isin("Article", "Annex") & F.col("tail_type").isin("Article", "Annex")
    ref = edges.where((F.col("type") == "REFERENCES") & provision & (regulation_prefix("head") != regulation_prefix("tail")))
    have = edges.where(F.col("type") == "INTERACTS_WITH").select("head", "tail", "source_chunk_id")
    new = ref.join(have, ["head", "tail", "source_chunk_id"], "left_anti")
    return new.select(F.lit("INTERACTS_WITH").alias("type"), "head", "tail", "source_chunk_id", "confidence", "head_type", "tail_type", F.lit(False).alias("violation"), F.lit(True).alias("derived"))


def leg(edges: DataFrame, edge: str, head: str, tail: str, chunks: str, heads: tuple[str, ...] = (), tails: tuple[str, ...] = ()) -> DataFrame:
    """One edge type as ``head, tail, chunks`` with its chunks collected first: joining legs then multiplies no chunks."""
    rows = edges.where(F.col("type") == edge)
    rows = rows.where(F.col("head_type").isin(*heads)) if heads else rows
    rows = rows.where(F.col("tail_type").isin(*tails)) if tails else rows
    return rows.groupBy(F.col("head").alias(head), F.col("tail").alias(tail)).agg(F.array_sort(F.collect_set("source_chunk_id")).alias(chunks))


def obligations_for_role(edges: DataFrame) -> DataFrame:
    return leg(edges, "APPLIES_TO", "o", "r", "applies_chunks", ("Obligation",), ("ActorRole",)).join(leg(edges, "IMPOSES", "a", "o", "imposes_chunks", ("Article",), ("Obligation",)), "o").select("r", "o", "a", "applies_chunks", "imposes_chunks")


def obligations_for_system(edges: DataFrame) -> DataFrame:
    """A classified system without duties keeps its row: both optional edges or neither."""
    duty = leg(edges, "APPLIES_TO", "o", "s", "applies_chunks", ("Obligation",)).join(leg(edges, "IMPOSES", "a", "o", "imposes_chunks"), "o")
    graded = leg(edges, "CLASSIFIED_AS", "s", "rc", "classified_chunks", ("SystemType",), ("RiskCategory",))
    none = F.array().cast("array<string>")
    return graded.join(duty, "s", "left").select("s", "rc", "o", "a", "classified_chunks", F.coalesce("applies_chunks", none).alias("applies_chunks"), F.coalesce("imposes_chunks", none).alias("imposes_chunks"))


def enforcement_chain(edges: DataFrame) -> DataFrame:
    pen = leg(edges, "PENALIZED_UNDER", "o", "p", "penalty_chunks", (), ("Article",))
    return leg(edges, "ENFORCED_BY", "o", "auth", "enforced_chunks", ("Obligation",), ("Authority",)).join(pen, "o", "left").select("o", "auth", "p", "enforced_chunks", F.coalesce("penalty_chunks", F.array().cast("array<string>")).alias("penalty_chunks"))


def definition_of(edges: DataFrame) -> DataFrame:
    return leg(edges, "DEFINED_IN", "t", "a", "defined_chunks", (), ("Article", "Annex"))


def cross_regulation(edges: DataFrame) -> DataFrame:
    """Undirected neighbours; per asserting chunk whether it is derived and points outward. A self-loop stands once."""
    e = edges.where(F.col("type") == "INTERACTS_WITH")
    out = e.select(F.col("head").alias("a"), F.col("tail").alias("b"), F.col("source_chunk_id").alias("chunk"), "derived", F.lit(True).alias("outbound"))
    back = e.where(F.col("head") != F.col("tail")).select(F.col("tail").alias("a"), F.col("head").alias("b"), F.col("source_chunk_id").alias("chunk"), "derived", F.lit(False).alias("outbound"))
    return out.unionByName(back).groupBy("a", "b").agg(F.array_sort(F.collect_set(F.struct("chunk", "derived", "outbound"))).alias("provenance"))


@dataclass(frozen=True)
class Part:
    """One leg of a template: edges ``x, y, chunk, derived`` told as x verb y, without being joined to the other legs.

    An edge belongs to the anchor in its column ``anchor``, or to every anchor that ``links(anchor, o)`` gives its y.
    """

    verb: str
    rows: DataFrame
    anchor: str = ""
    links: DataFrame | None = None


def _part(edges: DataFrame, edge: str, heads: tuple[str, ...] = (), tails: tuple[str, ...] = ()) -> DataFrame:
    rows = edges.where(F.col("type") == edge)
    rows = rows.where(F.col("head_type").isin(*heads)) if heads else rows
    rows = rows.where(F.col("tail_type").isin(*tails)) if tails else rows
    return rows.select(F.col("head").alias("x"), F.col("tail").alias("y"), F.col("source_chunk_id").alias("chunk"), "derived")


def parts(edges: DataFrame, template: str) -> list[Part]:
    """The legs of a template's rows, each edge once: what a row needs of the others is asked by semi joins."""
    if template == "obligations_for_role":
        imposed = _part(edges, "IMPOSES", ("Article",), ("Obligation",))
        applied = _part(edges, "APPLIES_TO", ("Obligation",), ("ActorRole",)).join(imposed.select(F.col("y").alias("x")).distinct(), "x", "left_semi")
        return [Part(" applies to ", applied, "y"), Part(" imposes: ", imposed, links=applied.select(F.col("y").alias("anchor"), F.col("x").alias("o")).distinct())]
    if template == "obligations_for_system":
        graded, imposed = _part(edges, "CLASSIFIED_AS", ("SystemType",), ("RiskCategory",)), _part(edges, "IMPOSES")
        applied = _part(edges, "APPLIES_TO", ("Obligation",)).join(graded.select(F.col("x").alias("y")).distinct(), "y", "left_semi").join(imposed.select(F.col("y").alias("x")).distinct(), "x", "left_semi")
        return [Part(" is classified as ", graded, "x"), Part(" applies to ", applied, "y"), Part(" imposes: ", imposed, links=applied.select(F.col("y").alias("anchor"), F.col("x").alias("o")).distinct())]
    if template == "enforcement_chain":
        enforced = _part(edges, "ENFORCED_BY", ("Obligation",), ("Authority",))
        return [Part(" is enforced by ", enforced, "x"), Part(" is penalised under ", _part(edges, "PENALIZED_UNDER", (), ("Article",)).join(enforced.select("x").distinct(), "x", "left_semi"), "x")]
    if template == "definition_of":
        return [Part(" is defined in ", _part(edges, "DEFINED_IN", (), ("Article", "Annex")), "x")]
    both = _part(edges, "INTERACTS_WITH")
    return [Part(" interacts with ", both, "x"), Part(" interacts with ", both.where(F.col("x") != F.col("y")), "y")]


def row_counts(edges: DataFrame, template: str) -> DataFrame:
    """``anchor, n``: how many rows a template has for each anchor, from the counts of its legs alone."""
    first, *rest = parts(edges, template)
    per = lambda rows, by: rows.select("x", "y").distinct().groupBy(F.col(by).alias("anchor")).agg(F.count("*").alias("n"))
    if template == "cross_regulation":
        ends = [p.rows.select(F.col(p.anchor).alias("anchor"), F.col("y" if p.anchor == "x" else "x").alias("other")) for p in (first, *rest)]
        return reduce(DataFrame.unionByName, ends).distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    duties = [p.links.join(per(p.rows, "y").withColumnRenamed("anchor", "o"), "o").groupBy("anchor").agg(F.sum("n").alias("n")) for p in rest if p.links is not None]
    if template == "obligations_for_role":
        return duties[0]
    more = duties or [per(p.rows, p.anchor) for p in rest]
    n = per(first.rows, first.anchor)
    return n.join(more[0].withColumnRenamed("n", "m"), "anchor", "left").select("anchor", (F.col("n") * F.coalesce("m", F.lit(1))).alias("n")) if more else n


BUILDERS = {f.__name__: f for f in (obligations_for_role, obligations_for_system, enforcement_chain, definition_of, cross_regulation)}


def validate(template: str, params: dict[str, str]) -> None:
    """A plan is checked before any job starts: a known template with exactly its declared parameters."""
    if template not in TEMPLATES:
        raise ValueError(f"no template {template!r}")
    if (declared := set(TEMPLATES[template][0])) != set(params):
        raise ValueError(f"{template} takes {sorted(declared)}, not {sorted(params)}")


def run_template(edges: DataFrame, template: str, params: dict[str, str]) -> DataFrame:
    validate(template, params)
    if template == "path_between":
        ends = edges.sparkSession.createDataFrame([(params["entity_a"], params["entity_b"])], "a string, b string")
        return shortest_paths(edges, ends)
    return BUILDERS[template](edges).where(F.col(ANCHORS[template]) == next(iter(params.values())))


def reach(edges: DataFrame, starts: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """starts(a) -> ``a, n, hops, nodes, legs``: one undirected shortest path to everything within ``hops`` edges.

    legs has type, chunk and derived of each edge passed. Of equal length the path least by name wins, and of parallel
    edges the least by chunk and type, so results repeat. Each hop joins a frontier with the distinct neighbours, a
    hub's rows spread by a salt, and leaves out what its source has reached.
    """
    leg_ = F.struct(F.col("source_chunk_id").alias("chunk"), "type", "derived")
    both = edges.select(F.inline(F.array(F.struct(F.col("head").alias("x"), F.col("tail").alias("y")), F.struct(F.col("tail").alias("x"), F.col("head").alias("y")))), leg_.alias("leg"))
    near = cut(both.where(F.col("x") != F.col("y")).groupBy("x", "y").agg(F.min("leg").alias("leg")))
    none = F.array().cast("array<struct<chunk:string,type:string,derived:boolean>>")
    front = starts.select("a").distinct().select("a", F.col("a").alias("n"), F.lit(0).alias("hops"), F.array("a").alias("nodes"), none.alias("legs"))
    seen = front
    for i in range(1, hops + 1):
        met = join_sized(near, front.select("a", F.col("n").alias("x"), "nodes", "legs"), ["x"])
        step = met.groupBy("a", F.col("y").alias("n")).agg(F.min(F.struct(F.array_append("nodes", F.col("y")).alias("nodes"), F.array_append("legs", F.col("leg")).alias("legs"))).alias("m"))
        front = cut(step.join(seen.select("a", "n"), ["a", "n"], "left_anti").select("a", "n", F.lit(i).alias("hops"), "m.nodes", "m.legs"))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = MOST_HOPS) -> DataFrame:
    """pairs(a, b) -> ``a, b, hops, nodes, legs``: of ``reach`` the paths asked for; a pair farther apart has no row."""
    return join_sized(reach(edges, pairs, hops).withColumnRenamed("n", "b"), pairs.select("a", "b").distinct(), ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``name, component``: least name of each undirected component, by spreading least labels and jumping along them.

    The joins are on a node and on a label; hubs and the giant component's label are salted.
    """
    e = edges.select(F.col("head").alias("x"), F.col("tail").alias("y")).where(F.col("x") != F.col("y"))
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = cut(edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct().withColumn("component", F.col("name")))
    while True:
        least = join_sized(e, label.select(F.col("name").alias("y"), "component"), ["y"]).groupBy(F.col("x").alias("name")).agg(F.min("component").alias("c"))
        hooked = label.join(least, "name", "left").select("name", F.least("component", F.coalesce("c", "component")).alias("component"), F.col("component").alias("old"))
        root = label.select(F.col("name").alias("component"), F.col("component").alias("root"))
        new = cut(join_sized(hooked, root, ["component"]).select("name", F.least("component", "root").alias("component"), (F.least("component", "root") < F.col("old")).alias("moved")))
        label = new.select("name", "component")
        if not new.where("moved").limit(1).count():
            return label


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct(), "name", "left_anti")


#: Per template the legs a row is told in: subject, verb, object and the column of its chunks.
LEGS = {
    "obligations_for_role": [("o", " applies to ", "r", "applies_chunks"), ("a", " imposes: ", "o", "imposes_chunks")],
    "obligations_for_system": [("s", " is classified as ", "rc", "classified_chunks"), ("o", " applies to ", "s", "applies_chunks"), ("a", " imposes: ", "o", "imposes_chunks")],
    "enforcement_chain": [("o", " is enforced by ", "auth", "enforced_chunks"), ("o", " is penalised under ", "p", "penalty_chunks")],
    "definition_of": [("t", " is defined in ", "a", "defined_chunks")],
}
#: The column of a template's rows that a call gives.
ANCHORS = {"obligations_for_role": "r", "obligations_for_system": "s", "enforcement_chain": "o", "definition_of": "t", "cross_regulation": "a"}


def told(rows: DataFrame, template: str, *by: str) -> DataFrame:
    """Template rows as ``by..., x, verb, y, chunk, derived``: one per leg and chunk behind it."""
    kept = [F.col(c).alias(f"_{c}") for c in by]
    if template == "cross_regulation":
        each = rows.select(*kept, "a", "b", F.inline("provenance"))
        x, y = (F.when(F.col("outbound"), F.col(p)).otherwise(F.col(q)) for p, q in (("a", "b"), ("b", "a")))
        flat = each.select(*(f"_{c}" for c in by), x.alias("x"), F.lit(" interacts with ").alias("verb"), y.alias("y"), "chunk", "derived")
    elif template == "path_between":
        hop = F.posexplode("legs").alias("i", "leg")
        each = rows.select(*kept, "nodes", hop)
        verb = F.concat(F.lit(" "), F.lower(F.replace("leg.type", F.lit("_"), F.lit(" "))), F.lit(" "))
        flat = each.select(*(f"_{c}" for c in by), F.get("nodes", F.col("i")).alias("x"), verb.alias("verb"), F.get("nodes", F.col("i") + 1).alias("y"), F.col("leg.chunk").alias("chunk"), F.col("leg.derived").alias("derived"))
    else:
        parts = F.array(*(F.struct(F.col(x).alias("x"), F.lit(v).alias("verb"), F.col(y).alias("y"), F.col(c).alias("cs")) for x, v, y, c in LEGS[template]))
        flat = rows.select(*kept, F.inline(parts)).select(*(f"_{c}" for c in by), "x", "verb", "y", F.explode("cs").alias("chunk"), F.lit(False).alias("derived"))
    flat = flat.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*(f"_{c}" for c in by), "x", "verb", "y", "chunk").agg(F.max("derived").alias("derived"))
    return flat.select(*(F.col(f"_{c}").alias(c) for c in by), "x", "verb", "y", "chunk", "derived")


def render(legs: DataFrame, names: DataFrame, labels: DataFrame, *by: str, shown: int = SHOWN, strict: bool = True) -> DataFrame:
    """Legs as citable sentences: one per distinct sentence, its chunks united in order, the first ones cited.

    ``by..., statement, chunk_id, provenance, n_chunks, text, derived``. names(name, display) and labels(chunk_id,
    citation_label) are met once for all. A chunk without a label could not be cited: an error if ``strict``, else
    the sentence is told without that chunk, and not at all without any.
    """
    d = names.select("name", F.coalesce("display", "name").alias("d"))
    one = join_sized(join_sized(legs, d.select(F.col("name").alias("x"), F.col("d").alias("dx")), ["x"]), d.select(F.col("name").alias("y"), F.col("d").alias("dy")), ["y"])
    one = join_sized(one, labels.select(F.col("chunk_id").alias("chunk"), "citation_label"), ["chunk"], "left" if strict else "inner")
    one = one.withColumn("label", F.coalesce("citation_label", F.raise_error(F.concat(F.lit("no label for "), F.col("chunk"))).cast("string")))
    caveat = _caveat("dx", "dy")
    s = one.groupBy(*by, F.concat("dx", "verb", "dy", F.lit(".")).alias("statement")).agg(F.array_sort(F.collect_set(F.struct("chunk", "label"))).alias("p"), F.max("derived").alias("derived"), F.max(caveat).alias("caveat"))
    return _cited(s, *by, shown=shown)


def _caveat(*shown: str) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(x).rlike(r"\bannex\s+(viii|xi)\b") for x in shown))


def _cited(s: DataFrame, *by: str, shown: int) -> DataFrame:
    """by..., statement, p(chunk, label), derived, caveat -> the sentences with the first labels cited."""
    n = F.size("p")
    cited = F.concat(F.array_join(F.transform(F.slice("p", 1, shown), lambda x: x["label"]), ", "), F.when(n > shown, F.concat(F.lit(", +"), n - shown, F.lit(" more"))).otherwise(""))
    text = F.concat("statement", F.lit(" ("), cited, F.lit(")"), F.when(F.col("caveat"), " [unverified annex section]").otherwise(""))
    return s.select(*by, "statement", F.col("p")[0]["chunk"].alias("chunk_id"), F.transform("p", lambda x: x["chunk"]).alias("provenance"), n.cast("bigint").alias("n_chunks"), text.alias("text"), "derived")


def statements(rows: DataFrame, template: str, names: DataFrame, labels: DataFrame, shown: int = SHOWN, strict: bool = True) -> DataFrame:
    """``told`` and ``render`` of one template's rows, whoever asked for them."""
    return render(told(rows, template), names, labels, shown=shown, strict=strict)


def checked(calls: DataFrame) -> DataFrame:
    """Calls written once, an unknown template being an error."""
    known = F.array(*map(F.lit, TEMPLATES))
    return cut(calls.withColumn("template", F.when(F.array_contains(known, F.col("template")), F.col("template")).otherwise(F.raise_error(F.concat(F.lit("no template "), F.col("template"))).cast("string"))))


def called(calls: DataFrame) -> list[str]:
    """The templates that are called at all, in their order."""
    used = {r.template for r in calls.select("template").distinct().collect()}
    return [t for t in TEMPLATES if t in used]


def report(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``qid, call, template, n_rows`` of every call, 0 where the graph has nothing. Rows are counted without being joined."""
    return _reported(checked(calls), edges, None)


def _reported(calls: DataFrame, edges: DataFrame, found: DataFrame | None) -> DataFrame:
    counts = [calls.where("false").select("qid", "call", "template", F.lit(0).cast("bigint").alias("n_rows"))]
    for template in called(calls):
        asked = calls.where(F.col("template") == template)
        if template == "path_between":
            on, n = ["a", "b"], shortest_paths(edges, asked.select("a", "b").distinct()) if found is None else found
            n = n.groupBy("a", "b").agg(F.count("*").alias("n"))
        else:
            on, n = ["a"], row_counts(edges, template).withColumnRenamed("anchor", "a")
        counts.append(asked.join(n, on, "left").select("qid", "call", "template", F.coalesce("n", F.lit(0)).alias("n_rows")))
    return reduce(DataFrame.unionByName, counts)


def told_alone(edges: DataFrame, template: str) -> DataFrame:
    """``x, verb, y, chunk, derived`` of all rows a template has, as ``told`` has them, without joining a leg to another."""
    each = [(p.rows if p.links is None else p.rows.join(p.links.select(F.col("o").alias("y")).distinct(), "y", "left_semi")).select("x", F.lit(p.verb).alias("verb"), "y", "chunk", "derived") for p in parts(edges, template)]
    return reduce(DataFrame.unionByName, each).groupBy("x", "verb", "y", "chunk").agg(F.max("derived").alias("derived"))


#: The bit of each leg of each template, and of a path's edge.
_KINDS = {k: i for i, k in enumerate((t, j) for t in TEMPLATES for j in range(3))}


def search(calls: DataFrame, graph: Graph, labels: DataFrame, shown: int = SHOWN, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Run the plans of many questions at once: calls(qid, call, template, a, b) -> ``(statements, report)``.

    A plan several questions have is run once. Legs gather their chunks once, whoever reaches them; plans are joined
    with the legs' ids only, and a sentence is worded once for all plans that reach it by the same legs. A sentence
    several calls of a question reach stands once, at the first of them, with the chunks of all.
    statements: ``qid, call, statement, chunk_id, provenance, n_chunks, text, derived``; report: ``qid, call,
    template, n_rows`` of every call, 0 where the graph has nothing. An unknown template is an error.
    """
    calls = checked(calls)
    per = calls.groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("call", "template", "a", "b"))).alias("plan")).withColumn("k", F.to_json(F.struct("plan")))
    plans = cut(per.groupBy("k").agg(F.first("plan").alias("plan")).withColumn("pid", F.monotonically_increasing_id()))
    asked = cut(per.select("qid", "k").join(plans.select("k", "pid"), "k").select("qid", "pid"))
    steps = plans.select("pid", F.inline("plan"))
    used, found, rows = called(calls), None, []
    each = {t: parts(graph.edges, t) for t in used if t != "path_between"}
    for t, legs in each.items():
        rows += [p.rows.select(F.lit(_KINDS[t, j]).alias("kind"), "x", F.lit(p.verb).alias("verb"), "y", "chunk", "derived") for j, p in enumerate(legs)]
    if "path_between" in used:
        found = cut(shortest_paths(graph.edges, calls.where(F.col("template") == "path_between").select("a", "b").distinct()))
        hops = cut(told(found, "path_between", "a", "b"))
        rows.append(hops.select(F.lit(_KINDS["path_between", 0]).alias("kind"), "x", "verb", "y", "chunk", "derived").distinct())
    if not rows:
        empty = calls.select("qid", "call", *(F.lit(None).cast(k).alias(n) for n, k in (("statement", "string"), ("chunk_id", "string"), ("provenance", "array<string>"), ("n_chunks", "bigint"), ("text", "string"), ("derived", "boolean"))))
        return empty.where("false"), _reported(calls, graph.edges, found)
    said = _worded(reduce(DataFrame.unionByName, rows), graph.nodes, labels, strict)
    place = cut(said.select("s", F.posexplode("edges").alias("i", "e")).select("s", "i", "e.verb", "e.x", "e.y", F.explode("e.kinds.kind").alias("kind")))
    met = []
    for t, legs in each.items():
        of = steps.where(F.col("template") == t).select("pid", "call", "a")
        for j, p in enumerate(legs):
            at = place.where(F.col("kind") == _KINDS[t, j])
            if p.links is None:
                met.append(join_sized(at.withColumn("a", F.col(p.anchor)), of, ["a"]).select("pid", "call", "s", "i", "kind"))
            else:
                via = join_sized(p.links.withColumnRenamed("anchor", "a"), of, ["a"]).select("pid", "call", F.col("o").alias("y"))
                met.append(at.join(via, "y").select("pid", "call", "s", "i", "kind"))
    if found is not None:
        of = steps.where(F.col("template") == "path_between").select("pid", "call", "a", "b").join(hops, ["a", "b"])
        met.append(place.where(F.col("kind") == _KINDS["path_between", 0]).join(of, ["x", "verb", "y"]).select("pid", "call", "s", "i", "kind"))
    # all that follows is of one sentence: rows move once
    at = reduce(DataFrame.unionByName, met).repartition("s").groupBy("s", "pid", "i").agg(F.min("call").alias("call"), F.bit_or(F.expr("shiftleft(1, kind)")).alias("kinds"))
    sets = at.groupBy("s", "pid", "call").agg(F.array_sort(F.collect_list(F.struct("i", "kinds"))).alias("legs"))
    by = sets.groupBy("s", "legs").agg(F.collect_list(F.struct("pid", "call")).alias("to"))
    reached = lambda leg_: F.filter(F.get("edges", leg_["i"])["kinds"], lambda k: leg_["kinds"].bitwiseAND(k["bit"]) != 0)
    behind = F.flatten(F.transform("legs", lambda x: F.transform(reached(x), lambda k: F.struct(k["p"].alias("p"), k["derived"].alias("derived"), F.get("edges", x["i"])["caveat"].alias("caveat")))))
    one = by.join(said, "s").select("statement", "to", F.filter(behind, lambda x: F.size(x["p"]) > 0).alias("behind")).where(F.size("behind") > 0)
    one = one.select("statement", "to", F.array_sort(F.array_distinct(F.flatten(F.transform("behind", lambda x: x["p"])))).alias("p"), F.exists("behind", lambda x: x["derived"]).alias("derived"), F.exists("behind", lambda x: x["caveat"]).alias("caveat"))
    out = _cited(one, "to", shown=shown).withColumn("to", F.explode("to")).select("*", "to.pid", "to.call")
    out = out.join(F.broadcast(asked) if small_enough(asked) else asked, "pid")
    return out.select("qid", "call", "statement", "chunk_id", "provenance", "n_chunks", "text", "derived"), _reported(calls, graph.edges, found)


def _worded(rows: DataFrame, names: DataFrame, labels: DataFrame, strict: bool) -> DataFrame:
    """kind, x, verb, y, chunk, derived -> ``s, statement, edges(verb, x, y, caveat, kinds(kind, bit, p, derived))``, each sentence once.

    p has the chunks behind a leg that have a label, and their labels; a chunk without one is an error if ``strict``.
    """
    one = join_sized(rows, labels.select(F.col("chunk_id").alias("chunk"), F.col("citation_label").alias("label")), ["chunk"], "left")
    if strict:
        one = one.withColumn("label", F.coalesce("label", F.raise_error(F.concat(F.lit("no label for "), F.col("chunk"))).cast("string")))
    has = F.col("label").isNotNull()
    legs = one.groupBy("kind", "verb", "x", "y").agg(F.collect_set(F.when(has, F.struct("chunk", "label"))).alias("p"), F.max(F.col("derived") & has).alias("derived"))
    edges = legs.groupBy("verb", "x", "y").agg(F.collect_list(F.struct("kind", F.expr("shiftleft(1, kind)").alias("bit"), "p", "derived")).alias("kinds"))
    d = names.select("name", F.coalesce("display", "name").alias("d"))
    edges = join_sized(join_sized(edges, d.select(F.col("name").alias("x"), F.col("d").alias("dx")), ["x"]), d.select(F.col("name").alias("y"), F.col("d").alias("dy")), ["y"])
    s = edges.groupBy(F.concat("dx", "verb", "dy", F.lit(".")).alias("statement")).agg(F.collect_list(F.struct("verb", "x", "y", _caveat("dx", "dy").alias("caveat"), "kinds")).alias("edges"))
    return cut(s.withColumn("s", F.monotonically_increasing_id()))


def cover(plans: DataFrame) -> DataFrame:
    """plans(qid, template, edges): whether the template covers any of the declared edge types."""
    covered = F.create_map(*[x for t, (_, e) in TEMPLATES.items() for x in (F.lit(t), F.array(*map(F.lit, e)).cast("array<string>"))])
    return plans.withColumn("hit", F.arrays_overlap(covered[F.col("template")], "edges"))


def provenance(calls: DataFrame, edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """calls(qid, call, template, a) -> distinct ``qid, call, chunk``: every chunk behind the rows of a call with one anchor.

    With ``within(qid, chunk)`` only a question's chunks that are in it, and a null chunk for every call with any at
    all: legs are then looked up by the chunks asked for, and what else hubs have behind them is never listed.
    """
    found = [calls.select("qid", "call", F.lit(None).cast("string").alias("chunk")).where("false")]
    for template in called(calls.where(F.col("template").isin(*ANCHORS))):
        asked = calls.where(F.col("template") == template).select("qid", "call", "a")
        legs = parts(edges, template)
        if within is not None:
            some = reduce(DataFrame.unionByName, (legs[0].rows.select(F.col(p.anchor).alias("a")) for p in (legs if template == "cross_regulation" else legs[:1]))).distinct()
            found.append(asked.join(some, "a", "left_semi").select("qid", "call", F.lit(None).cast("string").alias("chunk")))
            asked = cut(asked.join(within.select("qid", "chunk").distinct(), "qid"))
        on = ["a", "chunk"] if within is not None else ["a"]
        for p in legs:
            rows = p.rows.select(F.col(p.anchor or "y").alias("a" if p.anchor else "o"), "chunk").distinct()
            if p.links is None:
                found.append(rows.join(asked, on).select("qid", "call", "chunk"))
            elif within is None:
                found.append(p.links.withColumnRenamed("anchor", "a").join(asked, "a").join(rows, "o").select("qid", "call", "chunk"))
            else:
                found.append(rows.join(asked, "chunk").join(p.links.withColumnRenamed("anchor", "a"), ["a", "o"], "left_semi").select("qid", "call", "chunk"))
    return reduce(DataFrame.unionByName, found).distinct()


EDGE_KEY = ("type", "head", "tail", "source_chunk_id")


def merge(old: DataFrame, new: DataFrame, key: tuple[str, ...], order: str | None = None) -> DataFrame:
    """Merge rows on a key: each column takes its last known value, new rows after old ones, among them by ``order``.

    A null in a new row keeps what was known. Rows that tie in everything but their values are settled by the values,
    so the result repeats.
    """
    rest = [c for c in old.columns if c not in key]
    at = F.struct(F.col("_n"), F.col(order) if order else F.lit(0), F.to_json(F.struct(*rest)))
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    return both.groupBy(*key).agg(*(F.max_by(c, F.struct(F.col(c).isNotNull().alias("k"), at.alias("at"))).alias(c) for c in rest)).select(*old.columns)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(old, new, EDGE_KEY)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge on the canonical name; a type outside the closed list is an error."""
    kind = F.when(F.col("type").isin(*TYPE_PRIORITY), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("no such type: "), F.coalesce("type", F.lit("null")))).cast("string"))
    return merge(old, new.withColumn("type", kind), ("canonical_name",))


def key_violations(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys with a null part or held by several rows: ``key..., n``."""
    null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in key))
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)
