"""Queries over the property graph: build, checks, templates, statements, linking and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.text import ABBREVIATIONS, name_keys
from quillgraph.operators import graph as G
from quillgraph.operators import resolve as R
from quillgraph.operators import route as W
from quillgraph.operators import scores as S
from quillgraph.plans.runtime import cut, join_sized, table, wide
from quillgraph.schemas import ANCHOR_TYPES, AUTHORITY_WORDS, ENDPOINTS, INTERACTING, TERM_TYPES, TYPE_PRIORITY


def _graph(spark, d):
    return G.build(table(spark, d, "relationships"), table(spark, d, "graph_nodes"))


def _edges(spark, d):
    """Edges with derived bridges, written once: every template reads them more than once."""
    return _bridged(_graph(spark, d)).edges


def _bridged(g):
    e = cut(g.edges)
    return G.Graph(g.nodes, e.unionByName(G.bridges(e)), g.skipped)


def _joined(c):
    return F.array_join(c, ",")


def graph_edges(spark, d):
    return _graph(spark, d).edges.select("type", "head", "tail", "source_chunk_id", F.round("confidence", 6).alias("confidence"), "violation")


def skipped_edges(spark, d):
    return _graph(spark, d).skipped.distinct()


def graph_bridges(spark, d):
    return G.bridges(_graph(spark, d).edges).select("head", "tail", "source_chunk_id")


def graph_stats(spark, d):
    """Edges, violations and derived ones per type."""
    return _edges(spark, d).groupBy("type").agg(F.count("*").alias("n_edges"), F.count_if("violation").alias("n_violations"), F.count_if("derived").alias("n_derived"))


def isolated_nodes(spark, d):
    g = _graph(spark, d)
    return G.isolated(g.nodes, g.edges).select("name", "type")


def component_sizes(spark, d):
    return G.components(_graph(spark, d).edges).groupBy("component").agg(F.count("*").alias("n"))


def roles(spark, d):
    r = G.obligations_for_role(_edges(spark, d))
    return r.select("r", "o", "a", F.size("applies_chunks").alias("n_applies"), F.size("imposes_chunks").alias("n_imposes"), F.col("applies_chunks")[0].alias("first_applies"))


def systems(spark, d):
    r = G.obligations_for_system(_edges(spark, d))
    return r.select("s", "rc", "o", "a", F.size("classified_chunks").alias("n_classified"), F.size("applies_chunks").alias("n_applies"), F.size("imposes_chunks").alias("n_imposes"))


def enforcement(spark, d):
    r = G.enforcement_chain(_edges(spark, d))
    return r.select("o", "auth", "p", F.size("enforced_chunks").alias("n_enforced"), F.size("penalty_chunks").alias("n_penalty"))


def definitions(spark, d):
    return G.definition_of(_edges(spark, d)).select("t", "a", _joined("defined_chunks").alias("chunks"))


def interactions(spark, d):
    r = G.cross_regulation(_edges(spark, d))
    return r.select("a", "b", F.size("provenance").alias("n"), F.size(F.filter("provenance", lambda x: x["outbound"])).alias("n_out"), F.size(F.filter("provenance", lambda x: x["derived"])).alias("n_derived"))


def paths(spark, d):
    """Shortest paths from every lawful basis to every risk category in reach, derived bridges included."""
    n = table(spark, d, "graph_nodes")
    a = n.where(F.col("type") == "LawfulBasis").select(F.col("canonical_name").alias("a"))
    b = n.where(F.col("type") == "RiskCategory").select(F.col("canonical_name").alias("n"))
    p = join_sized(G.reach(_edges(spark, d), a), b, ["n"])
    legs = lambda f: F.array_join(F.transform("legs", lambda x: x[f].cast("string")), ",")
    return p.select("a", F.col("n").alias("b"), "hops", F.array_join("nodes", " > ").alias("path"), legs("chunk").alias("chunks"), legs("type").alias("types"), legs("derived").alias("derived"))


def definition_statements(spark, d):
    g = _graph(spark, d)
    return G.statements(G.definition_of(g.edges), "definition_of", g.nodes, table(spark, d, "chunks"), strict=False).select("statement", "chunk_id", "n_chunks", "text")


def _told(template):
    """A query of one template's sentences, over all its rows."""

    def run(spark, d):
        g = _bridged(_graph(spark, d))
        return G.render(G.told_alone(g.edges, template), g.nodes, table(spark, d, "chunks"), strict=False).select("statement", "chunk_id", "n_chunks", "text", "derived")

    return run


def _asked(spark, d):
    """The stated question set: typed spans, whose id is divisible by 20, in a question about them."""
    return _spans(spark, d).where(F.col("qid") % 20 == 0)


def _plans(spark, d):
    q = _asked(spark, d)
    return W.select_templates(q, cut(W.link(q, table(spark, d, "graph_nodes"))))


def _search(spark, d):
    return G.search(W.plan_calls(_plans(spark, d)), _bridged(_graph(spark, d)), table(spark, d, "chunks"), strict=False)


def graph_search(spark, d):
    """Plans of questions run over the graph and told as sentences, each at the first call that reaches it."""
    return _search(spark, d)[0].select("qid", "call", "statement", "chunk_id", "n_chunks", "text", "derived")


def graph_search_calls(spark, d):
    """Calls per template, those the graph has nothing for, and the rows returned."""
    r = G.report(W.plan_calls(_plans(spark, d)), _bridged(_graph(spark, d)).edges)
    return r.groupBy("template").agg(F.count("*").alias("calls"), F.count_if(F.col("n_rows") == 0).alias("empty_calls"), F.sum("n_rows").alias("n_rows"))


def _gold_names(spark, d):
    """The stated questions with the names an earlier linker recorded for them."""
    return table(spark, d, "linked_spans").where((F.col("span_id") % 20 == 0) & F.col("canonical_name").isNotNull()).select(F.col("span_id").alias("qid"), F.col("canonical_name").alias("name")).distinct()


def linker_board(spark, d):
    """Linker against the recorded names, with all links and with unambiguous ones, per recorded type and in all."""
    q = _asked(spark, d)
    n = table(spark, d, "graph_nodes").select(F.col("canonical_name").alias("name"), F.col("type").alias("stratum"))
    strata = join_sized(_gold_names(spark, d), n, ["name"], "left").groupBy("qid").agg(F.min(F.coalesce("stratum", F.lit("(none)"))).alias("stratum"))
    links = cut(W.link(q, table(spark, d, "graph_nodes")).select("qid", "name", "ambiguous"))
    return S.linker_board(strata, links, _gold_names(spark, d))


def selector_board(spark, d):
    """Rule-based plans against the chunks that mention the recorded names, the oracle of single calls beside them."""
    edges = cut(_bridged(_graph(spark, d)).edges)
    calls = cut(W.plan_calls(_plans(spark, d)))
    nodes = table(spark, d, "graph_nodes")
    named = _gold_names(spark, d)
    gold = cut(join_sized(named, nodes.select(F.col("canonical_name").alias("name"), F.explode("chunk_ids").alias("chunk")), ["name"]).select("qid", "chunk").distinct())
    offers = join_sized(named, nodes.select(F.col("canonical_name").alias("name"), "type"), ["name"])
    return S.selector_board(calls, G.provenance(calls, edges, gold), G.provenance(cut(W.single_calls(offers)), edges, gold), gold)


def type_votes(spark, d):
    return R.type_votes(_mentions(spark, d))


def _mentions(spark, d):
    """What users typed for entities, each span once, with the type they hinted at."""
    s = table(spark, d, "linked_spans").where(F.col("span").isNotNull()).groupBy("span_id").agg(F.min(F.struct(F.col("span").alias("raw"), "type", F.col("question_id").alias("chunk_id"))).alias("s"))
    return R.mentions_of(s.select("s.*"))


def reconciled_types(spark, d):
    return R.reconcile(R.type_votes(_mentions(spark, d)))


def resolved_nodes(spark, d):
    m = _mentions(spark, d)
    return R.build_nodes(m, R.reconcile(R.type_votes(m)).select("key", "type"))


def node_aliases(spark, d):
    return R.node_aliases(_mentions(spark, d))


def display_names(spark, d):
    return R.display_name(_mentions(spark, d))


def plurals(spark, d):
    names = table(spark, d, "linked_spans").select("span"), table(spark, d, "graph_nodes").select("canonical_name")
    return R.plural_map(name_keys(*names).where("key <> ''"))


def _chunk_entities(spark, d):
    """Entities a chunk names, by normalised name."""
    e = table(spark, d, "chunks").select("chunk_id", F.explode("entity_ids").alias("raw"))
    return join_sized(e, name_keys(e.select("raw")), ["raw"]).select("chunk_id", "key").distinct()


def chunk_gaps(spark, d):
    """Per kind of gap and regulation: ends of relations their chunk does not name, and named entities without relation."""
    r = table(spark, d, "relationships").where(F.col("source_chunk_id").isNotNull())
    ends = r.select(F.col("source_chunk_id").alias("chunk_id"), F.explode(F.array("head", "tail")).alias("raw"))
    keyed = join_sized(ends.where(F.col("raw").isNotNull()).distinct(), name_keys(ends.select("raw")), ["raw"])
    gaps = R.chunk_gaps(_chunk_entities(spark, d), keyed.select("chunk_id", F.col("key").alias("head"), F.lit(None).cast("string").alias("tail")))
    return gaps.groupBy("gap", F.regexp_extract("chunk_id", "^[a-z0-9]+", 0).alias("regulation")).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_chunks"))


def granularity_misses(spark, d):
    return R.granularity_misses(_chunk_entities(spark, d), table(spark, d, "chunks"))


def edge_key_violations(spark, d):
    """Extracted edges whose key has a null part or several rows, by edge type."""
    return G.key_violations(table(spark, d, "relationships"), G.EDGE_KEY).groupBy("type").agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))


def confidence_levels(spark, d):
    return R.confidence_histogram(table(spark, d, "relationships"))


def _questions(spark, d):
    return table(spark, d, "answers").select(F.col("answer_id").alias("qid"), "question").distinct()


def _spans(spark, d):
    """Typed spans as questions about an entity, and the questions of answers."""
    s = table(spark, d, "linked_spans").where(F.col("span").isNotNull()).groupBy("span_id").agg(F.min("span").alias("span"))
    return s.select(F.col("span_id").alias("qid"), F.concat(F.lit("What must "), "span", F.lit(" do under the GDPR, and who enforces it?")).alias("question"))


def linked_entities(spark, d):
    return W.link(_spans(spark, d), table(spark, d, "graph_nodes")).select("qid", "span", "name", "via", "ambiguous")


def routes(spark, d):
    q = _spans(spark, d).unionByName(_questions(spark, d).withColumn("qid", -F.col("qid") - 1))
    return W.route(q, cut(W.link(q, table(spark, d, "graph_nodes"))))


def template_plans(spark, d):
    q = _spans(spark, d)
    return W.plan_text(W.select_templates(q, cut(W.link(q, table(spark, d, "graph_nodes")))))


def question_shapes(spark, d):
    q = F.col("question")
    return _questions(spark, d).select("qid", q.rlike(W.ENUMERATIVE).alias("enumerative"), q.rlike(W.SECOND_ASK).alias("second_ask"), q.rlike(W.ENUMERATES).alias("enumerates"), q.rlike(W.ENUMERATES_WIDE).alias("enumerates_wide"), q.rlike(W.DEFINITIONAL).alias("definitional"), q.rlike(W.CROSS_INSTRUMENT).alias("cross_instrument"), W.enumeration_target(q).alias("target"))


def unlinked_ends(spark, d):
    """Names of edge ends that resolve to no node, with their uses."""
    r = table(spark, d, "relationships").select(F.explode(F.array("head", "tail")).alias("raw")).where(F.col("raw").isNotNull()).groupBy("raw").agg(F.count("*").alias("n"))
    return join_sized(r, G.resolve_names(r.select("raw"), table(spark, d, "graph_nodes")), ["raw"]).where(F.col("name").isNull()).select("raw", "n")


def _nk(x: str) -> str:
    return f"""trim(regexp_replace(regexp_replace(lower({x}), '["''`‘’“”]', '', 'g'), '[ \\t\\n\\r\\f\\x0B\\-\\x{{2010}}-\\x{{2015}}]+', ' ', 'g'), ' .,;:')"""


def _in(c: str, names: str) -> str:
    return f"{c} IN ({', '.join(repr(x) for x in names.split())})"


def _lone(b: str, other: str, side: str) -> str:
    """One outer bracket without a partner taken off."""
    return f"CASE WHEN {side}(k, 1) = '{b}' AND length(replace(k, '{b}', '')) < length(replace(k, '{other}', '')) THEN trim({'left(k, -1)' if side == 'right' else 'right(k, -1)'}, ' .,;:') ELSE k END"


def _spell(names: str) -> str:
    """CTEs ending in spell(raw, k): the normalised keys of names."""
    base = """trim(trim(regexp_replace(regexp_replace(lower(strip_accents(raw)), '["''`‘’“”]', '', 'g'), '[\\s\\x0B\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\-\\x{2010}-\\x{2015}]+', ' ', 'g')), ' .,;:')"""
    for b, other, side in ((")", "(", "right"), ("]", "[", "right"), ("(", ")", "left"), ("[", "]", "left")):
        base = f"{_lone(b, other, side)} AS k FROM (SELECT raw, {base}" + ("" if "AS k" in base else " AS k")
    short = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ABBREVIATIONS.items())
    return f"spell AS (SELECT raw, CASE k {short} ELSE k END AS k FROM (SELECT raw, {base} FROM (SELECT DISTINCT raw FROM ({names}) WHERE raw IS NOT NULL)))))))"


_OK = "CASE r.type " + " ".join(f"WHEN '{t}' THEN {_in('head_type', h)} AND {_in('tail_type', x)}" for t, (h, x) in ENDPOINTS.items()) + " ELSE true END"
_BASE = f"""{_spell("SELECT head AS raw FROM relationships UNION ALL SELECT tail FROM relationships UNION ALL SELECT canonical_name FROM graph_nodes UNION ALL SELECT unnest(aliases) FROM graph_nodes")},
keys AS (SELECT k AS key, min((r, name, type)) AS b FROM (SELECT canonical_name AS raw, 0 AS r, canonical_name AS name, type FROM graph_nodes
 UNION ALL SELECT unnest(aliases), 1, canonical_name, type FROM graph_nodes) JOIN spell USING (raw) GROUP BY k),
known AS (SELECT raw, b[2] AS name, b[3] AS type FROM spell JOIN keys ON key = k),
res AS (SELECT rel_id, r.type, head, tail, source_chunk_id, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence, loaded_at, h.name AS hn, h.type AS head_type, t.name AS tn, t.type AS tail_type FROM relationships r LEFT JOIN known h ON h.raw = r.head LEFT JOIN known t ON t.raw = r.tail),
e0 AS (SELECT type, hn AS head, tn AS tail, source_chunk_id, arg_max(confidence, (loaded_at, rel_id)) FILTER (confidence IS NOT NULL) AS confidence, any_value(head_type) AS head_type, any_value(tail_type) AS tail_type FROM res WHERE hn IS NOT NULL AND tn IS NOT NULL AND source_chunk_id IS NOT NULL GROUP BY ALL),
edges AS (SELECT r.*, NOT ({_OK}) AS violation FROM e0 r),
pre AS (SELECT *, nullif(regexp_extract(head, '^(aia|gdpr|led|eudpr)\\b', 1), '') AS hp, nullif(regexp_extract(tail, '^(aia|gdpr|led|eudpr)\\b', 1), '') AS tp FROM edges),
bridges AS (SELECT head, tail, source_chunk_id, head_type, tail_type FROM pre WHERE type = 'REFERENCES' AND head_type IN ('Article', 'Annex') AND tail_type IN ('Article', 'Annex') AND hp <> tp AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.type = 'INTERACTS_WITH' AND x.head = pre.head AND x.tail = pre.tail AND x.source_chunk_id = pre.source_chunk_id)),
ge AS (SELECT type, head, tail, source_chunk_id, head_type, tail_type, violation, false AS derived FROM edges UNION ALL SELECT 'INTERACTS_WITH', head, tail, source_chunk_id, head_type, tail_type, false, true FROM bridges)"""


def _leg(name: str, edge: str, h: str, t: str, where: str = "true") -> str:
    return f"{name} AS (SELECT head AS {h}, tail AS {t}, list_sort(list(DISTINCT source_chunk_id)) AS c FROM ge WHERE type = '{edge}' AND {where} GROUP BY ALL)"


def _plural_sql(keys: str) -> str:
    return f"""WITH n AS ({keys}), t AS (SELECT key, 0 AS r, left(key, length(key) - 1) AS s FROM n WHERE key LIKE '%s' UNION ALL SELECT key, 1, left(key, length(key) - 3) || 'y' FROM n WHERE key LIKE '%ies' UNION ALL SELECT key, 2, left(key, length(key) - 2) FROM n WHERE key LIKE '%es')
SELECT t.key AS plural, arg_min(s, r) AS singular FROM t JOIN n ON n.key = s WHERE s <> '' GROUP BY t.key"""


_TYPED = "SELECT span_id, min({'raw': span, 'type': type, 'chunk_id': question_id}) AS s FROM linked_spans WHERE span IS NOT NULL GROUP BY span_id"
_MENTIONS = f"""typed AS ({_TYPED}), {_spell("SELECT s.raw AS raw FROM typed")}, singular AS ({_plural_sql("SELECT DISTINCT k AS key FROM spell WHERE k <> ''")}),
m AS (SELECT coalesce(singular.singular, k) AS key, raw, s.type AS type, s.chunk_id AS chunk_id FROM (SELECT s, s.raw AS raw FROM typed) JOIN spell USING (raw) LEFT JOIN singular ON plural = k WHERE k <> ''),
votes AS (SELECT key, type, count(*) AS n FROM m WHERE type IS NOT NULL GROUP BY ALL)"""
_PRIO = "CASE type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TYPE_PRIORITY, 1)) + " ELSE 99 END"
_REC = f"""{_MENTIONS}, tot AS (SELECT key, sum(n) AS total, coalesce(sum(n) FILTER (type = 'DefinedTerm'), 0) AS loose, count(*) AS kinds FROM votes GROUP BY key),
cand AS (SELECT v.*, kinds, {_PRIO} AS prio FROM votes v JOIN tot USING (key) WHERE loose = total OR 2 * loose > total OR type <> 'DefinedTerm'),
top AS (SELECT key, max(n) AS best, count(*) AS nc FROM cand GROUP BY key), lead AS (SELECT cand.*, nc FROM cand JOIN top ON top.key = cand.key AND n = best),
agg AS (SELECT key, count(*) AS nl, any_value(nc) AS nc, any_value(kinds) AS kinds, any_value(type) AS one, bool_or(type = 'Authority') AND regexp_matches(key, '{AUTHORITY_WORDS}') AS hinted, arg_min(type, (prio, type)) AS first FROM lead GROUP BY key),
rec AS (SELECT key, CASE WHEN nl = 1 THEN one WHEN hinted THEN 'Authority' ELSE first END AS type, CASE WHEN kinds = 1 THEN 'single' WHEN nl = 1 THEN CASE WHEN nc > 1 THEN 'majority' ELSE 'only' END WHEN hinted THEN 'tie, authority' ELSE 'tie, priority' END AS rule FROM agg)"""
_Q = "q AS (SELECT DISTINCT answer_id AS qid, question FROM answers)"
_NEAR = "near AS (SELECT x, y, min((c, type, derived)) AS leg FROM (SELECT head AS x, tail AS y, source_chunk_id AS c, type, derived FROM ge UNION ALL SELECT tail, head, source_chunk_id, type, derived FROM ge) WHERE x <> y GROUP BY x, y)"


def _hop(i: int) -> str:
    seen = " UNION ALL ".join(f"SELECT a, n FROM f{j}" for j in range(i))
    return f"f{i} AS (SELECT a, n, {i} AS hops, m[1] AS nodes, m[2] AS legs FROM (SELECT a, y AS n, min((list_append(nodes, y), list_append(legs, leg))) AS m FROM f{i - 1} JOIN near ON x = n GROUP BY a, y) s WHERE NOT EXISTS (SELECT 1 FROM ({seen}) z WHERE z.a = s.a AND z.n = s.n))"


def _sentences(source: str, by: str = "") -> str:
    """source(by..., x, verb, y, c, derived) as sentences; chunks without a label are left out."""
    b = f"{by}, " if by else ""
    return f"""sl AS (SELECT {b}dx.display_name || verb || dy.display_name || '.' AS statement, c, citation_label AS l, derived, regexp_matches(lower(dx.display_name), '\\bannex\\s+(viii|xi)\\b') OR regexp_matches(lower(dy.display_name), '\\bannex\\s+(viii|xi)\\b') AS v
 FROM ({source}) JOIN chunks ON chunk_id = c JOIN graph_nodes dx ON dx.canonical_name = x JOIN graph_nodes dy ON dy.canonical_name = y),
sg AS (SELECT {b}statement, list_sort(list(DISTINCT {{'c': c, 'l': l}})) AS p, bool_or(v) AS v, bool_or(derived) AS derived FROM sl GROUP BY {b}statement),
told AS (SELECT {b}statement, p[1].c AS chunk_id, len(p) AS n_chunks, statement || ' (' || array_to_string(list_transform(p[1:3], lambda x: x.l), ', ') || CASE WHEN len(p) > 3 THEN ', +' || (len(p) - 3) || ' more' ELSE '' END || ')' || CASE WHEN v THEN ' [unverified annex section]' ELSE '' END AS text, derived FROM sg)"""


_ROLE_LEGS = _leg("ap", "APPLIES_TO", "o", "r", "head_type = 'Obligation' AND tail_type = 'ActorRole'") + ", " + _leg("im", "IMPOSES", "a", "o", "head_type = 'Article' AND tail_type = 'Obligation'")
_SYSTEM_LEGS = _leg("sca", "CLASSIFIED_AS", "s", "rc", "head_type = 'SystemType' AND tail_type = 'RiskCategory'") + ", " + _leg("sap", "APPLIES_TO", "o", "s", "head_type = 'Obligation'") + ", " + _leg("sim", "IMPOSES", "a", "o")
_ENFORCE_LEGS = _leg("en", "ENFORCED_BY", "o", "auth", "head_type = 'Obligation' AND tail_type = 'Authority'") + ", " + _leg("pu", "PENALIZED_UNDER", "o", "p", "tail_type = 'Article'")
_DEFINE_LEGS = _leg("df", "DEFINED_IN", "t", "a", "tail_type IN ('Article', 'Annex')")
_INTERACT = "ix AS (SELECT head AS a, tail AS b, source_chunk_id AS c, derived, true AS o FROM ge WHERE type = 'INTERACTS_WITH' UNION SELECT tail, head, source_chunk_id, derived, false FROM ge WHERE type = 'INTERACTS_WITH' AND head <> tail)"
#: Per template: its legs as anchor, x, verb, y, c, derived, from the CTEs above.
_TOLD_SQL = {
    "obligations_for_role": "SELECT r AS anchor, o AS x, ' applies to ' AS verb, r AS y, unnest(ap.c) AS c, false AS derived FROM ap JOIN im USING (o) UNION SELECT r, a, ' imposes: ', o, unnest(im.c), false FROM ap JOIN im USING (o)",
    "obligations_for_system": "SELECT s AS anchor, s AS x, ' is classified as ' AS verb, rc AS y, unnest(c) AS c, false AS derived FROM sca UNION SELECT s, o, ' applies to ', s, unnest(sap.c), false FROM sap JOIN sim USING (o) WHERE s IN (SELECT s FROM sca) UNION SELECT s, a, ' imposes: ', o, unnest(sim.c), false FROM sap JOIN sim USING (o) WHERE s IN (SELECT s FROM sca)",
    "enforcement_chain": "SELECT o AS anchor, o AS x, ' is enforced by ' AS verb, auth AS y, unnest(c) AS c, false AS derived FROM en UNION SELECT o, o, ' is penalised under ', p, unnest(pu.c), false FROM pu WHERE o IN (SELECT o FROM en)",
    "definition_of": "SELECT t AS anchor, t AS x, ' is defined in ' AS verb, a AS y, unnest(c) AS c, false AS derived FROM df",
    "cross_regulation": "SELECT a AS anchor, CASE WHEN o THEN a ELSE b END AS x, ' interacts with ' AS verb, CASE WHEN o THEN b ELSE a END AS y, c, derived FROM ix",
}
_ALL_LEGS = f"{_ROLE_LEGS}, {_SYSTEM_LEGS}, {_ENFORCE_LEGS}, {_DEFINE_LEGS}, {_INTERACT}"


_SPANS = "SELECT span_id AS qid, 'What must ' || min(span) || ' do under the GDPR, and who enforces it?' AS question FROM linked_spans WHERE span IS NOT NULL GROUP BY span_id"


def _link(questions: str) -> str:
    """CTEs ending in ln(qid, at, span, name, via, ambiguous, type): every span of every question, the leftmost longest kept step by step."""
    return f"""qs AS ({questions}),
plain AS (SELECT {_nk("canonical_name")} AS surface, canonical_name AS name, 0 AS r FROM graph_nodes UNION ALL SELECT {_nk("a")}, name, 2 FROM (SELECT unnest(aliases) AS a, canonical_name AS name FROM graph_nodes)),
fold AS ({_plural_sql("SELECT DISTINCT surface AS key FROM plain")}),
every AS (SELECT * FROM plain UNION ALL SELECT plural, name, r + 1 FROM fold JOIN plain ON surface = singular),
surf AS (SELECT surface, min((r, names)) AS best FROM (SELECT surface, r, list_sort(list(DISTINCT name)) AS names FROM every WHERE surface <> '' GROUP BY surface, r) GROUP BY surface),
most AS (SELECT max(len(string_split(surface, ' '))) AS n FROM surf),
qw AS (SELECT qid, list_filter(regexp_split_to_array(regexp_replace(question, '[?!]', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM qs),
starts AS (SELECT qid, w, unnest(range(0, len(w))) AS i FROM qw),
cuts AS (SELECT qid, w, i, unnest(range(1, least((SELECT n FROM most) + 2, len(w) - i) + 1)) AS len FROM starts),
typed AS (SELECT qid, i, len, array_to_string(w[i + 1:i + len], ' ') AS span FROM cuts),
forms AS (SELECT qid, i, len, span, 0 AS form, {_nk("span")} AS surface FROM typed UNION ALL SELECT qid, i, len, span, 1, {_nk("regexp_replace(span, '[''’]s$|[''’]$', '')")} FROM typed WHERE len = 1 AND regexp_matches(span, '[''’]s$|[''’]$')),
hits AS (SELECT qid, i, len, min((form, best[1], best[2], span)) AS h FROM forms JOIN surf USING (surface) GROUP BY ALL),
walk AS (SELECT qid, i, len, h, i + len AS upto FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY i, len DESC) = 1
 UNION ALL (SELECT n.qid, n.i, n.len, n.h, n.i + n.len FROM walk JOIN hits n ON n.qid = walk.qid AND n.i >= walk.upto QUALIFY row_number() OVER (PARTITION BY n.qid ORDER BY n.i, n.len DESC) = 1)),
ea AS (SELECT qid, i, h[4] AS span, CASE WHEN h[2] < 2 THEN 'canonical' ELSE 'alias' END AS via, len(h[3]) > 1 AS ambiguous, unnest(h[3]) AS name FROM walk),
ln AS (SELECT qid, name, m[1] AS i, m[2] AS span, m[3] AS via, m[4] AS ambiguous, type FROM (SELECT qid, name, min((i, span, via, ambiguous)) AS m FROM ea GROUP BY qid, name) JOIN graph_nodes ON canonical_name = name)"""


def _first_of(types) -> str:
    return f"(SELECT arg_min(name, (i, name)) FROM ln WHERE ln.qid = qs.qid AND type IN ({', '.join(map(repr, types))}))"


_ANCHORED = ", ".join(map(repr, ANCHOR_TYPES))
_ROUTE = f"""kinds AS (SELECT qid, bool_or(type IN ({_ANCHORED})) AS anchored, bool_or(type = 'ActorRole') AS actor FROM ln GROUP BY qid),
x AS (SELECT qs.*, anchored, actor, lower(question) AS l, regexp_matches(question, '{W.ENUMERATIVE}') AS en, regexp_matches(question, '{W.SECOND_ASK}') AS se, regexp_matches(question, '{W.PRONOUN_TAIL}') AS pt, regexp_matches(question, '{W.ENUMERATES}') AS enumerates FROM qs LEFT JOIN kinds USING (qid)),
y AS (SELECT *, CASE WHEN regexp_matches(l, '\\bgdpr\\b') THEN 'GDPR' ELSE 'AIA' END AS reg, regexp_extract(l, '\\bannex\\s+([ivx]+)\\b', 1) AS an, regexp_extract(l, '\\barticles?\\s+(\\d+)\\b', 1) AS ar FROM x),
z AS (SELECT *, CASE WHEN anchored IS NULL THEN 'R1-no-links' WHEN NOT anchored THEN 'R2-no-anchor' WHEN en AND NOT se AND actor THEN 'R3-enumerate-role' WHEN se AND NOT pt THEN 'R4-second-ask' ELSE 'R5-default' END AS rule FROM y)"""
_CALLS = f"""fo AS (SELECT qs.qid, regexp_matches(question, '{W.DEFINITIONAL}') AS d, regexp_matches(question, '{W.CROSS_INSTRUMENT}') AS c, {_first_of(TERM_TYPES)} AS t, {_first_of(("Obligation",))} AS o, {_first_of(INTERACTING)} AS i, {_first_of(("ActorRole",))} AS r, {_first_of(("SystemType",))} AS s,
 (SELECT list(name ORDER BY i, name) FROM ln WHERE ln.qid = qs.qid) AS names FROM qs),
ruled AS (SELECT qid, names, list_filter([CASE WHEN d AND t IS NOT NULL THEN {{'template': 'definition_of', 'a': t, 'b': NULL::VARCHAR, 'rule': 'S1-definitional'}} END, CASE WHEN o IS NOT NULL THEN {{'template': 'enforcement_chain', 'a': o, 'b': NULL::VARCHAR, 'rule': 'S2-obligation'}} END, CASE WHEN c AND i IS NOT NULL THEN {{'template': 'cross_regulation', 'a': i, 'b': NULL::VARCHAR, 'rule': 'S3-cross-instrument'}} END,
 CASE WHEN r IS NOT NULL THEN {{'template': 'obligations_for_role', 'a': r, 'b': NULL::VARCHAR, 'rule': 'S4-role'}} END, CASE WHEN s IS NOT NULL THEN {{'template': 'obligations_for_system', 'a': s, 'b': NULL::VARCHAR, 'rule': 'S5-system'}} END], lambda k: k IS NOT NULL)[1:3] AS calls FROM fo),
planned AS (SELECT qid, CASE WHEN len(calls) > 0 THEN calls WHEN len(names) >= 2 THEN [{{'template': 'path_between', 'a': names[1], 'b': names[2], 'rule': 'S6-bridge'}}] ELSE [] END AS calls FROM ruled)"""
_BY_20 = f"SELECT * FROM ({_SPANS}) WHERE qid % 20 = 0"
_ANSWERED = f"SELECT * FROM ({_SPANS}) UNION ALL SELECT DISTINCT -answer_id - 1, question FROM answers"
_CALL_ROWS = "calls AS (SELECT qid, generate_subscripts(calls, 1) - 1 AS call, unnest(calls) AS k FROM planned)"
_BRIDGE_PATHS = f"""ends AS (SELECT DISTINCT k.a AS a, k.b AS b FROM calls WHERE k.template = 'path_between'), f0 AS (SELECT DISTINCT a, a AS n, 0 AS hops, [a] AS nodes, CAST([] AS STRUCT(c VARCHAR, t VARCHAR, d BOOLEAN)[]) AS legs FROM ends), {", ".join(_hop(i).replace("list_append(legs, leg)", "list_append(legs, {'c': leg[1], 't': leg[2], 'd': leg[3]})") for i in range(1, 5))},
pa AS (SELECT a, b, nodes, legs FROM ends JOIN ({" UNION ALL ".join(f"SELECT a, n, nodes, legs FROM f{i}" for i in range(5))}) f USING (a) WHERE n = b)"""
_PATH_LEGS = "SELECT qid, call, nodes[i] AS x, ' ' || lower(replace(legs[i].t, '_', ' ')) || ' ' AS verb, nodes[i + 1] AS y, legs[i].c AS c, legs[i].d AS derived FROM (SELECT qid, call, nodes, legs, unnest(range(1, len(legs) + 1)) AS i FROM calls JOIN pa ON k.template = 'path_between' AND pa.a = k.a AND pa.b = k.b)"
_SEARCHED = " UNION ALL ".join([*(f"SELECT qid, call, x, verb, y, c, derived FROM calls JOIN ({q}) t ON k.template = '{t}' AND t.anchor = k.a" for t, q in _TOLD_SQL.items()), _PATH_LEGS])
_SEARCH = f"WITH RECURSIVE {_BASE}, {_link(_BY_20)}, {_CALLS}, {_CALL_ROWS}, {_ALL_LEGS}, {_NEAR}, {_BRIDGE_PATHS}"
_ROWS_OF = {
    "obligations_for_role": "SELECT r AS a, count(*) AS n FROM ap JOIN im USING (o) GROUP BY r",
    "obligations_for_system": "SELECT s AS a, count(*) AS n FROM sca LEFT JOIN (SELECT s, sim.a FROM sap JOIN sim USING (o)) USING (s) GROUP BY s",
    "enforcement_chain": "SELECT o AS a, count(*) AS n FROM en LEFT JOIN pu USING (o) GROUP BY o",
    "definition_of": "SELECT t AS a, count(*) AS n FROM df GROUP BY t",
    "cross_regulation": "SELECT a, count(DISTINCT b) AS n FROM ix GROUP BY a",
}
_COUNTED = " UNION ALL ".join([*(f"SELECT k.template AS template, coalesce(n, 0) AS n FROM calls LEFT JOIN ({q}) t ON t.a = k.a WHERE k.template = '{t}'" for t, q in _ROWS_OF.items()), "SELECT k.template, CASE WHEN pa.a IS NULL THEN 0 ELSE 1 END FROM calls LEFT JOIN pa ON pa.a = k.a AND pa.b = k.b WHERE k.template = 'path_between'"])
_GOLD = "gold AS (SELECT DISTINCT span_id AS qid, canonical_name AS name FROM linked_spans WHERE span_id % 20 = 0 AND canonical_name IS NOT NULL)"
_FITS = " UNION ALL ".join(f"SELECT '{t}' AS template, unnest([{', '.join(map(repr, types))}]) AS type" for t, types in (("definition_of", TERM_TYPES), ("enforcement_chain", ("Obligation",)), ("cross_regulation", INTERACTING), ("obligations_for_role", ("ActorRole",)), ("obligations_for_system", ("SystemType",))))
_BEHIND = " UNION ALL ".join(f"SELECT '{t}' AS template, anchor AS a, c FROM ({q})" for t, q in _TOLD_SQL.items())

QUERIES = {
    f.__name__: f
    for f in (graph_edges, skipped_edges, graph_bridges, graph_stats, isolated_nodes, component_sizes, roles, systems, enforcement, definitions, interactions, paths, definition_statements, graph_search, graph_search_calls, linker_board, selector_board, type_votes, reconciled_types, resolved_nodes, node_aliases, display_names, plurals, chunk_gaps, granularity_misses, edge_key_violations, confidence_levels, linked_entities, routes, template_plans, question_shapes, unlinked_ends)
}
QUERIES |= {
    "role_statements": _told("obligations_for_role"),
    "system_statements": _told("obligations_for_system"),
    "enforcement_statements": _told("enforcement_chain"),
    "interaction_statements": _told("cross_regulation"),
}
for _name in ("roles", "systems", "enforcement", "interactions", "paths", "graph_search"):
    QUERIES[_name] = wide(QUERIES[_name])
ORACLE = {
    "graph_edges": f"WITH {_BASE} SELECT type, head, tail, source_chunk_id, round(confidence, 6) AS confidence, violation FROM edges",
    "skipped_edges": f"WITH {_BASE} SELECT DISTINCT rel_id, type, concat_ws('|', CASE WHEN hn IS NULL THEN head END, CASE WHEN tn IS NULL THEN tail END) AS missing FROM res WHERE hn IS NULL OR tn IS NULL",
    "graph_bridges": f"WITH {_BASE} SELECT head, tail, source_chunk_id FROM bridges",
    "graph_stats": f"WITH {_BASE} SELECT type, count(*) AS n_edges, count(*) FILTER (violation) AS n_violations, count(*) FILTER (derived) AS n_derived FROM ge GROUP BY type",
    "isolated_nodes": f"WITH {_BASE} SELECT canonical_name AS name, type FROM graph_nodes n WHERE NOT EXISTS (SELECT 1 FROM edges WHERE head = n.canonical_name OR tail = n.canonical_name)",
    "component_sizes": f"""WITH RECURSIVE {_BASE}, n AS MATERIALIZED (SELECT DISTINCT head AS x, tail AS y FROM edges UNION SELECT tail, head FROM edges UNION SELECT head, head FROM edges UNION SELECT tail, tail FROM edges),
l(name, c) USING KEY (name) AS (SELECT x, min(y) FROM n GROUP BY x UNION (SELECT n.x, min(l.c) FROM n JOIN l ON l.name = n.y JOIN recurring.l AS o ON o.name = n.x GROUP BY n.x, o.c HAVING min(l.c) < o.c)) SELECT c AS component, count(*) AS n FROM l GROUP BY c""",
    "roles": f"WITH {_BASE}, {_leg('ap', 'APPLIES_TO', 'o', 'r', chr(34) + 'head_type' + chr(34) + ' = ' + repr('Obligation') + ' AND tail_type = ' + repr('ActorRole'))}, {_leg('im', 'IMPOSES', 'a', 'o', 'head_type = ' + repr('Article') + ' AND tail_type = ' + repr('Obligation'))} SELECT r, o, a, len(ap.c) AS n_applies, len(im.c) AS n_imposes, ap.c[1] AS first_applies FROM ap JOIN im USING (o)",
    "systems": f"""WITH {_BASE}, {_leg("ca", "CLASSIFIED_AS", "s", "rc", "head_type = 'SystemType' AND tail_type = 'RiskCategory'")}, {_leg("ap", "APPLIES_TO", "o", "s", "head_type = 'Obligation'")}, {_leg("im", "IMPOSES", "a", "o")}, duty AS (SELECT s, o, a, ap.c AS c1, im.c AS c2 FROM ap JOIN im USING (o))
SELECT s, rc, o, a, len(ca.c) AS n_classified, coalesce(len(c1), 0) AS n_applies, coalesce(len(c2), 0) AS n_imposes FROM ca LEFT JOIN duty USING (s)""",
    "enforcement": f"""WITH {_BASE}, {_leg("en", "ENFORCED_BY", "o", "auth", "head_type = 'Obligation' AND tail_type = 'Authority'")}, {_leg("pu", "PENALIZED_UNDER", "o", "p", "tail_type = 'Article'")} SELECT o, auth, p, len(en.c) AS n_enforced, coalesce(len(pu.c), 0) AS n_penalty FROM en LEFT JOIN pu USING (o)""",
    "definitions": f"""WITH {_BASE}, {_leg("df", "DEFINED_IN", "t", "a", "tail_type IN ('Article', 'Annex')")} SELECT t, a, array_to_string(c, ',') AS chunks FROM df""",
    "interactions": f"""WITH {_BASE}, i AS (SELECT head AS a, tail AS b, source_chunk_id AS c, derived, true AS o FROM ge WHERE type = 'INTERACTS_WITH' UNION SELECT tail, head, source_chunk_id, derived, false FROM ge WHERE type = 'INTERACTS_WITH' AND head <> tail)
SELECT a, b, count(*) AS n, count(*) FILTER (o) AS n_out, count(*) FILTER (derived) AS n_derived FROM i GROUP BY a, b""",
    "paths": f"""WITH {_BASE}, {_NEAR}, f0 AS (SELECT canonical_name AS a, canonical_name AS n, 0 AS hops, [canonical_name] AS nodes, CAST([] AS STRUCT(c VARCHAR, t VARCHAR, d BOOLEAN)[]) AS legs FROM graph_nodes WHERE type = 'LawfulBasis'), {", ".join(_hop(i).replace("list_append(legs, leg)", "list_append(legs, {'c': leg[1], 't': leg[2], 'd': leg[3]})") for i in range(1, 5))}, f AS ({" UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(5))})
SELECT a, n AS b, CAST(hops AS BIGINT) AS hops, array_to_string(nodes, ' > ') AS path, array_to_string(list_transform(legs, lambda x: x.c), ',') AS chunks, array_to_string(list_transform(legs, lambda x: x.t), ',') AS types, array_to_string(list_transform(legs, lambda x: CAST(x.d AS VARCHAR)), ',') AS derived FROM f JOIN graph_nodes ON canonical_name = n AND type = 'RiskCategory'""",
    "definition_statements": f"WITH {_BASE}, {_DEFINE_LEGS}, {_sentences(_TOLD_SQL['definition_of'])} SELECT statement, chunk_id, n_chunks, text FROM told",
    "type_votes": f"WITH {_MENTIONS} SELECT key, type, n FROM votes",
    "reconciled_types": f"WITH {_REC} SELECT key, type, rule FROM rec",
    "resolved_nodes": f"WITH {_REC} SELECT key, any_value(rec.type) AS type, count(*) AS mentions, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT raw) FILTER (raw <> key) AS n_aliases FROM m JOIN rec USING (key) GROUP BY key",
    "display_names": f"WITH {_MENTIONS}, s AS (SELECT key, raw, count(*) AS n FROM m GROUP BY ALL) SELECT key, arg_max(raw, (n, length(raw), raw)) AS display FROM s GROUP BY key",
    "plurals": f"WITH {_spell('SELECT span AS raw FROM linked_spans UNION ALL SELECT canonical_name FROM graph_nodes')} SELECT * FROM ({_plural_sql('SELECT DISTINCT k AS key FROM spell WHERE length(k) > 0')})",
    "confidence_levels": "SELECT CASE WHEN confidence IS NULL THEN 'null' WHEN CAST(confidence AS VARCHAR) = 'nan' THEN 'nan' WHEN confidence < 0 OR confidence > 1 THEN 'out of range' ELSE printf('%.1f', floor(confidence * 10) / 10) END AS bucket, count(*) AS n FROM relationships GROUP BY 1",
    "question_shapes": f"""WITH {_Q}, x AS (SELECT *, lower(question) AS l FROM q), y AS (SELECT *, CASE WHEN regexp_matches(l, '\\bgdpr\\b') THEN 'GDPR' ELSE 'AIA' END AS reg, regexp_extract(l, '\\bannex\\s+([ivx]+)\\b', 1) AS an, regexp_extract(l, '\\barticles?\\s+(\\d+)\\b', 1) AS ar FROM x)
SELECT qid, regexp_matches(question, '{W.ENUMERATIVE}') AS enumerative, regexp_matches(question, '{W.SECOND_ASK}') AS second_ask, regexp_matches(question, '{W.ENUMERATES}') AS enumerates, regexp_matches(question, '{W.ENUMERATES_WIDE}') AS enumerates_wide, regexp_matches(question, '{W.DEFINITIONAL}') AS definitional, regexp_matches(question, '{W.CROSS_INSTRUMENT}') AS cross_instrument,
CASE WHEN an IN ('i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii') THEN reg || ' annex ' || upper(an) WHEN ar <> '' THEN reg || ' article ' || ar END AS target FROM y""",
    "unlinked_ends": f"WITH {_BASE}, r AS (SELECT raw, count(*) AS n FROM (SELECT head AS raw FROM relationships WHERE head IS NOT NULL UNION ALL SELECT tail FROM relationships WHERE tail IS NOT NULL) GROUP BY raw) SELECT raw, n FROM r WHERE raw NOT IN (SELECT raw FROM known)",
    "graph_search": f"{_SEARCH}, each AS ({_SEARCHED}), one AS (SELECT qid, x, verb, y, c, min(call) AS call, bool_or(derived) AS derived FROM each GROUP BY qid, x, verb, y, c), placed AS (SELECT qid, min(call) OVER (PARTITION BY qid, x, verb, y) AS call, x, verb, y, c, derived FROM one), {_sentences('SELECT * FROM placed', 'qid, call')} SELECT qid, call, statement, chunk_id, n_chunks, text, derived FROM told",
    "graph_search_calls": f"{_SEARCH} SELECT template, count(*) AS calls, count(*) FILTER (n = 0) AS empty_calls, CAST(sum(n) AS BIGINT) AS n_rows FROM ({_COUNTED}) GROUP BY template",
    "linker_board": f"""WITH RECURSIVE {_link(_BY_20)}, {_GOLD}, st AS (SELECT qid, min(coalesce(type, '(none)')) AS stratum, count(DISTINCT name) AS gold FROM gold LEFT JOIN graph_nodes ON canonical_name = name GROUP BY qid),
said AS (SELECT DISTINCT 'all' AS arm, qid, name FROM ln UNION SELECT 'unambiguous', qid, name FROM ln WHERE NOT ambiguous), arms AS (SELECT unnest(['all', 'unambiguous']) AS arm),
per AS (SELECT arm, qid, stratum, gold, (SELECT count(*) FROM said s WHERE s.arm = arms.arm AND s.qid = st.qid) AS linked, (SELECT count(*) FROM said s JOIN gold g USING (qid, name) WHERE s.arm = arms.arm AND s.qid = st.qid) AS in_gold FROM st, arms)
SELECT arm, CASE WHEN grouping(stratum) = 1 THEN '(all)' ELSE stratum END AS stratum, count(*) AS rows, count(*) FILTER (linked > 0) AS linked_rows, count(*) FILTER (in_gold > 0) AS hit_rows, CAST(sum(linked) AS BIGINT) AS linked, CAST(sum(in_gold) AS BIGINT) AS in_gold, CAST(sum(gold) AS BIGINT) AS gold,
 round(count(*) FILTER (linked > 0) / count(*), 6) AS link_rate, round(count(*) FILTER (in_gold > 0) / count(*), 6) AS hit_rate, round(coalesce(sum(in_gold) / nullif(sum(linked), 0), 0), 6) AS precision, round(coalesce(sum(in_gold) / nullif(sum(gold), 0), 0), 6) AS recall_superset FROM per GROUP BY GROUPING SETS ((arm, stratum), (arm))""",
    "selector_board": f"""WITH RECURSIVE {_BASE}, {_link(_BY_20)}, {_CALLS}, {_CALL_ROWS}, {_ALL_LEGS}, {_GOLD}, behind AS ({_BEHIND}), fits AS ({_FITS}),
want AS (SELECT DISTINCT qid, unnest(chunk_ids) AS c FROM gold JOIN graph_nodes ON canonical_name = name),
found AS (SELECT DISTINCT qid, call, c FROM calls JOIN behind b ON b.template = k.template AND b.a = k.a),
offered AS (SELECT DISTINCT qid, b.template, b.a, c FROM gold JOIN graph_nodes ON canonical_name = name JOIN fits USING (type) JOIN behind b ON b.template = fits.template AND b.a = name),
per AS (SELECT qid, count(*) AS gold, (SELECT count(*) FROM calls WHERE calls.qid = want.qid) AS calls, (SELECT count(DISTINCT call) FROM found WHERE found.qid = want.qid) AS filled, (SELECT count(DISTINCT f.c) FROM found f JOIN want w USING (qid, c) WHERE f.qid = want.qid) AS hits,
 coalesce((SELECT max(h) FROM (SELECT count(*) AS h FROM offered o JOIN want w USING (qid, c) WHERE o.qid = want.qid GROUP BY o.template, o.a)), 0) AS oracle, (SELECT count(*) > 0 FROM offered o WHERE o.qid = want.qid) AS open FROM want GROUP BY qid)
SELECT count(*) AS n, CAST(sum(gold) AS BIGINT) AS gold_total, CAST(sum(hits) AS BIGINT) AS gold_hit, count(*) FILTER (hits > 0) AS rows_with_a_hit, count(*) FILTER (calls > 0) AS rows_with_a_plan, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(calls) - sum(filled) AS BIGINT) AS empty_calls, CAST(sum(oracle) AS BIGINT) AS oracle, count(*) FILTER (open) AS ceiling_anchor FROM per""",
    "linked_entities": f"WITH RECURSIVE {_link(_SPANS)} SELECT qid, span, name, via, ambiguous FROM ln",
    "routes": f"WITH RECURSIVE {_link(_ANSWERED)}, {_ROUTE} SELECT qid, CASE rule WHEN 'R3-enumerate-role' THEN 'graph' WHEN 'R4-second-ask' THEN 'both' ELSE 'vector' END AS route, rule, enumerates, CASE WHEN enumerates THEN CASE WHEN an IN ('i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii') THEN reg || ' annex ' || upper(an) WHEN ar <> '' THEN reg || ' article ' || ar END END AS target FROM z",
    "template_plans": f"WITH RECURSIVE {_link(_SPANS)}, {_CALLS} SELECT qid, array_to_string(list_transform(calls, lambda k: k.template || '(' || concat_ws(',', k.a, k.b) || ')'), '; ') AS plan, CASE WHEN len(calls) > 0 THEN array_to_string(list_transform(calls, lambda k: k.rule), '+') ELSE 'S0-none' END AS rule FROM planned",
    "node_aliases": f"WITH {_MENTIONS} SELECT key, raw AS alias, count(*) AS n FROM m WHERE raw <> key GROUP BY key, raw",
    "edge_key_violations": "SELECT type, count(*) AS keys, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT type, head, tail, source_chunk_id, count(*) AS n FROM relationships GROUP BY ALL) WHERE n > 1 OR type IS NULL OR head IS NULL OR tail IS NULL OR source_chunk_id IS NULL GROUP BY type",
    "chunk_gaps": f"""WITH {_spell("SELECT head AS raw FROM relationships UNION ALL SELECT tail FROM relationships UNION ALL SELECT unnest(entity_ids) FROM chunks")},
h AS (SELECT DISTINCT chunk_id, k AS key FROM (SELECT chunk_id, unnest(entity_ids) AS raw FROM chunks) JOIN spell USING (raw)), e AS (SELECT DISTINCT source_chunk_id AS chunk_id, k AS key FROM (SELECT source_chunk_id, unnest([head, tail]) AS raw FROM relationships WHERE source_chunk_id IS NOT NULL) JOIN spell USING (raw)),
g AS (SELECT 'dangling' AS gap, * FROM (SELECT * FROM e EXCEPT SELECT * FROM h) UNION ALL SELECT 'orphan', * FROM (SELECT * FROM h EXCEPT SELECT * FROM e)) SELECT gap, regexp_extract(chunk_id, '^[a-z0-9]+') AS regulation, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM g GROUP BY ALL""",
    "granularity_misses": f"""WITH {_spell("SELECT unnest(entity_ids) AS raw FROM chunks")}, h AS (SELECT DISTINCT chunk_id, k FROM (SELECT chunk_id, unnest(entity_ids) AS raw FROM chunks) JOIN spell USING (raw)),
o AS (SELECT chunk_id, lower(regulation) || ' art. ' || article AS named, lower(regulation) || ' art. ' || article || '(' || paragraph || ')' AS expected FROM chunks WHERE article IS NOT NULL AND paragraph IS NOT NULL)
SELECT * FROM o WHERE EXISTS (SELECT 1 FROM h WHERE h.chunk_id = o.chunk_id AND k = named) AND NOT EXISTS (SELECT 1 FROM h WHERE h.chunk_id = o.chunk_id AND k = expected)""",
    "role_statements": f"WITH {_BASE}, {_ROLE_LEGS}, {_sentences(_TOLD_SQL['obligations_for_role'])} SELECT * FROM told",
    "system_statements": f"WITH {_BASE}, {_SYSTEM_LEGS}, {_sentences(_TOLD_SQL['obligations_for_system'])} SELECT * FROM told",
    "enforcement_statements": f"WITH {_BASE}, {_ENFORCE_LEGS}, {_sentences(_TOLD_SQL['enforcement_chain'])} SELECT * FROM told",
    "interaction_statements": f"WITH {_BASE}, {_INTERACT}, {_sentences(_TOLD_SQL['cross_regulation'])} SELECT * FROM told",
}
