"""Closed vocabularies of the data model and the schemas of its records."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: types of entities, in the order that settles ties of votes
TYPE_PRIORITY = ("Authority", "ActorRole", "SystemType", "RiskCategory", "LawfulBasis", "Right", "Penalty", "Obligation", "Article", "Annex", "Regulation", "DefinedTerm")
CATCH_ALL = "DefinedTerm"
# fixed values: words that make a body with powers
AUTHORITY_WORDS = r"\b(authority|authorities|body|bodies|board|office|commission|agency|panel|forum|secretariat|institution|committee|supervisor)\b"
# fixed values: relation types and the entity types allowed as head and as tail
ENDPOINTS = {
    "DEFINED_IN": ("DefinedTerm ActorRole SystemType RiskCategory Obligation Right LawfulBasis Authority Penalty", "Article Annex"),
    "IMPOSES": ("Article Annex Regulation", "Obligation"),
    "APPLIES_TO": ("Obligation Article Annex RiskCategory LawfulBasis Right SystemType DefinedTerm", "ActorRole SystemType Authority DefinedTerm"),
    "CLASSIFIED_AS": ("SystemType DefinedTerm ActorRole", "RiskCategory"),
    "LISTED_IN": ("SystemType DefinedTerm Regulation Obligation Authority", "Article Annex"),
    "REFERENCES": ("Article Annex", "Article Annex"),
    "ENFORCED_BY": ("Obligation Regulation Article Right", "Authority"),
    "PENALIZED_UNDER": ("Obligation", "Article Annex"),
    "EXEMPT_FROM": ("ActorRole SystemType Obligation", "Obligation Article Annex"),
    "INTERACTS_WITH": ("Article Annex Regulation", "Regulation Article"),
    "PERMITS": ("Article Regulation Annex", "LawfulBasis"),
    "GRANTS": ("Article Annex Regulation", "Right"),
    "SETS_PENALTY": ("Article Annex", "Penalty"),
}
# fixed values: graph templates, their parameters and the edges they cover
TEMPLATES = {
    "obligations_for_role": (("role",), ("APPLIES_TO", "IMPOSES")),
    "obligations_for_system": (("system_type",), ("CLASSIFIED_AS", "APPLIES_TO", "IMPOSES")),
    "enforcement_chain": (("obligation",), ("ENFORCED_BY", "PENALIZED_UNDER")),
    "definition_of": (("term",), ("DEFINED_IN",)),
    "cross_regulation": (("article",), ("INTERACTS_WITH",)),
    "path_between": (("entity_a", "entity_b"), ()),
}
# fixed values: types that anchor a graph question, and types allowed per template parameter
ANCHOR_TYPES = ("ActorRole", "SystemType", "Obligation", "Article", "RiskCategory", "Annex")
TERM_TYPES = tuple(ENDPOINTS["DEFINED_IN"][0].split())
INTERACTING = tuple(sorted({*ENDPOINTS["INTERACTS_WITH"][0].split(), *ENDPOINTS["INTERACTS_WITH"][1].split()}))


def _s(*fields: tuple[str, str, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_json_string(f'"{t}"') if t in ("string", "integer", "long", "double", "boolean", "timestamp") else T.ArrayType(T.StringType(), False), null) for n, t, null in fields])


CHUNK = _s(
    *((n, "string", False) for n in ("chunk_id", "regulation", "shape")), ("article", "integer", True), ("article_title", "string", True), ("paragraph", "integer", True), ("definition", "integer", True),
    ("annex", "string", True), ("annex_title", "string", True), ("section", "string", True), ("point", "integer", True), ("token_count", "integer", True), ("citation_label", "string", False), ("text", "string", False), ("entity_ids", "strings", False),
)
ENTITY = T.StructType([T.StructField("type", T.StringType()), T.StructField("canonical_name", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])
RELATION = T.StructType([*(T.StructField(n, T.StringType()) for n in ("type", "head", "tail", "source_chunk_id")), T.StructField("confidence", T.DoubleType())])
EXTRACTION = T.StructType([T.StructField("chunk_id", T.StringType(), False), T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("relationships", T.ArrayType(RELATION))])
DECISION = T.StructType(
    [*(T.StructField(n, T.StringType()) for n in ("run_id", "question", "router", "route", "raw", "rule")), T.StructField("latency_ms", T.DoubleType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("linked", T.ArrayType(T.StringType())), *(T.StructField(n, T.StringType()) for n in ("question_id", "gold", "error", "outcome", "ts"))]
)
