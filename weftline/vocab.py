"""Closed vocabularies. All values here are fixed: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass

ENTITY_TYPES = ("Company", "Concept", "Event", "Fund", "Location", "Organization", "Person", "Product", "Region", "Regulation", "RiskFactor", "Sector", "Supplier", "Technology", "Time")
RELATION_TYPES = ("BELONGS_TO", "DEPENDS_ON", "DEVELOPED_BY", "HOLDS", "LOCATED_IN", "OWNS", "PART_OF", "REGULATED_BY", "RELATED_TO", "SUBJECT_TO", "USES", "WORKS_AT")


@dataclass(frozen=True)
class Metapath:
    """A typed path pattern: steps are (from type, relation, "out" or "in", to type)."""

    name: str
    description: str
    keywords: tuple[str, ...]
    steps: tuple[tuple[str, str, str, str], ...]


METAPATHS = {
    m.name: m
    for m in (
        Metapath("sector_exposure", "Find sectors represented by companies held by a fund.", ("sector", "industry", "concentration", "exposure"), (("Fund", "holds", "out", "Company"), ("Company", "belongs_to", "out", "Sector"))),
        Metapath("geographic_risk", "Find geographic regions represented by fund holdings.", ("geographic", "geography", "region", "country", "location"), (("Fund", "holds", "out", "Company"), ("Company", "located_in", "out", "Region"))),
        Metapath("supply_chain_risk", "Find supplier dependencies created by fund holdings.", ("supplier", "supply", "vendor", "dependency", "dependencies"), (("Fund", "holds", "out", "Company"), ("Company", "depends_on", "out", "Supplier"))),
        Metapath("technology_risk", "Find technology dependencies created by fund holdings.", ("technology", "platform", "cloud", "software", "infrastructure"), (("Fund", "holds", "out", "Company"), ("Company", "uses", "out", "Technology"))),
        Metapath("shared_sector", "Find companies connected through the same sector.", ("shared sector", "share", "peer", "peers", "same sector", "similar companies"), (("Company", "belongs_to", "out", "Sector"), ("Sector", "belongs_to", "in", "Company"))),
        Metapath("management_overlap", "Find companies connected through shared people.", ("management", "executive", "board", "director", "overlap"), (("Company", "works_at", "in", "Person"), ("Person", "works_at", "out", "Company"))),
        Metapath("compliance_chain", "Find regulations that apply through fund holdings.", ("regulation", "regulatory", "compliance", "basel", "sec", "subject to"), (("Fund", "holds", "out", "Company"), ("Company", "subject_to", "out", "Regulation"))),
        Metapath("subsidiary_chain", "Find multi-level company ownership chains.", ("subsidiary", "ownership", "owns", "owned", "parent"), (("Company", "owns", "out", "Company"), ("Company", "owns", "out", "Company"))),
    )
}
FALLBACK_METAPATHS = ("sector_exposure", "geographic_risk", "compliance_chain")


@dataclass(frozen=True)
class Rule:
    name: str
    metapath: str
    description: str
    conclusion: str
    keywords: tuple[str, ...]


RULES = (
    Rule("fund_sector_exposure", "sector_exposure", "If a fund holds a company and that company belongs to a sector, infer fund exposure to that sector.", "{start} has inferred sector exposure to {end}.", ("sector", "industry", "exposure", "concentration", "infer")),
    Rule("fund_geographic_exposure", "geographic_risk", "If a fund holds a company and that company is located in a region, infer geographic exposure.", "{start} has inferred geographic exposure to {end}.", ("geographic", "geography", "region", "country", "location", "infer")),
    Rule("fund_supplier_dependency", "supply_chain_risk", "If a fund holds a company and that company depends on a supplier, infer indirect supplier exposure.", "{start} has inferred supplier dependency exposure to {end}.", ("supplier", "supply", "vendor", "dependency", "dependencies", "infer")),
    Rule("fund_technology_dependency", "technology_risk", "If a fund holds a company and that company uses a technology, infer technology dependency exposure.", "{start} has inferred technology dependency exposure to {end}.", ("technology", "platform", "cloud", "software", "infrastructure", "infer")),
    Rule("fund_regulatory_scope", "compliance_chain", "If a fund holds a company and that company is subject to a regulation, infer regulatory scope.", "{start} has inferred regulatory exposure to {end}.", ("regulation", "regulatory", "compliance", "basel", "sec", "subject", "infer")),
    Rule("sector_peer", "shared_sector", "If two companies belong to the same sector, infer they are sector peers.", "{start} and {end} are inferred sector peers.", ("peer", "peers", "same sector", "shared sector", "similar", "infer")),
    Rule("management_overlap", "management_overlap", "If two companies share a person through works_at relationships, infer management overlap.", "{start} and {end} have inferred management overlap.", ("management", "executive", "board", "director", "overlap", "infer")),
    Rule("transitive_ownership", "subsidiary_chain", "If company A owns company B and B owns company C, infer indirect ownership exposure from A to C.", "{start} has inferred indirect ownership exposure to {end}.", ("subsidiary", "ownership", "owns", "owned", "parent", "indirect", "infer")),
)

ORG_SUFFIXES = ("incorporated", "inc", "corporation", "corp", "limited", "ltd", "llc", "plc", "ag", "sa")
QUERY_STOPWORDS = ("and", "for", "the", "their", "what", "which", "did")
ENTITY_STOPWORDS = tuple("a an and as did do does for from how in of report reported the to what when where which who why".split())
BROAD_TERMS = ("2021", "2022", "2023", "annual", "chase", "fiscal", "jpmorgan", "microsoft", "report", "year")
GENERIC_TERMS = ("major", "ratio", "source", "sources")
POLICY_TERMS = ("policy", "procedure", "process", "playbook", "control", "step", "workflow")
# intent -> (retrieval size, context limit)
INTENT_SIZES = {"factoid": (6, 5), "comparative": (12, 10), "procedural": (10, 8), "analytical": (14, 10), "exploratory": (12, 10)}
BRANCHES = ("vector", "subgraph", "path", "community", "metapath", "inference")
CDC_OPERATIONS = {"INSERT": "created", "CREATE": "created", "C": "created", "R": "created", "UPDATE": "modified", "MODIFY": "modified", "U": "modified", "DELETE": "deleted", "D": "deleted"}
MOJIBAKE = (
    ("﻿", ""), ("â€™", "'"), ("â€˜", "'"), ("â€œ", '"'), ("â€\u009d", '"'), ("â€”", "-"), ("â€“", "-"), ("â€¢", "- "), ("â¢", "- "), ("Â·", " - "), ("Â ", " "), ("Â", ""),
)
FILE_TYPES = {".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".csv": "table", ".xlsx": "table", ".xls": "table", ".txt": "text", ".md": "markdown"}
# words (either, in the first 200 characters; none: any text), entities (name, type, confidence), relations (head, relation, tail, confidence)
DEMO_EXTRACTIONS = (
    (("apple", "aapl"), (("Apple Inc", "Company", 0.92), ("Technology", "Sector", 0.88), ("Foxconn", "Supplier", 0.85)), (("Apple Inc", "BELONGS_TO", "Technology", 0.90), ("Apple Inc", "DEPENDS_ON", "Foxconn", 0.85))),
    (("jpmorgan", "lcr"), (("JPMorgan Chase", "Company", 0.92), ("Financial Services", "Sector", 0.88), ("United States", "Region", 0.90)), (("JPMorgan Chase", "BELONGS_TO", "Financial Services", 0.90), ("JPMorgan Chase", "LOCATED_IN", "United States", 0.88))),
    ((), (("Global Income Fund", "Fund", 0.88), ("Sample Corp", "Company", 0.85), ("Technology", "Sector", 0.87)), (("Global Income Fund", "HOLDS", "Sample Corp", 0.87), ("Sample Corp", "BELONGS_TO", "Technology", 0.85))),
)
INSUFFICIENT_TERMS = ("insufficient", "not enough", "not available", "cannot determine", "no evidence", "does not contain", "does not provide", "not contain information")
NO_RELATIONS = "No direct intra-community relationships"
