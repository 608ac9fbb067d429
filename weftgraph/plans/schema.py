"""Schemas (as DDL) and identities of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, label string, name string, filePath string, startLine long, endLine long, isExported boolean, content string, value double"
EDGE_SCHEMA = "id string, src string, dst string, type string, confidence double, step int"
EMBEDDING_SCHEMA = "id string, nodeId string, chunkIndex int, startLine long, endLine long, embedding array<float>, contentHash string"
CONTRACT_SCHEMA = "repo string, contractId string, type string, role string, symbolUid string, filePath string, symbolName string, confidence double, service string, meta string"
LINK_SCHEMA = "fromRepo string, fromUid string, toRepo string, toUid string, contractId string, matchType string, confidence double"

#: Floors of confidence by relation type (fixed values); 0.5 for others.
RELATION_CONFIDENCE = {
    "CALLS": 0.9, "IMPORTS": 0.9, "EXTENDS": 0.85, "IMPLEMENTS": 0.85, "METHOD_OVERRIDES": 0.85,
    "METHOD_IMPLEMENTS": 0.85, "HAS_METHOD": 0.95, "HAS_PROPERTY": 0.95, "ACCESSES": 0.8, "CONTAINS": 0.95,
}
IMPACT_RELATIONS = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "METHOD_OVERRIDES", "OVERRIDES", "METHOD_IMPLEMENTS"]


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), key.cast("string"))


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(kind, F.lit(":"), src, F.lit("->"), dst)


def label_of(node: Column) -> Column:
    """The label in front of an id's first colon."""
    return F.substring_index(node, ":", 1)


def stored_or_default_confidence(confidence: Column, kind: Column) -> Column:
    """The stored confidence if it is positive, else the floor of the relation type."""
    floors = F.create_map(*[F.lit(x) for kv in RELATION_CONFIDENCE.items() for x in kv])
    return F.when(confidence > 0, confidence).otherwise(F.coalesce(F.try_element_at(floors, kind), F.lit(0.5)))
