"""Cypher and GQL text over a graph: parsed here, planned by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomgraph.plans.cypher.compiler import Compiler
from loomgraph.plans.cypher.parser import CypherError, parse
from loomgraph.plans.cypher.writer import execute

__all__ = ["CypherError", "execute", "parse", "run"]


def run(graph, text: str, params: dict) -> DataFrame:
    return Compiler(graph, params).query(parse(text))
