"""Evolving-graph analytics on Spark DataFrames."""

from tidegraph.model import Graph, empty_graph

__all__ = ["Graph", "empty_graph"]
