"""Registered queries and their SQL."""

from . import answers, builds, docs, feeds, graphs, impact, imports, index, layers, packets, queries, questions, states, writes
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "answers", "builds", "docs", "feeds", "graphs", "impact", "imports", "index", "layers", "packets", "queries", "questions", "states", "writes"]
