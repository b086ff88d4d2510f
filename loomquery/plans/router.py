"""Which kind of question it is: about relationships, row statistics, tables, or data."""

from __future__ import annotations

import re

ROUTES = (
    ("relationships", r"\b(relationships?|foreign keys?|how .*(tables|they) .*(relate|related|connected|linked))\b"),
    ("row_statistics", r"\b(row counts?|record counts?|how many (rows|records))\b.*\b(each|every|all|per|database)\b|\b(largest|smallest|biggest) tables?\b|\bsize of (each|every|all) tables?\b"),
    ("ambiguous_count", r"^\s*how many (rows|records)( are there)?\s*\??\s*$"),
    ("tables", r"\b(list|show|what|which|how many)\b.*\btables\b(?!.*\bwhere\b)"),
)


def route(question: str) -> str:
    """The first route whose pattern fits, else query."""
    text = question.lower()
    return next((name for name, pattern in ROUTES if re.search(pattern, text)), "query")
