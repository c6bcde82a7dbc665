"""Registered queries and the SQL that states the same results."""

from __future__ import annotations

from orbispan.plans import q_alignments, q_benchmark, q_enrich, q_files, q_formats, q_hotspots, q_intervals, q_process, q_repeats, q_sequences, q_sources
from orbispan.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "q_alignments", "q_benchmark", "q_enrich", "q_files", "q_formats", "q_hotspots", "q_intervals", "q_process", "q_repeats", "q_sequences", "q_sources"]
