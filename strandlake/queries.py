"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import importlib

from .plans.registry import ORACLE_SQL, QUERIES

for _module in ("q_features", "q_sequence", "q_intervals", "q_clusters", "q_statistics", "q_groups", "q_dense", "q_manifest"):
    importlib.import_module(f"strandlake.plans.{_module}")

FLAGSHIP = "idf_l2_matrix"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
