"""Imports every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ("q_levels", "q_uncertainty", "q_ensemble", "q_stats", "q_sources", "q_assembly", "q_vectors", "q_text")

for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
