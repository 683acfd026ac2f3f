"""Registered queries: name -> Spark callable, and the same question in plain SQL."""

from __future__ import annotations

from sightledger.catalog.registry import ORACLES, QUERIES
from sightledger.catalog import candidates, entities, events, ledger, matching, roundtrips, scalars  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
