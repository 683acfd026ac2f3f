"""Spark-native visual entity resolution: candidates, matching, clusters, ledger."""

from sightledger.params import Params

__all__ = ["Params"]
