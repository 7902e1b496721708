"""All queries of the library but those on corpora: importing the modules registers them."""

from . import of_engine, of_events, of_files, of_findings, of_rules, of_sinks, of_store, of_supply, of_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
