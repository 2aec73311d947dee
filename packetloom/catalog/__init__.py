"""Registered queries: importing this package fills ``QUERIES`` and ``ORACLES``."""

from packetloom.catalog import channels, corpus, frames, http, review, streams, terminal, triage  # noqa: F401
from packetloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
