"""All registered queries of the library proper, by name, with their SQL twins."""

from __future__ import annotations

from . import aggregates, changes, graphs, ingest, joins, knames, scoring, search, streams, texts, windows  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
