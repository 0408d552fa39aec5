"""Imports every module that registers queries."""

from __future__ import annotations

from tracemill.plans import alignment, corpora, files, latents, resumed, speech, traces  # noqa: F401
from tracemill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
