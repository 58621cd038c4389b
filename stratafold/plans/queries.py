"""Registered queries of the segmentation engine and their SQL twins."""

from __future__ import annotations

from . import core, evaluation, models, prediction  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES  # noqa: F401
