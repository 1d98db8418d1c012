"""Data-quality detectors, reconciliation and text hygiene as PySpark DataFrame operators."""

from plumbline.session import build_session, cut_lineage
from plumbline.types import Detection

__all__ = ["Detection", "build_session", "cut_lineage"]
