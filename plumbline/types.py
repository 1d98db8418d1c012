"""Result container shared by the detectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame


class Detection(NamedTuple):
    """``verdict``: one row per series (inconclusive ones included); ``flags``: one row per flagged point."""

    verdict: DataFrame
    flags: DataFrame
