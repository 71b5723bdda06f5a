"""All registered queries outside the text operators."""

from __future__ import annotations

from .plans import ORACLES, QUERIES
from .plans import cataloging, clouds, composed, draws, grasping, learning, shapes, stream_twins, surfaces  # noqa: F401  they register themselves


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
