"""A server of bars without a network: a fixed saw-tooth, for trying the paged source."""

from __future__ import annotations

from tidegrid.schema import SECONDS

LAST_MS = 100 * 3600 * 1000


def fetch(tf: str, since: int, limit: int) -> list[list[float]]:
    step = SECONDS[tf] * 1000
    times = range(-(-since // step) * step, LAST_MS, step)
    return [[ms, 1.0 + k % 7, 3.0 + k % 7, 0.5 + k % 7, 2.0 + k % 7, 5.0] for ms in times[:limit] for k in (ms // step,)]
