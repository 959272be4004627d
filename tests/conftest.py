import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barlight.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return prepare(local_session("4", 4, "barlight-tests"))


BAR = "symbol string, timeframe string, t bigint, o double, h double, l double, c double, v double"


def make_rows(symbol: str, n: int, phase: float = 0.0, step_ms: int = 900_000, gap_at: int | None = None):
    """Two cycles, drift regimes, planted sweeps, whole-number prices."""
    rows, price, t = [], 100_000.0, 1_704_067_200_000
    for i in range(n):
        drift = 40 if i % 300 < 120 else -45 if i % 300 < 220 else 5
        close = round(price + drift + 900 * math.sin(i / 7 + phase) * math.cos(i / 31) + (i * 7919 % 613) - 306)
        high, low = max(price, close) + (i * 37 % 211), min(price, close) - (i * 53 % 197)
        if i % 73 == 72:
            low -= 2600
            close = max(close, round(low + 2400))
            high = max(high, close)
        rows.append((symbol, "15m", t, float(price), float(high), float(low), float(close), float(50 + i * 31 % 97 + (400 if i % 41 == 0 else 0))))
        price = close
        t += step_ms * (5 if gap_at == i else 1)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows("AAAUSDT", 700) + make_rows("BBBUSDT", 450, 1.3, gap_at=200)


@pytest.fixture(scope="session")
def bars(spark, rows):
    return spark.createDataFrame(rows, BAR).repartition(4).cache()
