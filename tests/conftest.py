import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk():
    """Two random-walk bar series of different length."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    frames = []
    for symbol, n in (("A", 700), ("B", 45)):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        opened = close + rng.normal(0, 0.3, n)
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "ts": pd.date_range("2024-01-01", periods=n, freq="15min"),
                    "open": opened,
                    "high": np.maximum(opened, close) + rng.uniform(0, 1, n),
                    "low": np.minimum(opened, close) - rng.uniform(0, 1, n),
                    "close": close,
                    "volume": rng.integers(1, 100, n).astype(float),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)
