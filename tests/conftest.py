import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(home / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(home / "warehouse"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """A dense-ish random panel: 40 users, 420 days, short names, and its matrices."""
    import numpy as np
    import pandas as pd

    from daypanel.sources import panel as P

    rng = np.random.default_rng(7)
    users, days = 40, 420
    here = rng.random((users, days)) < rng.uniform(0.02, 0.9, (users, 1))
    cart = np.where(here, rng.poisson(1.2, (users, days)), 0)
    orders = np.minimum(cart, np.where(here, rng.poisson(0.5, (users, days)), 0))
    gmv = np.round(np.where(orders > 0, rng.gamma(1.5, 40, (users, days)) + 1, 0), 2)
    u, d = np.nonzero(here)
    frame = pd.DataFrame({"user_id": u + 100, "day": d})
    values = {"gmv": gmv, "gmvs": gmv, "ord": orders, "cart": cart, "srch": cart * 2, "s2c": cart, "s2o": orders}
    for name in P.SHORT:
        frame[name] = values[name][u, d].astype(float) if name in values else 0.0
    panel = P.marked(spark.createDataFrame(frame)).repartition("user_id")
    return {"panel": panel, "here": here, "n_days": days, "users": np.arange(users) + 100, **values}
