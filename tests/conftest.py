import os
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])  # for Python workers
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from orderlens.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "orderlens-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.checkpoint.dir": str(shared / "checkpoints"),
           "spark.sql.warehouse.dir": str(shared / "warehouse")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def warehouse(spark):
    from orderlens.sources.star_schema import read_star_schema

    return read_star_schema(spark, SMALL)


@pytest.fixture(scope="session")
def answers(spark):
    """Result and plan of every query key as futures; the queries run side by side."""
    from compare import spark_result

    from orderlens import registry

    def answer(query):
        df = query(spark, SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        return *spark_result(df), plan

    with ThreadPoolExecutor(6) as pool:
        yield {key: pool.submit(answer, query) for key, query in registry.queries().items()}
