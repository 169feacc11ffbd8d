import pytest
from pyspark.sql import SparkSession

from locusframe.plans.session import tuned


@pytest.fixture(scope="session")
def spark():
    b = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    s = tuned(b.config("spark.driver.memory", "4g")).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def tuples(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
