import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from chainlake.session import configure

    s = (SparkSession.builder.master("local[*]").appName("chainlake-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


def rows(df, *cols):
    """Collect selected columns as a list of tuples (tests only)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
