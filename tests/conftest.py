import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from vecsync.session import LOCAL_DEFAULTS, checkpoint_dir

    import tempfile
    b = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="vecsync-wh-")))
    for k, v in LOCAL_DEFAULTS.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s
    s.stop()
