import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tallyframe.session import DEFAULT_CONF, ensure_checkpoint_dir

    builder = (SparkSession.builder.master("local[*]").appName("tallyframe-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "4g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tf-ckpt-")))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="tf-test-")


SF_SMALL = os.environ.get("TF_TEST_SF", "/root/testdata/sf0.001")
