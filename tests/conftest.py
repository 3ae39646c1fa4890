import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillspark.session import session, ship

    s = session("tests", "local[4]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="3g", spark_sql_warehouse_dir=str(tmp_path_factory.mktemp("warehouse")), spark_checkpoint_dir="file://" + str(tmp_path_factory.mktemp("checkpoints")))
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
