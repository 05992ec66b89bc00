import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from concordia.session import drop_run_folder, get_spark
    shared = tmp_path_factory.mktemp("shared")
    s = get_spark("local[4]", 4, extra={"spark.checkpoint.dir": f"file://{shared}/checkpoints",
                                        "spark.sql.warehouse.dir": f"file://{shared}/warehouse"})
    yield s
    drop_run_folder(s)
    s.stop()
