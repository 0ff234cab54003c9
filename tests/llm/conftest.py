import pytest


@pytest.fixture(scope="session", autouse=True)
def work_dir_is_local(spark):
    from meshlytics.llm import common

    assert common.work_dir(spark).startswith("/tmp/checkpoints/")
