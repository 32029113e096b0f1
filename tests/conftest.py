import pytest

from lodestream.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    return build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.ui.enabled": "false",
            "spark.sql.warehouse.dir": str(tmp / "warehouse"),
            "spark.checkpoint.dir": f"file://{tmp}/shared",
        },
    )
