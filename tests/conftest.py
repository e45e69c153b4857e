import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from prosopon.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """`apply(function, [inputs])`: the function's value for each input text, as plain Python."""
    from pyspark.sql import functions as F

    def plain(v):
        if hasattr(v, "asDict"):
            return {k: plain(x) for k, x in v.asDict().items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    def run(function, inputs):
        df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
        rows = df.select("i", function(F.col("s")).alias("v")).orderBy("i").collect()
        return [plain(r.v) for r in rows]

    return run
