import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tagloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def training(spark):
    rows = [
        ("a1", "chess puzzle board", "Games"),
        ("a2", "car racing game", "Games"),
        ("a3", "bank loan budget", "Finance"),
        ("a4", "budget tracker bank bank", "Finance"),
        ("a5", "yoga diet", "Health"),
    ]
    return spark.createDataFrame(rows, "appId string, clean_description string, segment string")
