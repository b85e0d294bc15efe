import pytest

from nasty_cases import frame, nasty_texts


@pytest.fixture(scope="session")
def nasty(spark):
    return frame(spark, nasty_texts()).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
