import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from trialweave.runtime import ship

    ship(spark)
