import pytest

from weir.shipping import ship


@pytest.fixture(autouse=True)
def sources(spark):
    ship(spark)
