import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortry.spec import PanelSpec  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from verify import session

    spark = session()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def spec():
    """The seventeen months of the launch panel."""
    return PanelSpec(panel_start=dt.date(1995, 1, 1), panel_end=dt.date(1996, 5, 1))


@pytest.fixture(scope="session")
def launch(spark, spec):
    """Warehouse over the first seventeen months of orders at sf0.01."""
    from cohortry.plans.warehouse import Warehouse
    from cohortry.sources.orders_panel import raw_panel

    warehouse = Warehouse(raw_panel(spark, "/root/testdata/sf0.01", dt.date(1996, 6, 1)), spec)
    warehouse.fct_customer = warehouse.fct_customer.cache()
    return warehouse
