"""One local session, and small frames shared by the tests."""

from __future__ import annotations

import datetime as dt

import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[4]", shuffle_partitions=4,
                            **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


DIM = ("instrument_id string, name string, asset_class string, desk string, currency string, quote string, source string, ticker string, "
       "tenor_years double, price_scale double, returns_proxy string, stress_proxy string")


@pytest.fixture(scope="session")
def instruments(spark):
    """An equity at home and one abroad, a metal priced abroad, a seven-year yield at home and the foreign currency."""
    return spark.createDataFrame([
        ("OAK", "oak", "equity", "Forest", "GBP", "price", "px", "TO", None, 1.0, None, None),
        ("ELM", "elm", "equity", "Overseas", "EUR", "price", "px", "TE", None, 1.0, None, None),
        ("TIN", "tin", "commodity", "Metals", "EUR", "price", "px", "TT", None, 1.0, None, None),
        ("N7", "n7", "rates", "Gilts", "GBP", "yield_pct", "cb", "TN", 7.0, 1.0, None, None),
        ("EURO", "euro", "fx", "Cash", "EUR", "fx", "cb", "TU", None, 1.0, None, None)], DIM)
