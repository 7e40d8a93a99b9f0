"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("market", "text", "ingest", "similarity", "kernels", "inference", "experiments")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name; sql: DuckDB's for the same columns, where SQL can express it."""

    def add(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(F.col(c), places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _load() -> None:
    for m in _MODULES:
        import_module(f"ledgerline.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return {name: _shipped(f) for name, f in _QUERIES.items()}


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ledgerline.plans.tables import sharing

        ship(spark)
        with sharing():
            return f(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the equal-weight walk-forward backtest over months, which even the smallest tables fill."""
    from ledgerline.operators import backtest, calendars, metrics, panel, universe
    from ledgerline.plans import market
    from ledgerline.plans import tables as t

    prices = t.prices(spark, sf_dir, "month")
    returns, calendar = panel.log_returns(prices), panel.calendar(prices)
    places = calendars.date_places(calendar, t.rebalances(spark))
    adv = universe.median_adv(panel.dollar_volume(prices), calendar, places, 6)
    members = universe.investable(adv, universe.completeness(returns, places, 24), adv, least_adv=1_000.0)
    return rounded(metrics.performance(backtest.run(market.equal_weights(members), returns, market.periods(spark))))
