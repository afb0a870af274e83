"""Numbers, times and reasons as analysts read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(amount: Column) -> Column:
    """Hong Kong dollars with two decimals and thousands apart."""
    return F.concat(F.lit("HKD "), F.format_number(amount, 2))


def whole(value: Column) -> Column:
    """A number without decimals, thousands apart."""
    return F.format_number(value, 0)


def percent(share: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, places), F.lit("%"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def code(name: str, **params: float) -> str:
    """A reason code that carries the parameters in force: ``name(a=1,b=0.5)``, in order of their names."""
    return f"{name}({','.join(f'{k}={v:g}' for k, v in sorted(params.items()))})" if params else name
