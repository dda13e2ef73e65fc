"""Registered queries: name -> Spark query and, where SQL can say it, its twin."""

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a query over (spark, sf_dir) with its optional SQL twin."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def rnd(column, digits=6):
    """The rounding of `sql.r`."""
    factor = float(10**digits)
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * factor + 0.50037) / factor


def rounded(df, digits=6, only=None):
    """Round the double columns of a result."""
    names = only or [n for n, t in df.dtypes if t == "double"]
    return df.select(
        *[rnd(f"`{n}`", digits).alias(n) if n in names else F.col(f"`{n}`") for n in df.columns]
    )
