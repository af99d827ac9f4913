"""Registration of a query and its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import fixtures

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

# Named sub-queries shared by several oracle texts.
PARTS: dict[str, str] = {}


class Views:
    """Access to the stand-in views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


def nudge(digits: int) -> str:
    """A small part of the rounding unit: moves exact halves to the same side in both engines."""
    return f"{3.3 * 10.0 ** (-digits - 4):e}"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, as the order of summation differs between engines (and no -0.0).

    Spark rounds by way of a decimal text, which takes longer than most of what is rounded. Whole steps are
    counted instead, as DuckDB does, below 1e10 steps, where the nudge is far wider than the error of the product.
    """
    scale, most = f"{10.0 ** digits:e}D", f"{10.0 ** (10 - digits):e}D"

    def steps(n: str) -> str:
        x = f"(`{n}` + {nudge(digits)}D)"
        return f"CASE WHEN abs(`{n}`) < {most} THEN rint({x} * {scale}) / {scale} ELSE round({x}, {digits}) END + 0e0D AS `{n}`"

    return df.selectExpr(*[steps(n) if t == "double" else f"`{n}`" for n, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str | list[str] = "", digits: int = 6):
    """Register ``fn(views) -> DataFrame``; ``doubles`` are the columns the oracle rounds."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(Views(spark, sf_dir)), digits)

        text = None
        if sql is not None:
            names = doubles.split() if isinstance(doubles, str) else doubles
            swaps = ", ".join(f'round("{n}" + {nudge(digits)}, {digits}) + 0e0 AS "{n}"' for n in names)
            body = f"SELECT * REPLACE ({swaps}) FROM ({sql}) q" if swaps else sql
            text = body
        if name in REGISTRY:
            raise ValueError(f"Query registered twice: {name}")
        REGISTRY[name] = (run, text)
        return fn

    return register


def oracle_texts() -> dict[str, str]:
    """Oracle SQL per query; rendered late, as parts may be defined after their first use."""
    return {name: fixtures.oracle(body, PARTS) for name, (_, body) in REGISTRY.items() if body is not None}
