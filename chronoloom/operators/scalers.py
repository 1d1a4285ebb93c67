"""Scalers, as functions of DataFrames and as pyspark.ml stages."""

from __future__ import annotations

from pyspark.ml.base import Estimator, Model, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import not_nan


class ZeroCentreModel(Model):
    """Divides columns by one scale."""

    def __init__(self, columns: list[str] | None = None, scale: float | None = None):
        super().__init__()
        self.columns, self.scale = columns or [], scale

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.scale is None:
            raise ValueError("the scaler isn't fitted")
        return df.withColumns({c: F.try_divide(F.col(c).cast("double"), F.lit(self.scale)) for c in self.columns})


class ZeroCentreScaler(Estimator):
    """One scale for all columns together: the greatest absolute value; a NaN makes the scale NaN."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _fit(self, df: DataFrame) -> ZeroCentreModel:
        found = df.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in self.columns]).first()
        values = [v for v in found if v is not None]
        return ZeroCentreModel(self.columns, max(values, key=lambda v: (v != v, v)) if values else None)


class FixedFactorScaler(Transformer):
    """Multiplies columns by a factor; inverse() divides."""

    def __init__(self, columns: list[str], factor: float = 1.0):
        super().__init__()
        self.columns, self.factor = columns, factor

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.factor for c in self.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) / self.factor for c in self.columns})


def zero_centre(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same in one plan: the scale is a one-row aggregate."""
    top = df.agg(F.greatest(*[F.max(F.abs(F.col(c).cast("double"))) for c in columns], F.lit(0.0)).alias("_scale"))
    return df.crossJoin(F.broadcast(top)).withColumns({c: F.try_divide(F.col(c).cast("double"), F.col("_scale")) for c in columns}).drop("_scale")


def standardise(df: DataFrame, columns: list[str], by: DataFrame | None = None) -> DataFrame:
    """Each column less its mean, divided by its sample deviation, both of the rows of ``by`` (df itself unless given); null where that is 0."""
    stats = (df if by is None else by).agg(*[f(not_nan(F.col(c))).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).select(*df.columns)


def one_hot(df: DataFrame, column: str, categories: list) -> DataFrame:
    """df with <column>_hot, 1.0 at the place of the category and 0.0 elsewhere."""
    return df.withColumn(f"{column}_hot", F.transform(F.array(*[F.lit(c) for c in categories]), lambda c: F.coalesce((c == F.col(column)).cast("double"), F.lit(0.0))))
