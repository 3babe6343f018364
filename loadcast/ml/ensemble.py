"""Weighted averages of several models' predictions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import r2
from ..operators.chunks import attach
from ..operators.evaluate import score
from ..operators.splits import temporal, validation_tail
from ..series import SeriesSpec
from ..session import keep_table
from .models import read_details, write_details


def weights(predictions: DataFrame, y: str, columns: list[str],
            keys: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Weight per prediction column from its R2: negatives count 0, the sum is 1, and all
    are equal when none is positive. One aggregate for all models."""
    scores = predictions.groupBy(*keys).agg(
        *[F.greatest(F.coalesce(r2(y, c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return scores.select(*keys, *[
        F.when(total > 0, F.col(c) / total).otherwise(F.lit(1 / len(columns))).alias(f"weight_{c}")
        for c in columns])


def contributions(predictions: DataFrame, weight_table: DataFrame, columns: list[str],
                  keys: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Add ``contribution_<column>`` per model and their sum as ``yhat``."""
    joined = attach(predictions, weight_table, keys)
    parts: dict[str, Column] = {f"contribution_{c}": F.col(c) * F.col(f"weight_{c}") for c in columns}
    joined = joined.withColumns(parts)
    total = sum((F.col(p) for p in list(parts)[1:]), F.col(next(iter(parts))))
    return joined.withColumn("yhat", total).select(*predictions.columns, *parts, "yhat")


@dataclass
class FittedEnsemble:
    """Members and their weights. ``transform`` adds ``yhat``.

    A member that cannot predict counts 0 and leaves the others alone; ``errors`` says why, by the member's number.
    """

    name: str
    feature_names: list[str]
    members: list
    member_weights: list[float]
    target: str = "y"
    errors: dict[int, str] = field(default_factory=dict)

    def _member_predictions(self, df: DataFrame) -> DataFrame:
        for i, m in enumerate(self.members):
            if i not in self.errors:
                try:
                    df = m.transform(df).withColumnRenamed("yhat", f"_m{i}")
                    continue
                except Exception as e:  # whatever stops one member must not stop the others
                    self.errors[i] = _said(e)
            df = df.withColumn(f"_m{i}", F.lit(0.0))
        return df

    def _parts(self) -> list[Column]:
        return [F.col(f"_m{i}") * w for i, w in enumerate(self.member_weights)]

    def transform(self, df: DataFrame) -> DataFrame:
        names = [f"_m{i}" for i in range(len(self.members))]
        terms = self._parts()
        return self._member_predictions(df).withColumn("yhat", sum(terms[1:], terms[0])).drop(*names)

    def contributions(self, df: DataFrame) -> DataFrame:
        """Each member's share under the member's name, and their sum as ``yhat``."""
        shares = {m.name: part for m, part in zip(self.members, self._parts(), strict=True)}
        total = sum(self._parts()[1:], self._parts()[0])
        names = [f"_m{i}" for i in range(len(self.members))]
        return self._member_predictions(df).withColumns({**shares, "yhat": total}).drop(*names)

    def evaluate(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        return score(self.transform(df), self.target, "yhat", by)

    def save(self, path: str) -> None:
        """Every member under its number, and what holds them together."""
        for i, m in enumerate(self.members):
            m.save(f"{path}/members/{i}")
        write_details(SparkSession.active(), path, {
            "kind": "ensemble", "name": self.name, "feature_names": self.feature_names, "target": self.target,
            "weights": self.member_weights, "errors": sorted(self.errors.items())})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedEnsemble:
        from . import load_model

        info = read_details(spark, path)
        members = [load_model(spark, f"{path}/members/{i}") for i in range(len(info["weights"]))]
        return cls(info["name"], info["feature_names"], members, info["weights"], info["target"],
                   dict(info.get("errors", [])))


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0][:300] if str(error) else ''}"


class Ensemble:
    """Fits every member, then weights them by R2 on the last fifth of the rows.

    By default the members have seen those rows, as is customary for this scheme; ``holdout=True`` weights models
    fitted without them. Each member is judged alone: one whose prediction fails, when it is planned or when it runs,
    gets weight 0 and its error is kept. A failing fit is an error.
    """

    def __init__(self, members: list, spec: SeriesSpec, holdout: bool = False):
        self.name, self.members, self.spec, self.holdout = "Ensemble Model", members, spec, holdout

    def fit(self, df: DataFrame, features: list[str], target: str | None = None) -> FittedEnsemble:
        target = target or self.spec.target
        fitted = [m.fit(df, features, target) for m in self.members]
        judged = fitted
        if self.holdout:
            early = temporal(df, self.spec, name="_part").where(F.col("_part") == "train").drop("_part")
            judged = [m.fit(early, features, target) for m in self.members]
        late = keep_table(validation_tail(df, self.spec), "validation")
        errors: dict[int, str] = {}
        scores = []
        for i, m in enumerate(judged):
            try:
                scores.append(max(m.transform(late).agg(r2(target, "yhat")).first()[0] or 0.0, 0.0))
            except Exception as e:  # whatever stops one member must not stop the others
                errors[i] = _said(e)
                scores.append(0.0)
        total = sum(scores)
        # none better than the mean: the members that work count alike
        working = len(scores) - len(errors)
        if total > 0:
            shares = [s / total for s in scores]
        else:
            shares = [0.0 if i in errors or not working else 1 / working for i in range(len(scores))]
        return FittedEnsemble(self.name, list(features), fitted, shares, target, errors)
