"""Explainable bonus rules over label probabilities, with a ceiling."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BONUS = 0.75


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    weight: float


@dataclass(frozen=True)
class Rules:
    """An ordered stack: each rule adds quality x weight x probability; above max_bonus all are scaled down alike."""

    rules: tuple[Rule, ...]
    max_bonus: float = MAX_BONUS

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(r.name for r in self.rules)

    @property
    def labels(self) -> tuple[str, ...]:
        return tuple(r.label for r in self.rules)

    def reweighted(self, weights: dict[str, float]) -> "Rules":
        """Weights by rule name; a name that no rule has is an error."""
        if unknown := sorted(set(weights) - set(self.names)):
            raise ValueError(f"no such rules: {', '.join(unknown)}; known: {', '.join(sorted(self.names))}")
        return replace(self, rules=tuple(replace(r, weight=weights.get(r.name, r.weight)) for r in self.rules))

    def contributions(self, quality: Column, probs: Column) -> Column:
        """map<name, points> in rule order; rules that add nothing stay in it. Sums run in rule order, so doubles repeat."""
        weights = F.array(*[F.lit(float(r.weight)) for r in self.rules]).cast("array<double>")
        given = F.array(*[F.coalesce(F.try_element_at(probs, F.lit(r.label)), F.lit(0.0)) for r in self.rules]).cast("array<double>")
        raw = F.zip_with(weights, given, lambda w, p: w * p)
        earned = total(raw)
        scale = F.when(earned > self.max_bonus, F.lit(float(self.max_bonus)) / earned).otherwise(F.lit(1.0))
        names = F.array(*[F.lit(r.name) for r in self.rules]).cast("array<string>")
        return F.map_from_arrays(names, F.transform(raw, lambda x: quality * x * scale))

    def breakdown(self, quality: Column, probs: Column) -> Column:
        """struct<quality, contributions, total>."""
        points = self.contributions(quality, probs)
        return F.struct(quality.alias("quality"), points.alias("contributions"), (quality + total(F.map_values(points))).alias("total"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def parse_weights(given: list[str]) -> dict[str, float]:
    """NAME=VALUE strings; the last of a name holds."""
    out = {}
    for item in given:
        name, sign, value = item.partition("=")
        try:
            number = float(value)
        except ValueError:
            number = -1.0
        if not sign or not name.strip() or not number >= 0 or number == float("inf"):
            raise ValueError(f"{item!r} is not NAME=VALUE with a number of 0 or more")
        out[name.strip()] = number
    return out


def weight_pair(pair: Column, known: tuple[str, ...]) -> Column:
    """struct<name, weight, fault> of a NAME=VALUE string, as `parse_weights` and `reweighted` judge it: fault is bad, unknown or empty."""
    at = F.instr(pair, F.lit("="))
    name = F.trim(F.substr(pair, F.lit(1), F.greatest(at - 1, F.lit(0))))
    value = F.trim(F.substr(pair, at + 1)).try_cast("double")
    good = (at > 0) & (name != "") & value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    fault = F.when(~F.coalesce(good, F.lit(False)), F.lit("bad")).when(~name.isin(*known), F.lit("unknown")).otherwise(F.lit(""))
    fine = fault == ""
    return F.struct(F.when(fine, name).alias("name"), F.when(fine, value).alias("weight"), fault.alias("fault"))


def softmax(logits: Column) -> Column:
    """exp(x - max) / sum, in array order."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / total(shifted))


def best_label(probs: Column, labels: tuple[str, ...]) -> Column:
    """The label of the largest probability; of equal ones the first in the order of `labels`."""
    values = F.array(*[F.coalesce(F.try_element_at(probs, F.lit(x)), F.lit(0.0)) for x in labels])
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(values, F.array_max(values)).cast("int"))


def uniform(labels: tuple[str, ...]) -> Column:
    """The probabilities of a dry run."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit(1.0 / len(labels)) for _ in labels]))


def canned(table: dict[str, dict[str, float]], labels: tuple[str, ...], name: Column) -> Column:
    """Probabilities by file name, 0 for labels not given; uniform for names not given. For tests."""
    out = uniform(labels)
    for key, probs in table.items():
        given = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit(float(probs.get(x, 0.0))) for x in labels]))
        out = F.when(name == key, given).otherwise(out)
    return out
