"""What a profile picks: long tables of picks, rejects and explanations, and the manifests made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumisift.functions import text

RENAME_SCHEMES = ("original", "sequential", "category-rank")


@dataclass
class Selection:
    """picked(category, cat_idx, rank, name), rejected(name, reason), explain(name, breakdown) or None."""

    picked: DataFrame
    rejected: DataFrame | None = None
    explain: DataFrame | None = None

    def all_picked(self) -> DataFrame:
        """Each picked name once, at its first place: (name, category, rank)."""
        first = F.min(F.struct("cat_idx", "rank", "category"))
        return self.picked.groupBy("name").agg(first.alias("f")).select("name", "f.category", "f.rank", "f.cat_idx")

    def reject_counts(self) -> DataFrame:
        return self.rejected.groupBy("reason").agg(F.count("*").alias("n"))

    def explained_picks(self) -> DataFrame:
        """Explanations of picked frames only."""
        return self.explain.join(self.picked.select("name"), "name", "left_semi")


def global_rank(picked: DataFrame) -> DataFrame:
    """Adds global_rank, a running number over categories in their order. Picks are capped, so few."""
    return picked.withColumn("global_rank", F.row_number().over(W.orderBy("cat_idx", "rank")))


def output_name(name: Column, category: Column, rank: Column, overall: Column, total: Column, scheme: str, convert_heic: bool = True) -> Column:
    """The file a pick is written to. Numbers are padded to the width of the total, at least 2."""
    if scheme not in RENAME_SCHEMES:
        raise ValueError(f"rename scheme {scheme!r} is not one of {RENAME_SCHEMES}")
    heic = text.suffix(name).isin(*text.HEIC) & F.lit(convert_heic)
    if scheme == "original":
        return F.when(heic, F.concat(text.stem(name), F.lit(".jpg"))).otherwise(name)
    ext = F.when(heic, F.lit(".jpg")).otherwise(text.suffix(name))
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    if scheme == "sequential":
        return F.concat(text.padded(overall, width), ext)
    return F.concat(category, F.lit("-"), text.padded(rank, width), ext)


def manifest(selection: Selection, profile: str, outputs: DataFrame | None = None) -> DataFrame:
    """One JSON document a category: category, json. Optional outputs(name, output_path, output_filename) are left out where absent."""
    rows = selection.picked if outputs is None else selection.picked.join(outputs, "name", "left")
    extra = [] if outputs is None else ["output_path", "output_filename"]
    entry = F.struct("rank", F.col("name").alias("filename"), *extra)
    grouped = rows.groupBy("category").agg(F.array_sort(F.collect_list(entry)).alias("picks"))
    return grouped.select("category", F.to_json(F.struct(F.lit(profile).alias("profile"), "category", "picks")).alias("json"))


def share(value: Column, total: Column) -> Column:
    """value of total as `12.3%`, or `-` where the total is 0."""
    return F.when(total == 0, F.lit("-")).otherwise(F.concat(F.format_string("%.1f", F.bround(value / total * 100, 1)), F.lit("%")))
