"""Human review: counts, override rates, the session a cull becomes, its restoration, and what a log of decisions comes to.

candidates(session, idx, path, filename, score, decision, rejected_reason, similar, ...): decision is keep, reject or empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumisift.operators.ordered import numbered, running

#: Near-duplicates of a candidate that one row of a new session holds.
SIMILAR_ROWS = 10_000
VIEWS = ("all", "undecided", "keep", "reject", "rejected-input")


def counts(candidates: DataFrame) -> DataFrame:
    """(session, total, keep, reject, undecided)."""
    keep, reject = F.count_if(F.col("decision") == "keep"), F.count_if(F.col("decision") == "reject")
    return candidates.groupBy("session").agg(F.count("*").alias("total"), keep.alias("keep"), reject.alias("reject"), F.count_if(F.col("decision") == "").alias("undecided"))


def chip_counts(candidates: DataFrame) -> DataFrame:
    """The counts on the filter chips: keep and reject leave out what the pipeline rejected, unlike the views."""
    pick = F.col("rejected_reason") == ""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return candidates.groupBy("session").agg(
        n(pick, "all"), n(pick & (F.col("decision") == ""), "undecided"), n(pick & (F.col("decision") == "keep"), "keep"),
        n(pick & (F.col("decision") == "reject"), "reject"), n(~pick, "rejected_input"),
    )


def view(candidates: DataFrame, which: str) -> DataFrame:
    """The rows of a filter view."""
    pick, decision = F.col("rejected_reason") == "", F.col("decision")
    rules = {"all": pick, "undecided": pick & (decision == ""), "keep": decision == "keep", "reject": decision == "reject", "rejected-input": ~pick}
    if which not in rules:
        raise ValueError(f"view {which!r} is not one of {VIEWS}")
    return candidates.where(rules[which])


def exported(candidates: DataFrame, include_undecided: bool = True) -> DataFrame:
    return candidates.where(F.col("decision").isin(*(["keep", ""] if include_undecided else ["keep"])))


def export_manifest(candidates: DataFrame, copied: DataFrame) -> DataFrame:
    """(session, rank, filename, output_filename, score, decision) of copied(session, path, dest), ranked anew over what was copied."""
    rows = candidates.join(copied, ["session", "path"])
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy("idx")))
    said = F.when(F.col("decision") == "", F.lit("undecided")).otherwise(F.col("decision"))
    return ranked.select("session", "rank", "filename", F.element_at(F.split("dest", "/"), -1).alias("output_filename"), F.bround("score", 4).alias("score"), said.alias("decision"))


def override_stats(candidates: DataFrame) -> DataFrame:
    """(session, picks, kept, overridden, decided, rescued, rate, line); sessions without picks are left out. Undecided counts as kept."""
    pick = F.col("rejected_reason") == ""
    n = lambda cond, name: F.count_if(cond).alias(name)
    sums = candidates.groupBy("session").agg(
        n(pick, "picks"), n(pick & (F.col("decision") == "reject"), "overridden"), n(pick & (F.col("decision") != ""), "decided"), n(~pick & (F.col("decision") == "keep"), "rescued"),
    ).where("picks > 0")
    kept = F.col("picks") - F.col("overridden")
    rescued = F.when(F.col("rescued") > 0, F.concat(F.lit(" · rescued "), F.col("rescued").cast("string"), F.lit(" pipeline reject"), F.when(F.col("rescued") > 1, F.lit("s")).otherwise(F.lit("")))).otherwise(F.lit(""))
    percent = F.bround(F.col("overridden") / F.col("picks") * 100).cast("int")
    line = F.concat(F.lit("kept "), kept.cast("string"), F.lit("/"), F.col("picks").cast("string"), F.lit(" picks — "), percent.cast("string"), F.lit("% override"), rescued)
    return sums.select("session", "picks", kept.alias("kept"), "overridden", "decided", "rescued", F.bround(F.col("overridden") / F.col("picks"), 4).alias("rate"), line.alias("line"))


def override_aggregate(stats: DataFrame) -> DataFrame:
    """One row over the sessions with a decision: a pooled rate, not a mean of rates. Nulls where no session has one."""
    some = F.col("decided") > 0
    total = lambda c: F.sum(F.when(some, F.col(c)))
    return stats.agg(F.count_if(some).alias("sessions"), F.count_if(~some).alias("undecided_sessions"), total("picks").alias("picks"), total("overridden").alias("overridden"), total("rescued").alias("rescued")).withColumn("rate", F.bround(F.try_divide("overridden", "picks"), 4))


def group_key(path: Column, similar: Column) -> Column:
    """The identity of a candidate's group: the set of its paths."""
    return F.array_sort(F.array_distinct(F.concat(F.array(path), F.transform(similar, lambda s: s["path"]))))


def promoted(candidate: Column, member: Column) -> Column:
    """Swap the pick with similar[member]: struct<path, filename, score, similar>. Swapping again restores it."""
    old = F.struct(candidate["path"].alias("path"), candidate["filename"].alias("filename"), candidate["score"].alias("score"))
    new = F.get(candidate["similar"], member)
    similar = F.transform(candidate["similar"], lambda x, i: F.when(i == member, old).otherwise(x))
    return F.struct(new["path"].alias("path"), new["filename"].alias("filename"), new["score"].alias("score"), similar.alias("similar"))


def restore(fresh: DataFrame, saved: DataFrame) -> DataFrame:
    """fresh and saved candidates(session, path, filename, score, decision, similar, ...) of the same sessions -> fresh, with the
    saved decision and pick where exactly one saved group has the same paths. Saved files and scores are never taken over."""
    key = group_key(F.col("path"), F.col("similar"))
    once = saved.withColumn("_key", key).groupBy("session", "_key").agg(F.count("*").alias("_n"), F.first("path").alias("_path"), F.first("decision").alias("_saved")).where("_n = 1")
    rows = fresh.withColumn("_key", key).join(once.select("session", "_key", "_path", "_saved"), ["session", "_key"], "left")
    member = F.array_position(F.transform("similar", lambda s: s["path"]), F.col("_path")).cast("int") - 1
    here = F.struct("path", "filename", "score", "similar")
    pick = F.when(F.col("_path").isNotNull() & (F.col("_path") != F.col("path")), promoted(here, member)).otherwise(here)
    moved = rows.withColumn("_pick", pick).withColumn("decision", F.when(F.col("_saved").isin("keep", "reject", ""), F.col("_saved")).otherwise(F.col("decision")))
    return moved.withColumns({c: F.col(f"_pick.{c}") for c in ("path", "filename", "score", "similar")}).drop("_key", "_path", "_saved", "_pick")


def build_session(keepers: DataFrame, clusters: DataFrame, scored: DataFrame, rejects: DataFrame | None = None, each: int = SIMILAR_ROWS) -> DataFrame:
    """Candidates of a cull: its keepers, each with its near-duplicates, then its rejects (but not unreadable ones) if given.

    A candidate is a row for each `each` of its near-duplicates, numbered by chunk from 0, so that no row or task holds a cluster of any size.
    """
    chunk = F.floor((F.col("ord") - 1) / each).cast("int")
    members = clusters.join(scored.select(F.col("name").alias("loser"), "score"), "loser").withColumn("chunk", chunk)
    similar = members.groupBy("winner", "chunk").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("loser").alias("path"), F.col("loser").alias("filename"), "score"))).alias("m"))
    nested = similar.select(F.col("winner").alias("path"), "chunk", F.transform("m", lambda x: F.struct(x["path"].alias("path"), x["filename"].alias("filename"), x["score"].alias("score"))).alias("similar"))
    rows = keepers.select(F.col("name").alias("path"), "score", F.lit("").alias("rejected_reason"), F.lit(0).alias("part"), F.col("rank").cast("long").alias("at"))
    if rejects is not None:
        more = rejects.where("reason <> 'unreadable'").join(keepers.select("name"), "name", "left_anti").join(scored.select("name", "score"), "name", "left")
        rows = rows.unionByName(more.select(F.col("name").alias("path"), F.coalesce("score", F.lit(0.0)).alias("score"), F.col("reason").alias("rejected_reason"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("at")))
    none = F.array().cast("array<struct<path:string,filename:string,score:double>>")
    return rows.join(nested, "path", "left").select("path", F.col("path").alias("filename"), "score", F.lit("").alias("decision"), "rejected_reason", F.coalesce("similar", none).alias("similar"), "part", "at", F.coalesce("chunk", F.lit(0)).alias("chunk"))


def next_undecided(candidates: DataFrame, focus: Column) -> DataFrame:
    """(session, next_idx): the first undecided pick after the focus in index order, else from the start."""
    open_ = candidates.where((F.col("rejected_reason") == "") & (F.col("decision") == ""))
    return open_.groupBy("session").agg(F.min_by("idx", F.struct(F.col("idx") <= focus, F.col("idx"))).alias("next_idx"))


def bracketed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log(session, at, action, idx) -> what its decisions come to: (session, idx, decision) and what undo would still forget, (session, place, idx) with places from 1.

    keep, reject and clear set a decision and are remembered; undo forgets the last remembered one and clears its decision (it does not bring back the one
    before), and does nothing where none is remembered; reset forgets and clears all. Other actions, and decisions without an index, are passed over.

    Undo is a closing bracket: the height of the stack after each event is a running sum that never falls below zero, and an undo closes the decision that
    last rose to its height. At one height of one session decisions and undos alternate, so what an undo closes is the row before it there, and what is still
    open is the last row there if it is a decision. Heights and rows before come from ranges of events, so a session of any length meets in no task.
    """
    said, undo = F.col("action").isin("keep", "reject", "clear") & F.col("idx").isNotNull(), F.col("action") == "undo"
    events = log.select("session", "at", "action", "idx").where(said | undo | (F.col("action") == "reset"))
    placed = numbered(events, [F.col(c) for c in ("session", "at", "action", "idx")])
    live = running(placed, ["session"], (F.col("action") == "reset").cast("int"), "resets", reverse=True).where("resets = 0")
    summed = running(live, ["session"], F.when(undo, -1).otherwise(1), "sum").checkpoint()
    least = running(summed, ["session"], F.col("sum"), "least", "min", strict=True)
    floor = F.least(F.lit(0), F.coalesce("least", F.lit(0)))
    counted = least.where(~undo | (F.col("sum") >= floor)).withColumn("height", F.col("sum") - F.least(floor, F.col("sum")) + F.when(undo, 1).otherwise(0))
    levels = numbered(counted.select("session", "height", F.col("pos").alias("event"), "action", "idx"), [F.col("session"), F.col("height"), F.col("event")])
    closing = running(levels, ["session", "height"], F.col("idx"), "opened", "last", strict=True)
    touched = closing.select("session", F.when(undo, F.col("opened")).otherwise(F.col("idx")).alias("idx"), "event", F.when(F.col("action").isin("keep", "reject"), F.col("action")).otherwise(F.lit("")).alias("decision"))
    decided = touched.groupBy("session", "idx").agg(F.max_by("decision", "event").alias("decision"))
    top = levels.groupBy("session", "height").agg(F.max_by(F.struct("action", "idx"), "event").alias("last"))
    remembered = top.where("last.action <> 'undo'").select("session", F.col("height").cast("long").alias("place"), F.col("last.idx").alias("idx"))
    return decided, remembered


def fold_decisions(log: DataFrame) -> DataFrame:
    """log(session, at, action, idx) -> (session, decisions map<idx, decision>, history array<idx>), a row a session: `bracketed`, nested."""
    decided, remembered = bracketed(log)
    maps = decided.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("idx", "decision"))).alias("decisions"))
    stacks = remembered.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "idx"))), lambda x: x["idx"]).alias("history"))
    idx = log.schema["idx"].dataType.simpleString()
    none = F.create_map().cast(f"map<{idx},string>"), F.array().cast(f"array<{idx}>")
    rows = log.select("session").distinct()
    for more in (maps, stacks):  # a null session is one, too
        rows = rows.join(more.withColumnRenamed("session", "_s"), F.col("session").eqNullSafe(F.col("_s")), "left").drop("_s")
    return rows.select("session", F.coalesce("decisions", none[0]).alias("decisions"), F.coalesce("history", none[1]).alias("history"))
