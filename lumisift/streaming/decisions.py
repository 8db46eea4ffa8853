"""Review decisions as a stream: the same fold as review.fold_decisions, kept as state by session."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from lumisift.shipping import ship

ship(__name__)

ACTIONS = ("keep", "reject", "clear", "undo", "reset")


def applied(decisions: dict[int, str], history: list[int], action: str, idx: int | None) -> None:
    """One event on a session's state, in place."""
    if action == "reset":
        decisions.clear()
        history.clear()
    elif action == "undo":
        if history:
            decisions[history.pop()] = ""
    elif action in ACTIONS:
        decisions[idx] = "" if action == "clear" else action
        history.append(idx)


def decision_stream(log: DataFrame) -> DataFrame:
    """log(session, at long, action, idx) -> after each micro-batch (session, version, decisions map, history array) of the sessions it touched."""

    def step(key, frames: Iterator, state):
        import pandas as pd

        decisions, history, version = {}, [], 0
        if state.exists:
            kept, version = state.get
            said = json.loads(kept)
            decisions, history = {int(k): v for k, v in said["decisions"].items()}, said["history"]
        for row in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.at):
            applied(decisions, history, row.action, None if pd.isna(row.idx) else int(row.idx))
        version += 1
        kept = json.dumps({"decisions": decisions, "history": history})
        state.update((kept, version))
        yield pd.DataFrame({"session": [key[0]], "version": [version], "kept": [kept]})

    said = log.groupBy("session").applyInPandasWithState(step, "session string, version long, kept string", "kept string, version long", "update", "NoTimeout")
    state = F.from_json("kept", "decisions map<string,string>, history array<int>")
    return said.select("session", "version", F.transform_keys(state["decisions"], lambda k, _: k.cast("int")).alias("decisions"), state["history"].alias("history"))
