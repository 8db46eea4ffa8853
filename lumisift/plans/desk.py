"""The review desk: a session file and what a reviewer does to it, each change saved before it counts.

A session is a dictionary as in `sources.sessions.SESSION`: candidates by index, the history of decisions, and counts. It holds the
keepers of one cull, so it is small; decisions over many sessions are `operators.review` and `streaming.decisions`.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift import sinks
from lumisift.functions import xmp
from lumisift.operators import review
from lumisift.sources import sessions
from lumisift.streaming.decisions import applied

FILE = "lumisift-session.json"
ACTIONS = ("keep", "reject", "clear", "undo", "reset")


class SaveError(RuntimeError):
    """A change could not be saved, and was taken back."""


def counted(session: dict) -> dict:
    said = [c["decision"] for c in session["candidates"]]
    counts = {"total": len(said), "keep": said.count("keep"), "reject": said.count("reject"), "undecided": said.count("")}
    return session | {"counts": counts}


def built(folder: str, prompt: str, input_count: int, reject_summary: dict[str, int], rows: DataFrame) -> dict:
    """The session of `review.build_session`'s candidates: part and at order them; ai_score, ai_reason and capture_time if they have them."""
    fields = sessions.CANDIDATE[len("struct<") : -1]
    names = [x.split(" ")[0] for x in fields.replace(sessions.SIMILAR, "similar").split(", ")]
    found: list[dict] = []
    for r in sorted((r.asDict(recursive=True) for r in rows.collect()), key=lambda r: (r["part"], r["at"], r["path"], r["chunk"])):  # keepers, and rejects if asked for
        if r.get("chunk"):
            found[-1]["similar"] += r["similar"]
        else:
            found.append(r)
    none = {"ai_score": None, "ai_reason": "", "capture_time": None}
    candidates = [{k: ({"idx": n} | none | r).get(k) for k in names} for n, r in enumerate(found)]
    return counted({"source_folder": folder, "prompt": prompt, "input_count": input_count, "reject_summary": reject_summary, "candidates": candidates, "history": []})


def load(path: str) -> dict | None:
    """The session of a file, or None where there is none that can be used."""
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path)
    try:
        with files.open_input_stream(at) as f:
            said = json.loads(f.read())
        wanted = ("idx", "path", "filename", "score", "decision", "rejected_reason", "similar")
        ok = said["candidates"] and all(isinstance(c, dict) and all(k in c for k in wanted) for c in said["candidates"])
        return counted({"history": [], "source_folder": "", "prompt": "", "input_count": 0, "reject_summary": {}} | said) if ok else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def after(session: dict, action: str, idx: int | None = None, member: int | None = None) -> dict:
    """The session after an action. Undo clears the last decision; swap makes similar frame `member` the pick."""
    new = copy.deepcopy(session)
    if action in ("keep", "reject", "clear", "swap") and (idx is None or not 0 <= idx < len(new["candidates"])):
        raise ValueError(f"no candidate {idx}")
    if action == "swap":
        c = new["candidates"][idx]
        if member is None or not 0 <= member < len(c["similar"]):
            raise ValueError(f"candidate {idx} has no similar frame {member}")
        old = {k: c[k] for k in ("path", "filename", "score")}
        c.update({k: c["similar"][member][k] for k in old})
        c["similar"][member] = old
    elif action in ACTIONS:
        decisions = {c["idx"]: c["decision"] for c in new["candidates"]}
        applied(decisions, new["history"], action, idx)
        for c in new["candidates"]:
            c["decision"] = decisions.get(c["idx"], "")
    else:
        raise ValueError(f"{action!r} is not one of {(*ACTIONS, 'swap')}")
    return counted(new)


def changed(session: dict, path: str, action: str, idx: int | None = None, member: int | None = None) -> dict:
    """The session after an action, saved."""
    new = after(session, action, idx, member)
    try:
        sinks.save_session(path, new)
    except OSError as error:
        raise SaveError(f"{path} could not be written, so nothing is changed: {error}") from error
    return new


class Store:
    """A session that several reviewers change: a numbered snapshot with each change, in a folder beside the session file, and the file itself as the newest.

    A change is made on the newest snapshot and counts once it has claimed the next number; who comes second makes the change again on what the first has left, so no event is
    lost. The snapshots' events are the log, and any of them can be gone back to, as a change of its own.
    """

    def __init__(self, path: str, attempts: int = 100):
        self.path, self.folder, self.attempts = path, f"{path}.versions", attempts

    def numbers(self) -> list[int]:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.folder)
        found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(int(f.base_name[1:-5]) for f in found if f.base_name.startswith("v") and f.base_name.endswith(".json"))

    def _read(self, number: int) -> dict:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(f"{self.folder}/v{number:08}.json")
        with files.open_input_stream(at) as f:
            return json.loads(f.read())

    def newest(self) -> tuple[int, dict | None]:
        """The newest snapshot's number and session; 0 and the session file's before the first change. No session where the file is gone or broken."""
        numbers, file = self.numbers(), load(self.path)
        return (numbers[-1], self._read(numbers[-1])["session"] if file else None) if numbers else (0, file)

    def events(self) -> list[dict]:
        return [self._read(k)["event"] for k in self.numbers()]

    def _claimed(self, event: dict, make) -> dict:
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(self.folder)
        files.create_dir(at, recursive=True)
        for _ in range(self.attempts):
            number, held = self.newest()
            new = make(held)
            try:
                if sinks.claim(f"{self.folder}/v{number + 1:08}.json", json.dumps({"event": event, "session": new}).encode()):
                    sinks.save_session(self.path, self._read(self.numbers()[-1])["session"])  # perhaps one that is newer still
                    return new
            except OSError as error:
                raise SaveError(f"{self.path} could not be written, so nothing is changed: {error}") from error
        raise SaveError(f"{self.path} is changed too often by others")

    def change(self, action: str, idx: int | None = None, member: int | None = None) -> dict:
        """The session after an action on its newest state, saved."""
        def make(held: dict | None) -> dict:
            if held is None:
                raise ValueError(f"no usable session in {self.path}")
            return after(held, action, idx, member)

        return self._claimed({"action": action, "idx": idx, "member": member}, make)

    def put(self, session: dict) -> dict:
        """A whole session, as of a new cull, in place of the newest."""
        return self._claimed({"action": "put"}, lambda _: counted(session))

    def back_to(self, number: int) -> dict:
        """The session as it was in a snapshot, saved as its newest."""
        return self._claimed({"action": "back", "to": number}, lambda _: self._read(number)["session"])


def candidates(spark: SparkSession, session: dict) -> DataFrame:
    rows = [tuple(c.get(k) for k in ("idx", "path", "filename", "score", "decision", "rejected_reason")) for c in session["candidates"]]
    return spark.createDataFrame([("", *r) for r in rows], "session string, idx int, path string, filename string, score double, decision string, rejected_reason string")


def export(spark: SparkSession, session: dict, target: str, include_undecided: bool = True) -> tuple[int, int]:
    """Write the kept files, with a rating by rank, and export-manifest.json into a folder: (written, failed)."""
    from pyarrow import fs

    rows = review.exported(candidates(spark, session), include_undecided)
    total = rows.count()
    ranked = rows.withColumn("name", F.col("filename")).withColumn("rank", F.expr("row_number() OVER (ORDER BY idx)"))  # a reviewer's picks
    report = sinks.write_files(ranked.select("name", "path", F.col("filename").alias("output_filename"), xmp.star_rating(F.col("rank"), F.lit(total)).alias("rating")), target).collect()
    done = {(r.name, r.output_path) for r in report if r.ok}
    copied = rows.select("session", "path", "filename").distinct().join(spark.createDataFrame(sorted(done), "filename string, dest string"), "filename").select("session", "path", "dest")
    picks = [r.asDict() for r in review.export_manifest(rows, copied).drop("session").orderBy("rank").collect()]
    files, at = fs.FileSystem.from_uri(target)
    with files.open_output_stream(f"{at}/export-manifest.json") as f:
        f.write(json.dumps({"source_folder": session["source_folder"], "picks": picks}, indent=2).encode())
    return sum(r.ok for r in report), sum(not r.ok for r in report)
