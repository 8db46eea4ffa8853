"""Commands: cull a folder, pick by a profile, review a session. Thin wrappers; every step is a library call.

Exit codes: 1 for usage, configuration, an empty folder or a missing provider, 2 for an output that can't be written.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
import threading
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift import sinks
from lumisift.functions import codecs, text, xmp
from lumisift.operators import classify, gate, rank, rerank, review, rules, selection
from lumisift.plans import desk, profiles
from lumisift.plans.cull import TOP_N, cull
from lumisift.session import session
from lumisift.sources import frames as source
from lumisift.sources import cache, sessions
from lumisift.streaming import progress, watch


#: A score cache of more versions is compacted.
MANY_VERSIONS = 16


def _between(low: int, high: int):
    def number(said: str) -> int:
        if not said.lstrip("-").isdigit() or not low <= int(said) <= high:
            raise argparse.ArgumentTypeError(f"{said!r} is not a whole number from {low} to {high}")
        return int(said)

    return number


def _widths(said: str) -> list[int]:
    try:
        found = sorted({int(w) for w in said.split(",") if w.strip()})
    except ValueError:
        raise argparse.ArgumentTypeError(f"{said!r} is not a list of whole numbers") from None
    if any(w <= 0 for w in found):
        raise argparse.ArgumentTypeError("widths must be above 0")
    return found


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumisift", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("cull", help="the best n of a folder")
    two = sub.add_parser("pick", help="a profile's selection of a folder")
    for p in (one, two):
        p.add_argument("folder")
        p.add_argument("--output", help="write the chosen files here")
        p.add_argument("--overwrite", action="store_true", help="also into a folder that is not empty")
        p.add_argument("--manifest", help="write a JSON manifest to this path")
        p.add_argument("--json", action="store_true", help="print the result as JSON")
        p.add_argument("--jpg-quality", type=_between(1, 100), default=codecs.JPEG_QUALITY)
    one.add_argument("--top", type=_between(1, 5000), default=TOP_N)
    one.add_argument("--sharpness", type=float, default=gate.MIN_SHARPNESS)
    one.add_argument("--min-long-edge", type=int, default=gate.MIN_LONG_EDGE)
    one.add_argument("--sort", choices=rank.SORT_MODES, default="score")
    one.add_argument("--faces", metavar="MODULE:NAME", help="a function from a file's path to its faces' eyes; closed eyes cost score")
    one.add_argument("--prompt", help="rerank the keepers by a model's answers to this")
    one.add_argument("--client", metavar="MODULE:NAME", help="what makes the model's client")
    one.add_argument("--no-ai", action="store_true", help="no rerank even with a prompt")
    one.add_argument("--ai-workers", type=_between(1, 16), default=4)
    one.add_argument("--ai-max-attempts", type=_between(1, 10))
    one.add_argument("--xmp", action="store_true", help="write a star rating by rank into JPEG copies")
    one.add_argument("--session", action="store_true", help=f"write a review session, {desk.FILE}, into the folder")
    one.add_argument("--include-rejects", action="store_true", help="rejected frames are candidates of the session too")
    one.add_argument("--live-progress", action="store_true", help=f"show each step of the work, for {progress.BOUND} seconds at most, not only the start and end of a stage")
    one.add_argument("--progress-log", metavar="FOLDER", help="leave each step as a file of JSON there, for a stream to follow")
    one.add_argument("--resume", action="store_true", help="show the folder's session, if it has a usable one, instead of culling")
    two.add_argument("--profile")
    two.add_argument("--config", help="a JSON description of a profile")
    two.add_argument("--weight", action="append", default=[], metavar="NAME=VALUE", help="another weight of a rule for this run; 0 switches it off")
    two.add_argument("--classifier", metavar="MODULE:NAME", help="what makes the classifier; without one labels are uniform")
    two.add_argument("--cache", help="a Parquet table that keeps the classifier's answers")
    two.add_argument("--convert-heic", action=argparse.BooleanOptionalAction, default=True)
    two.add_argument("--rename-scheme", choices=selection.RENAME_SCHEMES, default="original")
    two.add_argument("--thumbnails", type=_widths, default=[], metavar="WIDTHS", help="such as 400,800")
    two.add_argument("--webp", action="store_true", help="a WebP file beside each output")
    two.add_argument("--webp-quality", type=_between(1, 100), default=codecs.WEBP_QUALITY)
    two.add_argument("--benchmark", action="store_true", help="show what each rule added to each pick")
    two.add_argument("--dry-run", action="store_true", help="uniform labels, and nothing is written")
    sub.add_parser("profiles", help="list profiles")
    three = sub.add_parser("review", help="decide, swap, undo and export in a folder's session")
    three.add_argument("folder")
    three.add_argument("action", choices=[*desk.ACTIONS, "swap", "export", "stats"])
    three.add_argument("args", nargs="*", help="an index; for swap an index and a member; for export a folder")
    four = sub.add_parser("overrides", help="how often reviewers overrule the picks, over sessions")
    four.add_argument("folders", nargs="*")
    four.add_argument("--root")
    four.add_argument("--file-name", default=desk.FILE)
    return top


def _provider(named: str):
    """What MODULE:NAME names, called if it is a class."""
    module, sign, name = named.partition(":")
    if not sign:
        raise ValueError(f"{named!r} is not MODULE:NAME")
    found = getattr(importlib.import_module(module), name)
    return found() if isinstance(found, type) else found


def fs_path(uri: str) -> str:
    """The path that a URI's file system knows it by."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)[1]


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return source.with_capture_time(source.hashed(source.scan_folder(spark, folder, codecs.decoders())), spark, folder)


def _say(line: str) -> None:
    print(line, file=sys.stderr)


def _write_json(path: str, said: dict) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(said, f, indent=2, sort_keys=True)


def _written(spark: SparkSession, picks: DataFrame, folder: str, overwrite: bool, encoders: dict) -> dict[str, str]:
    """Write files; names to output paths. OSError if none could be written."""
    sinks.guard_output(spark, folder, overwrite)
    report = sinks.write_files(picks, _uri(folder), encoders).collect()  # as few as the picks
    for r in report:
        if not r.ok:
            _say(f"  could not write {r.name}: {r.error}")
    done = {r.name: r.output_path for r in report if r.ok}
    if report and not done:
        raise OSError("nothing could be written")
    _say(f"wrote {len(done)} of {len(report)} files to {folder}")
    return done


@contextmanager
def _followed(spark: SparkSession, args):
    """A watch whose stages are shown on standard error: their starts and ends, or with --live-progress each step."""
    keep = watch.log_to(_uri(args.progress_log)) if args.progress_log else lambda state: None

    def tell(state: dict) -> None:
        keep(state)
        if not args.live_progress and not state["finished"] and state["done"] in (0, state["total"]):
            _say(f"  {state['stage']}: {state['done']}/{state['total']}")

    broker = watch.Broker(args.folder, tell)

    def show() -> None:
        for state in broker.states(progress.BOUND):
            _say(f"  {'finished' if state['finished'] else state['stage']}: {state['done']}/{state['total']}")

    shown = threading.Thread(target=show, daemon=True)
    if args.live_progress:
        shown.start()
    try:
        yield watch.Watch(spark, broker)
    except BaseException:
        broker.update("error", 0, 0)
        raise
    finally:
        broker.finish()
        if args.live_progress:
            shown.join()


def _cull(spark: SparkSession, args) -> int:
    with _followed(spark, args) as followed:
        return _culled(spark, args, followed)


def _culled(spark: SparkSession, args, followed: watch.Watch) -> int:
    saved = f"{_uri(args.folder)}/{desk.FILE}"
    if args.resume and (held := desk.Store(saved).newest()[1]):
        said = {"source_folder": held["source_folder"], "prompt": held["prompt"], "counts": held["counts"]}
        print(json.dumps(said) if args.json else f"resumed: {said['counts']}")
        return 0
    frames = _frames(spark, args.folder).persist()  # pixels are read once; grids are small
    with followed.stage("scan"):
        if not frames.count():
            raise ValueError(f"no images in {args.folder}")
    client = _provider(args.client) if args.prompt and not args.no_ai and args.client else None
    if args.prompt and not args.no_ai and client is None:
        raise ValueError("a prompt needs a --client, or --no-ai")
    faces = classify.faces(frames, _provider(args.faces), "path") if args.faces else None
    if faces is not None:
        faces = faces.withColumnRenamed("name", "path").join(frames.select("path", "name"), "path")
    with followed.stage("dedup"):
        done = cull(frames, args.top, args.sharpness, args.min_long_edge, args.sort, faces=faces)
    keepers = done.keepers.withColumns({"ai_score": F.lit(None).cast("int"), "ai_reason": F.lit(None).cast("string")})
    if client is not None:
        asked = done.keepers.join(sinks.resized(spark, args.folder, done.keepers.select("name")), "name")
        ranked = rerank.rerank(asked, client, args.prompt, attempts=args.ai_max_attempts, workers=args.ai_workers)
        keepers = ranked.drop("rank").withColumnRenamed("ai_rank", "rank")
    with followed.stage("select" if client is None else "rerank"):
        rows = sorted(keepers.select("rank", "name", "path", "score", text.iso(F.col("capture_time")).alias("taken"), "ai_score", "ai_reason").collect())  # the best n
    counts, inputs = {r.reason: r.n for r in done.reject_counts().collect()}, done.input_count().first()[0]
    ai = {r.name: {"score": r.ai_score, "reason": r.ai_reason} for r in rows if r.ai_score is not None}
    said = {"folder": args.folder, "top": args.top, "keepers": [r.name for r in rows], "scores": {r.name: round(r.score, 4) for r in rows}, "ai_scores": ai, "reject_counts": counts}
    print(json.dumps(said) if args.json else sinks.summary(counts, len(rows), inputs) + "".join(f"\n{r['rank']:4d} {r.score:.4f} {r.name}" for r in rows))
    if args.output:
        encoders = codecs.jpeg_encoders(args.jpg_quality)
        rating = xmp.star_rating(F.col("rank"), F.lit(len(rows))) if args.xmp else F.lit(None).cast("int")
        name = selection.output_name(F.col("name"), F.lit(""), F.lit(1), F.lit(1), F.lit(1), "original", bool(encoders))
        picks = spark.createDataFrame([(r.name, r.path, r["rank"]) for r in rows], "name string, path string, rank int").select("name", "path", name.alias("output_filename"), rating.alias("rating"))
        with followed.stage("write"):
            _written(spark, picks, args.output, args.overwrite, encoders)
    if args.manifest:
        picks = [{"rank": r["rank"], "filename": r.name, "path": r.path, "score": round(r.score, 4), "capture_time": r.taken} | ({"ai_score": r.ai_score, "ai_reason": r.ai_reason} if r.ai_score is not None else {}) for r in rows]
        _write_json(args.manifest, {"folder": args.folder, "generated_at": datetime.now(timezone.utc).isoformat(), "top": args.top, "prompt": args.prompt or "", "reject_counts": counts, "input_count": inputs, "picks": picks})
    if args.session:
        built = review.build_session(keepers, done.clusters, done.scored, done.rejects if args.include_rejects else None)
        more = spark.createDataFrame([(r.name, r.taken, r.ai_score, r.ai_reason or "") for r in rows], "_name string, capture_time string, ai_score int, ai_reason string")
        named = built.select(F.explode(F.concat(F.array("path"), F.transform("similar", lambda s: s["path"]))).alias("name")).distinct()
        known = {r.name: r.path for r in frames.join(named, "name").select("name", "path").collect()}  # candidates and their like
        session_ = desk.built(args.folder, args.prompt or "", inputs, counts, built.join(more, F.col("path") == F.col("_name"), "left").drop("_name"))
        for c in session_["candidates"]:
            c["path"], c["ai_reason"] = known.get(c["path"], c["path"]), c["ai_reason"] or ""
            c["similar"] = [s | {"path": known.get(s["path"], s["path"])} for s in c["similar"]]
        desk.Store(saved).put(session_)
    frames.unpersist()
    done.survivors.unpersist()
    return 0


def _profile(args) -> profiles.Profile:
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            profile = profiles.register(profiles.from_config(json.load(f)))
        profile = profiles.get(args.profile) if args.profile else profile
    else:
        profile = profiles.get(args.profile or "default")
    weights = rules.parse_weights(args.weight)
    return profile.reweighted(weights) if weights else profile


def _pick(spark: SparkSession, args) -> int:
    profile = _profile(args)
    frames = _frames(spark, args.folder)
    if frames.isEmpty():
        raise ValueError(f"no images in {args.folder}")
    labels = profile.labels or ("any",)
    classifier = _provider(args.classifier) if args.classifier and not args.dry_run else classify.Stub()
    if args.cache and not args.dry_run:
        key = sessions.cache_key(F.col("path"), F.col("modified"), F.col("bytes"), F.array(*[F.lit(x) for x in labels]))
        keyed = frames.join(source.file_facts(spark, args.folder), "name").withColumn("cache_key", key).drop("modified", "bytes")
        probed, fresh = classify.classify_cached(keyed, classifier, labels, cache.read(spark, args.cache))
        probed, fresh = probed.drop("cache_key").persist(), fresh.persist()
        probed.count()  # before the table it reads is written
        if not fresh.isEmpty():
            cache.append(fresh, args.cache)
            if len(cache.live(spark, args.cache)) > MANY_VERSIONS:
                cache.compact(spark, args.cache)
    else:
        probed = classify.classify(frames, classifier, labels)
    probed = probed.persist()
    chosen = profile.select(probed)
    picked = selection.global_rank(chosen.picked).join(probed.select("name", "path", "width", "height", "capture_time"), "name").persist()
    total = picked.count()
    rows = picked.select("name", "category", "rank", "global_rank", "path", "width", "height", text.iso(F.col("capture_time")).alias("taken")).orderBy("global_rank").collect()  # capped
    counts = {r.reason: r.n for r in chosen.reject_counts().collect()} if chosen.rejected is not None else {}
    said = {"profile": profile.name, "source": args.folder, "selection": [(r.category, r["rank"], r.name) for r in rows], "reject_counts": counts}
    if args.benchmark:
        explained = chosen.explained_picks().collect() if chosen.explain is not None else []
        said["benchmark"] = {r.name: {"quality": r.breakdown.quality, "contributions": r.breakdown.contributions, "total": r.breakdown.total} for r in explained}
    if args.json:
        print(json.dumps(said))
    else:
        print("\n".join([("[dry-run] " if args.dry_run else "") + f"{profile.name}: {total} picks", *(f"  {r.category} {r['rank']} {r.name}" for r in rows)]))
        for name, b in said.get("benchmark", {}).items():
            print(f"  {name}: {b['quality']:.4f}" + "".join(f" {k} {v:+.4f}" for k, v in b["contributions"].items()) + f" = {b['total']:.4f}")
        if args.benchmark and not said["benchmark"]:
            print("  this profile gives no breakdown")
    if args.dry_run:
        if args.output:
            _say(f"[dry-run] would write {total} files to {args.output}")
        if args.manifest:
            _say(f"[dry-run] would write {args.manifest}")
        return 0
    outputs: dict[str, str] = {}
    thumbs: dict[str, dict[str, str]] = {}
    webps: dict[str, str] = {}
    if args.output:
        encoders = codecs.jpeg_encoders(args.jpg_quality) if args.convert_heic else {}
        name = selection.output_name(F.col("name"), F.col("category"), F.col("rank"), F.col("global_rank"), F.lit(total), args.rename_scheme, bool(encoders))
        picks = picked.select("name", "path", F.concat("category", F.lit("/"), name).alias("output_filename"), F.lit(None).cast("int").alias("rating"))
        outputs = _written(spark, picks, args.output, args.overwrite, encoders)
        root = _uri(args.output).rstrip("/")
        stems = {k: v.rpartition(".")[0][len(fs_path(root)) + 1 :] for k, v in outputs.items()}
        if args.thumbnails:
            beside = spark.createDataFrame(sorted(stems.items()), "name string, stem string")
            for r in sinks.write_thumbnails(spark, args.folder, beside, args.thumbnails, _uri(args.output)).collect():  # a row a file
                thumbs.setdefault(r.name, {})[str(r.width)] = r.output_path
        if args.webp:
            encoder = codecs.webp_encoder(args.webp_quality)
            if encoder is None:
                _say("  no WebP encoder is installed; none are written")
            else:
                renamed = picks.where(F.col("name").isin(*outputs)).withColumn("output_filename", F.concat(text.stem(F.col("output_filename")), F.lit(".webp")))
                webps = {r.name: r.output_path for r in sinks.write_files(renamed, _uri(args.output), dict.fromkeys(text.SCANNED, encoder)).collect() if r.ok}
    if args.manifest:
        last = lambda path: path.rpartition("/")[2]
        picks = []
        for r in rows:
            size = {"width": r.width, "height": r.height} if r.width is not None else None
            pick = {"category": r.category, "rank": r["rank"], "filename": r.name, "path": r.path, "capture_time": r.taken, "dimensions": size}
            if r.name in outputs:
                pick |= {"output_path": outputs[r.name], "output_filename": last(outputs[r.name])}
            if r.name in thumbs:
                pick["thumbnails"] = {w: last(p) for w, p in sorted(thumbs[r.name].items())}
            if r.name in webps:
                pick |= {"output_webp": webps[r.name], "output_webp_filename": last(webps[r.name])}
            picks.append(pick)
        _write_json(args.manifest, {"profile": profile.name, "source": args.folder, "generated_at": datetime.now(timezone.utc).isoformat(), "picks": picks, "reject_counts": counts})
    return 0


def _review(spark: SparkSession, args) -> int:
    path = f"{_uri(args.folder)}/{desk.FILE}"
    held = desk.Store(path).newest()[1]
    if held is None:
        raise ValueError(f"no usable session in {args.folder}")
    if args.action == "export":
        if len(args.args) != 1:
            raise ValueError("export needs a folder")
        wrote, failed = desk.export(spark, held, _uri(args.args[0]))
        print(f"wrote {wrote}, failed {failed}")
        return 0 if wrote or not failed else 2
    if args.action == "stats":
        found = review.override_stats(desk.candidates(spark, held)).first()
        print(found.line if found else "no picks")
        return 0
    try:
        held = desk.Store(path).change(args.action, *[int(x) for x in args.args[:2]])
    except desk.SaveError as error:
        raise OSError(str(error)) from error
    print(json.dumps(held["counts"]))
    return 0


def _overrides(spark: SparkSession, args) -> int:
    rows = sessions.candidates(sessions.read_sessions(spark, *args.folders, root=args.root, file_name=args.file_name))
    stats = review.override_stats(rows).persist()
    for r in stats.orderBy("session").collect():  # a row a session file
        print(f"{r.session}: {r.line}")
    print(json.dumps(review.override_aggregate(stats).first().asDict()))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as done:
        return 0 if done.code in (0, None) else 1
    if args.command == "profiles":
        print("\n".join(profiles.names()))
        return 0
    try:
        return {"cull": _cull, "pick": _pick, "review": _review, "overrides": _overrides}[args.command](session(), args)
    except (ValueError, KeyError, NotADirectoryError, FileNotFoundError, ImportError, AttributeError) as error:
        _say(str(error))
        return 1
    except OSError as error:
        _say(str(error))
        return 2


if __name__ == "__main__":
    sys.exit(main())
