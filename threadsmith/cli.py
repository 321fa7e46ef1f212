"""Command-line runner: one batch run, a stream run, a state reset or an
export of stored stories.  Options mirror the original tool's; every other
detail lives in ``CurationConfig``.

    python -m threadsmith run --pages crawl.parquet --out out/ [--authors A B]
    python -m threadsmith stream --landing landing/ --out out/
    python -m threadsmith clear --out out/
    python -m threadsmith export --out out/ [--html-dir dir] [--files f1 f2]
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .config import DEFAULT_IDENTIFIERS, CurationConfig


def _config(a) -> CurationConfig:
    return CurationConfig(
        extra_authors=tuple(a.authors or ()), identifiers=tuple(a.identifiers or DEFAULT_IDENTIFIERS),
        match_author_root=not a.no_match_author, all_posts=a.all_posts, resize_images=not a.no_resize_images,
        download_images=a.download_images, use_state=not a.no_database, dedup_as_coded=a.dedup_as_coded,
        identifier_rescues_short=a.identifier_rescues_short, resume_as_coded=not a.resume_intent,
        dedup_across_runs=a.dedup_across_runs)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="threadsmith")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("run", "stream"):
        s = sub.add_parser(name)
        if name == "run":
            s.add_argument("--pages", required=True, help="parquet: topic_id, link, page_no, html[, status, attempt]")
            s.add_argument("--run-id", help="name of the run; a run of the same name replaces what it wrote")
        else:
            s.add_argument("--landing", required=True, help="folder where crawled page files land")
        s.add_argument("--out", required=True)
        s.add_argument("--authors", nargs="+")
        s.add_argument("-i", "--identifiers", nargs="+")
        s.add_argument("--all-posts", action="store_true")
        s.add_argument("--no-match-author", action="store_true")
        s.add_argument("--no-resize-images", action="store_true")
        s.add_argument("--download-images", action="store_true")
        s.add_argument("--no-database", action="store_true")
        s.add_argument("--dedup-as-coded", action="store_true")
        s.add_argument("--dedup-across-runs", action="store_true")
        s.add_argument("--identifier-rescues-short", action="store_true")
        s.add_argument("--resume-intent", action="store_true")
        s.add_argument("--image-targets", help="parquet of image-host pages: url, html")
        s.add_argument("--asset-manifest", help="parquet: file_name, url, status, final_url")
        s.add_argument("--fetch-status", help="parquet: url, status, final_url, fetch_error")
        s.add_argument("--snapshots", help="parquet: url, archive_url, snapshot_ts, status")
    c = sub.add_parser("clear")
    c.add_argument("--out", required=True)
    e = sub.add_parser("export")
    e.add_argument("--out", required=True)
    e.add_argument("--html-dir")
    e.add_argument("--files", nargs="+")
    return p


def _image_inputs(spark, a) -> dict:
    """The image tables named by the options; half-given ones are refused."""
    from .operators import extract as X
    from .plans import curate
    given = [a.asset_manifest, a.fetch_status, a.snapshots]
    if a.download_images != any(given) or any(given) != all(given):
        raise SystemExit("--download-images needs --asset-manifest, --fetch-status and --snapshots, and they need it")
    if a.image_targets and a.no_resize_images:
        raise SystemExit("--image-targets has no use with --no-resize-images")
    return {"image_targets": X.image_targets(spark.read.parquet(a.image_targets)) if a.image_targets else None,
            "assets": curate.AssetInputs(*map(spark.read.parquet, given)) if a.download_images else None}


def run_batch(spark, a) -> dict:
    from .operators import extract as X
    from .operators import ledger as L
    from .operators import state as ST
    from .plans import curate, outputs
    from .session import release_scratch, scratch_mark
    from .sources.stories import StoryStore
    cfg = _config(a)
    base = a.out.rstrip("/")
    mark = scratch_mark()
    pages = spark.read.parquet(a.pages)
    store = StoryStore(spark, f"{base}/story_table")
    before = ST.latest_version(spark, f"{base}/state") or 0
    # with state, a run that was ended before it wrote the state is tried again under its own name
    run_id = a.run_id or (f"state-{before + 1}" if cfg.use_state else None)
    seq = store.sequence(run_id)
    stems = store.commits().filter(F.col("run_seq") != seq).select(F.col("story").alias("file_path"))
    have = {}
    if cfg.use_state:
        waiting = f"{base}/waiting/version={before}"
        have = {"state": ST.read_state(spark, f"{base}/state"), "ledger": L.ledger_log(spark, f"{base}/ledger").read(before),
                "waiting": spark.read.schema(X.WAITING_SCHEMA).parquet(waiting) if outputs.exists(spark, waiting)
                else spark.createDataFrame([], X.WAITING_SCHEMA)}
    earlier = None
    if cfg.dedup_across_runs:
        earlier = outputs.first_keys_of(spark, base, curate.prepare_pages(
            pages, ST.empty_state(spark), cfg.with_(use_state=False)), before)
    out = curate.run(spark, pages, cfg, run_id=run_id or f"run-{seq}", existing_stems=stems, earlier_keys=earlier,
                     **_image_inputs(spark, a), **have)
    done = outputs.write_run(spark, base, out, cfg, before + 1, f"run_seq={seq}", run_id, earlier)
    release_scratch(spark, mark)       # outputs are committed: drop this run's intermediate tables
    return {"run_seq": done}


def run_export(spark, a) -> dict:
    """Documents of the run's own stories, and stored ones named by the user."""
    from .sources import stories as SS
    base = a.out.rstrip("/")
    store = SS.StoryStore(spark, f"{base}/story_table")
    files = []
    if store.runs():
        files.append(SS.write_named(SS.whole_documents(store), f"{base}/export"))
        posts = spark.read.parquet(f"{base}/story_posts").filter(F.col("run_seq").isin(store.runs()))
        files.append(SS.write_named(SS.big_parts(store, posts, CurationConfig()), f"{base}/export"))
    if a.html_dir or a.files:
        normal, big = SS.split_big(SS.documents(spark, a.html_dir, a.files))
        files.append(SS.write_named(normal, f"{base}/export"))
        parts = SS.export_parts(big).join(big.select("path", "name"), "path")
        step = SS.BLOCKS_PER_PART
        files.append(SS.write_named(parts.select(F.concat(
            F.col("name"), F.lit("-part-"), (F.col("part_no") * step).cast("string"), F.lit("-to-"),
            ((F.col("part_no") + 1) * step).cast("string")).alias("name"), "html"), f"{base}/export"))
    if not files:
        raise ValueError(f"no stories in {base}")
    return {"files": sum(f.count() for f in files)}


def main(argv=None, spark=None) -> int:
    a = _parser().parse_args(argv)
    if spark is None:
        from .session import build_session
        spark = build_session()
    from .operators import state as ST
    out_dir = a.out.rstrip("/")
    if a.cmd == "clear":
        from .operators import dedup as D
        from .operators import ledger as L
        at = (ST.latest_version(spark, f"{out_dir}/state") or 0) + 1
        L.ledger_log(spark, f"{out_dir}/ledger").replace(L.empty_ledger(spark), at)
        D.first_key_log(spark, f"{out_dir}/first_keys").replace(spark.createDataFrame([], D.FIRST_KEYS), at)
        ST.clear_state(spark, f"{out_dir}/state")
    elif a.cmd == "run":
        run_batch(spark, a)
    elif a.cmd == "stream":
        from .streaming.ingest import page_ingest
        schema = spark.read.parquet(a.landing).schema
        page_ingest(spark, a.landing, schema, out_dir, _config(a), **_image_inputs(spark, a))
    elif a.cmd == "export":
        run_export(spark, a)
    return 0
