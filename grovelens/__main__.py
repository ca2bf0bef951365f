"""python -m grovelens VERB [PATH]: the verbs on the command line. Exit code 1 on faults, conflicts, and what a check finds."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from grovelens.operators import drift, state
from grovelens.plans import verbs
from grovelens.sources.config import ConfigError
from grovelens.sources.store import StoreError


def session() -> SparkSession:
    spark = SparkSession.builder.appName("grovelens").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def generate(spark: SparkSession, mode: str, args: argparse.Namespace) -> int:
    only_check = getattr(args, "check", False)
    dry_run = mode == "try" or getattr(args, "dry_run", False)
    report = verbs.run(spark, args.path, mode, preview=dry_run or only_check, force=getattr(args, "force", False))
    for warning in report.refresh.warnings:
        print(f"warning: {warning}", file=sys.stderr)
    if not report.config.found and not only_check and mode != "try":
        print("No .grovelens/config.yaml — using defaults (run `grovelens init` to customise artifacts and modules).")
    print(verbs.describe_changes(report))
    pending, attention = report.pending_writes(), report.needs_attention()
    if dry_run:
        for text in verbs.diffs(report.results):
            print(text)
    if pending or attention:
        print("Out of date:" if only_check else "Would write:" if dry_run else "Artifacts:")
        print("\n".join(verbs.describe_results(report)))
    else:
        print(f"All {report.results.count()} artifacts are up to date.")
    if only_check:
        return int(pending or attention)
    if mode == "try":
        print("Nothing was written. To adopt: `grovelens init`, then `grovelens analyze`.")
        return 0
    for row in state.lapsed(report.conventions).collect():
        print(f'warning: confirmed convention no longer holds and is no longer emitted: "{row.statement}" ({row.id})', file=sys.stderr)
    if waiting := state.pending_count(report.conventions):
        print(f"{waiting} convention candidate{'' if waiting == 1 else 's'} awaiting review — run `grovelens review conventions`.")
    found = verbs.find_drift(spark, args.path, report)
    if n := found.count():
        print(f"Hand-written docs: {n} statement(s) no longer match the code, e.g.")
        print("\n".join(f"  {r.message}" for r in drift.message(found.limit(verbs.REMINDER)).collect()))
    return int(attention)


def check(spark: SparkSession, args: argparse.Namespace) -> int:
    said = verbs.check(spark, args.path)
    if args.json:
        print(json.dumps(said, indent=2, ensure_ascii=False))
        return int(not said["ok"])
    print("Generated sections: out of date. Run `grovelens sync`." if said["stale"] else "Generated sections: up to date.")
    for item in said["stale"]:
        print(f"  {item['action']:<10} {item['path']}  {item['error'] or ', '.join(r['id'] for r in item['regions'])}")
    print(f"Hand-written docs: {len(said['drift'])} statement(s) no longer match the code." if said["drift"] else "Hand-written docs: every command, path, link and code name they mention exists.")
    for f in said["drift"]:
        hint = f" (did you mean `{f['suggestion']}`?)" if f["suggestion"] else ""
        print(f"  {f['file']}:{f['line']}  `{f['reference']}`: {f['message']}{hint}")
    return int(not said["ok"])


def review(spark: SparkSession, args: argparse.Namespace) -> int:
    store, pending = verbs.pending_reviews(spark, args.path)
    asked, tally = pending.collect(), {"confirmed": 0, "rejected": 0, "skipped": 0}
    if not asked:
        print("No pending conventions. Only patterns that at least 80% of 3 or more files follow are proposed.")
        return 0
    lines = iter(sys.stdin)
    for row in asked:
        print(row.prompt)
        line = next(lines, None)
        if line is None:
            break
        outcome = verbs.answer(args.path, store, row.id, line)
        tally[outcome] += 1
        print(f"  -> {outcome}{' (will reappear next time)' if outcome == 'skipped' else ''}")
    print(f"{tally['confirmed']} confirmed, {tally['rejected']} rejected, {tally['skipped']} skipped.")
    return 0


def rollback(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = verbs.rollback(spark, args.path, args.dry_run)
    names = {"restore": "would restore" if args.dry_run else "restored", "error": "ERROR"}
    for r in rows:
        said = r["reason"] or ("(matches HEAD)" if r["action"] == "unchanged" else ", ".join(o["id"] for o in r["outcomes"] if o["status"] in ("updated", "added")))
        print(f"{names.get(r['action'], r['action']):<13} {r['path']}  {said}")
        if r["kept"]:
            print(f"{'':<13} kept regions added since HEAD: {', '.join(r['kept'])}")
    if any(r["action"] == "restore" for r in rows):
        print(verbs.ROLLBACK_NOTE)
    return int(any(r["action"] == "error" for r in rows))


def init(spark: SparkSession, args: argparse.Namespace) -> int:
    said = verbs.init(spark, args.path, args.force)
    print(f"Wrote {said['written']}{' and .grovelens/.gitignore' if said['ignore_written'] else ''}")
    print(f"Detected {said['files']} source file(s) in {said['modules']} module(s): {', '.join(said['languages']) or 'no recognised source files'}.")
    if said["stack"]:
        print(f"Stack: {', '.join(said['stack'])}.")
    for doc in said["fill"]:
        print(f"Found {doc} — only markers that you place in it are filled.")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="grovelens")
    subs = top.add_subparsers(dest="verb", required=True)
    verbs_ = {"try": (), "init": ("--force",), "analyze": ("--dry-run", "--force"), "sync": ("--dry-run", "--check", "--force"), "check": ("--json",), "rollback": ("--dry-run",)}
    for name, flags in verbs_.items():
        sub = subs.add_parser(name)
        sub.add_argument("path", nargs="?", default=".")
        for flag in flags:
            sub.add_argument(flag, action="store_true")
    inner = subs.add_parser("review").add_subparsers(dest="what", required=True).add_parser("conventions")
    inner.add_argument("path", nargs="?", default=".")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if not os.path.isdir(args.path):
        print(f"error: {args.path} is not a directory", file=sys.stderr)
        return 1
    spark = spark or session()
    own = {"check": check, "review": review, "rollback": rollback, "init": init}
    try:
        return own[args.verb](spark, args) if args.verb in own else generate(spark, args.verb, args)
    except (ConfigError, StoreError, FileExistsError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
