"""python -m strandlake COMMAND ...

run CONFIG [--sequences DIR] [--tracks DIR] [--force-from STAGE]   all stages
STAGE CONFIG ...      one stage (manifest, sketch, select, ..., report); what precedes it has to be done
publish CONFIG        the report again
info CONFIG           which stages are done, with their figures and times
index FASTA...        .fai and .gzi beside files
fetch FASTA CONTIG [START END]   bases of a contig
init-config, validate-config CONFIG

--set section.key=value changes a setting.
"""

from __future__ import annotations

import argparse
import dataclasses
import json


def main(args: list[str] | None = None) -> int:
    from .plans.config import Config, load
    from .plans.stages import STAGES, Run

    parser = argparse.ArgumentParser(prog="strandlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", *STAGES, "publish", "info", "validate-config"):
        p = commands.add_parser(name)
        p.add_argument("config")
        p.add_argument("--set", action="append", default=[])
        if name in ("run", *STAGES, "publish"):
            p.add_argument("--sequences")
            p.add_argument("--tracks")
            p.add_argument("--force-from" if name == "run" else "--force", **({} if name == "run" else {"action": "store_true"}))
    commands.add_parser("init-config")
    commands.add_parser("index").add_argument("fasta", nargs="+")
    p = commands.add_parser("fetch")
    p.add_argument("fasta")
    p.add_argument("contig")
    p.add_argument("start", nargs="?", type=int, default=0)
    p.add_argument("end", nargs="?", type=int)
    given = parser.parse_args(args)

    if given.command == "init-config":
        print(json.dumps(dataclasses.asdict(Config()), indent=1))
        return 0
    if given.command == "fetch":
        from .sources.fasta import fetch

        print(fetch(given.fasta, given.contig, given.start, given.end))
        return 0
    config = load(given.config, given.set) if given.command != "index" else None
    if given.command == "validate-config":
        print("valid")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(config.run_name if config else "index").getOrCreate()
    if given.command == "index":
        from .sources.fasta import build_indexes

        build_indexes(spark, given.fasta)
        return 0
    table = lambda path: spark.read.parquet(path) if path else None
    run = Run(spark, config, table(getattr(given, "sequences", None)), table(getattr(given, "tracks", None)))
    if given.command == "info":
        marks = {s: run._mark(s) for s in STAGES}
        print(json.dumps({s: None if m is None else {"seconds": m["seconds"], "current": m["digest"] == run._digest(s), **json.loads(m["detail"])} for s, m in marks.items()}, indent=1))
    elif given.command == "run":
        print(json.dumps(run.run(given.force_from), indent=1, default=str))
    else:
        stage = "report" if given.command == "publish" else given.command
        print(json.dumps(run.run_stage(stage, given.force or given.command == "publish"), indent=1, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
