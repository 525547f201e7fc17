"""Analyse source trees (and optional exported commit logs) and write every derived table.

usage:
  python scripts/analyze.py --repo NAME=/path/to/tree [--repo ...] [--log NAME=/path/to/log.txt ...]
                            [--goal "Add JWT authentication to protect routes" ...] --out /shared/output

The log is the text of `git log --pretty=format:commit:%H|%an --name-only` (newest first).
Tables are written as Parquet partitioned by repo_id (`save_analysis`); answers to goals go to
`candidates` and `agent_context`.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from archspark.plans.analysis import answer_goals, build_analysis  # noqa: E402
from archspark.session import build_session  # noqa: E402
from archspark.sources import corpus as src  # noqa: E402


def _pairs(values: list[str]) -> dict[str, str]:
    out = {}
    for v in values:
        name, _, path = v.partition("=")
        out[name] = path
    return out


def main(argv: list[str] | None = None, spark=None) -> None:
    """Run on the given session (left open), or on an own one."""
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--repo", action="append", required=True, help="NAME=PATH of a source tree")
    ap.add_argument("--log", action="append", default=[], help="NAME=PATH of an exported commit log")
    ap.add_argument("--goal", action="append", default=[], help="goal sentence (repeatable)")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    args = ap.parse_args(argv)

    own = spark is None
    spark = spark or build_session()
    corpus = src.load_directories(spark, _pairs(args.repo))
    commit_files = None
    for repo, path in _pairs(args.log).items():
        cf = src.read_commit_log(spark, path, repo)
        commit_files = cf if commit_files is None else commit_files.unionByName(cf)
    tables = build_analysis(spark, corpus, commit_files, store=os.path.join(args.out, "stored"))
    if args.goal:
        goals = spark.createDataFrame([(f"g{i}", g) for i, g in enumerate(args.goal, start=1)],
                                      "goal_id string, goal string")
        tables.update(answer_goals(spark, tables, goals))
    tables.pop("code_facts", None)  # nested facts stay recomputable from the corpus; flat tables are written
    src.save_analysis(tables, args.out)
    print("wrote", ", ".join(sorted(tables)), "to", args.out)
    if own:
        spark.stop()


if __name__ == "__main__":
    main()
