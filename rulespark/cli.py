"""Run programs: python -m rulespark.cli [options] FILE... ; without files, read commands from standard input."""

from __future__ import annotations

import argparse
import sys

from rulespark.engine import Engine
from rulespark.plans.syntax import ProgramError


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="rulespark", description=__doc__)
    p.add_argument("files", nargs="*")
    p.add_argument("--fact-directory", default="", help="where input and output files are")
    p.add_argument("--naive", action="store_true", help="match all rows in each iteration")
    p.add_argument("--to-json", action="store_true", help="write FILE.json, a graph of the rows")
    p.add_argument("--to-dot", action="store_true", help="write FILE.dot")
    p.add_argument("--max-functions", type=int, default=40)
    p.add_argument("--max-calls-per-function", type=int, default=40)
    p.add_argument("--master", default=None)
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("rulespark")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    new = lambda: Engine(spark, a.fact_directory, not a.naive)
    if not a.files:
        engine, text = new(), ""
        for line in sys.stdin:
            text += line
            if text.count("(") > text.count(")"):  # the command goes on
                continue
            try:
                print(*engine.run(text), sep="\n", flush=True)
            except ProgramError as e:
                print(f"error: {e}", file=sys.stderr)
            text = ""
        return 0
    for file in a.files:
        engine = new()
        try:
            with open(file) as f:
                program = f.read()
            for line in engine.run(program):
                print(line)
        except Exception as e:  # noqa: BLE001
            print(f"{file}: {e}", file=sys.stderr)
            return 1
        from rulespark.sources.facts import write_graph

        for wanted, end in ((a.to_json, "json"), (a.to_dot, "dot")):
            if wanted:
                write_graph(engine, f"{file}.{end}", most_rows=a.max_calls_per_function, most_functions=a.max_functions)
    return 0


if __name__ == "__main__":
    sys.exit(main())
