"""Fact files (tab-separated, without head or quotes), printed functions, and appended lines."""

from __future__ import annotations

import csv
import io
import json
import os

from pyspark.sql import functions as F

from rulespark.functions.sorts import F64, I64, STRING, UNIT
from rulespark.operators.extract import Terms, _ids, costs, text_of
from rulespark.plans.syntax import ProgramError


def input_facts(engine, name: str, file: str) -> None:
    """Insert the rows of a file. Fields are trimmed; a line with other columns than the function has is an error.

    A custom function's last column is its result; relations have no more than their keys, and a constructor's terms are
    made. Read by Spark, so a file can be of any size, in any store.
    """
    t = engine.table(name)
    sorts = [*t.takes, *([t.out] if t.kind == "custom" and t.out != UNIT else [])]
    if bad := [s for s in sorts if s not in (I64, F64, STRING)]:
        raise ProgramError(f"input {name}: no column can be {bad[0]}")
    lines = engine.spark.read.text(engine.path(file)).select(F.split(F.regexp_replace("value", "\r$", ""), "\t", -1).alias("f"))
    wrong = F.raise_error(F.concat(F.lit(f"input {name}: wrong number of columns: "), F.size("f").cast("string")))
    lines = lines.select(F.when(F.size("f") == len(sorts), F.col("f")).otherwise(wrong.cast("array<string>")).alias("f"))
    fields = [F.trim(F.get("f", F.lit(i))).cast(s.ddl).alias(f"x{i}") for i, s in enumerate(sorts)]
    df = lines.select(*fields)
    if t.kind == "custom" and t.out == UNIT:
        df = df.withColumn("out", F.lit(True))
    engine.insert_rows(name, df)


def append_lines(path: str, lines: list[str]) -> None:
    with open(path, "a") as f:
        f.writelines(f"{x}\n" for x in lines)


def print_function(engine, name: str, n: int | None, file: str | None, mode: str) -> None:
    """The first n rows of a function, as s-expressions or CSV (name, arguments, result)."""
    t = engine.table(name)
    df = t.df(engine.spark).select(F.to_json(F.struct(*t.keys, *t.values) if t.keys or t.values else F.struct(F.lit(0).alias("_"))).alias("j"))
    rows = [json.loads(r.j) for r in (df.limit(n) if n is not None else df).toLocalIterator()]
    terms = Terms(engine, costs(engine)) if t.out.has_ids and t.kind == "custom" or any(s.has_ids for s in t.takes) else None
    out = []
    for r in rows:
        for c, s in zip([*t.keys, *t.values], [*t.takes, t.out], strict=False):
            if terms is not None and (s is not t.out or t.kind == "custom"):
                for i in _ids(r.get(c), s):
                    terms.text(i)
        term = terms.known.__getitem__ if terms is not None else str
        own = [text_of(r.get(c), s, term) for c, s in zip(t.keys, t.takes, strict=True)]
        call = f"({' '.join([name, *own])})"
        result = text_of(r.get("out"), t.out, term) if t.kind == "custom" else call if t.kind == "constructor" else "()"
        out.append([name, *own, result] if mode == "csv" else f"{call} -> {result}" if t.kind != "relation" else call)
    if mode == "csv":
        buffer = io.StringIO()
        csv.writer(buffer, lineterminator="\n").writerows(out)
        text = buffer.getvalue()
    else:
        text = "(\n" + "".join(f"   {x}\n" for x in out) + ")"
    if file:
        with open(file, "w") as f:
            f.write(text)
    else:
        engine.outputs.append(text)


def export_graph(engine, most_rows: int = 40, most_functions: int = 40, most_calls: int = 1000) -> dict:
    """Rows of constructors and functions as a graph: nodes with their operator, children and class; capped, for display."""
    engine.flush()
    out: dict = {"nodes": {}, "omitted": []}
    calls = 0
    for k, t in enumerate(sorted(engine.tables.values(), key=lambda t: t.name)):
        if t.hidden or t.kind == "relation":
            continue
        if k >= most_functions or calls >= most_calls:
            out["omitted"].append(t.name)
            continue
        rows = t.df(engine.spark).select(F.to_json(F.struct(*t.keys, "out", "sub")).alias("j")).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            out["omitted"].append(t.name)
        for i, r in enumerate(rows[:most_rows]):
            calls += 1
            row = json.loads(r.j)
            children = []
            for c, s in zip(t.keys, t.takes, strict=True):
                if s.kind == "eq":
                    children.append(f"class-{row[c]}")
                else:
                    leaf = f"{s}-{json.dumps(row[c])}"
                    out["nodes"].setdefault(leaf, {"op": text_of(row[c], s, str), "children": [], "eclass": leaf, "cost": 1, "subsumed": False})
                    children.append(leaf)
            cls = f"class-{row['out']}" if t.out.kind == "eq" else f"{t.out}-{json.dumps(row['out'])}"
            out["nodes"][f"{t.name}-{i}"] = {"op": t.name, "children": children, "eclass": cls, "cost": t.cost, "subsumed": row["sub"]}
    return out


def write_graph(engine, path: str, **caps) -> None:
    """Write the graph as JSON, or as DOT if the path ends so."""
    graph = export_graph(engine, **caps)
    if path.endswith(".dot"):
        quote = json.dumps
        classes: dict[str, list[str]] = {}
        for name, node in graph["nodes"].items():
            classes.setdefault(node["eclass"], []).append(name)
        lines = ["digraph {", "  compound=true"]
        for i, (c, names) in enumerate(classes.items()):
            lines += [f"  subgraph cluster_{i} {{", *[f"    {quote(n)} [label={quote(graph['nodes'][n]['op'])}]" for n in names], "  }"]
        for name, node in graph["nodes"].items():
            lines += [f"  {quote(name)} -> {quote(classes[c][0])}" for c in node["children"] if c in classes]
        text = "\n".join([*lines, "}"])
    else:
        text = json.dumps(graph, indent=1)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
