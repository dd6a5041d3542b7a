"""Sinks: graph tables, ledgers, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, snapshot: str) -> None:
    """K2, K6: nodes and edges of a snapshot as partitioned Parquet; writing a snapshot again replaces it alone."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("snapshot", F.lit(snapshot)).write.option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").mode("overwrite").parquet(f"{path}/{name}")


def append_ledger(path: str, row: DataFrame) -> None:
    """K5: rows added to a JSON-lines ledger."""
    row.write.mode("append").json(path)


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """K3, K7: a small table as Markdown, with what it leaves out."""
    rows, n = df.limit(most).collect(), df.count()
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    body = ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
    return "\n".join([*head, *body, *([f"... and {n - most} more"] if n > most else [])])


def mermaid(matrix: DataFrame, most: int = 200) -> str:
    """K3: a domain matrix (a, b, weight) as a diagram."""
    rows = matrix.orderBy(F.desc("weight"), "a", "b").limit(most).collect()
    return "\n".join(["graph LR", *[f'  {r.a!r} ---|{r.weight}| {r.b!r}'.replace("'", '"') for r in rows]])
