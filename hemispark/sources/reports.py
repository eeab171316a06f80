"""Small results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_markdown(df: DataFrame, title: str, rows: int = 50) -> str:
    """A heading and a table of the first rows; what is cut off is said. For results of a few rows, ordered by the caller."""
    found = df.limit(rows + 1).collect()
    text = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(text, r)) + " |" for r in found[:rows]]
    return "\n".join(lines + (["", f"Only the first {rows} rows are shown."] if len(found) > rows else [])) + "\n"
