"""Writers: JSON payloads, CSV facts, Markdown and SVG reports, idempotent appends."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """Fixed columns with a header; nulls become empty."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Appends rows whose key is not there yet; a repeated run adds nothing. Returns the number of rows added."""
    from driftline.operators.history import not_done

    spark = df.sparkSession
    try:
        todo = not_done(df, spark.read.parquet(path), keys)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = df
    todo = todo.cache()
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    todo.unpersist()
    return n


def show_number(v: object) -> str:
    return "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)


def markdown_table(title: str, df: DataFrame, limit: int = 1000) -> str:
    """An aggregate table as Markdown; beyond ``limit`` rows (it is a page to read) it says that more were left out."""
    rows = df.limit(limit + 1).collect()
    rows, more = rows[:limit], len(rows) > limit
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(show_number(r[c]) for c in df.columns) + " |" for r in rows] + (["", f"The first {limit} rows."] if more else [])) + "\n"


def bar_chart(title: str, df: DataFrame, label: str, value: str, width: int = 640, limit: int = 40) -> str:
    """An aggregate as an SVG bar chart; beyond ``limit`` bars its title says that more were left out."""
    rows = df.select(F.col(label).cast("string"), F.col(value).cast("double")).limit(limit + 1).collect()
    if len(rows) > limit:
        rows, title = rows[:limit], f"{title} (first {limit})"
    top = max([r[1] or 0 for r in rows], default=0) or 1
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{24 * len(rows) + 40}"><text x="8" y="20">{escape(title)}</text>']
    for i, r in enumerate(rows):
        y = 36 + 24 * i
        parts.append(f'<text x="8" y="{y + 12}">{escape(r[0] or "")}</text><rect x="200" y="{y}" width="{(width - 280) * (r[1] or 0) / top:.1f}" height="16"/><text x="{width - 70}" y="{y + 12}">{show_number(r[1])}</text>')
    return "".join(parts) + "</svg>"


def write_model(weights: dict[str, DataFrame], path: str) -> None:
    """A model as parquet tables (weights, vocabularies, settings), one folder each."""
    for name, df in weights.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
