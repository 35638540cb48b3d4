"""Sinks: JSON Lines, CSV with nested cells, comparison CSV, packaged profiles, Markdown, inventories."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.semantics import last_wins


def write_json_lines(rows: DataFrame, path: str, mode: str = "overwrite", gzip: bool = False) -> None:
    writer = rows.write.mode(mode)
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key is not in ``path`` yet; rerunning appends nothing twice."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], rows.schema)
    new = rows.join(done.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    seen = Observation()
    new.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def append_checkpoint(rows: DataFrame, path: str, turn: int) -> None:
    """Append a batch of results under its turn; a row that comes again in a later turn replaces the earlier one on reading."""
    rows.withColumn("_turn", F.lit(turn)).write.mode("append").json(path)


def read_checkpoint(spark, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last result of each key."""
    return last_wins(spark.read.schema(f"{schema}, _turn int").json(path), keys, ["_turn"]).drop("_turn")


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which CSV can hold."""
    return rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with header; refuses an existing path unless told otherwise."""
    flat(rows).write.mode(mode).option("header", True).csv(path)


#: columns of a comparison file, in order (fixed names)
COMPARISON = ("model", "strategy", "metric", "construct", "treatment_numerator", "treatment_denominator", "treatment_score", "control_numerator", "control_denominator", "control_score", "treatment_minus_control")


def write_comparison(table: DataFrame, path: str) -> None:
    """One CSV file of a comparison's eleven columns, sorted by key; refuses an existing path and other columns."""
    if set(table.columns) != set(COMPARISON):
        raise ValueError(f"a comparison has the columns {', '.join(COMPARISON)}")
    table.select(*COMPARISON).orderBy(*COMPARISON[:4]).coalesce(1).write.mode("error").option("header", True).csv(path)


def inventory(spark, path: str) -> DataFrame:
    """file, bytes and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def configurations(rows: DataFrame) -> DataFrame:
    """model, strategy and rows of every configuration, sorted."""
    return rows.groupBy(F.coalesce("model_id", F.lit("?")).alias("model"), F.coalesce("prompt_template", F.lit("?")).alias("strategy")).agg(F.count(F.lit(1)).alias("rows")).orderBy("model", "strategy")


def inventory_document(rows: DataFrame, path: str) -> str:
    """JSON text of a release: rows, configurations, and the files below ``path`` with their hashes."""
    listed = [r.asDict() for r in configurations(rows).limit(10_000).collect()]
    files = [r.asDict() for r in inventory(rows.sparkSession, path).orderBy("file").limit(10_000).collect()]
    return json.dumps({"rows": sum(c["rows"] for c in listed), "configurations": listed, "files": files}, sort_keys=True, separators=(",", ":"))


def metrics_document(metrics: DataFrame, hashes: dict[str, str], versions: dict[str, str]) -> str:
    """JSON text of one evaluation: its metrics (name, status, score), the hashes of what was evaluated, and versions."""
    named = {r["metric"]: {"status": r["status"], "score": r["score"]} for r in metrics.orderBy("metric").limit(1000).collect()}
    return json.dumps({"metrics": named, "sha256": hashes, "versions": versions}, sort_keys=True, separators=(",", ":"))


def latex_rows(table: DataFrame, columns: list[str], most: int = 1000) -> str:
    """Rows of a LaTeX table of a small aggregate."""
    text = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("&", r"\&").replace("_", r"\_").replace("%", r"\%")
    return "\n".join(" & ".join(text(r[c]) for c in columns) + r" \\" for r in table.select(*columns).limit(most).collect())


def count_ticks(most: int, wanted: int = 5) -> list[int]:
    """Round axis ticks from 0 to at least ``most``: steps of 1, 2 or 5 times a power of ten."""
    step = 1
    while step * wanted < most:
        step = next(k * 10 ** (len(str(step)) - 1 + e) for e in (0, 1) for k in (1, 2, 5) if k * 10 ** (len(str(step)) - 1 + e) > step)
    return list(range(0, step * -(-max(most, 1) // step) + 1, step))


def stacked_bars(table: DataFrame, label: str, series: list[str], colors: list[str], most: int = 200) -> str:
    """An SVG of horizontal stacked bars of a small aggregate, one per row, with round ticks."""
    rows = table.limit(most).collect()
    top = count_ticks(max([sum(r[s] or 0 for s in series) for r in rows], default=0))
    scale, out = 480 / max(top[-1], 1), []
    for i, r in enumerate(rows):
        x, y = 200.0, 20 + 24 * i
        out.append(f'<text x="192" y="{y + 13}" text-anchor="end">{escape(str(r[label]))}</text>')
        for s, color in zip(series, colors):
            w = (r[s] or 0) * scale
            if w:
                out.append(f'<rect x="{x:.1f}" y="{y}" width="{w:.1f}" height="18" fill="{color}"><title>{escape(s)}: {r[s]}</title></rect>')
            x += w
    bottom = 28 + 24 * len(rows)
    out += [f'<text x="{200 + t * scale:.1f}" y="{bottom + 12}" text-anchor="middle">{t}</text>' for t in top]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="720" height="{bottom + 24}" font-family="sans-serif" font-size="11">' + "".join(out) + "</svg>"


def package_profiles(rows: DataFrame, path: str, columns: list[str], most_bytes: int = 50 << 20) -> DataFrame:
    """Compact gzip profiles; fails where a file is larger than allowed. Returns the inventory."""
    write_json_lines(rows.select(*columns), path, gzip=True)
    files = inventory(rows.sparkSession, path).where(F.col("file").endswith(".gz"))
    large = files.where(F.col("bytes") > most_bytes).limit(1).collect()
    if large:
        raise ValueError(f"{large[0]['file']} is larger than {most_bytes} bytes")
    return files


def markdown(table: DataFrame, headings: list[str] | None = None, most: int = 10_000) -> str:
    """A Markdown table of a small aggregate; refuses tables of more than ``most`` rows."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("reports are for small aggregates")
    names = headings or table.columns
    lines = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])
