"""Writers of tables (distributed) and of small reports (driver)."""

from __future__ import annotations

import hashlib
import html
import json
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.keys import upsert
from lectern.schemas import CASE_OWN, TRACKS, case_schema, prediction_schema
from lectern.sources.files import read_jsonl

# Columns of the leaderboard's CSV, in order.
LEADERBOARD_CSV = ("model_id", "provider", "mode", "mode_label", "completed_tracks", "coverage", "mean_score", "coverage_adjusted_score", "human_effect_category_macro_f1", "human_effect_evidence_accuracy", "human_effect_overclaim_penalty", "binding_rank_spearman", "binding_rank_kendall", "binding_rank_pairwise_accuracy", "pose_contact_precision", "pose_contact_recall", "pose_contact_f1", "structure_score", "structure_rmsd_status", "total_cases_attempted", "total_cases_completed", "invalid_json_count", "api_error_count", "total_cost_estimate_if_available", "run_timestamp", "benchmark_release", "evaluator_commit", "is_baseline", "competitive", "scored", "fallback_prediction_count", "unresolved_provider_error_count", "unresolved_invalid_json_count", "row_status", "status", "leaderboard_status", "retry_recovered_count", "retry_still_failed_count")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with fields by name; nulls are left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> DataFrame:
    """A folder a split; returns (split, n)."""
    df.write.mode("overwrite").partitionBy(column).json(path)
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def write_leaderboard(public: DataFrame, path: str) -> None:
    """The public rows as a JSON and a CSV folder; the CSV has its fixed columns, nested ones as JSON text."""
    flat = public
    for name, kind in public.dtypes:
        if kind.startswith(("map", "struct", "array")):
            flat = flat.withColumn(name, F.to_json(name))
    public.write.mode("overwrite").json(f"{path}/leaderboard.json")
    flat.select(*[F.col(c) if c in flat.columns else F.lit(None).cast("string").alias(c) for c in LEADERBOARD_CSV]).write.mode("overwrite").option("header", True).csv(f"{path}/leaderboard.csv")


def replace_record(df: DataFrame, path: str, key: str, out: str) -> None:
    """The records at ``path`` with those of ``df`` in place of the same keys, written to ``out``."""
    write_jsonl(upsert(read_jsonl(df.sparkSession, path, df.schema, strict=False), df, [key]), out)


def mirror(df: DataFrame, paths: list[str]) -> None:
    """The same records to several folders; the table is computed once."""
    kept = df.persist()
    try:
        for p in paths:
            write_jsonl(kept, p)
    finally:
        kept.unpersist()


def write_templates(spark, path: str) -> list[str]:
    """An empty CSV with the header of each track's cases."""
    out = []
    for track in TRACKS:
        own = [f.name for f in case_schema(track).fields]
        where = f"{path}/{track}"
        spark.createDataFrame([(",".join(own),)], "value string").coalesce(1).write.mode("overwrite").text(where)
        out.append(where)
    return out


def json_schemas() -> dict[str, str]:
    """Spark's JSON form of every record schema."""
    return {**{f"{t}_case": case_schema(t).json() for t in CASE_OWN}, **{f"{t}_prediction": prediction_schema(t).json() for t in CASE_OWN}}


def write_text(path: str, text: str) -> str:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(p)


def write_json(path: str, value: object) -> str:
    return write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def package(folder: str, out: str, violations: DataFrame) -> str:
    """Archive and its SHA-256 beside it; refused while there are violations."""
    if not violations.isEmpty():
        raise ValueError("the release has violations")
    with tarfile.open(out, "w:gz") as tar:
        for p in sorted(Path(folder).rglob("*")):
            tar.add(p, arcname=str(p.relative_to(folder)), recursive=False)
    digest = hashlib.sha256(Path(out).read_bytes()).hexdigest()
    write_text(f"{out}.sha256", f"{digest}  {Path(out).name}\n")
    return digest


def _table(rows: list, columns: list[str]) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |", *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])


def datasheet(cases: DataFrame, title: str = "Datasheet") -> str:
    """Markdown with counts by track and by source."""
    parts = [f"# {title}", f"Records: {cases.count()}"]
    for c in ("track", "source_database"):
        parts.append(_table(cases.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(c).collect(), [c, "n"]))
    return "\n\n".join(parts) + "\n"


def benchmark_card(cases: DataFrame, status: str) -> str:
    return "\n\n".join(["# Benchmark card", f"Status: {status}", _table(cases.groupBy("track").agg(F.count(F.lit(1)).alias("n")).orderBy("track").collect(), ["track", "n"])]) + "\n"


def release_report(violations: DataFrame) -> str:
    rows = violations.orderBy("scope", "message").limit(1000).collect()  # a report shows this many
    return "\n\n".join(["# Release report", "Passed." if not rows else _table(rows, ["scope", "message"])]) + "\n"


def source_card(source: DataFrame) -> str:
    r = source.first().asDict()
    return "\n".join([f"# {r.get('name')}", "", *(f"- {k}: {v}" for k, v in sorted(r.items()) if v is not None)]) + "\n"


def leaderboard_report(public: DataFrame) -> str:
    """Markdown of ranked rows, and of the others below."""
    columns = ["rank", "model_id", "mode", "mean_score", "coverage_adjusted_score", "status"]
    ranked, rest = public.where("rank is not null").orderBy("rank").collect(), public.where("rank is null").orderBy("model_id", "mode").collect()
    return "\n\n".join(["# Leaderboard", _table(ranked, columns), "## Not ranked", _table(rest, columns)]) + "\n"


def leaderboard_page(public: DataFrame) -> str:
    """One static page; rows sort by a click on a header."""
    columns = ["rank", "model_id", "mode", "coverage_adjusted_score", "human_effect", "binding_rank", "pose", "structure", "status"]
    cells = "".join("<tr>" + "".join(f"<td>{html.escape('' if r[c] is None else str(r[c]))}</td>" for c in columns) + "</tr>" for r in public.collect())
    script = "document.querySelectorAll('th').forEach((h,i)=>h.onclick=()=>{const b=document.querySelector('tbody'),v=r=>{const x=r.cells[i].textContent,n=parseFloat(x);return x===''?-Infinity:isNaN(n)?x:n},d=h.dataset.d=h.dataset.d==='1'?'-1':'1';[...b.rows].sort((p,q)=>(v(p)>v(q)?1:v(p)<v(q)?-1:0)*d).forEach(r=>b.append(r))})"
    return f"<!doctype html><meta charset=utf-8><title>Leaderboard</title><table><thead><tr>{''.join(f'<th>{c}</th>' for c in columns)}</tr></thead><tbody>{cells}</tbody></table><script>{script}</script>\n"


def copy_redacted(source: str, target: str, binary: tuple[str, ...] = (".safetensors", ".bin", ".pt", ".pth")) -> bool:
    """Copy a file of the driver's; text loses its secrets. True if something was redacted."""
    import re
    import shutil

    from lectern.functions.text import SECRET_PATTERNS

    Path(target).parent.mkdir(parents=True, exist_ok=True)
    if Path(source).suffix in binary:
        shutil.copyfile(source, target)
        return False
    text = clean = Path(source).read_text(encoding="utf-8", errors="replace")
    for p in SECRET_PATTERNS:
        clean = re.sub(p, "[REDACTED]", clean)
    write_text(target, clean)
    return clean != text
