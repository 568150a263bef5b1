"""Reports of latency summaries, as JSON and Markdown, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

COLUMNS = ("name", "count", "min", "p50", "p95", "p99", "max", "mean", "ops_per_second")


def markdown(rows: list[dict]) -> str:
    def cell(v) -> str:
        return "n/a" if v is None else f"{v:,.1f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(COLUMNS) + " |", "| " + " | ".join("---" for _ in COLUMNS) + " |"]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in COLUMNS) + " |" for r in rows]) + "\n"


def write(path: str, rows: list[dict]) -> None:
    """JSON or, for .md, Markdown; a reader sees the old file or the new one."""
    text = markdown(rows) if path.endswith(".md") else json.dumps(rows, indent=1, sort_keys=True) + "\n"
    folder = Path(path).resolve().parent
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)
