"""Reports: the views of a range rendered as JSON, Markdown or HTML. Views are small; they are collected to render."""

from __future__ import annotations

import html as _html
import json
from datetime import UTC, datetime, time, timedelta

from pyspark.sql import DataFrame

from . import anomaly, security, views


def build(logs: DataFrame, start: datetime, end: datetime, *, name: str = "Log report", window: str = "1h", filters: dict | None = None, with_anomalies: bool = True, with_security: bool = True) -> dict:
    """Sections of rows for the inclusive range."""
    rows = views.scoped(logs, start, end, filters)
    frames = {
        "overview": views.overview(rows),
        "errors": views.errors(rows),
        "status_codes": views.status_codes(rows),
        "latency": views.latency(rows),
        "traffic": views.traffic(rows, start, end),
        "services": views.services(rows, start, end),
    }
    if with_anomalies:
        frames["anomalies"] = anomaly.scan(rows, start, end, window)
    if with_security:
        frames["security"] = security.analyze(rows)
    return {"name": name, "start": start.isoformat(), "end": end.isoformat(), "sections": {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in frames.items()}}


def daily(logs: DataFrame, day: datetime, **options) -> dict:
    begin = datetime.combine(day.date(), time.min, UTC)
    return build(logs, begin, begin + timedelta(days=1) - timedelta(microseconds=1), name=f"Daily report {day:%Y-%m-%d}", **options)


def summary(logs: DataFrame, hours: float = 24.0, now: datetime | None = None, **options) -> dict:
    end = now or datetime.now(UTC)
    return build(logs, end - timedelta(hours=hours), end, **options)


def to_json(report: dict, indent: int = 2) -> str:
    return json.dumps(report, indent=indent, default=str, ensure_ascii=False)


def _table(rows: list[dict]) -> list[list[str]]:
    return [list(rows[0]), *[[("" if v is None else str(v)) for v in r.values()] for r in rows]] if rows else []


def to_markdown(report: dict) -> str:
    out = [f"# {report['name']}", "", f"{report['start']} to {report['end']}", ""]
    for section, rows in report["sections"].items():
        out += [f"## {section.replace('_', ' ').title()}", ""]
        table = [[c.replace("|", "\\|").replace("\n", " ") for c in line] for line in _table(rows)]
        if table:
            out += ["| " + " | ".join(table[0]) + " |", "|" + " --- |" * len(table[0]), *["| " + " | ".join(line) + " |" for line in table[1:]], ""]
        else:
            out += ["nothing found", ""]
    return "\n".join(out)


def to_html(report: dict) -> str:
    e = _html.escape
    parts = [f"<!doctype html><html lang='en'><head><meta charset='utf-8'><title>{e(report['name'])}</title></head><body><h1>{e(report['name'])}</h1><p>{e(report['start'])} to {e(report['end'])}</p>"]
    for section, rows in report["sections"].items():
        parts.append(f"<h2>{e(section)}</h2>")
        table = _table(rows)
        if table:
            parts.append("<table><tr>" + "".join(f"<th>{e(c)}</th>" for c in table[0]) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(c)}</td>" for c in line) + "</tr>" for line in table[1:]) + "</table>")
        else:
            parts.append("<p>nothing found</p>")
    return "".join([*parts, "</body></html>"])


RENDER = {"json": to_json, "markdown": to_markdown, "html": to_html}


def save(report: dict, path: str, fmt: str = "json") -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(RENDER[fmt](report))
    return path
