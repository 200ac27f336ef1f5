"""Comparisons as markdown, JSON or HTML. Inputs are collected rows of diff or trend: a few dozen."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from typing import Any

BARS = "▁▂▃▄▅▆▇█"


def cell(value: float | None, signed: bool = False) -> str:
    return "—" if value is None else f"{value:+.2f}" if signed else f"{value:.2f}"


def sparkline(values: Sequence[float | None]) -> str:
    return "".join(" " if v is None else BARS[min(len(BARS) - 1, int(v * len(BARS)))] for v in values)


def _table(head: list[str], rows: list[list[str]], notes: Sequence[str]) -> str:
    lines = [f"| {' | '.join(head)} |", f"|{'---|' * len(head)}", *(f"| {' | '.join(r)} |" for r in rows)]
    return "\n".join([*lines, *(f"\n> {n}" for n in notes)]) + "\n"


def _plain(head: list[str], rows: list[list[str]], notes: Sequence[str]) -> str:
    """Columns in line, for a terminal."""
    wide = [max(len(r[k]) for r in [head, *rows]) for k in range(len(head))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in [head, ["-" * w for w in wide], *rows]]
    return "\n".join([*lines, *(f"note: {n}" for n in notes)]) + "\n"


def _page(title: str, head: list[str], rows: list[list[str]], notes: Sequence[str]) -> str:
    e = html.escape
    body = "".join(f"<tr class='{e(r[-1])}'>{''.join(f'<td>{e(c)}</td>' for c in r)}</tr>" for r in rows)
    style = "body{font:14px sans-serif}td,th{padding:4px 10px;text-align:left}.regression,.removed,.regressed{background:#fdd}.improved{background:#dfd}"
    return f"<!doctype html><meta charset='utf-8'><title>{e(title)}</title><style>{style}</style><h1>{e(title)}</h1><table><tr>{''.join(f'<th>{e(h)}</th>' for h in head)}</tr>{body}</table>{''.join(f'<p>{e(n)}</p>' for n in notes)}"


def _form(form: str, title: str, head: list[str], rows: list[list[str]], notes: Sequence[str]) -> str:
    return _page(title, head, rows, notes) if form == "html" else (_plain if form == "table" else _table)(head, rows, notes)


def _diff_rows(rows: Sequence[Any]) -> list[list[str]]:
    return [[r["capability"], cell(r["baseline"]), cell(r["candidate"]), cell(r["delta"], True), r["status"]] for r in sorted(rows, key=lambda r: r["capability"])]


def _trend_rows(rows: Sequence[Any]) -> list[list[str]]:
    return [[r["capability"], *map(cell, r["values"]), sparkline(r["values"]), cell(r["delta"], True), cell(r["worst_step"], True), r["status"]] for r in sorted(rows, key=lambda r: r["capability"])]


def render_diff(rows: Sequence[Any], form: str = "markdown", notes: Sequence[str] = (), max_drop: float = 0.05) -> str:
    head = ["capability", "baseline", "candidate", "delta", "status"]
    if form == "json":
        keys = ("capability", "baseline", "candidate", "delta", "significant", "status")
        failing = any(r["status"] in ("regression", "removed") for r in rows)
        return json.dumps({"max_drop": max_drop, "regressed": failing, "rows": [{k: r[k] for k in keys} for r in sorted(rows, key=lambda r: r["capability"])], "notes": [*notes]}, indent=2)
    return _form(form, "Scorecard comparison", head, _diff_rows(rows), notes)


def render_trend(rows: Sequence[Any], labels: Sequence[str], form: str = "markdown", notes: Sequence[str] = ()) -> str:
    head = ["capability", *labels, "ladder", "delta", "worst step", "status"]
    if form == "json":
        keys = ("capability", "values", "delta", "worst_step", "monotonic", "status")
        return json.dumps({"labels": [*labels], "rows": [{k: r[k] for k in keys} for r in sorted(rows, key=lambda r: r["capability"])], "notes": [*notes]}, indent=2)
    return _form(form, "Scorecard ladder", head, _trend_rows(rows), notes)


def render_findings(rows: Sequence[Any]) -> str:
    return "".join(f"{r['level']}: {r['code']}: {r['message']}\n" for r in sorted(rows, key=lambda r: (r["level"], r["code"], r["message"]))) or "no findings\n"
