"""Plans as JSON and Markdown."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path

from .planner import Plan

SHOWN_TABLES = 20


def to_json(plan: Plan) -> str:
    return json.dumps(asdict(plan), indent=2, default=lambda d: d.isoformat())


def _code(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _grid(head: str, rows: list[list[str]]) -> Iterator[str]:
    names = head.split(", ")
    for cells in [names, *rows]:
        yield f"| {' | '.join(cells)} |"
        if cells is names:
            yield "|" + "---|" * len(names)


def _mapping(t: dict) -> Iterator[str]:
    goal = f"`{t['target_table']}`" if t["target_table"] else "**(no target table found)**"
    yield f"### `{t['source_table']}` -> {goal}\n"
    rows = [[c["source_column"] or "_(none)_", c["target_column"] or "_(none)_", c["source_type"] or "", c["target_type"] or "", c["match_kind"], f"{c['confidence']:.2f}", (c["notes"] or "").replace("|", "/")] for c in t["column_mappings"]]
    if rows:
        yield from _grid("Source Column, Target Column, Source Type, Target Type, Match, Confidence, Notes", rows)
    yield ""


def _phase(p: dict) -> Iterator[str]:
    yield f"### Phase {p['order']}: {p['name']}\n\n{p['description']}\n"
    for title, key in (("Entry criteria", "entry_criteria"), ("Tasks", "tasks"), ("Tables", "tables"), ("Exit criteria", "exit_criteria")):
        if key == "tables" and p[key]:
            more = len(p[key]) - SHOWN_TABLES
            yield f"**Tables:** {_code(p[key][:SHOWN_TABLES])}" + (f" (+{more} more)" if more > 0 else "")
        elif p[key]:
            yield f"**{title}:**"
            yield from (f"- {x}" for x in p[key])
    yield ""


# The headings, table heads and placeholders of this file are fixed values: the report's format.


def _lines(plan: Plan) -> Iterator[str]:
    yield f"# Data Migration Plan\n\n- **Source dialect:** {plan.source_dialect}\n- **Target dialect:** {plan.target_dialect}\n- **Generated:** {plan.generated_at.isoformat()}\n"
    yield f"## Executive Summary\n\n{plan.architecture_summary}\n\n## Migration Order (Dependency-Resolved)\n"
    yield from [f"{i}. `{t}`" for i, t in enumerate(plan.migration_order, 1)] or ["_No tables resolved into a load order._"]
    yield ""
    if plan.cyclic_dependencies:
        yield "### Circular Dependencies (excluded from ordering above)\n"
        yield from (f"- {_code(g)}" for g in plan.cyclic_dependencies)
        yield ""
    yield "## Table & Column Mappings\n"
    for t in plan.table_mappings:
        yield from _mapping(t)
    yield "## Risks\n"
    yield from _grid("ID, Severity, Category, Title, Affected Objects, Mitigation", [[r["id"], r["severity"].upper(), r["category"], r["title"], _code(r["affected_objects"]) or "-", r["mitigation"]] for r in plan.risks_by_severity()])
    yield "\n## Validation Plan\n"
    yield from _grid("Check, Type, Target Objects, Description", [[c["name"], c["type"], _code(c["target_objects"]), c["description"]] for c in plan.validation_plan])
    yield "\n## Execution Phases\n"
    for p in sorted(plan.execution_phases, key=lambda p: p["order"]):
        yield from _phase(p)
    if plan.notes:
        yield "## Notes\n"
        yield from (f"- {n}" for n in plan.notes)
        yield ""


def to_markdown(plan: Plan) -> str:
    return "\n".join(_lines(plan))


def write(plan: Plan, folder: str) -> list[Path]:
    """Write migration_plan.md and migration_plan.json to a folder, made if need be."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    files = [out / "migration_plan.md", out / "migration_plan.json"]
    files[0].write_text(to_markdown(plan))
    files[1].write_text(to_json(plan))
    return files
