"""Write COVERAGE.md: which registered queries exercise each operator of the blueprint."""

from __future__ import annotations

import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tidemark import queries  # noqa: E402


def render() -> str:
    cov, oracle = queries.coverage(), queries.oracle_sql()
    order = sorted(cov, key=lambda op: ("SPJAWTUFCMH".index(op[0]), int(re.sub(r"\D", "", op))))
    lines = [
        "# Operator coverage", "",
        f"{len(queries.queries())} registered queries, {len(oracle)} with a SQL twin. A name in *italics* has no SQL twin and is",
        "checked against brute force in `tests/` instead.", "", "| Operator | Queries |", "|---|---|",
    ]
    for op in order:
        lines.append(f"| {op} | " + ", ".join(f"`{n}`" if n in oracle else f"*{n}*" for n in cov[op]) + " |")
    lines += [
        "", "Extension points: X1 a forecaster is a function `(context, observations) -> predictions` (`tidemark/operators/forecast.py`);",
        "X2 a source is a function returning canonical rows (`tidemark/sources/canonical.py`); X3 a rule is a function of the windows",
        "returning a boolean column (`tidemark/operators/events.py`); X4 `resolution_fn` is a column of the tasks schema, and only exact",
        "resolution exists; X5 verdicts and labels of judges are input columns (`rationale_alignment`, `label_rule_matches`).", "",
    ]
    return "\n".join(lines)


if __name__ == "__main__":
    (ROOT / "COVERAGE.md").write_text(render())
