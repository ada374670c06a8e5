"""Expected results in plain SQL, one statement per query name."""

from __future__ import annotations

from oracles import classification, commands, ordering, scalars, texts, totals

CHECKS: dict[str, str] = {
    **scalars.CHECKS,
    **classification.CHECKS,
    **texts.CHECKS,
    **totals.CHECKS,
    **ordering.CHECKS,
    **commands.CHECKS,
}
