"""Recipes: an ordered list of operator steps applied with ``df.transform``.

A recipe is checked when it is built (known operators, accepted
arguments) and again when it is applied: every step is analysed by
Catalyst as it is added, so a missing column fails before any job runs.
The steps become one logical plan that Catalyst optimises as a whole
(filters move down to the scan, projections merge).
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import cleaning, columns, filters, ordering
from ..session import cut_lineage

STEPS: dict[str, Callable[..., DataFrame]] = {
    "select": columns.select_columns,
    "filter": filters.filter_rows,
    "sort": ordering.sort_rows,
    "preview": ordering.preview,
    "rename": columns.rename_column,
    "drop_column": columns.drop_column,
    "add_column": columns.add_column,
    "convert": columns.convert_type,
    "drop_nulls": cleaning.drop_nulls,
    "fill_nulls": cleaning.fill_nulls,
    "drop_duplicates": cleaning.drop_duplicates,
    "checkpoint": cut_lineage,
}


@dataclass(frozen=True)
class Step:
    op: str
    args: Mapping[str, object] = field(default_factory=dict)

    def bind(self) -> Callable[[DataFrame], DataFrame]:
        fn = STEPS[self.op]
        return lambda df: df.transform(fn, **dict(self.args))


def _check(step: Step) -> None:
    if step.op not in STEPS:
        raise ValueError(f"Unknown step {step.op!r}; known: {sorted(STEPS)}")
    sig = inspect.signature(STEPS[step.op])
    try:
        sig.bind(None, **dict(step.args))
    except TypeError as e:
        raise ValueError(f"Step {step.op!r}: {e}") from None


class Recipe:
    """An ordered, validated list of steps."""

    def __init__(self, steps: Iterable[Step | tuple | Mapping]):
        self.steps: list[Step] = []
        for s in steps:
            if isinstance(s, Step):
                step = s
            elif isinstance(s, Mapping):
                step = Step(s["op"], {k: v for k, v in s.items() if k != "op"})
            else:
                op, *rest = s
                step = Step(op, rest[0] if rest else {})
            _check(step)
            self.steps.append(step)

    def __len__(self) -> int:
        return len(self.steps)

    def apply(self, df: DataFrame, watch: Callable[[Step, DataFrame], DataFrame] | None = None) -> DataFrame:
        """The steps in order; ``watch(step, result)`` may wrap the result of each (a row counter, say)."""
        for s in self.steps:
            df = s.bind()(df)
            if watch is not None:
                df = watch(s, df)
        return df

    __call__ = apply

    def to_json(self) -> str:
        """The steps as JSON, e.g. for a scheduled job's configuration."""
        return json.dumps([{"op": st.op, **dict(st.args)} for st in self.steps])

    @classmethod
    def from_json(cls, text: str) -> "Recipe":
        """Steps from ``to_json`` output; validated like any recipe."""
        data = json.loads(text)
        if not isinstance(data, list) or not all(isinstance(d, dict) and "op" in d for d in data):
            raise ValueError("a recipe is a JSON list of objects with an 'op' key")
        return cls(data)

    @classmethod
    def from_actions(cls, actions: Iterable[str]) -> "Recipe":
        """Build from ``NAME:arg:...`` action strings, e.g. ``FILTER:price:>:1000``,
        ``SORT:price:desc``, ``RENAME:a:b``, ``DROP_COLUMN:a``, ``REMOVE_NULLS:fill``,
        ``REMOVE_DUPLICATES``. The last argument of FILTER keeps any ``:`` it holds."""
        steps = []
        for raw in actions:
            text = raw.strip()
            if text.startswith("ACTION:"):
                text = text[len("ACTION:"):]
            name, _, rest = text.partition(":")
            name = name.strip().upper()
            if name == "FILTER":
                column, op, value = (p.strip() for p in rest.split(":", 2))
                steps.append(Step("filter", {"column": column, "operator": op, "value": value}))
            elif name == "SORT":
                parts = [p.strip() for p in rest.split(":")]
                steps.append(Step("sort", {"column": parts[0], "order": parts[1] if len(parts) > 1 else "asc"}))
            elif name == "RENAME":
                old, new = (p.strip() for p in rest.split(":", 1))
                steps.append(Step("rename", {"old_name": old, "new_name": new}))
            elif name == "DROP_COLUMN":
                steps.append(Step("drop_column", {"column": rest.strip()}))
            elif name == "REMOVE_NULLS":
                steps.append(Step("fill_nulls" if "fill" in rest else "drop_nulls", {}))
            elif name == "CHECKPOINT":
                steps.append(Step("checkpoint", {}))
            elif name == "REMOVE_DUPLICATES":
                steps.append(Step("drop_duplicates", {}))
            else:
                raise ValueError(f"Action {raw!r} is not a data step")
        return cls(steps)
