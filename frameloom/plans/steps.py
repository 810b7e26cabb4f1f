"""Steps of a plan and their registry. A step takes and gives named DataFrames."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any, Protocol

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)
#: Group of entry points under which installed packages offer steps.
ENTRY_POINTS = "frameloom.steps"


@dataclass
class Context:
    """What a plan has so far: DataFrames by name, and its parameters."""

    tables: dict[str, DataFrame]
    params: Any = None


@dataclass
class Result:
    ok: bool
    step: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    notes: dict[str, Any] = field(default_factory=dict)


class Step(Protocol):
    name: str
    version: str

    def handles(self, step: str) -> bool: ...

    def run(self, context: Context) -> Result: ...


class Registry:
    """Steps in the order they were added; the first of a name stays, the first that handles a step runs it."""

    def __init__(self) -> None:
        self._steps: dict[str, Step] = {}
        self._loaded = False

    def add(self, step: Step) -> bool:
        if not all(hasattr(step, a) for a in ("name", "version", "handles", "run")):
            log.warning("%r is no step and is left out", step)
            return False
        if step.name in self._steps:
            log.warning("step %s is there already", step.name)
            return False
        self._steps[step.name] = step
        return True

    def _load(self) -> None:
        if not self._loaded:
            self._loaded = True
            for point in entry_points(group=ENTRY_POINTS):
                try:
                    self.add(point.load()())
                except Exception:  # noqa: BLE001 - a broken package doesn't end the plan
                    log.exception("step %s can't be loaded", point.name)

    def names(self) -> list[str]:
        self._load()
        return list(self._steps)

    def find(self, step: str) -> Step | None:
        self._load()
        return next((s for s in self._steps.values() if s.handles(step)), None)


def run_steps(names: list[str], registry: Registry, context: Context, done: set[str] | None = None) -> list[Result]:
    """Runs steps in order; those done are skipped, unknown ones warn, a failed one leaves its tables out."""
    out = []
    for name in names:
        if name in (done or set()):
            continue
        step = registry.find(name)
        if step is None:
            log.warning("no step handles %s", name)
            out.append(Result(False, name, notes={"reason": "unresolved"}))
            continue
        try:
            result = step.run(context)
        except Exception as e:  # noqa: BLE001
            log.exception("step %s failed", name)
            result = Result(False, name, notes={"reason": f"{type(e).__name__}: {e}"})
        if result.ok:
            context.tables.update(result.tables)
        out.append(result)
    return out


@dataclass
class FunctionStep:
    """A step made of a function of the context that gives tables."""

    name: str
    function: Any
    version: str = "1"

    def handles(self, step: str) -> bool:
        return step == self.name

    def run(self, context: Context) -> Result:
        return Result(True, self.name, self.function(context))
