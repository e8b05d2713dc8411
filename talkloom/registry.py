"""Operators by name, with declared parameters: the counterpart of a tool registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Parameter:
    """A declared argument. [VAL6]"""

    kind: type
    required: bool = False
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def problem(self, name: str, value: Any) -> str | None:
        if not isinstance(value, self.kind) or isinstance(value, bool) and self.kind is not bool:
            return f"{name} must be {self.kind.__name__}"
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            return f"{name} is out of range"
        return f"{name} must be one of {self.choices}" if self.choices and value not in self.choices else None


@dataclass(frozen=True)
class Result:
    success: bool
    data: Any = None
    error: str = ""


@dataclass(frozen=True)
class Tool:
    name: str
    run: Callable[..., Any]
    category: str = "general"
    parameters: dict[str, Parameter] = field(default_factory=dict)
    any_of: tuple[str, ...] = ()


class Registry:
    """register, list (FLT15, SET6) and execute; errors become results."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def tools(self, category: str | None = None, names: list[str] | None = None) -> list[Tool]:
        return [t for t in self._tools.values() if category in (None, t.category) and (names is None or t.name in names)]

    def check(self, tool: Tool, given: dict[str, Any]) -> str | None:
        for name, p in tool.parameters.items():
            if name not in given:
                if p.required:
                    return f"{name} is missing"
            elif problem := p.problem(name, given[name]):
                return problem
        unknown = set(given) - set(tool.parameters)
        if unknown:
            return f"unknown argument {sorted(unknown)[0]}"
        return f"one of {tool.any_of} is needed" if tool.any_of and not set(tool.any_of) & set(given) else None

    def execute(self, name: str, **given: Any) -> Result:
        tool = self._tools.get(name)
        if tool is None:
            return Result(False, error=f"Unknown tool: {name}")
        if problem := self.check(tool, given):
            return Result(False, error=problem)
        try:
            return Result(True, tool.run(**given))
        except Exception as e:  # noqa: BLE001
            return Result(False, error=str(e))


def register_functions(spark) -> None:
    """SQL names for the functions that aren't built in: fuzzy_ratio, language_runs, transliterate. [FN10, FN12, FN32]"""
    from pyspark.sql import functions as F

    from .functions import runs

    spark.udf.register("fuzzy_ratio", F.pandas_udf(runs.ratios, "double"))
    spark.udf.register("language_runs", F.pandas_udf(runs.language_runs, "array<struct<segment:string,lang:string>>"))
    spark.udf.register("transliterate", F.pandas_udf(runs.transliterated, "string"))
