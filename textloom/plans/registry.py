"""What can be run: detectors, their parameters, languages, and what users add of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import math


@dataclass(frozen=True)
class ParamSpec:
    """A parameter that a user may set. ``fixed`` ones can't change once a task has run."""

    name: str
    display: str
    default: float
    minimum: float
    maximum: float
    step: float
    is_int: bool = False
    fixed: bool = True
    description: str = ""

    def valid(self, value: float) -> bool:
        """In range, whole if need be, and on a step within one ten-thousandth."""
        if value != value or not self.minimum <= value <= self.maximum or self.is_int and value != int(value):
            return False
        steps = (value - self.minimum) / self.step if self.step else 0
        return abs(steps - round(steps)) * self.step <= 1e-4

    def rounded(self, value: float) -> float:
        """The nearest step in range; halves go up."""
        at = self.minimum + math.floor((value - self.minimum) / self.step + 0.5) * self.step if self.step else value
        return min(self.maximum, max(self.minimum, int(at) if self.is_int else round(at, 6)))

    def pick(self, value: float | None) -> float:
        """The value where it is valid, else the default."""
        out = self.default if value is None or value != value or not self.minimum <= value <= self.maximum or self.is_int and value != int(value) else value
        return int(out) if self.is_int else float(out)


SAME_NAME = ParamSpec("matchByFilename", "Match by Filename", 0, 0, 1, 1, True)


@dataclass(frozen=True)
class DetectorSpec:
    """``run(ctx, params)`` gives matches; ``group(ctx, matches, params)`` blocks of groups; ``totals(ctx)`` what to count a file by.

    A detector whose groups don't need matches of pairs has ``blocks(ctx, params)`` instead of the first two, which takes out given
    code itself. All of them may read what makers of artifacts make: ``ctx.artifact(group)``.
    """

    name: str
    display: str
    params: tuple[ParamSpec, ...]
    languages: tuple[str, ...]
    run: Callable | None = None
    group: Callable | None = None
    totals: Callable | None = None
    group_params: tuple[ParamSpec, ...] = ()
    blocks: Callable | None = None

    def values(self, given: dict[str, float] | None = None) -> dict[str, float]:
        given = given or {}
        return {p.name: p.pick(given.get(p.name)) for p in (*self.params, *self.group_params, SAME_NAME)}


class Registry:
    """Detectors, languages, token filters and artifact makers by name."""

    def __init__(self):
        self.detectors: dict[str, DetectorSpec] = {}
        self.artifacts: dict[str, dict[str, Callable]] = {}

    def detector(self, spec: DetectorSpec) -> DetectorSpec:
        if spec.name in self.detectors:
            raise ValueError(f"{spec.name} is registered already")
        self.detectors[spec.name] = spec
        return spec

    def artifact(self, group: str, language: str, make: Callable):
        """A maker of something from source text, for one language of a group of such makers: ``make(text)`` gives a list of strings, which
        ``Context.artifact`` has as rows; makers of trees give what ``structure.parse`` reads."""
        self.artifacts.setdefault(group, {})[language.lower()] = make

    def maker(self, group: str, language: str) -> Callable | None:
        return self.artifacts.get(group, {}).get(language.lower())

    def languages(self, names: list[str] | None = None) -> set[str]:
        """Languages that all the detectors can read."""
        sets = [set(d.languages) for n, d in self.detectors.items() if names is None or n in names]
        return set.intersection(*sets) if sets else set()

    def for_language(self, language: str) -> list[str]:
        return [n for n, d in self.detectors.items() if language.lower() in d.languages]


@dataclass
class Template:
    """A named set of detectors and parameter values that jobs are made from."""

    name: str
    language: str
    owner: str = ""
    public: bool = False
    detectors: dict[str, dict[str, float]] = field(default_factory=dict)

    def visible_to(self, user: str) -> bool:
        return self.public or self.owner == user

    def copy(self, name: str, owner: str) -> "Template":
        return replace(self, name=name, owner=owner, public=False, detectors={k: dict(v) for k, v in self.detectors.items()})

    def set(self, registry: Registry, detector: str, param: str, value: float, has_run: bool = False):
        spec = next((p for p in (*registry.detectors[detector].params, *registry.detectors[detector].group_params, SAME_NAME) if p.name == param), None)
        if spec is None:
            raise KeyError(param)
        if has_run and spec.fixed:
            raise ValueError(f"{param} can't change after a run")
        self.detectors.setdefault(detector, {})[param] = spec.rounded(value)
