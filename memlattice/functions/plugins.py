"""Plugins: named extractors, enrichers, evolvers and metrics, each a function of a DataFrame, run as ordered stages."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

KINDS = ("extractor", "enricher", "evolver", "grounder", "embedder", "metric", "stage")


@dataclass
class Registry:
    known: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(self, kind: str, name: str, f: Callable[[DataFrame], DataFrame]) -> None:
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
        if (kind, name) in self.known:
            raise ValueError(f"there is a {kind} {name} already")
        self.known[kind, name] = f

    def get(self, kind: str, name: str) -> Callable[[DataFrame], DataFrame]:
        return self.known[kind, name]

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self.known if k == kind)


def compatible(version: str, wanted: str) -> bool:
    """Whether a version meets comma-separated bounds such as >=1.2,<2; what can't be read counts as met."""
    try:
        mine = tuple(int(x) for x in version.split("."))
        for part in filter(None, (x.strip() for x in wanted.split(","))):
            op, bound = re.fullmatch(r"(>=|<=|==|>|<)\s*([\d.]+)", part).groups()
            other = tuple(int(x) for x in bound.split("."))
            n = max(len(mine), len(other))
            a, b = (x + (0,) * (n - len(x)) for x in (mine, other))
            if not {">=": a >= b, "<=": a <= b, "==": a == b, ">": a > b, "<": a < b}[op]:
                return False
    except (ValueError, AttributeError):
        return True
    return True


@dataclass
class Pipeline:
    """Ordered stages (name, function).  run stops after `until`; resume goes on with the stages after the last one run."""

    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]
    history: list[tuple[str, DataFrame]] = field(default_factory=list)

    def run(self, df: DataFrame, until: str | None = None) -> DataFrame:
        self.history = [("", df)]
        return self._go(self.stages, until)

    def resume(self, until: str | None = None) -> DataFrame:
        return self._go(self.stages[len(self.history) - 1 :], until)

    def undo(self) -> DataFrame:
        """The frame before the last stage."""
        if len(self.history) > 1:
            self.history.pop()
        return self.history[-1][1]

    def _go(self, stages: list, until: str | None) -> DataFrame:
        for name, stage in stages:
            self.history.append((name, stage(self.history[-1][1])))
            if name == until:
                break
        return self.history[-1][1]


def order_stages(needs: dict[str, list[str]]) -> list[str]:
    """Names so that each comes after what it needs, the first by name among the free; ValueError on a cycle."""
    left = {k: set(v) for k, v in needs.items()}
    out: list[str] = []
    while left:
        free = sorted(k for k, v in left.items() if not v & left.keys())
        if not free:
            raise ValueError("the stages need each other")
        out.append(free[0])
        del left[free[0]]
    return out


def problem(kind: str, name: str, f: object) -> str | None:
    """What keeps a plugin from being registered, or None."""
    if kind not in KINDS:
        return "unknown kind"
    if not re.fullmatch(r"[A-Za-z][\w-]*", name):
        return "no name"
    return None if callable(f) else "not callable"


def load(registry: Registry, offers: dict[str, tuple[str, str, Callable[[], Callable]]], wanted: str) -> dict[str, str]:
    """Registers what offers (name: kind, version, loader) give; the state of each: loaded, incompatible or failed."""
    out: dict[str, str] = {}
    for name, (kind, version, loader) in offers.items():
        if not compatible(version, wanted):
            out[name] = "incompatible"
            continue
        try:
            f = loader()
            if why := problem(kind, name, f):
                raise ValueError(why)
            registry.register(kind, name, f)
        except Exception:  # a plugin may fail in any way; the others load
            out[name] = "failed"
        else:
            out[name] = "loaded"
    return out


def guarded(f: Callable[[], object], seconds: float) -> str:
    """What a plugin returns as text, the name of its exception, or timeout; it runs in a thread of its own."""
    pool = ThreadPoolExecutor(1)
    try:
        return str(pool.submit(f).result(seconds))
    except TimeoutError:
        return "timeout"
    except Exception as e:
        return type(e).__name__
    finally:
        pool.shutdown(wait=False)


def retried(stage: Callable[[DataFrame], DataFrame], df: DataFrame, tries: int = 3, wait: float = 1.0, skip: bool = True) -> tuple[DataFrame, str, int]:
    """(frame, outcome, tries) of a stage that may fail: tried again after twice as long each time, then skipped, or the error raised."""
    for k in range(1, tries + 1):
        try:
            return stage(df), "done", k
        except Exception:
            if k == tries and not skip:
                raise
            if k < tries:
                time.sleep(wait * 2 ** (k - 1))
    return df, "skipped", tries
