"""SQL over registered views, and the column functions by name."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from .functions import dates, extract, nested, rules, scoring, text
from .operators import views

#: The pure column functions of the library by name, to be called on columns or read by tools.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    f"{module.__name__.rsplit('.', 1)[1]}.{name}": f
    for module in (dates, extract, nested, rules, scoring, text)
    for name, f in vars(module).items()
    if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == module.__name__ and "DataFrame" not in str(getattr(f, "__annotations__", {}).get("return", ""))
} | {"views.actionable": views.actionable, "views.triage": views.triage}


def call(name: str, *args, **options) -> Column:
    """A registered function applied to columns; an unknown name is an error that names the nearest ones."""
    if name not in FUNCTIONS:
        near = ", ".join(sorted(n for n in FUNCTIONS if n.split(".")[-1][:3] == name.split(".")[-1][:3]))
        raise KeyError(f"no function {name!r}" + (f"; there are {near}" if near else ""))
    return FUNCTIONS[name](*args, **options)


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Each table as a temporary view of its name, so that spark.sql() can be asked."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def folder_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}


@dataclass(frozen=True)
class Config:
    """What a run is told, checked when it is made: wrong values are errors here and not in the middle of a plan."""

    sources: str = "all"
    as_of: str | None = None
    history_days: int | None = None
    max_records: int = 1000
    max_pages: int = 50
    time_budget_seconds: int | None = None
    workers: int = 4
    state_folder: str | None = None
    output_folder: str = "out"
    state_disabled: bool = False
    caps: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("max_records", "max_pages", "workers"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("history_days", "time_budget_seconds"):
            if getattr(self, name) is not None and getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.as_of is not None:
            import datetime

            datetime.date.fromisoformat(self.as_of)

    @classmethod
    def from_env(cls, prefix: str = "TALUS_", env: Mapping[str, str] | None = None) -> Config:
        """Fields from the environment's variables, by prefix and name in capitals; unknown ones are an error."""
        env = os.environ if env is None else env
        kinds = {n: f.type for n, f in cls.__dataclass_fields__.items()}
        given = {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}
        if unknown := given.keys() - kinds.keys():
            raise ValueError(f"unknown settings {sorted(unknown)}")
        read = lambda n, v: int(v) if "int" in kinds[n] and "Mapping" not in kinds[n] else v.lower() in ("1", "true", "yes") if kinds[n] == "bool" else dict((a, int(b)) for a, b in (x.split("=") for x in v.split(",") if x)) if "Mapping" in kinds[n] else v
        return cls(**{n: read(n, v) for n, v in given.items()})
