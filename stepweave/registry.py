"""Environments by name, run settings, simulated tools and the command line's verbs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave import dims


@dataclass(frozen=True)
class EnvSpec:
    """How an environment is made: its maker, domain, and arguments that a call may override."""

    name: str
    maker: Callable[..., object]
    domain: str = "generic"
    arguments: dict = field(default_factory=dict)


_ENVS: dict[str, EnvSpec] = {}


def register(name: str, maker: Callable[..., object], domain: str = "generic", **arguments: object) -> None:
    """A name is given once."""
    if name in _ENVS:
        raise ValueError(f"there is an environment {name!r} already")
    _ENVS[name] = EnvSpec(name, maker, domain, arguments)


def spec(name: str) -> EnvSpec:
    if name not in _ENVS:
        raise KeyError(f"no environment {name!r}; there are {', '.join(list_envs())}")
    return _ENVS[name]


def make(name: str, **arguments: object) -> object:
    """The environment of a name, made with its own arguments and those given here on top."""
    s = spec(name)
    return s.maker(**(s.arguments | arguments))


def list_envs(domain: str | None = None) -> list[str]:
    return sorted(n for n, s in _ENVS.items() if domain in (None, s.domain))


@dataclass(frozen=True)
class Settings:
    """Settings of a run; None stands for not given."""

    epochs: int = 3
    batch_size: int = 4
    max_length: int = 2048
    chunk_overlap: int = 1
    curriculum_warmup: int = 3
    curriculum_start: float = 0.3
    seed: int = 42
    mask_observations: bool = True
    step_weighted: bool = False


def settings(spark: SparkSession, path: str | None = None, **given: object) -> Settings:
    """Defaults, then those of a JSON file of any file system of the cluster, then what is given here and isn't None; unknown names are an error."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    return replace(Settings(), **(found | {k: v for k, v in given.items() if v is not None}))


def settings_rows(spark: SparkSession, s: Settings) -> DataFrame:
    """(name, value) of settings."""
    return spark.createDataFrame([(k, str(v)) for k, v in asdict(s).items()], "name string, value string")


def simulated_output(domain: Column, tool: Column, params: Column) -> Column:
    """What a tool says where none is attached: answers are echoed, reads and searches name what they were asked, tools that the domain doesn't know are refused."""
    known = F.lit(False)
    for d in dims.list_domains():
        names = [n for _, n, _, _ in dims.tool_rows(d)]
        if names:
            known = known | ((domain == d) & tool.isin(names))
    said = F.coalesce(*(F.get_json_object(params, f"$.{k}") for k in ("message", "query", "pattern", "path", "command")), F.lit(""))
    return F.when(~known, F.concat(F.lit("unknown tool: "), tool)).otherwise(F.concat(F.lit("["), tool, F.lit("] "), said))
