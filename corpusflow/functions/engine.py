"""The boundary to a model: a column function behind a small contract, and its wire format."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError

#: Names of sampling parameters on the wire.
OPTIONS = {"temperature": "temperature", "top_p": "top_p", "top_k": "top_k", "max_tokens": "num_predict", "seed": "seed", "stop": "stop", "repeat_penalty": "repeat_penalty"}


@dataclass(frozen=True)
class Engine:
    """A named engine: ``chat`` answers a batch of rendered prompts, ``load`` runs once in a worker."""

    name: str
    load: Callable[[], object]
    chat: Callable[[object, list[str]], list[str]]
    models: tuple[str, ...] = ()
    capabilities: frozenset[str] = field(default_factory=frozenset)

    def health(self) -> tuple[bool, str]:
        """Never raises."""
        try:
            self.load()
        except Exception as error:  # noqa: BLE001  a sick engine is an answer
            return False, str(error)
        return True, "ok"

    def column(self, prompt: Column) -> Column:
        """The model's answers; the model is loaded once for each worker's task."""
        load, chat = self.load, self.chat

        def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for prompts in batches:
                yield pd.Series(chat(model, prompts.tolist()), dtype=object)

        answer.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(answer, "string")(prompt)


class Engines:
    """Engines by name; unknown names say which there are."""

    def __init__(self) -> None:
        self._known: dict[str, Engine] = {}

    def register(self, engine: Engine, replace: bool = False) -> None:
        if engine.name in self._known and not replace:
            raise EngineError(f"engine {engine.name!r} is registered already")
        self._known[engine.name] = engine

    def get(self, name: str) -> Engine:
        if name not in self._known:
            raise EngineError(f"unknown engine {name!r}; there are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]


def wire_message(df: DataFrame) -> Column:
    """A turn as the wire's JSON; empty fields are left out, calls carry their arguments as JSON text."""
    assistant, tool = F.col("role") == "assistant", F.col("role") == "tool"
    calls = F.transform("tool_calls", lambda c: F.struct(F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))
    optional = lambda name, when: F.when(when, F.nullif(F.col(name), F.lit(""))) if name in df.columns else F.lit(None).cast("string")
    return F.to_json(F.struct("role", F.coalesce("content", F.lit("")).alias("content"), optional("thinking", assistant).alias("thinking"), F.when(F.size("tool_calls") > 0, calls).alias("tool_calls"), optional("name", tool).alias("tool_name"), optional("tool_call_id", tool).alias("tool_call_id")), {"ignoreNullFields": "true"})


def wire_think(enabled: Column, effort: Column) -> Column:
    """false, true or the effort as JSON; null where no level is set."""
    return F.when(enabled.isNull(), None).when(~enabled, "false").otherwise(F.coalesce(F.concat(F.lit('"'), effort, F.lit('"')), F.lit("true")))


def wire_options(df: DataFrame) -> Column:
    """Sampling parameters that are set, as JSON under their wire names."""
    return F.to_json(F.struct(*(F.col(k).alias(v) for k, v in OPTIONS.items() if k in df.columns)), {"ignoreNullFields": "true"})


def read_calls(raw: Column) -> Column:
    """Calls of an answer's JSON text: arguments may be an object or JSON text; nameless ones are dropped,
    other arguments raise."""
    parsed = F.from_json(raw, "array<struct<id:string,function:struct<name:string,arguments:string>>>")
    named = F.filter(parsed, lambda c: F.coalesce(c["function"]["name"], F.lit("")) != "")

    def call(c: Column) -> Column:
        text = F.coalesce(F.nullif(F.trim(c["function"]["arguments"]), F.lit("")), F.lit("{}"))
        good = text.startswith("{") & F.try_parse_json(text).isNotNull()
        checked = F.when(good, text).otherwise(F.raise_error(F.concat(F.lit("arguments are no object: "), text)))
        return F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), checked.alias("arguments"))

    return F.transform(named, call)
