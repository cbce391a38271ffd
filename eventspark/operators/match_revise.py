"""Apply an operator with different settings to the rows that different matchers select."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import dsl
from eventspark.functions.blocks import BLOCK
from eventspark.sources.tables import ORDER

MODES = ("match_and_revise", "multi_match_and_revise")


def match_revise(df: DataFrame, blocks: list[dict[str, Any]], apply: Callable[[DataFrame, dict[str, Any]], DataFrame], shared: dict[str, Any] | None = None, mode: str = "match_and_revise", columns: Callable[[DataFrame, dict[str, Any]], dict[str, Column]] | None = None, together: Callable[[DataFrame, list[dict[str, Any]]], DataFrame] | None = None) -> DataFrame:
    """``blocks``: settings with a ``_matcher`` each, over the ``shared`` ones. In ``match_and_revise`` a row goes to
    its first block; in ``multi_match_and_revise`` to every block that matches. Rows of no block stay as they are,
    after the blocks' rows of the same time; a row whose matcher is null vanishes, as it is in neither.

    An operator that only changes columns names them with ``columns``: then the input is read once, each row beside
    the numbers of its blocks. So it is for one that works on all blocks ``together``: it gets the rows with the number of
    their block (``functions.blocks.BLOCK``; a row of several blocks stands once for each) and the settings of all blocks,
    and leaves rows of no block as they are. Any other operator gets the rows of each block as a frame of its own."""
    if mode not in MODES:
        raise ValueError(f"'{mode}' is no mode of match and revise: {', '.join(MODES)}")
    if not isinstance(blocks, list) or not blocks or not all(isinstance(b, dict) and "_matcher" in b for b in blocks):
        raise ValueError("Match and revise needs a list of settings with a '_matcher' each")
    tests, settings = [], [{**(shared or {}), **{k: v for k, v in b.items() if k != "_matcher"}} for b in blocks]
    for i, b in enumerate(blocks):
        test, need = dsl.matcher(b["_matcher"])
        if lacking := sorted(need - set(df.columns)):
            raise ValueError(f"The matcher of block {i} reads {lacking}, but the rows have {sorted(df.columns)}")
        tests.append(test)
    none = reduce(and_, [~t for t in tests])
    first_only = mode == MODES[0]
    own = [reduce(and_, [*(~t for t in tests[:i] if first_only), t]) for i, t in enumerate(tests)]
    if columns is not None:
        return _in_one_pass(df, [*own, none], [columns(df, s) for s in settings])
    if together is not None:
        return _at_once(df, together(_dealt(df, [*own, none]), settings))
    parts = [apply(df.where(t), s) for t, s in zip(own, settings, strict=True)] + [df.where(none)]
    if ORDER in df.columns:
        parts = [p.withColumn(ORDER, F.struct(F.lit(i).alias("b"), F.col(ORDER).alias("o"))) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _dealt(df: DataFrame, tests: list[Column]) -> DataFrame:
    """A row for each test that holds, with the test's number."""
    return df.withColumn(BLOCK, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))))


def _at_once(df: DataFrame, out: DataFrame) -> DataFrame:
    """What an operator made of all blocks together, checked for the columns of the rows of no block."""
    if added := sorted(set(out.columns) - {*df.columns, BLOCK}):
        raise ValueError(f"Rows of no block would lack the new columns {added}")
    place = F.struct(F.col(BLOCK).alias("b"), F.col(ORDER).alias("o")) if ORDER in df.columns else None
    return out.select(*[place.alias(ORDER) if c == ORDER else F.col(f"`{c}`") for c in df.columns])


def _in_one_pass(df: DataFrame, tests: list[Column], changes: list[dict[str, Column]]) -> DataFrame:
    """A row for each test that holds, with that block's columns; the last test stands for no block."""
    kinds = df.schema
    names = list(dict.fromkeys([*df.columns, *(k for c in changes for k in c)]))
    if added := [n for n in names if n not in df.columns and not all(n in c for c in changes)]:
        raise ValueError(f"Every block has to make the new columns {added}, as blocks are put together")
    if added := [n for n in names if n not in df.columns]:
        raise ValueError(f"Rows of no block would lack the new columns {added}")
    own = _dealt(df, tests)
    out = []
    for name in names:
        value = F.col(f"`{name}`")
        for i, c in enumerate(changes):
            if name in c:
                value = F.when(F.col(BLOCK) == i, c[name].cast(kinds[name].dataType)).otherwise(value)
        out.append((F.struct(F.col(BLOCK).alias("b"), F.col(ORDER).alias("o")) if name == ORDER else value).alias(name))
    return own.select(*out)
