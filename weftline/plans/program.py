"""Programs as nested calls, ``["emit", "y", ["square", ["cast_double", ["input", "x"]]]]``, turned into a DataFrame.

A call of row-local functions becomes a Column; a call that looks at other rows adds a column to the frame.  Equal calls are
made once.  Catalyst plans the rest.  Types are exact: ``float`` and ``double`` series don't mix, and a number must be cast
before use; calls that don't resolve raise ``ProgramError``.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import ieee, special
from weftline.operators import convolve, scan, shift
from weftline.operators.frame import IDX, settle
from weftline.plans.calls import Call, digest, reads

log = logging.getLogger(__name__)


class ProgramError(ValueError):
    """A call that doesn't resolve, or a parameter out of range."""


@dataclass(frozen=True)
class Series:
    """A Column of the frame, ``float`` or ``double``; ``free`` if it needs no input."""

    column: Column
    kind: str
    free: bool


@dataclass(frozen=True)
class Scalar:
    value: float
    kind: str  # float, double, int64, or number for one that isn't cast


@dataclass
class Sinks:
    """What a program asks for, in order: (name, column) of emitters and meters, and calls of the plotter."""

    emit: list[tuple[str, Column]] = field(default_factory=list)
    meter: list[tuple[str, Column]] = field(default_factory=list)
    plot: list[dict[str, Any]] = field(default_factory=list)


#: Calls that a user adds: name -> function of (evaluator, arguments) that returns a Series or Scalar.
EXTENSIONS: dict[str, Callable[[Evaluator, list[Any]], Any]] = {}


def register(name: str, build: Callable[[Evaluator, list[Any]], Any]) -> None:
    EXTENSIONS[name] = build


def parse(text: str) -> list[Any]:
    """A program from JSON; ``{"$ref": "#/0/1"}`` stands for the call at that path, which is built once."""
    root = json.loads(text)
    built: dict[str, Any] = {}

    def at(path: str) -> Any:
        if path not in built:
            node = root
            for step in path.split("/")[1:]:
                node = node[int(step)]
            built[path] = whole(node, path)
        return built[path]

    def whole(node: Any, path: str) -> Any:
        if isinstance(node, dict) and "$ref" in node:
            return at(node["$ref"])
        if not isinstance(node, list):
            return node
        items = [at(f"{path}/{i}") for i in range(len(node))]
        return Call(items) if items and isinstance(items[0], str) else items

    return whole(root, "#")


_SCANS: dict[str, Callable[..., DataFrame]] = {"cum_sum": scan.cumulative_sum, "cum_sum_clamped": scan.clamped_sum, "cum_prod": scan.cumulative_product, "cum_log_sum_exp": scan.log_sum_exp, "fwd_fill_zero": scan.fill_zeros, "monotonify": scan.running_maximum, "slow_pass_zero": scan.slow_pass_zero}


class Evaluator:
    """Evaluates calls over a frame; ``df`` gains a column for each call that looks at other rows."""

    def __init__(self, df: DataFrame, by: Sequence[str] = (), drawings: dict[str, DataFrame] | None = None):
        self.df, self.by, self.drawings = df, list(by), drawings or {}
        self.inputs = {c for c in df.columns if c != IDX and c not in self.by}
        self.made: dict[Any, Any] = {}
        self.names = 0

    # -- values

    def value(self, node: Any) -> Any:
        if isinstance(node, bool | str):
            return node
        if node is None:
            return Scalar(math.nan, "number")
        if isinstance(node, int | float):
            return Scalar(float(node), "number")
        key = digest(node)
        if key not in self.made:
            self.made[key] = self.call(node[0], list(node[1:]))
        return self.made[key]

    def fresh(self) -> str:
        self.names += 1
        return f"_v{self.names}"

    def stored(self, s: Series) -> str:
        """The name of a column of the frame that holds the series."""
        name = self.fresh()
        self.df = self.df.withColumn(name, s.column)
        return name

    def shaped(self, column: Column, kind: str, free: bool) -> Series:
        return Series(column.cast("float") if kind == "float" else column.cast("double"), kind, free)

    def over_rows(self, s: Series, build: Callable[[DataFrame, str, str], DataFrame]) -> Series:
        """A new column that ``build(frame, input column, output column)`` adds.  ``build`` may read the frame more than once,
        so the frame is written first and what it holds is made once."""
        source, out = self.stored(self.shaped(s.column, "double", s.free)), self.fresh()
        self.df = build(settle(self.df), source, out).drop(source)
        return self.shaped(F.col(out), s.kind, s.free)

    # -- calls

    def call(self, name: str, args: list[Any]) -> Any:
        if name in EXTENSIONS:
            return EXTENSIONS[name](self, args)
        if name == "input":
            if args[0] not in self.inputs:
                raise ProgramError(f"no input named {args[0]!r}")
            return self.over_rows(Series(F.col(f"`{args[0]}`").cast("double"), "double", False), lambda df, x, out: shift.forward_fill(df, x, out, self.by))
        if name == "meta":
            return self.value(args[0])
        if name == "conv":
            return self.conv(*args)
        v = [self.value(a) for a in args]
        if name == "arr":
            kinds = {(type(x), getattr(x, "kind", None)) for x in v}
            if len(kinds) != 1 or next(iter(kinds))[1] not in ("float", "double"):
                raise ProgramError("arr takes floats, doubles or series of one kind, at least one")
            return v
        if name.startswith("cast_"):
            return self.cast(name[5:], *v)
        if name == "info":
            log.info("%s: %s", v[0], v[1].value)
            return v[1]
        if name == "check_eq":
            return self.check(*v)
        if name in ieee.UNARY or name in special.UNARY:
            return self.local(ieee.UNARY.get(name) or special.UNARY[name], v, name, 1)
        if name in ieee.BINARY:
            return self.local(ieee.BINARY[name], v, name, 2)
        if name == "cond":
            return self.local(ieee.choose, v, name, 3)
        if name == "tri_cond":
            return self.local(ieee.choose_by_sign, v, name, 4)
        found = getattr(self, f"do_{name}", None)
        if found is None and name in _SCANS:
            return self.over_rows(self.series(v[0], name), lambda df, x, out: _SCANS[name](df, x, out, self.by))
        if found is None:
            raise ProgramError(f"unable to resolve {name}")
        return found(*v)

    def series(self, x: Any, name: str) -> Series:
        if not isinstance(x, Series):
            raise ProgramError(f"{name} takes a series")
        return x

    def number(self, x: Any, name: str, kinds: tuple[str, ...] = ("float", "double")) -> float:
        if not isinstance(x, Scalar) or x.kind not in kinds:
            raise ProgramError(f"{name} takes a {' or '.join(kinds)}")
        return x.value

    def cast(self, kind: str, x: Any) -> Any:
        if kind not in ("float", "double", "int64"):
            raise ProgramError(f"unable to resolve cast_{kind}")
        if isinstance(x, Series):
            if kind == "int64":
                raise ProgramError("a series can't be cast to int64")
            return self.shaped(x.column, kind, x.free)
        if not isinstance(x, Scalar):
            raise ProgramError(f"cast_{kind} takes a number or a series")
        if kind == "int64":
            if not math.isfinite(x.value):
                raise ProgramError("cast_int64 takes a finite number")
            return Scalar(int(x.value), "int64")
        with np.errstate(over="ignore"):
            return Scalar(float(np.float32(x.value)) if kind == "float" else float(x.value), kind)

    def check(self, a: Any, b: Any) -> None:
        if not isinstance(a, Scalar) or not isinstance(b, Scalar) or a.kind != b.kind:
            raise ProgramError("check_eq takes two scalars of one kind")
        if math.isnan(a.value - b.value):
            good = math.isnan(a.value) == math.isnan(b.value)
        else:
            good = abs(a.value - b.value) <= 1e-6 * max(1, abs(a.value) + abs(b.value))
        if not good:
            raise AssertionError(f"{a.value} is not {b.value}")

    def local(self, f: Callable[..., Column], v: list[Any], name: str, takes: int) -> Any:
        """A row-local call; of scalars alone, a scalar (mixed kinds of two give a double)."""
        kinds = [getattr(x, "kind", None) for x in v]
        if any(k not in ("float", "double") for k in kinds) or len(v) != takes:
            raise ProgramError(f"unable to resolve {name} of {kinds}")
        if all(isinstance(x, Scalar) for x in v):
            if len(set(kinds)) > 1 and len(v) != 2:
                raise ProgramError(f"unable to resolve {name} of {kinds}")
            kind = "float" if set(kinds) == {"float"} else "double"
            return Scalar(self.folded(f(*[F.lit(x.value).cast("double") for x in v]), kind), kind)
        if len(set(kinds)) > 1:
            raise ProgramError(f"unable to resolve {name} of {kinds}")
        columns = [(x.column if isinstance(x, Series) else F.lit(x.value)).cast("double") for x in v]
        s = self.shaped(f(*columns), kinds[0], all(not isinstance(x, Series) or x.free for x in v))
        name = self.stored(s)
        return Series(F.col(name), s.kind, s.free)

    def folded(self, column: Column, kind: str) -> float:
        """The value of a Column of literals: a one-row plan, so that scalars and series follow the same rules."""
        return float(self.df.sparkSession.range(1).select(column.cast(kind).cast("double").alias("v")).first()[0])

    # -- generators

    def generated(self, column: Column, kind: str) -> Series:
        s = self.shaped(column, kind, True)
        return Series(F.col(self.stored(s)), kind, True)

    def do_to_ts(self, x: Any) -> Series:
        if isinstance(x, list) and isinstance(x[0], Scalar):
            return self.generated(convolve.listed([y.value for y in x]), x[0].kind)
        return self.generated(F.lit(self.number(x, "to_ts")), x.kind)

    def do_seq(self, scale: Any) -> Series:
        return self.generated(convolve.sequence(self.number(scale, "seq")), scale.kind)

    def do_gaussian(self, wavelength: Any) -> Series:
        return self.generated(convolve.gaussian(self.number(wavelength, "gaussian")), wavelength.kind)

    def do_drawn(self, name: str, trigger: Any) -> Series:
        trigger = self.series(trigger, "drawn")
        if name not in self.drawings:
            return self.generated(F.lit(math.nan), trigger.kind)
        out = self.fresh()
        self.df = settle(convolve.drawn(self.df, self.drawings[name], out))
        return Series(F.col(out), "double", False)

    # -- other rows

    def do_delay(self, x: Any, rows: Any) -> Series:
        rows = int(self.number(rows, "delay", ("int64",)))
        if rows <= 0:
            raise ProgramError("a delay must be at least one row")
        return self.over_rows(self.series(x, "delay"), lambda df, c, out: shift.delay(df, c, out, rows, self.by))

    def do_sub_delta(self, x: Any) -> Series:
        return self.over_rows(self.series(x, "sub_delta"), lambda df, c, out: shift.difference(df, c, out, self.by))

    def do_div_delta(self, x: Any) -> Series:
        return self.over_rows(self.series(x, "div_delta"), lambda df, c, out: shift.difference(df, c, out, self.by, ratio=True))

    def do_decaying_sum(self, x: Any, rate: Any) -> Series:
        if getattr(rate, "kind", None) != self.series(x, "decaying_sum").kind:
            raise ProgramError("decaying_sum takes a rate of the series' kind")
        by_row = F.lit(rate.value) if isinstance(rate, Scalar) else F.col(self.stored(rate)).cast("double")
        return self.over_rows(x, lambda df, c, out: scan.decaying_sum(df, c, by_row, out, self.by))

    def do_scan_if(self, condition: Any, other: Any, start: Any) -> Series:
        condition = self.series(condition, "scan_if")
        if {condition.kind, getattr(other, "kind", None), getattr(start, "kind", None)} != {condition.kind}:
            raise ProgramError("scan_if takes arguments of one kind")
        first = self.number(start, "scan_if")
        value = F.lit(other.value) if isinstance(other, Scalar) else F.col(self.stored(other)).cast("double")
        return self.over_rows(condition, lambda df, c, out: scan.hold_if(df, c, value, first, out, self.by))

    def do_norm(self, x: Any, rows: Any, zero_outside: bool) -> Series:
        x, n = self.series(x, "norm"), int(self.number(rows, "norm", ("int64",)))
        if n <= 0:
            raise ProgramError("norm takes a positive size")
        return self.over_rows(x, lambda df, c, out: convolve.normalise(df, c, out, n, bool(zero_outside), self.by))

    def do_dot(self, a: Any, b: Any) -> Series:
        if not isinstance(a, list) or not isinstance(b, list) or len(a) != len(b) or a[0].kind != b[0].kind:
            raise ProgramError("dot takes two arrays of one length and kind")
        side = lambda v: [(x.column if isinstance(x, Series) else F.lit(x.value)).cast("double") for x in v]
        scalars = all(isinstance(x, Scalar) for x in (*a, *b))
        kind = "float" if scalars else a[0].kind
        s = self.shaped(convolve.dot(side(a), side(b)), kind, all(isinstance(x, Scalar) or x.free for x in (*a, *b)))
        return Series(F.col(self.stored(s)), kind, s.free)

    def conv(self, kernel: Any, x: Any, taps: Any, backfill: bool) -> Series:
        n = int(self.number(self.value(taps), "conv", ("int64",)))
        if n <= 1 or n > 0xFFFFFFFF:
            raise ProgramError("a kernel has at least two taps")
        x = self.series(self.value(x), "conv")
        # a kernel that needs no input is evaluated over as many rows as it has taps; another over this frame
        if reads(kernel):
            k = self.series(self.value(kernel), "conv")
            values = convolve.kernel_values(self.df, k.column, n, self.by)
        else:
            alone = Evaluator(convolve.index_frame(self.df.sparkSession, n))
            k = alone.series(alone.value(kernel), "conv")
            values = convolve.kernel_values(alone.df, k.column, n)
        if k.kind != x.kind:
            raise ProgramError("conv takes a kernel and a series of one kind")
        return self.over_rows(x, lambda df, c, out: convolve.convolve(df, c, values, out, bool(backfill), self.by))


def evaluate(df: DataFrame, program: list[Any] | str, by: Sequence[str] = (), drawings: dict[str, DataFrame] | None = None) -> tuple[DataFrame, Sinks]:
    """The frame with all columns that ``program`` needs, and its sinks.

    ``df`` has ``idx``, the ``by`` columns and the inputs (null: the key is missing, so the value before it holds; NaN: no
    value).  A top-level call that doesn't resolve is logged and left out; the others still run.
    """
    calls = parse(program) if isinstance(program, str) else program
    run, sinks = Evaluator(df, by, drawings), Sinks()
    for call in calls:
        try:
            if call[0] in ("emit", "meter"):
                s = run.series(run.value(call[2]), call[0])
                getattr(sinks, call[0]).append((call[1], F.col(run.stored(s))))
            elif call[0] == "plot":
                s = run.series(run.value(call[2]), "plot")
                sinks.plot.append({"name": call[1], "column": F.col(run.stored(s)), "offset": call[3], "enabled": call[4], "color": call[5:9]})
            elif call[0] == "drawing":
                sinks.plot.append({"name": call[1], "points": run.drawings.get(call[1]), "enabled": call[2], "color": call[3:7]})
            elif call[0] == "check_eq":
                run.value(call)
            else:
                raise ProgramError(f"{call[0]} is not a sink")
        except ProgramError as e:
            log.warning("%s: %s", call[:2], e)
    return run.df, sinks


def run(df: DataFrame, program: list[Any] | str, by: Sequence[str] = (), drawings: dict[str, DataFrame] | None = None) -> DataFrame:
    """``by``, ``idx`` and the emitted columns, in the program's order; values that are not finite are null."""
    frame, sinks = evaluate(df, program, by, drawings)
    return frame.select(*by, IDX, *[F.when(ieee.finite(c), c).alias(name) for name, c in sinks.emit])


def metered(df: DataFrame, program: list[Any] | str, indices: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """The metered columns at these row indices, in their order; only whole indices can be metered."""
    if any(not isinstance(i, int) for i in indices):
        raise ProgramError("only whole row indices can be metered")
    frame, sinks = evaluate(df, program, by)
    rank = F.array_position(F.array(*[F.lit(i) for i in indices]), F.col(IDX).cast("int"))
    rows = frame.where(F.col(IDX).isin(list(indices)))
    return rows.select(*by, IDX, *[F.when(ieee.finite(c), c).alias(name) for name, c in sinks.meter], rank.alias("_rank")).orderBy("_rank").drop("_rank")


def session_range(spark: SparkSession, rows: int) -> DataFrame:
    """A frame for programs without inputs: they are as long as this says."""
    return convolve.index_frame(spark, rows)
