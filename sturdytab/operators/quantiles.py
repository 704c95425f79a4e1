"""Exact linear-interpolated quantiles of many columns, whatever the row count.

`percentile` keeps every distinct value in one buffer, which is fine for small tables only. Beyond
SMALL_CELLS the wanted ranks are bracketed by `percentile_approx` (a mergeable sketch of fixed size) and the
exact values are taken from the few rows inside the bracket; a bracket still too wide is bracketed again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

SMALL_CELLS = 5_000_000
BRACKET_ROWS = 2_000_000
SKETCH_ACCURACY = 10_000
COLUMNS_PER_JOB = 8


@dataclass
class ColumnProfile:
    """Facts about one numeric column; NULLs are skipped. `varied` means more than two distinct values."""

    n: int
    low: float | None
    high: float | None
    std: float | None
    varied: bool = False
    quantiles: dict[float, float | None] = field(default_factory=dict)

    @property
    def iqr(self) -> float | None:
        q1, q3 = self.quantiles.get(0.25), self.quantiles.get(0.75)
        return None if q1 is None or q3 is None else q3 - q1


def profile_columns(
    df: DataFrame, columns: list[str], probabilities=(0.25, 0.5, 0.75), rows: int | None = None,
    small_cells: int = SMALL_CELLS,
) -> dict[str, ColumnProfile]:
    """Count, range, sample deviation and exact quantiles per column: two scans when small, three when large.

    `rows` is the row count of the table; without it a count decides which way to go.
    """
    if not columns:
        return {}
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    rows = df.count() if rows is None else rows
    large = rows * len(columns) > small_cells
    slack = 2 / SKETCH_ACCURACY
    shares = F.array(*[F.lit(x) for q in probabilities for x in (max(0.0, q - slack), min(1.0, q + slack))])
    out: dict[str, ColumnProfile] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        ids = list(range(start, min(start + COLUMNS_PER_JOB, len(columns))))
        part = data.select(*[f"c{i}" for i in ids])
        first = part.agg(*[
            a for i in ids for a in (
                F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"),
                F.max(f"c{i}").alias(f"hi{i}"), F.stddev_samp(f"c{i}").alias(f"sd{i}"),
                *([F.percentile_approx(f"c{i}", shares, SKETCH_ACCURACY).alias(f"g{i}")] if large else []),
            )
        ]).first()
        for i in ids:
            out[columns[i]] = ColumnProfile(first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"], first[f"sd{i}"])
        profiles = {i: out[columns[i]] for i in ids}
        if large:
            sketched = {
                (i, q): first[f"g{i}"][2 * j: 2 * j + 2] if first[f"g{i}"] else None
                for i in ids for j, q in enumerate(probabilities)
            }
            _large(part, profiles, probabilities, sketched)
        else:
            _small(part, profiles, probabilities)
    return out


def _between(i: int, p: ColumnProfile):
    """Whether some value lies strictly inside the range: exactly when there are more than two distinct ones."""
    c = F.col(f"c{i}")
    return F.max(F.when((c > F.lit(p.low)) & (c < F.lit(p.high)), 1)).alias(f"varied{i}")


def _small(part, profiles, probabilities):
    filled = {i: p for i, p in profiles.items() if p.n}
    for p in profiles.values():
        p.quantiles = {q: None for q in probabilities}
    if not filled:
        return
    shares = F.array(*[F.lit(float(q)) for q in probabilities])
    row = part.agg(*[
        a for i, p in filled.items()
        for a in (F.percentile(f"c{i}", shares).alias(f"q{i}"), _between(i, p))
    ]).first()
    for i, p in filled.items():
        p.varied = row[f"varied{i}"] is not None
        p.quantiles = dict(zip(probabilities, row[f"q{i}"]))


def _ranks(n: int, q: float) -> tuple[int, int, float]:
    """0-based ranks on both sides of the quantile and the weight of the upper one."""
    position = q * (n - 1)
    low = math.floor(position)
    return low, min(low + 1, n - 1), position - low


def _large(part, profiles, probabilities, sketched):
    filled = {i: p for i, p in profiles.items() if p.n}
    for p in profiles.values():
        p.quantiles = {q: None for q in probabilities}
    wanted = {}  # (column, probability) -> ranks still open
    spans = {}  # (column, probability) -> [low, high, rows below low or equal, rows strictly inside]
    values = {}  # (column, rank) -> value
    for i, p in filled.items():
        for q in probabilities:
            low, high, _ = _ranks(p.n, q)
            for r in {low, high}:
                if r == 0:
                    values[i, r] = p.low
                elif r == p.n - 1:
                    values[i, r] = p.high
                else:
                    wanted.setdefault((i, q), set()).add(r)
            if (i, q) in wanted:
                spans[i, q] = [p.low, p.high, None, p.n]
    first = True
    shrinking = set(wanted)
    while shrinking:
        guesses = sketched if first else _sketch(part, spans, wanted, shrinking)
        narrowed = _count_around(part, filled, spans, wanted, shrinking, values, guesses, with_varied=first)
        first = False
        shrinking = {
            key for key in wanted
            if wanted[key] and key in narrowed and spans[key][3] > BRACKET_ROWS
        }
    open_keys = {key for key in wanted if wanted[key]}
    if open_keys:
        _pick(part, spans, wanted, open_keys, values)
    for i, p in filled.items():
        for q in probabilities:
            low, high, share = _ranks(p.n, q)
            a, b = values[i, low], values[i, high]
            p.quantiles[q] = a + (b - a) * share


def _sketch(part, spans, wanted, keys):
    """New bounds inside each open bracket."""
    slack = 2 / SKETCH_ACCURACY
    sketches = {}  # quantiles of a column that still share a bracket share one sketch
    for i, q in sorted(keys):
        low, high, below, inside = spans[i, q]
        ranks = sorted(wanted[i, q])
        shares = sketches.setdefault((i, low, high, below), [])
        shares.append(max(0.0, (ranks[0] - below) / inside - slack))
        shares.append(min(1.0, (ranks[-1] + 1 - below) / inside + slack))
    aggregates = []
    for at, ((i, low, high, _), shares) in enumerate(sketches.items()):
        c = F.col(f"c{i}")
        within = F.when((c > F.lit(low)) & (c < F.lit(high)), c)
        aggregates.append(F.percentile_approx(within, F.array(*map(F.lit, shares)), SKETCH_ACCURACY).alias(f"g{at}"))
    sketch = part.agg(*aggregates).first()
    guesses = {}
    for at, (i, low, high, below) in enumerate(sketches):
        mine = [key for key in sorted(keys) if key[0] == i and tuple(spans[key][:3]) == (low, high, below)]
        for j, key in enumerate(mine):
            guesses[key] = sketch[f"g{at}"][2 * j: 2 * j + 2]
    return guesses


def _count_around(part, filled, spans, wanted, keys, values, guesses, with_varied):
    """Count around the new bounds and settle every rank that lies on one. Returns the keys that shrank."""
    keys = sorted(keys)
    counts = [_between(i, p) for i, p in filled.items()] if with_varied else []
    bounds = {}
    for j, (i, q) in enumerate(keys):
        lo, hi = bounds[i, q] = guesses[i, q]
        c = F.col(f"c{i}")
        counts += [
            F.count_if(c < F.lit(lo)).alias(f"under{j}"), F.count_if(c == F.lit(lo)).alias(f"at_lo{j}"),
            F.count_if((c > F.lit(lo)) & (c < F.lit(hi))).alias(f"inside{j}"),
            F.count_if(c == F.lit(hi)).alias(f"at_hi{j}"),
        ]
    row = part.agg(*counts).first()
    if with_varied:
        for i, p in filled.items():
            p.varied = row[f"varied{i}"] is not None
    shrunk = set()
    for j, key in enumerate(keys):
        lo, hi = bounds[key]
        under, at_lo, inside = row[f"under{j}"], row[f"at_lo{j}"], row[f"inside{j}"]
        at_hi = row[f"at_hi{j}"] if hi > lo else 0
        left = set()
        for r in wanted[key]:
            if under <= r < under + at_lo:
                values[key[0], r] = lo
            elif under + at_lo + inside <= r < under + at_lo + inside + at_hi:
                values[key[0], r] = hi
            else:
                left.add(r)
        wanted[key] = left
        if not left:
            continue
        # the sketch promises "inside"; a rank it missed keeps the part of the old bracket it lies in
        old_low, old_high, old_below, old_inside = spans[key]
        if old_below is None:
            old_low, old_high, old_below = -math.inf, math.inf, 0
        starts = (old_below, under + at_lo, under + at_lo + inside + at_hi)
        ends = (under, under + at_lo + inside, old_below + old_inside)
        regions = [0 if r < under else 1 if r < ends[1] else 2 for r in left]
        first, last = min(regions), max(regions)
        spans[key] = [(old_low, lo, hi)[first], (lo, hi, old_high)[last], starts[first], ends[last] - starts[first]]
        if spans[key][3] < old_inside:
            shrunk.add(key)
    return shrunk


def _pick(part, spans, wanted, keys, values):
    """Exact values at the open ranks, from the distinct values inside the brackets."""
    keys = sorted(keys)
    tests, cells = [], []
    for j, (i, q) in enumerate(keys):
        low, high, _, _ = spans[i, q]
        c = F.col(f"c{i}")
        test = (c > F.lit(low)) & (c < F.lit(high))
        tests.append(test)
        cells.append(F.when(test, F.struct(F.lit(j).alias("bracket"), c.alias("value"))))
    anywhere = tests[0]
    for test in tests[1:]:
        anywhere = anywhere | test
    inside = (
        part.where(anywhere).select(F.explode(F.array_compact(F.array(*cells))).alias("cell"))
        .groupBy("cell.bracket", "cell.value").agg(F.count("*").alias("n"))
    )
    upto = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    running = inside.withColumn("upto", F.sum("n").over(upto))
    asked = []
    for j, key in enumerate(keys):
        for r in wanted[key]:
            asked.append((j, r, F.min(F.when(
                (F.col("bracket") == j) & (F.col("upto") > r - spans[key][2]), F.col("value"))).alias(f"v{len(asked)}")))
    row = running.agg(*[a for _, _, a in asked]).first()
    for at, (j, r, _) in enumerate(asked):
        values[keys[j][0], r] = row[f"v{at}"]
