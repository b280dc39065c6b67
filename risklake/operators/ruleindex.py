"""An index of the literals that rules need: a line meets the rules whose literal it holds, and no others.

Each expression is read for strings of which one must stand in every line that it matches. An automaton over all of them, in lower
case, passes once over a batch of lines; a line and a slot (one expression of a rule) whose string it holds are a candidate, and only
candidates are matched. Time grows with lines and candidates, not with rules. Expressions without such a string are matched with every line.

The literals go out with the tasks: at most `MAX_BYTES` of them, or the catalogue is refused.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 16_000_000
#: A shorter string stands in too many lines to be of use.
LEAST_CHARS = 3
#: Sets of strings that are asked for of one expression.
MOST_SETS = 4


def required(pattern: str) -> list[frozenset[str]]:
    """Sets of strings, in lower case: whatever the expression matches holds one of each set. Empty if none is of use."""
    try:
        found = [x for x in _sets(re._parser.parse(pattern, re.IGNORECASE)) if min(map(len, x)) >= 2]
    except (re.error, OverflowError, RecursionError):
        return []
    found = sorted(dict.fromkeys(found), key=_worth, reverse=True)[:MOST_SETS]
    return found if found and min(map(len, found[0])) >= LEAST_CHARS else []


def _worth(strings: frozenset[str]) -> tuple:
    return min(map(len, strings)), -len(strings), sorted(strings)


def _of_sequence(items) -> frozenset[str] | None:
    return max(_sets(items), key=_worth, default=None)


def _sets(items) -> list[frozenset[str]]:
    found: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append(frozenset([run]))
        run = ""

    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += _lower(arg)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue  # no character of its own
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len({_lower(c) for _, c in arg}) == 1:
            run += _lower(arg[0][1])
        elif name == "SUBPATTERN" and all(str(o) == "LITERAL" for o, _ in arg[3]):
            run += "".join(_lower(c) for _, c in arg[3])
        else:
            close()
            inner = None
            if name == "SUBPATTERN":
                inner = _of_sequence(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                inner = _of_sequence(arg[2])
            elif name == "BRANCH":
                parts = [_of_sequence(b) for b in arg[1]]
                inner = None if None in parts else frozenset().union(*parts)
            if inner:
                found.append(inner)
    close()
    return found


def _lower(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


#: Where a word of ASCII letters, digits and _ begins or ends, and where not.
EDGES = {"b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"}


def ascii_edges(pattern: str) -> str:
    r"""The expression with \b and \B over ASCII words, as the rules are meant and SQL takes them: up to Java 18, they go by all letters, though
    \w does not, and "DES" before an accented letter would not end."""
    return re.sub(r"\\(.)", lambda m: EDGES.get(m[1], m[0]), pattern, flags=re.DOTALL)


@dataclass(frozen=True)
class Slots:
    """Expressions by number; their literals, each with the parts (slot * MOST_SETS + set) that it stands for; how many sets each slot
    asks for; and the slots that every line must be tried with."""

    patterns: tuple[str, ...]
    literals: tuple[tuple[str, tuple[int, ...]], ...]
    sets: tuple[int, ...]
    always: tuple[int, ...]

    @classmethod
    def of(cls, patterns: list[tuple[str, ...]]) -> Slots:
        """patterns: the alternatives of each slot."""
        by_literal, many, always = defaultdict(list), [], []
        for k, alternatives in enumerate(patterns):
            found = [required(p) for p in alternatives]
            if len(found) > 1:  # one of the best strings of any alternative
                found = [[frozenset().union(*(f[0] for f in found))]] if all(found) else [[]]
            many.append(len(found[0]))
            if not found[0]:
                always.append(k)
            for n, strings in enumerate(found[0]):
                for literal in sorted(strings):
                    by_literal[literal].append(k * MOST_SETS + n)
        joined = tuple(ascii_edges("(?i)" + "|".join(f"(?:{p})" for p in alternatives)) for alternatives in patterns)
        size = sum(len(x.encode()) for x in by_literal) + sum(map(len, joined))
        if size > MAX_BYTES:
            raise ValueError(f"rules of {size} bytes; at most {MAX_BYTES}")
        return cls(joined, tuple((x, tuple(ks)) for x, ks in sorted(by_literal.items())), tuple(many), tuple(always))


@lru_cache(maxsize=4)
def _automaton(literals: tuple[tuple[str, tuple[int, ...]], ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for literal, parts in literals:
        automaton.add_word(literal, np.array(parts, np.int64))
    automaton.make_automaton()
    return automaton


def _candidates(slots: Slots, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, wanted = _automaton(slots.literals), np.array(slots.sets)
        width = len(wanted) * MOST_SETS
        for batch in batches:
            lines = pc.ascii_lower(pc.fill_null(batch.column("line"), ""))
            # Places of the line breaks that are put between the lines.
            breaks = np.cumsum(pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1) - 1
            hits = list(automaton.iter("\n".join(lines.to_pylist())))
            row = np.searchsorted(breaks, np.fromiter((end for end, _ in hits), np.int64, len(hits)))
            sizes = np.fromiter((len(parts) for _, parts in hits), np.int64, len(hits))
            parts = np.concatenate([parts for _, parts in hits]) if hits else sizes
            # A line and slot of which all sets have been met.
            met, n = np.unique(np.unique(np.repeat(row, sizes) * width + parts) // MOST_SETS, return_counts=True)
            row, slot = np.divmod(met, len(wanted))
            full = n == wanted[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[full])) for c in names[:-1]), pa.array(slot[full], pa.int32())], names=names)

    return run


def candidates(lines: DataFrame, slots: Slots) -> DataFrame:
    """lines(line, ...) -> with slot, an expression that may match the line, once for each."""
    parts = []
    if slots.literals:
        names = [*lines.columns, "slot"]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
        parts.append(lines.mapInArrow(_candidates(slots, names), f"{fields}, slot int"))
    if slots.always:
        # These are constant expressions, compiled once: what does not match goes here.
        met = F.array_compact(F.array(*[F.when(F.col("line").rlike(slots.patterns[k]), F.lit(k)) for k in slots.always]))
        parts.append(lines.withColumn("slot", F.explode(met)))
    return reduce(DataFrame.unionByName, parts) if parts else lines.withColumn("slot", F.lit(0)).limit(0)


def matches(lines: DataFrame, slots: Slots) -> DataFrame:
    """lines(line, ...) -> with slot and its expression (_regex), for each that matches the line."""
    spark = lines.sparkSession
    table = spark.createDataFrame(list(enumerate(slots.patterns)), "slot int, _regex string")
    return candidates(lines, slots).join(F.broadcast(table), "slot").filter(F.rlike("line", F.col("_regex")))
