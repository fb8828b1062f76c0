"""Array expressions whose cost stays linear in long arrays, as Columns.

``aggregate`` copies its state at every step, so a state that grows to n elements costs n squared. Here long
arrays are worked off in chunks of ``CHUNK`` elements: the state of a chunk stays small, and the chunks themselves are few.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(items: Column) -> Column:
    """An array of strings without commas as an array of comma-joined chunks."""
    return F.regexp_extract_all(F.array_join(items, ","), F.lit(f"[^,]++(?:,[^,]++){{0,{CHUNK - 1}}}"), F.lit(0))


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The inclusive running result of ``op`` over an array of integers from 0 up; ``op`` is associative with 0 as its neutral element."""
    def running(array: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc, v):
            at = op(acc["at"], v.cast("int"))
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(array, zero, step, lambda acc: acc["out"])

    parts = F.transform(chunks(F.transform(values, lambda v: v.cast("string"))), lambda c: running(F.split(c, ",")))
    return let(parts, lambda p: let(running(F.transform(p, lambda a: F.array_max(F.slice(a, -1, 1)))), lambda ends: F.flatten(
        F.zip_with(p, shifted(ends, 1, F.lit(0)), lambda a, before: F.transform(a, lambda v: op(before, v))))))


def shifted(array: Column, by: int, fill: Column) -> Column:
    """The array moved right (``by`` > 0) or left, filled with ``fill``."""
    if by > 0:
        return F.slice(F.concat(F.array_repeat(fill, by), array), F.lit(1), F.size(array))
    return F.slice(F.concat(array, F.array_repeat(fill, -by)), F.lit(1 - by), F.size(array))


def _number(item: Column, place: int) -> Column:
    return F.get(F.split(item, ":"), F.lit(place)).cast("int")


def cut_out(text: Column, items: Column) -> Column:
    """Stretches of ``text``, as an array: each of ``items`` is a string ``skip:take``, so many code points to leave out and then to
    take. The text is cut into one stretch for each chunk of items first, and then each of those by itself."""
    empty = F.array().cast("array<string>")

    def used(chunk: Column) -> Column:
        return F.aggregate(F.split(chunk, ","), F.lit(0), lambda a, i: a + _number(i, 0) + _number(i, 1))

    def texts(parts: Column) -> Column:
        def step(acc, c):
            return let(used(c), lambda n: F.struct(F.substring(acc["rest"], n + 1, F.length(acc["rest"])).alias("rest"),
                                                   F.concat(acc["out"], F.array(F.substring(acc["rest"], F.lit(1), n))).alias("out")))
        return F.aggregate(parts, F.struct(text.alias("rest"), empty.alias("out")), step, lambda acc: acc["out"])

    def taken(chunk: Column, part: Column) -> Column:
        def step(acc, i):
            skip, take = _number(i, 0), _number(i, 1)
            return F.struct(F.substring(acc["rest"], skip + take + 1, F.length(acc["rest"])).alias("rest"),
                            F.concat(acc["out"], F.array(F.substring(acc["rest"], skip + 1, take))).alias("out"))
        return F.aggregate(F.split(chunk, ","), F.struct(part.alias("rest"), empty.alias("out")), step, lambda acc: acc["out"])

    return let(chunks(items), lambda c: F.flatten(F.zip_with(c, texts(c), taken)))


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each span (struct ``start``, ``end`` and further fields, sorted by start) replaced by ``label(span)``, a string;
    spans that overlap are one, with the label of the first. Positions are code points, the end exclusive."""
    def heads(s: Column, tops: Column) -> Column:
        starts = F.zip_with(s, shifted(tops, 1, F.lit(0)), lambda x, before: F.when(
            x["start"] >= before, F.struct(x["start"].alias("start"), before.alias("before"), label(x).alias("label"))))
        return F.filter(starts, lambda x: x.isNotNull())

    def items(h: Column) -> Column:
        """What each head leaves out (the spans before it, from the start of the head before) and takes (up to its own start)."""
        return F.zip_with(F.transform(h, lambda x: F.struct(x["start"], x["before"])),
                          shifted(F.transform(h, lambda x: x["start"]), 1, F.lit(0)),
                          lambda x, last: F.concat((x["before"] - last).cast("string"), F.lit(":"), (x["start"] - x["before"]).cast("string")))

    def joined(h: Column, tops: Column) -> Column:
        pairs = F.zip_with(cut_out(text, items(h)), h, lambda gap, x: F.concat(gap, x["label"]))
        end = F.array_max(tops)
        return F.concat(F.array_join(pairs, ""), F.substring(text, end + 1, F.length(text)))

    done = let(spans, lambda s: let(scan(F.transform(s, lambda x: x["end"]), F.greatest), lambda tops: let(
        heads(s, tops), lambda h: joined(h, tops))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
