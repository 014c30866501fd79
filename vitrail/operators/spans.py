"""Regex spans, overlap resolution and replacement, as Column expressions.

A span is struct<start,end,value>, 0-based code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sub(text: Column, start: Column, length: Column) -> Column:
    """`length` characters from 0-based `start`."""
    return F.call_function("substring", text, start + 1, length)


BLOCK = 64  # elements folded at a time


def running(numbers: Column, greatest: bool = False) -> Column:
    """Running sums (or maxima) of an array<int>.

    A fold copies what it has made at every step, so it goes over blocks, then
    over the blocks' ends: linear in the array but for n**2 / 8192 copied numbers."""
    both = (lambda a, b: F.greatest(a, b)) if greatest else (lambda a, b: a + b)
    least = F.lit(-(1 << 31) if greatest else 0)
    none = F.array().cast("array<int>")

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda out, x: F.concat(out, F.array(both(F.coalesce(F.get(out, F.size(out) - 1), least), x))))

    def joined(blocks: Column) -> Column:
        ends = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(let(ends, lambda e: F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: both(x, F.get(e, i - 1)))))))

    def over(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), lambda i: fold(F.slice(xs, i, F.lit(BLOCK))))
        return F.when(F.size(xs) == 0, none).when(F.size(xs) <= BLOCK, fold(xs)).otherwise(let(blocks, joined))

    return let(numbers, over)


def regex_spans(text: Column, rx: str, group: int = 0) -> Column:
    """All matches, from the pieces between them and the matches themselves.

    The pattern must not match the empty string; a `group` must end where its match
    ends, and the match alone must match the pattern alike.  A text without a match is passed over
    once, any other twice."""
    none = F.array().cast(f"array<{SPAN}>")

    def build(whole: Column) -> Column:
        inner = F.transform(whole, lambda w: F.regexp_extract(w, rx, group)) if group else whole
        steps = F.zip_with(F.slice(F.split(text, rx, -1), F.lit(1), F.size(whole)), whole, lambda b, w: F.length(b) + F.length(w))
        span = lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"))
        return let(steps, lambda s: F.zip_with(inner, running(s), span))

    return let(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda w: F.when(F.size(w) > 0, build(w)).otherwise(none))


def line_spans(text: Column, rx: str, wanted: str | None, body) -> Column:
    """body(span, span in the line, struct<i,at,line>, lines) of all matches within a line; only
    lines that `wanted` (a pattern) is in are looked at.  The span's offsets are those in the text."""

    def of(lines: Column) -> Column:
        ends = running(F.transform(lines, lambda x: F.length(x) + 1))
        rows = let(ends, lambda e: F.transform(lines, lambda x, i: F.struct(i.alias("i"), (F.get(e, i) - F.length(x) - 1).alias("at"), x.alias("line"))))
        rows = F.filter(rows, lambda r: r["line"].rlike(wanted or rx))

        def spans(r: Column) -> Column:
            shifted = lambda s: F.struct((s["start"] + r["at"]).alias("start"), (s["end"] + r["at"]).alias("end"), s["value"].alias("value"))
            return F.transform(regex_spans(r["line"], rx), lambda s: body(shifted(s), s, r, lines))

        return F.flatten(F.transform(rows, spans))

    return let(F.split(text, "\n", -1), of)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _cut(array: Column, first: Column) -> Column:
    """array<array>: the array cut before each place (from 0) where `first` is true; it is at 0."""
    starts = F.filter(F.transform(first, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
    return let(starts, lambda s: F.transform(s, lambda a, k: F.slice(array, a + 1, F.coalesce(F.get(s, k + 1), F.size(array)) - a)))


def keep_best(spans: Column, kind: str) -> Column:
    """Greedy selection without overlaps: by confidence, then length, then the
    order of detection (seq, start); returned by start.  `kind` is the DDL of a span.

    Spans that reach each other are chosen among themselves, so that a text
    with many spans costs no more for each."""

    def choose(group: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                group,
                lambda s: F.struct((-s["confidence"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["seq"].alias("c"), s["start"].alias("d"), s.alias("s")),
            )
        )
        kept = F.aggregate(
            ranked,
            F.array().cast(f"array<{kind}>"),
            lambda out, r: F.when(F.exists(out, lambda k: overlaps(k, r["s"])), out).otherwise(F.concat(out, F.array(r["s"]))),
        )
        return F.when(F.size(group) == 1, group).otherwise(F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s.alias("s")))), lambda r: r["s"]))

    def grouped(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda s: s["end"]), greatest=True)
        first = lambda e: F.transform(ordered, lambda s, i: (i == 0) | (s["start"] >= F.get(e, i - 1)))
        return F.flatten(F.transform(_cut(ordered, let(ends, first)), choose))

    by_start = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s")))), lambda r: r["s"])
    return let(by_start, lambda s: F.when(F.size(s) == 0, s).otherwise(grouped(s)))


PIECE = 1024  # characters


def slices(text: Column, bounds: Column) -> Column:
    """array<string>: the text between neighbouring bounds (ascending, from 0-based offsets).

    A substring is looked for from the text's beginning, so a long text is cut
    into pieces first and each slice put together from those it lies in."""

    def of(pieces: Column, bounds: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            e = F.get(bounds, i + 1)
            p, q = (F.floor(x / PIECE).cast("int") for x in (b, e))
            piece = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
            within = sub(piece(p), b - p * PIECE, e - b)
            across = F.concat(
                sub(piece(p), b - p * PIECE, F.lit(PIECE)), F.array_join(F.slice(pieces, p + 2, F.greatest(q - p - 1, F.lit(0))), ""), sub(piece(q), F.lit(0), e - q * PIECE)
            )
            return F.when(p == q, within).otherwise(across)

        return F.filter(F.transform(bounds, lambda b, i: F.when(i + 1 < F.size(bounds), one(b, i))), lambda x: x.isNotNull())

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    pieces = F.when(F.length(text) <= PIECE, F.array(text)).otherwise(cut)
    return let(pieces, lambda p: let(bounds, lambda b: of(p, b)))


def replace_spans(text: Column, spans: Column, token) -> Column:
    """The text with each span (by start, disjoint) as token(span)."""

    def replaced(s: Column) -> Column:
        bounds = F.flatten(F.concat(F.array(F.array(F.lit(0))), F.transform(s, lambda x: F.array(x["start"], x["end"])), F.array(F.array(F.length(text)))))
        piece = lambda x, i: F.when(i % 2 == 0, x).otherwise(token(F.get(s, ((i - 1) / 2).cast("int"))))
        return F.array_join(F.transform(slices(text, bounds), piece), "")  # between the spans, and the spans

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(replaced(s)))


MANY = 64


def _starting(text: Column, pairs: Column) -> Column:
    """The pairs whose value's first four characters are in the text or in a token."""
    every = F.concat(text, F.lit("\n"), F.array_join(F.array_distinct(F.transform(pairs, lambda p: p["token"])), "\n"))
    starts = F.transform(pairs, lambda p: F.left(p["value"], F.lit(4)))
    met = F.array_intersect(starts, F.regexp_extract_all(every, F.lit("(?s)(?=(.{4}))"), F.lit(1)))
    return let(met, lambda m: F.filter(pairs, lambda p: F.array_contains(m, F.left(p["value"], F.lit(4)))))


def replace_values(text: Column, pairs: Column) -> Column:
    """Replaces what is left of known values (struct<value,token>) of four
    characters or more, longest first, ties in the given order.

    Every value is looked for in the whole text; of many, only those that can be there."""
    long = F.filter(pairs, lambda p: F.length(p["value"]) >= 4)
    placed = F.array_sort(F.transform(long, lambda p, i: F.struct(p["value"].alias("value"), p["token"].alias("token"), i.alias("i"))))
    same = lambda a, b: (a["value"] == b["value"]) & (a["token"] == b["token"])
    once = let(placed, lambda s: F.filter(s, lambda p, i: (i == 0) | ~same(F.get(s, i - 1), p)))
    rank = lambda p: F.struct((-F.length(p["value"])).alias("a"), p["i"].alias("b"), p["value"].alias("value"), p["token"].alias("token"))

    def replaced(t: Column) -> Column:
        left = let(once, lambda o: F.when(F.size(o) > MANY, _starting(t, o)).otherwise(o))
        return F.aggregate(F.array_sort(F.transform(left, rank)), t, lambda out, p: F.replace(out, p["value"], p["token"]))

    return let(text, replaced)
