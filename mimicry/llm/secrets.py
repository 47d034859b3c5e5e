"""Secret scan: fixed patterns, and windows of high entropy in long mixed strings.

DataFrame functions only. Places come from the text between matches: ``split`` and
``regexp_extract_all`` by one pattern give gaps and matches in turn, and their running
lengths are code-point positions. A text is split only where the pattern occurs at all.

Entropy: candidates are what is left of maximal runs of base64-like characters when spans
of the fixed patterns and allow-listed parts are cut out. Over a candidate's windows of
``WINDOW`` characters the sum of c * log2(c) is kept up to date as one character enters and
one leaves, so a window costs two updates. A candidate's class (hexadecimal, letters, no
letter beside a digit, letters and digits, all) sets the entropy from which a window counts;
the span runs from the first such window to the end of the last.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mimicry.llm.common import table

# The three base patterns. Bounds that cannot change which match comes next
# are written as counts; the assigned value's length is checked afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGNED_LENGTH = 8

WINDOW = 20
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
SEPARATORS = "+/_=-"
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
#: (characters of the class, bits a window must reach), the first that fits a candidate.
#: Paths and phrases, with no letter beside a digit, come near random characters.
CLASSES = (
    (r"^[0-9a-fA-F]+$", 3.0),
    (r"^[A-Za-z]+$", 3.8),
    (rf"^(?!.*(?:{MIXED}))", 4.1),
    (r"^[0-9A-Za-z]+$", 3.7),
    (r"", 3.8),
)
#: What matches one of these is no secret: the part between separators, or the whole
#: candidate if the match is in none of its parts.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|changeme|dummy|redacted",
    r"^(?:sha|md)[0-9]{1,3}[-=]",
)
KINDS = ("assign", "access", "hex", "entropy")
_TERMS = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 2))]
_TOLERANCE = 1e-9
MARK = "[SECRET]"

LOT = 128  # items an array grows by before a new one is begun
PAGE = 512
_PLACE = "struct<start:int,value:string>"
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where functions of elements refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lots(items: Column) -> Column:
    """Items in order, in arrays of ``LOT``."""
    starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / LOT).cast("int"))
    cut = bound(items, lambda of: F.transform(starts, lambda i: F.slice(of, i * LOT + 1, F.lit(LOT))))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def running(
    items: Column, zero: Column, fold: Callable[[Column, Column], Column], kind: str, emit: Callable[[Column, Column], Column]
) -> Column:
    """The arrays ``emit(state, x)`` of all items joined; the state folds the items before x.

    An array that grows by one is copied each time, so items are taken in lots: first the
    state at the start of each lot, then the lots by themselves. ``kind`` is the element type.
    """

    def states(of: Column) -> Column:
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("all"))

        def step(acc: Column, lot: Column) -> Column:
            return F.struct(
                F.aggregate(lot, acc["now"], fold).alias("now"),
                F.concat(acc["all"], F.array(acc["now"])).alias("all"),
            )

        return F.aggregate(of, start, step)["all"]

    def of_lot(lot: Column, state: Column) -> Column:
        start = F.struct(state.alias("now"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return F.struct(fold(acc["now"], x).alias("now"), F.concat(acc["out"], emit(acc["now"], x)).alias("out"))

        return F.aggregate(lot, start, step)["out"]

    return bound(lots(items), lambda of: F.flatten(F.zip_with(of, states(of), of_lot)))


def located(text: Column, pattern: str, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """``(start, value)`` of the pattern's matches that ``keep(match, its group)`` accepts."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    empty = F.array().cast(f"array<{_PLACE}>")

    def after(at: Column, x: Column) -> Column:
        return (at + F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))).cast("int")

    def place(at: Column, x: Column) -> Column:
        found = F.struct((at + F.length(x["gap"])).cast("int").alias("start"), x["match"].alias("value"))
        return F.when(x["match"].isNotNull() & keep(x["match"], x["part"]), F.array(found)).otherwise(empty)

    places = bound(parts, lambda of: running(of, F.lit(0), after, _PLACE, place))
    return F.when(text.rlike(pattern), places).otherwise(empty)


def spans(found: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(
        found,
        lambda x: F.struct(
            x["start"].alias("start"), rank.alias("rank"), (x["start"] + F.length(x["value"])).cast("int").alias("end")
        ),
    ).cast(_SPANS)


def _piece(value: Column, begin: Column, end: Column, at: Column, stop: Column) -> Column:
    """(start, value) of ``at`` to ``stop`` of a run if long enough, without separators where cut."""
    whole = F.substring(value, at - begin + 1, F.greatest(stop - at, F.lit(0)))
    left = F.when(at > begin, F.ltrim(whole, F.lit(SEPARATORS))).otherwise(whole)
    both = F.when(stop < end, F.rtrim(left, F.lit(SEPARATORS))).otherwise(left)
    found = F.struct((at + F.length(whole) - F.length(left)).cast("int").alias("start"), both.alias("value"))
    return F.when(F.length(both) >= WINDOW, F.array(found)).otherwise(F.array().cast(f"array<{_PLACE}>"))


def cut(x: Column, gone: Column) -> Column:
    """The pieces (start, value) of a run ``x`` outside the sorted spans ``gone``, if long enough.

    Where a piece was cut, separators at its end are not part of it.
    """
    begin, end = x["start"], x["start"] + F.length(x["value"])
    empty = F.array().cast("array<struct<start:int,value:string>>")

    def piece(at: Column, stop: Column) -> Column:
        return _piece(x["value"], begin, end, at, stop)

    def step(acc: Column, s: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], s["end"]).cast("int").alias("at"),
            F.concat(acc["out"], piece(acc["at"], s["start"])).alias("out"),
        )

    touching = F.filter(gone, lambda s: (s["start"] < end) & (begin < s["end"]))
    return F.aggregate(
        touching,
        F.struct(begin.cast("int").alias("at"), empty.alias("out")),
        step,
        lambda acc: F.concat(acc["out"], piece(acc["at"], end)),
    )


def outside(runs: Column, base: Column) -> Column:
    """What ``cut`` gives for all runs, in one pass over runs and spans by their places.

    Between two places the state tells the run last begun and how far spans reach.
    """
    empty = F.array().cast(f"array<{_PLACE}>")
    events = F.sort_array(
        F.concat(
            F.transform(base, lambda x: _event(x["start"], x["end"], F.lit(None))),
            F.transform(runs, lambda x: _event(x["start"], x["start"] + F.length(x["value"]), x["value"])),
            F.array(_event(F.lit(2**31 - 1), F.lit(0), F.lit(None))),
        )
    )
    nothing = F.struct(F.lit(0).alias("at"), F.lit(0).alias("covered"), _event(F.lit(0), F.lit(0), F.lit("")).alias("run"))

    def fold(state: Column, x: Column) -> Column:
        is_run = x["value"].isNotNull()
        covered = F.when(is_run, state["covered"]).otherwise(F.greatest(state["covered"], x["end"]))
        run = F.when(is_run, x).otherwise(state["run"])
        return F.struct(x["start"].alias("at"), covered.alias("covered"), run.alias("run"))

    def piece(state: Column, x: Column) -> Column:
        at = F.greatest(state["at"], state["covered"])
        stop = F.least(x["start"], state["run"]["end"])
        found = _piece(state["run"]["value"], state["run"]["start"], state["run"]["end"], at, stop)
        return F.when(stop - at >= WINDOW, found).otherwise(empty)

    # Without spans every run is whole, and long enough by its pattern.
    return F.when(F.size(base) == 0, runs).otherwise(running(events, nothing, fold, _PLACE, piece))


def _event(start: Column, end: Column, value: Column) -> Column:
    kinds = {"start": (start, "int"), "end": (end, "int"), "value": (value, "string")}
    return F.struct(*[c.cast(kind).alias(name) for name, (c, kind) in kinds.items()])


def allowed_parts(x: Column, allowed: Sequence[str]) -> Column:
    """Spans (start, end) of the parts of a run between separators that are allow-listed."""
    start = F.struct(x["start"].cast("int").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        after = (acc["at"] + F.length(part)).cast("int")
        span = F.array(F.struct(acc["at"].alias("start"), after.alias("end")))
        listed = _matches(part, allowed)
        return F.struct(
            (after + 1).cast("int").alias("at"), F.when(listed, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(_parts(x["value"]), start, step, lambda acc: acc["out"])


def _parts(value: Column) -> Column:
    return F.split(value, f"[{SEPARATORS}]", -1)


def _matches(value: Column, allowed: Sequence[str]) -> Column:
    fine = F.lit(False)
    for pattern in allowed:
        fine = fine | value.rlike(pattern)
    return fine


def candidates(runs: Column, base: Column, allowed: Sequence[str]) -> Column:
    """(start, value) of the pieces of runs outside the base spans and allow-listed parts."""

    def listed_whole(x: Column) -> Column:
        whole = F.lit(False)
        for pattern in allowed:
            inside = F.exists(_parts(x["value"]), lambda part: _matches(part, [pattern]))  # noqa: B023
            whole = whole | (x["value"].rlike(pattern) & ~inside)
        return whole

    def scanned(x: Column) -> Column:
        return F.when(_matches(x["value"], allowed), cut(x, allowed_parts(x, allowed))).otherwise(F.array(x))

    return F.flatten(F.transform(F.filter(outside(runs, base), lambda x: ~listed_whole(x)), scanned))


def hot_span(codes: Column, bits: Column) -> Column:
    """``(first, last)``: from the first window with ``bits`` of entropy to the end of the last.

    ``codes`` are the places of a candidate's characters in the alphabet.
    """
    terms = F.array(*map(F.lit, _TERMS))
    nothing = F.lit(None).cast("int")
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        nothing.alias("first"),
        nothing.alias("last"),
    )

    def at(values: Column, i: Column) -> Column:
        return F.get(values, i)

    def step(acc: Column, i: Column) -> Column:
        enters, leaves = at(codes, i), F.coalesce(at(codes, i - WINDOW), F.lit(-1))
        gone = F.coalesce(at(acc["counts"], leaves), F.lit(0))
        without = acc["sum"] + F.when(leaves >= 0, at(terms, gone - 1) - at(terms, gone)).otherwise(0.0)
        before = at(acc["counts"], enters) - (enters == leaves).cast("int")
        total = without + at(terms, before + 1) - at(terms, before)
        hot = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= bits - _TOLERANCE)
        return F.struct(
            F.transform(
                acc["counts"], lambda n, j: n + (j == enters).cast("int") - (j == leaves).cast("int")
            ).alias("counts"),
            total.alias("sum"),
            F.coalesce(acc["first"], F.when(hot, i - WINDOW + 1)).cast("int").alias("first"),
            F.when(hot, i + 1).otherwise(acc["last"]).cast("int").alias("last"),
        )

    end = F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step)
    return F.struct(end["first"].alias("first"), end["last"].alias("last"))


def entropy_spans(found: Column) -> Column:
    def coded(x: Column) -> Column:
        bits = F.lit(CLASSES[-1][1])
        for pattern, least in reversed(CLASSES[:-1]):
            bits = F.when(x["value"].rlike(pattern), least).otherwise(bits)
        codes = F.transform(F.split(x["value"], ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        return F.struct(x["start"].alias("start"), codes.alias("codes"), bits.alias("bits"))

    def hull(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), hot_span(x["codes"], x["bits"]).alias("hot"))

    hulls = F.filter(
        F.transform(F.transform(found, coded), hull), lambda x: x["hot"]["first"].isNotNull()
    )
    return F.transform(
        hulls,
        lambda x: F.struct(
            (x["start"] + x["hot"]["first"]).cast("int").alias("start"),
            F.lit(KINDS.index("entropy")).alias("rank"),
            (x["start"] + x["hot"]["last"]).cast("int").alias("end"),
        ),
    ).cast(_SPANS)


def scan(docs: DataFrame, *, text: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` as ``row`` (a struct of its columns), with ``text``, ``base`` and ``added``.

    ``base`` and ``added`` are arrays of (start, rank of the kind, end), sorted, in code
    points, end exclusive. Null texts count as empty. Rows are kept one for one.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    always = lambda _, __: F.lit(True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), value.alias("text"))
    body = F.col("text")

    found = rows.select(
        "row",
        "text",
        F.array_sort(
            F.concat(
                spans(located(body, ASSIGN, lambda _, part: F.length(part) >= ASSIGNED_LENGTH, 2), "assign"),
                spans(located(body, ACCESS, always), "access"),
                spans(located(body, HEX, always), "hex"),
            )
        ).alias("base"),
        located(body, CANDIDATE, always).alias("runs"),
    )
    pieces = found.select("row", "text", "base", candidates(F.col("runs"), F.col("base"), allowed).alias("candidates"))
    return pieces.select("row", "text", "base", entropy_spans(F.col("candidates")).alias("added"))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["rank"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, found: Column, mark: str = MARK) -> Column:
    """The text with each run of overlapping spans replaced by the mark.

    The text is cut into pages, so that what stands between two spans is found in a few of them.
    """

    def between(pages: Column, at: Column, stop: Column) -> Column:
        first, last = F.floor(at / PAGE).cast("int"), F.floor(stop / PAGE).cast("int")
        near = F.array_join(F.slice(pages, first + 1, last - first + 1), "")
        return F.substring(near, at - first * PAGE + 1, stop - at)

    def cleaned(pages: Column) -> Column:
        def kept(at: Column, x: Column) -> Column:
            apart = F.array(between(pages, at, x["start"]), F.lit(mark))
            return F.when(x["start"] >= at, apart).otherwise(F.array().cast("array<string>"))

        def reach(at: Column, x: Column) -> Column:
            return F.greatest(at, x["end"]).cast("int")

        tail = F.aggregate(found, F.lit(0), reach)
        parts = running(found, F.lit(0), reach, "string", kept)
        return F.array_join(F.concat(parts, F.array(between(pages, tail, F.length(text)))), "")

    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    return F.when(F.size(found) == 0, text).otherwise(bound(pages, cleaned))


def redact(docs: DataFrame, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by the mark; ``length``, if there, counts anew."""
    found = scan(docs, text=text).withColumn("_clean", redacted(F.col("text"), F.array_sort(F.concat("base", "added"))))
    clean = F.when(F.col(f"row.`{text}`").isNotNull(), F.col("_clean"))
    new = {text: clean, length: F.when(clean.isNotNull(), F.length(clean)).otherwise(F.col(f"row.`{length}`")) if length in docs.columns else None}
    kinds = dict(docs.dtypes)
    return found.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        counted(F.col("base"), "assign").alias("n_assign"),
        counted(F.col("base"), "access").alias("n_access"),
        counted(F.col("base"), "hex").alias("n_hex"),
        counted(F.col("added"), "entropy").alias("n_entropy"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(every).alias("spans"),
    )
