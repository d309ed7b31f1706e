"""Benchmark passages in documents, also with other numbers, names and units.

Texts become templates: a token that is a number, a unit behind a number or a name is replaced by a
typed placeholder. Windows of template tokens are hashed and joined with those of the benchmark.
Windows of one passage lie on one diagonal (document position less item position); along it each
placeholder's value has to be exchanged consistently for the passage to count. Windows of the tokens
themselves are joined as well: a long verbatim passage counts whatever stands elsewhere on its diagonal.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import text as tx
from shelfcast.llm.storage import BROADCAST_BYTES, staged

#: Tokens of a window, and of the shortest item that is searched for.
TOKENS = 8
SHORTEST = 5
#: Share of a template window's tokens that have to be literal words; those that begin a sentence count.
LITERAL = 0.5
#: Windows on one diagonal that make a finding, if the item has as many: 13 words in a row.
LEAST_WINDOWS = 6
#: Verbatim windows that make a finding even if values contradict each other, if the item has as many.
LEAST_EXACT = 12

# Number words and units.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven",
    "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million", "billion",
]
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "meter", "meters",
    "kilometers", "mg", "g", "kg", "gram", "grams", "kilograms", "pound", "pounds", "ml", "l", "liter",
    "liters", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros",
    "percent", "degrees", "mph",
]

WORD, NUMBER, UNIT, NAME = range(4)
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"): ord("9") + 1] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"): ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a"): ord("z") + 1] = True
_INNER = _DIGIT | _UPPER | _LOWER
_INNER[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True


def _literal_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    return np.sort(tx.word_hash(data, starts, ends))


def _within(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(hashes), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)] == hashes


def _lowered(column: pa.Array) -> pa.Array:
    """Lower-case texts of the same length in bytes; a text that would change it stays as it is."""
    lower = pc.utf8_lower(column)
    return pc.if_else(pc.equal(pc.binary_length(lower), pc.binary_length(column)), lower, column)


def _templates(data: np.ndarray, lowered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of a slice: (template hash, token hash, kind, literal, start, end, row). Punctuation
    around a token and its letters' case don't count; tokens of punctuation alone are left out. A
    capitalised word is a name wherever its sentence begins, and literal as well where it begins one."""
    starts, ends, rows = tx.word_spans(~tx.SPACE[data], offsets)
    inner = np.flatnonzero(_INNER[data])
    if not len(inner) or not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none.astype(bool), none, none, none
    first = np.searchsorted(inner, starts)
    last = np.searchsorted(inner, ends) - 1
    full = last >= first
    stop = _STOP[data[ends - 1]]
    new_row = np.concatenate(([True], rows[1:] != rows[:-1]))
    newline = np.concatenate(([0], np.cumsum(data == ord("\n"))))
    gap_from = np.concatenate(([0], ends[:-1]))
    begins = new_row | np.concatenate(([True], stop[:-1])) | (newline[starts] > newline[np.minimum(gap_from, starts)])
    starts, ends, rows, begins = inner[first[full]], inner[last[full]] + 1, rows[full], begins[full]

    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    letters = np.concatenate(([0], np.cumsum(_UPPER[data] | _LOWER[data] | (data >= 0x80))))
    lower = np.concatenate(([0], np.cumsum(_LOWER[data] | (data >= 0x80))))
    hashes = tx.word_hash(tx.LOWER[lowered], starts, ends)
    size = ends - starts
    kind = np.full(len(starts), WORD)
    named = _UPPER[data[starts]] & (size > 1) & (lower[ends] - lower[starts] == size - 1)
    kind[named] = NAME
    number = (digits[ends] > digits[starts]) & (letters[ends] == letters[starts])
    kind[number | _within(_literal_hashes(NUMBER_WORDS), hashes)] = NUMBER
    behind = np.zeros(len(kind), bool)
    behind[1:] = (kind[:-1] == NUMBER) & (rows[1:] == rows[:-1])
    kind[behind & (kind != NUMBER) & _within(_literal_hashes(UNITS), hashes)] = UNIT
    literal = (kind == WORD) | ((kind == NAME) & begins)
    template = np.where(kind == WORD, hashes, tx.constants(4, 77)[kind])
    return template, tx.mix(hashes ^ tx.constants(1, 78)[0]), kind, literal, starts, ends, rows


def _windows(lengths: list[int] | None, wanted: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Template windows with their values, and verbatim windows. Without ``lengths``, for items, each
    row's own length, ``TOKENS`` at most, is taken, and template windows need their share of literal
    words; with ``wanted`` only windows whose hash is there are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            texts = pc.fill_null(batch.column("text"), "")
            both = zip(tx.slices(texts), tx.slices(_lowered(texts)), strict=True)
            for (first, last, data, offsets), (_, _, lowered, _) in both:
                template, exact, kind, is_literal, starts, ends, rows = _templates(data, lowered, offsets)
                counts = np.bincount(rows, minlength=last - first)
                begin = np.concatenate(([0], np.cumsum(counts)))
                literal = np.concatenate(([0], np.cumsum(is_literal)))
                out: dict[str, list] = {c: [] for c in ("id", "window", "at", "size", "tokens", "kept", "exact", "values")}
                for k, hashes in itertools.product(lengths or range(SHORTEST, TOKENS + 1), (template, exact)):
                    grams, by = tx.windows(hashes, rows, last - first, k)
                    take = counts >= k if lengths else np.minimum(counts, TOKENS) == k
                    row = np.repeat(np.arange(last - first), np.diff(by))
                    at = np.arange(len(grams)) - by[row]
                    good = take[row]
                    place = np.minimum(begin[row] + at, len(kind))
                    filled = literal[np.minimum(place + k, len(kind))] - literal[place] >= LITERAL * k
                    if not lengths and hashes is template:
                        good &= filled
                        kept = np.bincount(row[good], minlength=last - first)
                    if wanted is not None:
                        good &= _within(wanted, grams)
                    for i in np.flatnonzero(good).tolist():
                        a, r = int(place[i]), int(row[i])
                        slots = [
                            f"{int(kind[j])}:{bytes(data[starts[j]: ends[j]]).decode(errors='replace').lower()}"
                            for j in range(a, a + k) if kind[j] != WORD and hashes is template
                        ]
                        values = (
                            ids[first + r].as_py(), grams[i].view("i8").item(), int(at[i]), k, int(counts[r]),
                            0 if lengths else int(kept[r]), hashes is exact, slots,
                        )
                        for column, value in zip(out.values(), values, strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


_SCHEMA = "id long, window long, at long, size int, tokens long, kept long, exact boolean, values array<string>"


def leaked_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per document and benchmark item found in it: id, item id, n_windows, n_slots,
    coverage, position, contaminated (always true).

    n_windows counts the item's windows on the best diagonal, as templates or verbatim, coverage is
    their share of all, and n_slots the placeholder values in template windows there. A diagonal needs
    ``LEAST_WINDOWS`` template windows with literal words, or as many verbatim ones; if values there
    contradict each other, two for one value or one for two, it needs ``LEAST_EXACT`` verbatim ones.
    An item with fewer windows of a sort needs all of them.

    Items of fewer than ``SHORTEST`` tokens and null texts have no window; rows without an id are
    left out, since nothing names them; repeated rows give one finding; equal items each give
    theirs. Empty tables give none.

    The benchmark's windows are looked up inside the scan as long as their number is small; beyond,
    all windows take part in the join. Findings are few, and are grouped by document and item.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    asked = staged(items.where("id IS NOT NULL").mapInArrow(_windows(None, None), _SCHEMA), "leak-benchmark")
    lengths = sorted(r["size"] for r in asked.select("size").distinct().collect()) or [TOKENS]
    wanted = None
    if asked.count() * 8 <= BROADCAST_BYTES:
        found = asked.select("window").distinct().toPandas()["window"].to_numpy()
        wanted = np.sort(found.astype("i8").view("u8"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    seen = staged(texts.where("id IS NOT NULL").mapInArrow(_windows(lengths, wanted), _SCHEMA), "leak-windows")

    hits = seen.alias("d").join(asked.alias("b"), ["window", "size"]).select(
        F.col("d.id").alias("doc"), F.col("b.id").alias("item"), (F.col("d.at") - F.col("b.at")).alias("diagonal"),
        F.col("b.at").alias("at"), F.greatest(F.col("b.tokens") - F.col("b.size") + 1, F.lit(1)).alias("windows"),
        F.col("b.kept").alias("kept"), F.col("b.exact").alias("exact"),
        F.arrays_zip(F.col("b.values").alias("asked"), F.col("d.values").alias("seen")).alias("slots"),
    )
    pairs = F.array_distinct(F.flatten(F.collect_set("slots")))
    places = lambda which: F.size(F.collect_set(F.when(which, F.col("at")))).cast("long")
    lines = hits.groupBy("doc", "item", "diagonal", "windows", "kept").agg(
        places(F.lit(True)).alias("n_windows"), places(~F.col("exact")).alias("n_template"),
        places(F.col("exact")).alias("n_exact"), pairs.alias("pairs"),
    )
    n = F.size("pairs")
    consistent = (F.size(F.array_distinct("pairs.asked")) == n) & (F.size(F.array_distinct("pairs.seen")) == n)
    as_template = (F.col("n_template") > 0) & (F.col("n_template") >= F.least(F.lit(LEAST_WINDOWS), "kept"))
    verbatim = lambda least: F.col("n_exact") >= F.least(F.lit(least), "windows")
    lines = lines.where((consistent & (as_template | verbatim(LEAST_WINDOWS))) | verbatim(LEAST_EXACT))
    return lines.groupBy("doc", "item").agg(
        F.max_by(F.struct("n_windows", n.cast("long").alias("n_slots"), "windows", "diagonal"), F.struct("n_windows", -F.col("diagonal"))).alias("best")
    ).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("best.n_windows").alias("n_windows"),
        F.col("best.n_slots").alias("n_slots"), (F.col("best.n_windows") / F.col("best.windows")).alias("coverage"),
        F.col("best.diagonal").alias("position"), F.lit(True).alias("contaminated"),
    )
