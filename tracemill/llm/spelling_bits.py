"""Spelling variants by a bit-sliced position index over the vocabulary.

An index holds one bitset per (position, letter): bit j says whether word j has that letter
there. A query is read letter by letter; one word-parallel step updates the words that agree
so far without an error, and those with one error, the letters after it being looked up at the same
position (a replaced letter) or one later (a letter that only the indexed word has). Index
bits go by falling count of the words, so the first bit of an answer is the best variant.

The vocabulary is dealt out so that an index is of bounded size: words that are one error apart
agree in the first or in the last half of the shorter one, so words of about one length meet in
tiles of either half. A pair that agrees in the first half counts only in its tile: the words
without an error up to the half's end are known from the recurrence.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Batches, utf8, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters of a run after lower-casing A-Z: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
#: One word in so many, by hash, loses a letter.
ONE_IN = 97
#: Words of an index at most, and queries answered at once.
TILE, STRIPE = 2048, 512
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def respelled(doc_id: str, run: str) -> str:
    """The run as it counts: of one in 97 a letter is left out, both chosen by crc32."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): distinct words of all documents with `shortest` letters and `least` occurrences.

    A null text has no words, a null id counts as "null"; rows that repeat count each. Counts
    are added up per task before they are shuffled, so no frequent word is a hot key.
    """

    def run(batches: Batches) -> Batches:
        counts: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})
            counts.clear()
            return made

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids, utf8(batch.column("text")), strict=True):
                name = "null" if doc_id is None else str(doc_id)
                # bytes lower-case A-Z only; equal runs of a document share one hash
                for word, n in Counter(RUN.findall(text.lower().decode())).items():
                    counts[respelled(name, word)] += n
                if len(counts) > HELD:
                    yield handed()
        if counts:
            yield handed()

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    long_enough = found.filter(F.length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _letters(words: list[str], width: int) -> np.ndarray:
    """(words, width) numbers of letters, `LETTERS` past a word's end."""
    out = np.full((len(words), width), LETTERS, np.uint8)
    for i, word in enumerate(words):
        code = np.frombuffer(word.encode("latin-1"), np.uint8)
        out[i, : len(code)] = np.where(code < 128, code - 97, code - 192 + 26)
    return out


def _slice(letters: np.ndarray, at: int) -> np.ndarray:
    """Bitsets of a position, a row per letter; the last one is of words that end before it."""
    if at >= letters.shape[1]:
        return np.zeros((LETTERS + 1, -(-len(letters) // 8)), np.uint8)
    return np.packbits(letters[:, at] == np.arange(LETTERS + 1, dtype=np.uint8)[:, None], axis=1)


def one_error(
    queries: np.ndarray, index: np.ndarray, length: int, half: int, from_front: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Bitsets of the index's words one replaced letter, and one more letter, from each query.

    `queries` are letters of words of `length`, `index` those of words of `length` or one more.
    Only words that agree in the first `half` letters count with `from_front`, else only others.
    """
    shape = (len(queries), -(-len(index) // 8))
    full = np.packbits(np.ones(len(index), bool))
    exact = np.broadcast_to(full, shape).copy()
    replaced, longer = np.zeros(shape, np.uint8), exact.copy()
    here, agree = _slice(index, 0), exact.copy()
    for at in range(length):
        ahead = _slice(index, at + 1)
        letter = queries[:, at]
        match = here[letter]
        # an error made here, or made before and the letter agrees
        replaced = (replaced & match) | exact
        exact &= match
        # the indexed word has had one letter more: the query's letter is looked up one later
        longer = (longer & ahead[letter]) | exact
        if at + 1 == half:
            agree = exact.copy()
        here = ahead
    ended = here[LETTERS]
    replaced = replaced & ended & ~exact
    longer = longer & ~ended & full
    wanted = agree if from_front else ~agree
    return replaced & wanted, longer & wanted


def _pairs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of every bit that is set, in order."""
    row, byte = np.nonzero(bits)
    each = np.unpackbits(bits[row, byte][:, None], axis=1)
    which, bit = np.nonzero(each)
    return row[which], byte[which] * 8 + bit


def _tile(words: list[str], n: np.ndarray, side: np.ndarray, length: int, from_front: bool) -> tuple[list, ...]:
    """For each word of the tile: how many near words it meets here, and the best of them.

    `side` is 0 or 1 where the words of two units meet, 2 where a unit meets itself.
    """
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n, side = [words[i] for i in order], n[order], side[order]
    size = np.array([len(w) for w in words])
    letters = _letters(words, length + 1)
    none = len(words)
    near, best = np.zeros(none, np.int64), np.full(none, none)

    def met(asked: np.ndarray, held: np.ndarray, both_ways: bool) -> None:
        """Queries `asked` against an index of `held`; equal lengths of one unit meet twice."""
        if not len(asked) or not len(held):
            return
        for at in range(0, len(asked), STRIPE):
            some = asked[at : at + STRIPE]
            replaced, longer = one_error(letters[some], letters[held], length, length // 2, from_front)
            for bits, twice in ((replaced, both_ways), (longer, True)):
                q, w = _pairs(bits)
                q, w = some[q], held[w]
                for a, b in ((q, w), (w, q)) if twice else ((q, w),):
                    np.add.at(near, a, 1)
                    np.minimum.at(best, a, b)

    short, numbers = size == length, np.arange(none)
    if (side == 2).any():
        met(numbers[short], numbers, False)
    else:
        met(numbers[short & (side == 0)], numbers[side == 1], True)
        met(numbers[short & (side == 1)], numbers[(side == 0) & ~short], True)
    found = np.flatnonzero(near)
    top = best[found]
    return [words[i] for i in found], near[found], [words[i] for i in top], n[top]


def _half(word: Column, length: Column, from_front: bool) -> Column:
    k = F.floor(length / 2).cast("int")
    return F.substring(word, F.lit(1), k) if from_front else F.substring(word, F.char_length(word) - k + 1, k)


def _tiles(words: DataFrame) -> DataFrame:
    """(word, n, length, front, tile, side): words dealt out to the tiles in which they meet others.

    A word takes part among words of its own length and one less, by either half. Halves share a
    shelf by hash, so many rare halves fill one tile; a shelf of more than a tile is
    cut into units, each two of which meet.
    """
    own = F.char_length("word")
    sizes = words.groupBy(own.alias("_length")).agg(F.count("*").alias("_n"))
    both = sizes.union(sizes.select(F.col("_length") - 1, "_n"))
    # one row per length
    shelves = both.groupBy(F.col("_length").alias("length")).agg(F.ceil(F.sum("_n") * 2 / TILE).alias("_shelves"))
    roles = words.select("word", "n", F.explode(F.array(own, own - 1)).alias("length"))
    roles = roles.join(F.broadcast(shelves), "length")
    cells = F.array(*(F.struct(F.lit(f).alias("front"), F.xxhash64(_half(F.col("word"), F.col("length"), f)).alias("h")) for f in (True, False)))
    placed = roles.select("word", "n", "length", "_shelves", F.explode(cells).alias("_c"))
    placed = placed.select("word", "n", "length", "_c.front", F.pmod("_c.h", "_shelves").alias("_shelf"))
    placed = written(placed, "shelves")
    where = ["length", "front", "_shelf"]
    # one row per shelf, so about one for half a tile of words
    units = placed.groupBy(*where).agg(F.ceil(F.count("*") / TILE).alias("_units"))
    dealt = placed.join(units, where).withColumn("_unit", F.pmod(F.xxhash64("word"), F.col("_units")))
    others = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("_units") - 1),
        lambda o: F.struct(
            F.least(o, F.col("_unit")).alias("low"),
            F.greatest(o, F.col("_unit")).alias("high"),
            F.when(o == F.col("_unit"), 2).when(o > F.col("_unit"), 0).otherwise(1).alias("side"),
        ),
    )
    met = dealt.select("word", "n", *where, F.explode(others).alias("_o"))
    return met.select("word", "n", "length", "front", F.xxhash64(*where, "_o.low", "_o.high").alias("tile"), "_o.side")


def nearest_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): number of words one error away, and the one of largest count.

    Ties go to the smaller word in code-point order; words without a near one have no row.
    """

    def run(table: pa.Table) -> pa.Table:
        length, front = table.column("length")[0].as_py(), table.column("front")[0].as_py()
        found = _tile(
            table.column("word").to_pylist(),
            table.column("n").to_numpy(),
            table.column("side").to_numpy(),
            length,
            front,
        )
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, _PARTS.types, strict=True)], schema=_PARTS)

    schema = "word string, n_near bigint, best string, best_n bigint"
    parts = _tiles(words).groupBy("tile", "length", "front").applyInArrow(run, schema)
    rank = F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))
    best = F.min(rank)
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select(
        "word", "n_near", F.col("_b.w").alias("best"), (-F.col("_b.n")).alias("best_n")
    )


_PARTS = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word when forms are followed.

    Counts at least double along forms, so a chain has 63 steps at most; every round halves it.
    """
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        state = written(state.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"), "roots")
        if state.filter("_next IS NOT NULL").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of the vocabulary of `docs`.

    `docs` has doc_id and text, other columns are not used. `form` is the most frequent word one
    error away if it has `factor` times the word's count, else null; `root` is where the forms
    lead, the word itself if it has none. Empty tables and texts without runs give no rows.
    """
    words = written(vocabulary(docs, shortest, least), "vocabulary")
    near = nearest_words(words)
    known = words.join(near, "word", "left")
    better = F.col("best_n") >= factor * F.col("n")
    known = written(
        known.select(
            "word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(better, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    led = roots(known.filter("form IS NOT NULL"))
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
