"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The documents of a source, shuffled by hash, form one stream of words that is cut into blocks of
equal length. Slots 0, 1, ... of the mix are given to sources by golden-ratio points: a slot's
point falls into one of the sources' intervals, whose lengths are the targets. The r-th slot of a
source takes the r-th block of its stream, which starts over when it ends; a source's last
block is cut where its target is reached, and a source whose slots end before that gets the
few it lacks at the end of the mix.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.nulls import join_on
from tracemill.llm.common import written
from tracemill.operators.scan import running

WORD = r"[^\x20\x09-\x0D]+"
#: Points lie on 2^32 places; the step is 2^32 over the square of the golden ratio, odd, so a
#: cycle of 2^32 slots meets every place once.
PLACES, STEP = 1 << 32, 1640531527
#: Slots (or copies) handled as one stretch.
CHUNK = 1 << 16
#: Documents of a source that share the leading bits of their hash, about so many, are one stretch.
STRETCH = 4096
#: Sources up to which their table, of some 50 bytes a row, is broadcast.
MANY = 100_000

DOCUMENT = ["number", "doc_id", "size", "copy"]


class Mix(NamedTuple):
    """`documents`: (source, number, doc_id, size, copy, first), `first` the place of its first word
    in its source's stream; `sources`: (source, number, weight, size, target, words), `words` what
    the mix takes; `pieces`: (slot, number, epoch, doc_id, size, copy, first_word, n_words), the mix
    in order of `slot` and, within one, of `at`; `words_of` the same pieces with a row for every
    document, `slot` null where none of its words is taken."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame
    words_of: DataFrame
    n_sources: int


def in_stretches(df: DataFrame, *order: str) -> DataFrame:
    """`df` in stretches of `order` of about equal length, numbered as `_stretch`, written once.

    The table must be grouped by `order` already: rows that are equal in it share a stretch.
    """
    return written(df.repartitionByRange(*order).withColumn("_stretch", F.spark_partition_id().cast("bigint")), "stretches")


def _weighted(sources: DataFrame, cycle: int) -> DataFrame:
    """Adds `number` (code points, null last) and `weight` (1, 2, ..., `cycle`, repeating)."""
    named = sources.withColumns({"_null": F.col("source").isNull().cast("int"), "_name": F.coalesce("source", F.lit(""))})
    ranked = running(in_stretches(named, "_null", "_name"), [], "_stretch", ["_null", "_name"], {"number": ("sum", F.lit(1))})
    number = F.col("number").cast("bigint") - 1
    return ranked.select("source", number.alias("number"), (number % cycle + 1).alias("weight"), "size")


def _totals(df: DataFrame, *columns: str) -> tuple[int, ...]:
    return tuple(df.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in columns)).first())


def targets(sources: DataFrame, cycle: int = 3, most: int = 3) -> DataFrame:
    """(source, number, weight, size, target, words) from (source, size), one row per source.

    Targets share the sum of all sizes by weight. Sources in ascending order of `most` x size /
    weight are capped as long as their cap is no more than their share of what the capped ones
    before them leave; the rest share what all capped ones leave. That is where resharing the
    excess ends. `words` is the target rounded to a whole word, half up.
    """
    weighted = _weighted(sources, cycle).withColumns({"_cap": most * F.col("size"), "_ratio": most * F.col("size") / F.col("weight")})
    ordered = ["_ratio", "number"]
    before = running(
        in_stretches(weighted, *ordered),
        [],
        "_stretch",
        ordered,
        {"_caps": ("sum", F.col("_cap")), "_weights": ("sum", F.col("weight"))},
        inclusive=False,
    )
    held = written(before, "targets")
    whole, weight = _totals(held, "size", "weight")
    capped = F.col("_cap") * (weight - F.col("_weights")) <= (whole - F.col("_caps")) * F.col("weight")
    caps, weights = _totals(held.filter(capped), "_cap", "weight")
    share = (F.lit(whole - caps) * F.col("weight")).cast("double") / float(max(weight - weights, 1))
    target = F.when(capped, F.col("_cap").cast("double")).otherwise(share)
    return held.select("source", "number", "weight", "size", target.alias("target"), F.floor(target + 0.5).alias("words"))


def _copies(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, copy): a row per document; equal rows are counted, then dealt out again."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    counted = docs.select("source", "doc_id", size.alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("_n"))
    cut = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(CHUNK).cast("bigint"))))
    return cut.select(
        "source", "doc_id", "size", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("_n")) - 1)).alias("copy")
    )


def _small(rows: DataFrame, n: int) -> DataFrame:
    """A table of `n` rows, one per source: sent to every task up to `MANY` sources, joined by key beyond.

    Then a source with a large share of all rows stays spread as it is.
    """
    return F.broadcast(rows) if n <= MANY else rows


def _power(n: int) -> int:
    return max(int(n) - 1, 0).bit_length()


def _streams(documents: DataFrame, bits: int) -> DataFrame:
    """Adds `first`: words before the document in its source's stream, in order of a hash."""
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "size", "copy"))
    hashed = documents.withColumn("_hash", F.md5(F.concat_ws(":", *parts)))
    lead = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint")
    cut = hashed.withColumn("_stretch", F.shiftright(lead, 32 - bits))
    return running(
        cut, ["number"], "_stretch", ["_hash", "doc_id", "size", "copy"], {"first": ("sum", F.col("size"))}, inclusive=False
    ).drop("_hash", "_stretch")


def _slots(sources: DataFrame, n_slots: int, n_sources: int, block: int) -> DataFrame:
    """(slot, number, epoch, block, take): which block of its source's stream every slot takes."""
    spark = sources.sparkSession
    bits = min(max(_power(n_sources), 8), 31)
    # running sums of the targets, on the places of the points
    # numbers are those of the rows, so stretches of them are in order
    stretched = sources.withColumn("_stretch", F.floor(F.col("number") / STRETCH))
    summed = running(stretched, [], "_stretch", ["number"], {"_upto": ("sum", F.col("target"))})
    whole = summed.agg(F.max("_upto")).first()[0] or 1.0
    used = summed.filter("words > 0").select(
        "number",
        "size",
        "words",
        F.floor((F.col("_upto") - F.col("target")) / whole * PLACES).alias("_low"),
        F.floor(F.col("_upto") / whole * PLACES).alias("_high"),
    )
    span = PLACES >> bits
    cells = used.filter("_high > _low").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_low") / span), F.floor((F.col("_high") - 1) / span)))
    )
    slot = F.col("id")
    points = spark.range(n_slots).select(slot.alias("slot"), (slot % PLACES * STEP % PLACES).alias("_point"))
    points = points.withColumn("_cell", F.floor(F.col("_point") / span))
    given = points.join(cells.select("_cell", "number", "_low", "_high"), "_cell")
    given = given.filter("_low <= _point AND _point < _high").select("slot", "number", F.floor(F.col("slot") / CHUNK).alias("_stretch"))
    ranked = running(given, ["number"], "_stretch", ["slot"], {"rank": ("sum", F.lit(1))})
    ranked = ranked.select("slot", "number", (F.col("rank").cast("bigint") - 1).alias("rank"))
    per_epoch = F.ceil(F.col("size") / block)
    rest = F.col("words") % F.col("size")
    needed = F.floor(F.col("words") / F.col("size")) * per_epoch + F.ceil(rest / block)
    needs = used.select("number", "size", "words", per_epoch.alias("_blocks"), needed.alias("_needed"))
    # at most the discrepancy of the points, and the short blocks at a stream's end, are lacking
    had = ranked.groupBy("number").agg(F.count("*").alias("_had"))
    lacking = needs.join(had, "number", "left").withColumn("_had", F.coalesce("_had", F.lit(0)))
    lacking = lacking.filter("_had < _needed").select(
        "number", F.explode(F.sequence(F.col("_had").cast("bigint"), F.col("_needed") - 1)).alias("rank"), "_had"
    )
    late = F.lit(n_slots) + (F.col("rank") - F.col("_had")) * n_sources + F.col("number")
    every = ranked.union(lacking.select(late.alias("slot"), "number", "rank"))
    epoch, at = F.floor(F.col("rank") / F.col("_blocks")), F.col("rank") % F.col("_blocks")
    done = epoch * F.col("size") + at * block
    length = F.least(F.lit(block), F.col("size") - at * block, F.col("words") - done)
    return every.join(_small(needs, n_sources), "number").filter("rank < _needed").select(
        "slot", "number", epoch.alias("epoch"), at.alias("block"), length.cast("bigint").alias("take")
    )


def mix(docs: DataFrame, block: int = 128, cycle: int = 3, most: int = 3) -> Mix:
    """The mix of all documents (doc_id, source, text), with blocks of `block` words.

    A document's size is its number of words (a null text: 0); one without words is never
    taken. Null ids and sources are values like any other, rows that repeat an id are documents
    of their own; an empty table, or one without a word, gives an empty mix. Other columns are
    not used. No document is taken more than `most` times its size, and every source's words
    are its target rounded to a word. All order comes from hashes, so reruns agree.
    """
    copies = written(_copies(docs), "documents")
    sources = written(targets(copies.groupBy("source").agg(F.sum("size").alias("size")), cycle, most), "sources")
    n_docs, words = copies.count(), *_totals(copies, "size")
    n_sources = sources.count()
    numbered = join_on(copies, _small(sources.select("source", "number"), n_sources), ["source"])
    documents = written(_streams(numbered, min(_power(n_docs / STRETCH), 31)), "streams")
    slots = _slots(sources, -(-words // block), n_sources, block)
    last = F.floor((F.col("first") + F.col("size") - 1) / block)
    met = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), last))
    pieces = documents.select(*DOCUMENT, "first", F.explode_outer(met).alias("block")).join(slots, ["number", "block"], "left")
    start = F.col("block") * block
    end = start + F.coalesce("take", F.lit(0))
    low = F.greatest(F.col("first"), start)
    high = F.least(F.col("first") + F.col("size"), end)
    n = F.greatest(high - low, F.lit(0))
    words_of = pieces.select(
        "slot", "number", "epoch", "doc_id", "size", "copy",
        (low - F.col("first")).alias("first_word"), n.alias("n_words"), (low - start).alias("at"),
    )
    return Mix(documents, sources, words_of.filter("n_words > 0"), words_of, n_sources)


def taken(docs: DataFrame, **settings: int) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copy): one row per document of `mix`."""
    mixed = mix(docs, **settings)
    each = mixed.words_of.groupBy(*DOCUMENT).agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken"))
    named = mixed.sources.select("number", "source", F.col("size").alias("source_size"), "target")
    return each.join(_small(named, mixed.n_sources), "number").select("doc_id", "size", "source_size", "target", "taken", "source", "copy")


def texts(docs: DataFrame, mixed: Mix) -> DataFrame:
    """(slot, at, doc_id, text): the words of every piece, joined by spaces.

    Of documents that share source, id and size, which no key tells apart, the least text serves.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    whole = docs.select("source", "doc_id", size.alias("size"), "text").groupBy("source", "doc_id", "size").agg(F.min("text").alias("text"))
    named = join_on(mixed.pieces.join(mixed.sources.select("number", "source"), "number"), whole, ["source", "doc_id", "size"])
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int"))
    return named.select("slot", "at", "doc_id", F.array_join(part, " ").alias("text"))
