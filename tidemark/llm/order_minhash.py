"""Order MinHash fingerprints, with DataFrame functions only.

The k-mers of a text are its runs of five words, numbered by occurrence, so that a repeated k-mer
counts as often as it occurs. Their hashes are dealt to 64 bins; each bin's two smallest are put
back into text order and hashed as a tuple. Two texts agree in a bin if they share the selected
k-mers *and* their order, which follows edit distance rather than set overlap. A fingerprint is the
list of its bins' tuples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, partitions_for

K = 5
TUPLE = 2
BIN_BITS = 6
HASH_BITS = 18
#: As many as the places of an array need, so that no text is too long for its order.
POS_BITS = 31
#: Upper bits of a k-mer's hash that fit a long together with its position.
KEPT_BITS = 63 - POS_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(hash_: Column, pos: Column) -> Column:
    """Hash above, position below, as a non-negative long: its order is that of hashes, then of text."""
    high = F.shiftleft(F.shiftrightunsigned(hash_, 64 - KEPT_BITS), POS_BITS)
    return high.bitwiseOR(pos.cast("long"))


def _hash(x: Column) -> Column:
    return F.shiftright(x, POS_BITS)


def _pos(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << POS_BITS) - 1).cast("long"))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 63 - BIN_BITS)


def _kmers(words: Column) -> Column:
    """Sorted, placed hashes of the k-mers; fewer than k words are one k-mer, none are none."""

    def of(h: Column) -> Column:
        one = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(K)))
        many = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: _placed(one(i), i))
        few = F.array(_placed(F.xxhash64(h), F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < K, few).otherwise(many)

    return F.sort_array(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def _numbered(kmers: Column) -> Column:
    """Occurrences after the first get a hash of their own; ``kmers`` is sorted, so they stand together."""

    def by_runs(starts: Column, s: Column) -> Column:
        def run(start: Column, j: Column) -> Column:
            last = F.coalesce(F.get(starts, j + 1), F.size(s)) - 1

            def again(i: Column) -> Column:
                x = F.get(s, i)
                return F.when(i == start, x).otherwise(_placed(F.xxhash64(_hash(x), i - start), _pos(x)))

            return F.transform(F.sequence(start, last), again)

        return F.sort_array(F.flatten(F.transform(starts, run)))

    def of(s: Column) -> Column:
        is_start = lambda i: (i == 0) | (_hash(F.get(s, i)) != _hash(F.get(s, i - 1)))
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), is_start)
        numbered = let(starts, lambda st: F.when(F.size(st) == F.size(s), s).otherwise(by_runs(st, s)))
        return F.when(F.size(s) <= 1, s).otherwise(numbered)

    return let(kmers, of)


def _selected(kmers: Column) -> Column:
    """The ``TUPLE`` smallest of each bin."""
    return let(kmers, lambda s: F.filter(s, lambda x, i: (i < TUPLE) | (_bin(F.get(s, i - TUPLE)) != _bin(x))))


def _tuples(selected: Column) -> Column:
    """One int per bin in use: the bin above, the hash of its k-mers in text order below."""

    def of(s: Column) -> Column:
        def each(x: Column, i: Column) -> Column:
            y = F.get(s, i + 1)
            single = F.xxhash64(_hash(x))
            pair = F.when(_pos(x) <= _pos(y), F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
            value = F.when(_bin(y) == _bin(x), pair).otherwise(single)
            first = (i == 0) | (_bin(F.get(s, i - 1)) != _bin(x))
            packed = F.shiftleft(_bin(x), HASH_BITS).bitwiseOR(F.shiftrightunsigned(value, 64 - HASH_BITS))
            return F.when(first, packed.cast("int"))

        return F.filter(F.transform(s, each), lambda t: t.isNotNull())

    return let(selected, of)


def signature(text: Column) -> Column:
    """Array of ints, one per bin in use; empty for a text without words."""
    return _tuples(_selected(_numbered(_kmers(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))))


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda t: F.lower(F.lpad(F.hex(t), (BIN_BITS + HASH_BITS) // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins in use in which two signatures agree; 1 if neither has one."""
    bins = lambda s: F.transform(s, lambda t: F.shiftright(t, HASH_BITS))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def with_next(texts: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """``texts`` with the derived columns, and with ``next_text`` and ``next_*`` of the row that follows in
    descending doc_id, round and round.

    Rows are dealt to ranges of doc_id by quantiles (one number per range goes through the driver);
    within a range the next row is a window's, and the row after a range's last is the first of the
    range below, which is looked up by its id. Null ids come last, equal ids in the order of their
    texts' hashes.
    """
    carried = ["text", *derived]
    parts = partitions_for(texts)
    n = 2 * parts
    ids = texts.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("at"))
    bounds = sorted(set(ids.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    edges = F.array(*(F.lit(int(b)).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    range_of = lambda c: F.size(F.filter(edges, lambda b: b < c))
    # The first row of every range, by way of the ids alone.
    heads = ids.groupBy(range_of(F.col("at")).alias("range")).agg(F.max("at").alias("head"))
    below = Window.orderBy(F.desc("range"))
    whole = below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = heads.select("range", F.coalesce(F.lead("head").over(below), F.first("head").over(whole)).alias("next_head"))
    at = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    found = (
        texts.withColumn("at", at)
        .join(F.broadcast(nexts), F.col("at") == F.col("next_head"))  # two numbers per range
        .withColumns(derived)
        .groupBy("range")
        .agg(F.min(F.struct(F.md5("text").alias("key"), F.struct(*carried).alias("row"))).alias("head_row"))
        .select(F.col("range").alias("of"), F.col("head_row.row").alias("head_row"))
    )
    order = Window.partitionBy("range").orderBy(F.desc("at"), F.md5("text"))
    rows = texts.withColumns(derived).withColumn("at", at).withColumn("range", range_of(F.col("at"))).repartition(parts, "range")
    rows = rows.withColumn("following", F.lead(F.struct(*carried)).over(order))
    # ``found`` holds whole texts, one per range: rows are already dealt by range and meet them there.
    rows = rows.join(found.hint("merge"), (F.col("range") == F.col("of")) & F.col("following").isNull(), "left")
    following = F.coalesce("following", "head_row")
    return rows.select(*texts.columns, *derived, *(following[c].alias(f"next_{c}") for c in carried))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text's last floor(n/2) code points are the first as many of the next document, in
    descending doc_id and after the last the first. Null and empty texts have an empty fingerprint;
    a table of one row follows itself; an empty table gives no rows; other columns are not read.
    """
    rows = with_next(ids_and_texts(docs), {"sig": signature(F.col("text"))}).withColumn("n_chars", F.length("text"))
    half = F.expr("n_chars div 2").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", signature(F.col("edited")).alias("edited_sig"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("sig")).alias("fingerprint"),
        as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
