"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003), in DataFrame functions only.

Every `gram` consecutive words are hashed; in each window of `window` consecutive hashes the smallest is kept, the rightmost of
equal ones, with its position. Any passage of window + gram - 1 words that two texts share gives both a common hash.

Words are hashed once. The hash of a gram rolls by cyclic shifts: hash(a + b) = shift(hash(a), words of b) xor hash(b), so grams of 5
words come from those of 2 and 4 by three passes over the array, whatever their length. A hash and its position are packed in one
long: 34 bits of hash, then 30 bits that fall with the position (a text has less than 2^30 words), so that the plain minimum of a
window is the smallest hash at its rightmost place. The sliding minimum doubles its reach each pass, so its cost grows with the
logarithm of the window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE, SPACE_CHARS, id_bounds, range_of, text_bytes

PLACE_BITS = 30
PLACES = (1 << PLACE_BITS) - 1
MOST_RANGES = 20_000


def _turned(x: Column, n: int) -> Column:
    n %= 64
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n)) if n else x


def _from(a: str, n: int) -> Column:
    """The array without its first n entries."""
    return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))


def _grams(df: DataFrame, one: str, gram: int) -> DataFrame:
    """Column `one`, hashes of words, becomes the hashes of grams from each start; entries past the last whole gram are null or partial."""
    have, reach = None, 0
    for bit in range(gram.bit_length()):
        if gram >> bit & 1:
            if have is None:
                df = df.withColumn("_have", F.col(one))
            else:  # words of `have` first, then those of `one`
                df = df.withColumn("_have", F.zip_with("_have", _from(one, reach), lambda a, b: _turned(a, 1 << bit).bitwiseXOR(b)))  # noqa: B023
            have, reach = "_have", reach + (1 << bit)
        if gram >> bit + 1:
            df = df.withColumn(one, F.zip_with(one, _from(one, 1 << bit), lambda a, b: _turned(a, 1 << bit).bitwiseXOR(b)))  # noqa: B023
    return df.withColumn(one, F.col("_have")).drop("_have")


def with_fingerprint(df: DataFrame, text_col: str, out: str, gram: int = 5, window: int = 8) -> DataFrame:
    """df plus `out`: array of longs, hash * 2^30 + (2^30 - 1 - position), in text order, without repeats.

    Null text counts as empty. Fewer words than a gram: one gram of all words; a text without words has the fingerprint of one empty gram.
    """
    g, n = f"_{out}_grams", f"_{out}_n"
    words = F.split(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_CHARS)), SPACE)
    df = df.withColumn(g, F.transform(words, lambda w: F.xxhash64(w)))
    short = F.array(F.xxhash64(g))
    df = df.withColumn(n, F.size(g)).withColumn(f"{g}_short", F.when(F.col(n) < gram, short))
    df = _grams(df, g, gram)
    whole = F.when(F.col(n) < gram, F.col(f"{g}_short")).otherwise(F.slice(g, F.lit(1), F.greatest(F.col(n) - gram + 1, F.lit(1))))
    high = F.lit(-1 << PLACE_BITS).cast("long")
    df = df.withColumn(g, F.transform(whole, lambda h, i: F.xxhash64(h).bitwiseAND(high).bitwiseOR((F.lit(PLACES) - i).cast("long")))).drop(f"{g}_short")
    starts = F.greatest(F.size(g) - window + 1, F.lit(1))
    df, reach = df.withColumn(n, starts), 1
    while reach < window:
        step = min(reach, window - reach)
        df = df.withColumn(g, F.zip_with(g, _from(g, step), lambda a, b: F.least(a, b)))
        reach += step
    return df.withColumn(out, F.array_distinct(F.slice(g, F.lit(1), F.col(n)))).drop(g, n)


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, PLACE_BITS)))


def positions(fingerprint: Column) -> Column:
    """Word positions, ascending."""
    return F.transform(fingerprint, lambda x: F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES)))


def as_text(fingerprint: Column) -> Column:
    """hash@position, comma-separated."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, PLACE_BITS))), F.lit("@"), (F.lit(PLACES) - x.bitwiseAND(F.lit(PLACES))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two arrays of distinct hashes, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 8 << 20, add: Callable[[DataFrame], DataFrame] = lambda d: d, ahead: tuple[str, ...] = ()) -> DataFrame:
    """docs plus _next, a struct of text_col and the columns `ahead` of the next row by ascending id (nulls first); after the last row comes the first.

    Id ranges, at most MOST_RANGES, are windows of their own. The first text of each range is also dealt to the range before it, as one row
    more, which goes after it has been seen. `add` may add the columns `ahead`; it runs between the shuffle and the windows. Rows of equal
    id are ordered by their text. Null text counts as empty.
    """
    total = text_bytes(docs, text_col, 64)  # empty and short texts fill ranges too
    bounds = id_bounds(docs, id_col, min(MOST_RANGES, max(1, -(-total // range_bytes))))
    keyed = docs.withColumn(text_col, F.coalesce(text_col, F.lit(""))).withColumn("_range", range_of(F.col(id_col).cast("long"), bounds))
    # first row of each range, found by its id: one row a range, so no more than MOST_RANGES are broadcast
    lowest = keyed.groupBy("_range").agg(F.when(F.count("*") == F.count(id_col), F.min(id_col)).alias("_first"))
    around = Window.partitionBy(F.lit(0)).orderBy("_range")
    everywhere = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.coalesce(F.lag("_range").over(around), F.last("_range").over(everywhere))
    lowest = F.broadcast(lowest.select(F.col("_range").alias("_r"), "_first", to.alias("_to")))
    firsts = keyed.join(lowest, (F.col("_range") == F.col("_r")) & F.col(id_col).eqNullSafe(F.col("_first"))).groupBy("_to").agg(F.min(text_col).alias(text_col))
    rows = keyed.withColumn("_extra", F.lit(False)).unionByName(firsts.select(F.col("_to").alias("_range"), text_col, F.lit(True).alias("_extra")), allowMissingColumns=True)
    rows = add(rows.repartition(len(bounds) + 1, "_range"))
    order = Window.partitionBy("_range").orderBy("_extra", F.col(id_col).asc_nulls_first(), text_col)
    return rows.withColumn("_next", F.lead(F.struct(text_col, *ahead)).over(order)).where("not _extra").drop("_range", "_extra")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 5, window: int = 8, range_bytes: int = 8 << 20) -> DataFrame:
    """Rows (id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    edited: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document.
    Null text: empty. Null ids stand first, rows of equal id side by side by text. A single document is its own next. An empty table gives
    an empty result. Other columns are not read. Each document's own fingerprint is made once and also serves the one before it.
    """
    d = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    own = lambda rows: with_fingerprint(rows, "_text", "fingerprint", gram, window)
    d = with_next(d, id_col, "_text", range_bytes, own, ("fingerprint",)).withColumn("n_chars", F.length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("_text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("_next._text", F.lit(1), half)))
    d = with_fingerprint(d.withColumn("_following", F.col("_next.fingerprint")).drop("_text", "_next"), "edited", "edited_fingerprint", gram, window)
    mine = hashes(F.col("fingerprint"))
    return d.select(id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(mine, hashes(F.col("edited_fingerprint"))).alias("near_edited"), likeness(mine, hashes(F.col("_following"))).alias("near_next"))
