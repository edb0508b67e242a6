"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A sketch holds every distinct hash of a five-word shingle that lies in the
lowest ``1 / SCALE`` of the hash range.  The threshold is the same for all
documents, so sketches merge by union, and the share of one sketch that is in
another estimates how much of that document the other contains, however
unequal the two are.  A text none of whose hashes lies below the threshold,
which happens to short ones, keeps its smallest hash, so that no sketch is
empty and short texts are told apart too.

Cases: a null or empty text is one empty word, so one shingle.  Texts with
fewer than five words have one shingle of all their words.  A very long text is
one array of hashes, of which a share of ``1 / SCALE`` is kept.  Rows with a
null id have no next document; their edited text is their own.  Rows of one id
stand in the order of their texts' hashes.  Repeated rows, of one id and text,
count as one document in that order and are returned as often as they occur.  A
table of one document follows itself.  Columns besides the id and the text are
not read, and may have any names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SHINGLE_WORDS, SCALE = 5, 4


def limit(scale: int) -> int:
    """The hashes that are kept lie below this."""
    return -(2**63) + 2**64 // scale


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value made once: a lambda's variable is a name, a repeated expression is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, *, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The sorted retained hashes of a non-null text."""

    def hashes(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(p) - words, F.lit(0)))
        # get() beyond the last word is null, which the hash leaves out; slice() would copy the whole array each time.
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(words)]))

    def kept(every: Column) -> Column:
        low = F.filter(every, lambda h: h < limit(scale))
        return _named(low, lambda few: F.when(F.size(few) > 0, F.array_sort(F.array_distinct(few))).otherwise(F.array(F.array_min(every))))

    return _named(F.split(F.trim(F.lower(text)), r"\s+"), lambda p: _named(hashes(p), kept))


def merged(a: Column, b: Column, *, scale: int = SCALE) -> Column:
    """The sketch of two documents together: the union, or of two lone hashes above the threshold the smaller."""
    both = F.array_sort(F.array_union(a, b))
    return _named(both, lambda u: _named(F.filter(u, lambda h: h < limit(scale)), lambda low: F.when(F.size(low) > 0, low).otherwise(F.slice(u, 1, 1))))


def containment(a: Column, b: Column) -> Column:
    """The share of sketch a that is in sketch b."""
    return F.size(F.array_intersect(a, b)) / F.size(a)


def likeness(a: Column, b: Column) -> Column:
    """The containment of the smaller sketch in the larger."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def fingerprint(hashes: Column) -> Column:
    """The hashes as 16 hexadecimal digits each."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch) of every row; no shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), sketch(F.coalesce(F.col(text_col), F.lit(""))).alias("sketch"))


def followers(rows: DataFrame) -> DataFrame:
    """(doc_id, hash, next_id, next_hash) of the distinct documents (doc_id, hash), by ascending id, then hash; the last is followed by the first.

    Only these narrow rows are sorted, by range over all partitions, so an id
    that many rows share is divided like any other.  Inside a partition a window
    finds the next row; the last row takes the first of the next partition that
    has rows, from a table of one row a partition.
    """
    keys = rows.select("doc_id", "hash").distinct()
    placed = durable(keys.repartitionByRange("doc_id", "hash").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("doc_id", "hash")
    inside = placed.withColumn("next", F.lead(F.struct("doc_id", "hash")).over(order))
    heads = placed.groupBy("part").agg(F.min(F.struct("doc_id", "hash")).alias("head"))
    whole = Window.orderBy("part")  # one row a partition
    heads = heads.select("part", F.coalesce(F.lead("head").over(whole), F.min("head").over(Window.partitionBy())).alias("then"))
    both = inside.join(F.broadcast(heads), "part").withColumn("next", F.coalesce("next", "then"))  # one row a partition
    return both.select("doc_id", "hash", F.col("next.doc_id").alias("next_id"), F.col("next.hash").alias("next_hash"))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each row beside the next by ascending id, the last beside the first.

    The order is found on ids and hashes.  The texts are shuffled twice: once
    by their own key, where each row waits for its next one and learns whose
    next one it is itself, and once as what follows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Under names of their own, both uses of the rows have one plan, and Spark shuffles them once for both.
    known = docs.select(F.col(id_col).cast("long").alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("own_text")).where("own_id is not null")
    known = known.select("own_id", F.xxhash64("own_text").alias("own_hash"), "own_text")
    before = durable(followers(known.select(F.col("own_id").alias("doc_id"), F.col("own_hash").alias("hash"))))
    # Of repeated rows one text stands for all; the aggregation has nothing to do where keys are unique.
    unique = known.groupBy("own_id", "own_hash").count().where("count > 1").isEmpty()
    once = known if unique else known.groupBy("own_id", "own_hash").agg(F.min("own_text").alias("own_text"))
    told = before.select(F.col("next_id").alias("own_id"), F.col("next_hash").alias("own_hash"), F.col("doc_id").alias("first_id"), F.col("hash").alias("first_hash"))
    after = once.join(told.hint("merge"), ["own_id", "own_hash"]).select("first_id", "first_hash", F.col("own_text").alias("next_text"))
    beside = known.join(after.hint("merge"), (F.col("own_id") == F.col("first_id")) & (F.col("own_hash") == F.col("first_hash")))
    beside = beside.select(F.col("own_id").alias("doc_id"), F.col("own_text").alias("text"), "next_text")
    return beside.unionByName(rows.where("doc_id is null").withColumn("next_text", F.lit(None).cast("string")))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose later half gives way to the beginning of the next document."""
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    rows = with_next(docs, id_col=id_col, text_col=text_col).withColumn(
        "edited", F.when(F.col("next_text").isNull(), F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half)))
    )
    # Each sketch is a column of its own, made once.
    rows = rows.withColumns({"sketch": sketch(F.col("text")), "edited_sketch": sketch(F.col("edited")), "next_sketch": F.when(F.col("next_text").isNotNull(), sketch(F.col("next_text")))})
    return rows.select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
