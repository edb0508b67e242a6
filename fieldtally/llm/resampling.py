"""Importance resampling towards a target: hashed word n-grams, log ratios, Gumbel top-k.

1. A text's separators collapse to single spaces.  An overlapped regular
   expression, anchored by a look-behind, finds at every word the spans of its
   runs of one, two and three words; each span's CRC-32, carried on from the
   shorter one, names a bucket.
2. The buckets of all documents and of all target texts are counted, each
   partition by itself first; what the driver gets is one number a bucket, a
   fixed quantity.
3. A bucket's gain is the floored, scaled logarithm of its smoothed share in the
   target against its share in the documents.  A document's weight is the sum
   over its features, its score the weight and a Gumbel noise made of its id.
4. The highest scores among documents of enough words are drawn: a sample
   without replacement in proportion to the importance.  Only rows above an
   approximate quantile, chosen so low that none is missed, are placed in order,
   by range over all partitions.

Texts are read once; what stays of a document is its buckets, two bytes a
feature and never more than a count a bucket.

Cases: a null or empty text has no words, no features and weight 0, and is not
drawn.  A very long text is scanned in parts.  Rows of one id share their noise;
ties go to the smaller id, then to the smaller weight.  Repeated rows are rows
of their own and may all be drawn.  A null id is the empty text before hashing and comes
first among ties.  Without target texts all targets count 0.  An empty table
gives no rows.  Columns besides the id and the text are not read, and may have
any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice
from operator import methodcaller

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import durable

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, (5, 100), 42
#: Matches that are hashed at a time, and rows that a Python function hands back at a time.
PART, SLICE = 65_536, 512
#: How far below the wanted share the quantile lies from which rows are placed in order, and the quantile's accuracy.
SLACK, ACCURACY = 0.01, 1_000

#: Bytes that are no part of a word become spaces, A-Z small letters; bytes of other characters stay.
_PLAIN = bytes(b if b > 127 else 32 if not chr(b).isalnum() else ord(chr(b).lower()) for b in range(256))
#: At the beginning of a word: the word, and with their spaces the next one and the one after, empty at the end.
_RUNS = regex.compile(rb"(?<= )([^ ]++)((?: [^ ]++)?+)((?: [^ ]++)?+)")
_SPANS = methodcaller("groups")


def collapsed(text: str | None) -> bytes:
    """The words of a text in UTF-8, each behind one space."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    return b" " + b" ".join(words) if words else b""


def feature_hashes(plain: bytes) -> Iterator[np.ndarray]:
    """The CRC-32 of every run of one to three words of a collapsed text, in parts."""
    matches, crc = map(_SPANS, _RUNS.finditer(plain, overlapped=True)), zlib.crc32
    part = list(islice(matches, PART))
    while part:
        following = list(islice(matches, PART))
        one, two, three = zip(*part)
        ones = list(map(crc, one))
        twos = list(map(crc, two, ones))
        threes = list(map(crc, three, twos))
        # The last word has no second one, and the last two no third.
        ends = (len(part), len(part) - (not two[-1]), len(part) - sum(not x for x in three[-2:]))
        yield np.array(ones[: ends[0]] + twos[: ends[1]] + threes[: ends[2]], np.uint32)
        part = following


def _dense(n: int, buckets: int) -> bool:
    return n >= 2 * buckets


def features(text: str | None, buckets: int = BUCKETS) -> tuple[int, int, bytes]:
    """(words, features, buckets): the bucket of each feature in two bytes or four, ascending; of many features a count of eight bytes for every bucket."""
    plain = collapsed(text)
    n_words = plain.count(b" ")
    n = sum(max(0, n_words - k) for k in range(3))
    parts = (h % buckets for h in feature_hashes(plain))
    if _dense(n, buckets):
        return n_words, n, sum((np.bincount(p, minlength=buckets) for p in parts), np.zeros(buckets, np.int64)).tobytes()
    return n_words, n, np.sort(np.concatenate([np.empty(0, np.uint32), *parts])).astype("<u2" if buckets <= 65_536 else "<u4").tobytes()


def bucket_values(kept: bytes, n: int, values: np.ndarray) -> int:
    """The sum of the integer values of a text's buckets."""
    if _dense(n, len(values)):
        return int(np.frombuffer(kept, np.int64) @ values)
    return int(values[np.frombuffer(kept, "<u2" if len(values) <= 65_536 else "<u4")].sum())


def featured(rows: DataFrame, *, id_col: str | None, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, kept) of every row; no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, SLICE) for a in range(0, batch.num_rows, SLICE)):
                words, sizes, kept = zip(*(features(t.as_py(), buckets) for t in part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_features", "kept"])

    own = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return rows.select(own.alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n_words long, n_features long, kept binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all featured rows each bucket holds; partitions are summed before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for kept, n in zip(batch["kept"], batch["n_features"]):
                if _dense(n, buckets):
                    total += np.frombuffer(kept, np.int64)
                else:
                    total += np.bincount(np.frombuffer(kept, "<u2" if buckets <= 65_536 else "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select("kept", "n_features").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target against its share in the source."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times) a Gumbel noise, from the first 32 bits of the SHA-256 of the seed and the id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(share))).cast("long")


def weighted(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of featured rows."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [bucket_values(k.as_py(), n.as_py(), gains) for k, n in zip(batch.column("kept"), batch.column("n_features"))]
            yield batch.select(["doc_id", "n_words", "n_features"]).append_column("weight", pa.array(weights, pa.int64()))

    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; those that aren't drawn have no rank."""
    kept = durable(featured(docs, id_col=id_col, text_col=text_col, buckets=buckets))
    gains = bucket_gains(bucket_counts(kept, buckets), bucket_counts(featured(target, id_col=None, text_col=target_col, buckets=buckets), buckets))
    scored = durable(weighted(kept, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    wanted = n * share[0] // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    # From this score on there are more rows than are drawn; that is checked, and else all take part.
    low = scored.where(able).agg(F.percentile_approx("score", max(0.0, 1 - share[0] / share[1] - SLACK), ACCURACY)).first()[0]
    enough = scored.where(able & (F.col("score") >= low)).count() >= wanted
    open_ = able & (F.col("score") >= low) if enough else able
    placed = numbered(scored.where(open_), "place", F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features"))
    drawn = placed.select(*columns, F.when(F.col("place") <= wanted, F.col("place")).cast("long").alias("rank"))
    return drawn.unionByName(scored.where(~open_).select(*columns, F.lit(None).cast("long").alias("rank")))
