"""English scores of paragraphs: a classifier on hashed character n-grams, learnt from a bounded sample of documents.

The n-grams are the first and the last three letters of each word, where languages differ most. Their buckets' weights
are log-odds of standing in English documents, in sixteenths and cut to 63 either way, so that they are whole numbers
and a table of them is a few bytes. Built-in functions apply it, a byte looked up for each n-gram.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import let

#: Buckets of a table, steps of a log-odds unit, greatest weight.
BUCKETS, STEPS, MOST = 2048, 16, 63
#: Runs of letters: a to z and all beyond ASCII.
WORD = r"[^\x00-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _bucket(gram: Column, last: bool) -> Column:
    """Bucket of up to three letters; those that begin words and those that end them are kept apart."""
    code = lambda i: F.ascii(F.substring(gram, i, 1))
    return ((code(1) * 961 + code(2) * 31 + code(3)) % (BUCKETS // 2) + (BUCKETS // 2 if last else 0)).cast("int")


def grams(text: Column) -> Column:
    """Buckets of the text's n-grams, two for each word."""
    return F.flatten(F.transform(words(text), lambda w: F.array(_bucket(F.substring(w, 1, 3), False), _bucket(F.right(w, F.lit(3)), True))))


def learnt(docs: DataFrame, limit: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", english: str = "en") -> bytes:
    """The table of weights, a byte (64 and more or less) for each bucket, from `limit` documents of known language.

    The documents of lowest hashes of ids are taken, whole; buckets that none of them has weigh nothing.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    # hashes first, so that no task gets texts of more than the sample
    chosen = known.select(F.col(id_col).alias("_id")).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(limit)
    own = known.select(F.col(id_col).alias("_id"), (F.col(lang_col) == english).alias("en"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "_id", "left_semi")
    counts = own.select("en", F.explode(grams(F.col("t"))).alias("b")).groupBy("b").agg(F.count_if("en").alias("y"), F.count_if(~F.col("en")).alias("n")).collect()  # a row for each bucket
    return weights({r.b: (r.y, r.n) for r in counts})


def weights(counts: dict[int, tuple[int, int]]) -> bytes:
    """By bucket, how often English and other documents have it."""
    yes, no = (sum(c[k] for c in counts.values()) + 0.5 * BUCKETS for k in (0, 1))
    out = bytearray([64] * BUCKETS)
    for b, (y, n) in counts.items():
        ratio = math.log((y + 0.5) / yes) - math.log((n + 0.5) / no)
        out[b] = 64 + max(-MOST, min(MOST, math.floor(STEPS * ratio + 0.5)))
    return bytes(out)


def english_score(table: bytes, slope: float = 2.0) -> Callable[[Column], Column]:
    """The score of a paragraph, 0 to 1: the logistic function of the n-grams' mean weight; 0.5 without letters."""
    weight = lambda b: F.ascii(F.substring(F.lit(bytearray(table)), b + 1, F.lit(1)).cast("string")) - 64

    def score(paragraph: Column) -> Column:
        total = lambda bs: F.aggregate(bs, F.lit(0), lambda a, b: a + weight(b))
        return let(grams(paragraph), lambda bs: 1 / (1 + F.exp(-slope / STEPS * total(bs) / F.greatest(F.lit(1), F.size(bs)))))

    return score
