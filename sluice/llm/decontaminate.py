"""Benchmark decontamination by templates, in DataFrame functions only.

Texts become tokens: numbers, runs of capitalised words, words. In the template numbers, names and units of measure (a
unit's word after a number) are typed placeholders and words are in lower case. Windows of `width` template tokens are
hashed and joined: every window of the benchmark that has at least `literals` plain words, every window of a document.
An item with fewer tokens is one window of its own length. The same is done with the single words in lower case, only
numbers and units typed, so that capitals hide nothing; windows of these with fewer plain words than `literals` are
joined by the words and numbers as they are. Matches of a document and an item on one diagonal (equal shift of positions) count if their slots are
consistent: equal fillers in the item have equal fillers in the document in at least `consistent` of the pairs. A
document is flagged with an item if such matches cover at least `coverage` of the item's tokens, in templates or in
single words; n_windows, n_covered, n_tokens and n_changed are those of the way that covers more. Re-parameterised
copies differ in fillers only, so they match; `n_changed` counts the fillers that differ.

Null and empty texts have no tokens and are never flagged. Rows with the same id and text are one document; a null id is
an id like any other. Empty tables flag nothing. Texts are searched whole; a very long one is one row of tokens and of
window hashes, some 30 times its bytes. The benchmark's windows are broadcast only if a count has shown at most
`broadcast_rows`. Of the tables' columns only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"\d+(?:[.,]\d+)*|\p{Lu}[\p{L}\p{M}]*(?: \p{Lu}[\p{L}\p{M}]*)*|[\p{L}\p{M}]+"
NUMBER, NAME, UNIT = "<0>", "<n>", "<u>"
#: Columns of the words and of the tokens that are hashed, by key: templates, case-folded words with typed numbers and units, case-folded words as they are.
TEMPLATE, FOLDED, EXACT = 0, 1, 2
KEYS = {TEMPLATE: ("words", "form"), FOLDED: ("folded", "typed"), EXACT: ("folded", "folded")}
#: Units of measure: fixed values.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph percent pct dollar dollars euro euros cent cents usd eur gbp j kj w kw v a hz khz mhz ghz kb mb gb tb deg degrees c f k".split()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def spelled(df: DataFrame) -> DataFrame:
    """Adds `form` (the tokens of `words` with numbers, names and units as placeholders), `folded` (the single words in lower case, numbers as they are) and `typed` (those with numbers and units as placeholders)."""
    # whole texts of tokens, joined by a sign that no token holds: a function call by token costs more
    named = F.lower(F.regexp_replace(F.array_join("words", "\n"), r"(?m)^[\p{Lu}\p{Lt}].*$", NAME))
    line = F.lower(F.array_join("words", " "))
    split = lambda c, by: F.when(F.size("words") > 0, F.split(c, by)).otherwise(F.array().cast("array<string>"))

    def typed(c: Column | str, by: str) -> Column:
        numbers = F.regexp_replace(c, r"\d+(?:[.,]\d+)*", NUMBER)
        return F.regexp_replace(numbers, rf"{NUMBER}{by}(?:{'|'.join(UNITS)})(?={by}|$)", f"{NUMBER}{by}{UNIT}")

    return df.withColumn("line", line).select("*", split(typed(named, "\n"), "\n").alias("form"), split(F.col("line"), " ").alias("folded"), split(typed("line", " "), " ").alias("typed")).drop("line")


def _searched(df: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """Adds (key, width, said, pos, hash) of every window of these keys and widths; one row each. said: the key's words."""
    both = []
    for key, width in keys:
        words, form = KEYS[key]
        n = F.size(form)
        starts = F.when(n >= width, F.sequence(F.lit(0), n - width))
        # the hash of a slice, for half the time
        hashes = F.transform(starts, lambda i: F.xxhash64(F.lit(key), *[F.col(form)[i + j] for j in range(width)]))  # noqa: B023  called at once
        both.append(F.struct(F.lit(key).alias("key"), F.lit(width).alias("width"), F.col(words).alias("said"), hashes.alias("hashes")))
    out = df.select("doc_id", "th", F.inline(F.array(*both)))
    return out.select("doc_id", "th", "key", "width", "said", F.posexplode("hashes").alias("pos", "hash"))


def _sides(items: DataFrame, width: int, literals: int) -> DataFrame:
    """(item_id, n_tokens, key, width, item_pos, hash, kinds, item_words) of the items' windows; a shorter item is one window."""
    out = None
    for key, (words, form) in KEYS.items():
        own = items.where(F.size(form) > 0).select("item_id", "typed", F.col(words).alias("words"), F.col(form).alias("form"), F.size(form).alias("n_tokens"), F.least(F.size(form), F.lit(width)).alias("width"))
        own = own.select("*", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - F.col("width"))).alias("item_pos"))
        cut = lambda c: F.slice(c, F.col("item_pos") + 1, F.col("width"))
        plain = F.size(F.filter(cut("form" if key == TEMPLATE else "typed"), lambda w: ~w.isin(NUMBER, NAME, UNIT)))
        own = own.where(plain < literals if key == EXACT else plain >= literals)
        own = own.select("item_id", "n_tokens", F.lit(key).alias("key"), "width", "item_pos", F.xxhash64(F.lit(key), cut("form")).alias("hash"), cut("form").alias("kinds"), cut("words").alias("item_words"))
        out = own if out is None else out.union(own)
    return out.distinct()


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 4, consistent: float = 0.8, coverage: float = 0.4, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, th, item_id, n_windows, n_covered, n_tokens, n_changed): documents with the items they hold; th hashes the text."""
    sides = _sides(spelled(benchmark.select("item_id", tokens(F.col("text")).alias("words"))), width, literals)
    sizes = sides.groupBy("key", "width").count().collect()  # at most `width` rows a key
    small = sum(r["count"] for r in sizes) <= broadcast_rows
    keys = sorted((r["key"], r["width"]) for r in sizes) or [(TEMPLATE, width)]

    own = docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), tokens(F.col("text")).alias("words"))
    own = _searched(spelled(own), keys)
    said = F.slice("said", F.col("pos") + 1, F.col("width")).alias("doc_words")
    sides = sides.drop("key", "width")
    if small:  # the documents' words stay in the row up to the join and are cut for matches only
        hit = own.join(F.broadcast(sides), "hash").withColumn("doc_words", said)
    else:
        hit = own.select("doc_id", "th", "key", "width", "pos", "hash", said).join(sides, "hash")
    # two uses keep the cut a projection of its own, beside the join; a document of many matches then doesn't hold its words for each
    at = F.filter(F.sequence(F.lit(0), F.size("doc_words") - 1), lambda i: F.col("kinds")[i].isin(NUMBER, NAME, UNIT))
    slots = F.transform(at, lambda i: F.struct(F.lower(F.col("item_words")[i]).alias("i"), F.lower(F.col("doc_words")[i]).alias("d")))
    hit = hit.select("doc_id", "th", "item_id", (F.col("key") == TEMPLATE).alias("template"), "n_tokens", "width", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), slots.alias("slots"))
    # an item's windows bound what a group collects
    line = hit.groupBy("doc_id", "th", "item_id", "template", "n_tokens", "width", "diagonal").agg(F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    fillers = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    line = line.where((F.size("pairs") == 0) | (fillers >= consistent * F.size("pairs")))
    changed = F.size(F.filter("pairs", lambda p: p["i"] != p["d"])).alias("changed")
    line = line.select("doc_id", "th", "item_id", "template", "n_tokens", "width", "at", changed)
    whole = line.groupBy("doc_id", "th", "item_id", "template", "n_tokens", "width").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"), F.sum("changed").alias("n_changed"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("width") - 1)))))
    whole = whole.select("doc_id", "th", "item_id", "template", F.size("at").cast("long").alias("n_windows"), covered.cast("long").alias("n_covered"), F.col("n_tokens").cast("long").alias("n_tokens"), "n_changed").where(F.col("n_covered") >= coverage * F.col("n_tokens"))
    # found by both: the one that covers more, the template's if they are equal
    best = F.max(F.struct((F.col("n_covered") / F.col("n_tokens")).alias("share"), "template", "n_windows", "n_covered", "n_tokens", "n_changed")).alias("best")
    return whole.groupBy("doc_id", "th", "item_id").agg(best).select("doc_id", "th", "item_id", "best.n_windows", "best.n_covered", "best.n_tokens", "best.n_changed")


def flagged(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """(doc_id, item_id, n_windows, n_covered, n_tokens, n_changed) of contaminated documents."""
    return matches(docs, benchmark, **parameters).drop("th")


def kept(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows, all columns, of documents that hold no benchmark item."""
    bad = matches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **parameters)
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_t"))
    return packed.join(bad, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left_anti").select("_row.*")
