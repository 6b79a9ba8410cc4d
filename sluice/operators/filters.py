"""Predicates over records and texts, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import text as tx

# Thresholds and lists that results depend on.
PURE_MATH = ("AG", "AT", "CT", "AC", "NT", "GT", "DG", "CO", "LO", "RT", "RA", "KT", "GR", "OA", "QA", "SG", "MG", "GN", "FA", "CV", "CA", "SP", "PR")
ENGLISH = ("en", "eng", "english")
DATA_SUFFIXES = (".jsonl", ".jsonl.gz", ".jsonl.zst", ".jsonl.zstd", ".json.gz", ".json", ".json.zst", ".parquet")


def md5_sample(key: Column, modulus: int, remainder: int = 0) -> Column:
    """The first 32 bits of the key's MD5, modulo `modulus`: the same rows in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % modulus == remainder


def web_math_base(text: Column, info: Column) -> Column:
    """Keeps pages with TeX or a fair score; a missing or zero score counts as 1."""
    score = F.coalesce(F.element_at(info, "math_score"), F.lit(1.0))
    score = F.when(score == 0, 1.0).otherwise(score)
    tex, images = tx.tex_signals(text, info), tx.signal_sum(info, ("img_math",))
    return ~tx.is_path_noise(text) & ~((tex == 0) & (images > 0)) & ~((tex == 0) & (score < 0.5)) & (score >= 0.25)


def _web_math(text: Column, info: Column, min_score: float, min_native: int, max_legacy: float, tex: Column) -> Column:
    native, legacy = tx.signal_sum(info, tx.NATIVE_SIGNALS), tx.signal_sum(info, tx.LEGACY_SIGNALS)
    share = F.when(native + legacy > 0, legacy / (native + legacy)).otherwise(0.0)
    score = F.coalesce(F.element_at(info, "math_score"), F.lit(0.0))
    images = tx.signal_sum(info, ("img_math",))
    return ~tx.is_path_noise(text) & (score >= min_score) & (native >= min_native) & (share <= max_legacy) & ~((tex == 0) & (images > 0))


def web_math_high(text: Column, info: Column) -> Column:
    return _web_math(text, info, 0.8, 3, 0.5, tx.tex_signals(text, info))


def web_math_relaxed(text: Column, info: Column) -> Column:
    meta_only = tx.signal_sum(info, (*tx.NATIVE_SIGNALS, "script_math_tex", "mathjax_tag", "codecogs_latex", "wp_latex"))
    return _web_math(text, info, 0.72, 2, 0.5, meta_only)


def formal_code(text: Column, meta: Column, shard: Column | None = None) -> Column:
    """Not an import shell, and in a language of proof assistants or TeX."""
    return ~tx.is_import_shell(text) & F.coalesce(tx.code_language(meta, text, shard).isin(*tx.FORMAL_LANGUAGES), F.lit(False))


def primary_is_math(cats: Column) -> Column:
    return F.coalesce(tx.primary_category(cats).startswith("math."), F.lit(False))


def all_math(cats: Column) -> Column:
    own = tx.categories(cats)
    return (F.size(own) > 0) & F.forall(own, lambda c: F.lower(c).startswith("math."))


def pure_math(cats: Column) -> Column:
    return all_math(cats) & F.forall(tx.categories(cats), lambda c: F.coalesce(tx.subcategory(c).isin(*PURE_MATH), F.lit(False)))


def is_english(tag: Column) -> Column:
    """A tag that says English; a missing one doesn't."""
    return F.coalesce(F.lower(tx.strip(tag)).isin(*ENGLISH), F.lit(False))


def proof_gate(text: Column, min_chars: int = 10_000, max_chars: int = 200_000, min_proofs: int = 2) -> Column:
    n = F.length(text)
    return F.coalesce((tx.strip(text) != "") & n.between(min_chars, max_chars) & (tx.proof_environments(text) >= min_proofs), F.lit(False))


def is_filled(tool: Column, kind: str = "string") -> Column:
    """A tool field that isn't null, blank or an empty list."""
    return F.coalesce(tool.isNotNull() & ((tx.strip(tool) != "") if kind == "string" else (F.size(tool) > 0)), F.lit(False))


def english_score(score: Column, least: float = 0.5) -> Column:
    return F.coalesce(score >= least, F.lit(False))


# Frequent English words, for the score that stands in where no language model is given.
ENGLISH_WORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "as", "with", "be", "by", "at", "this", "are", "from", "or")


def english_share(paragraph: Column) -> Column:
    """Four times the share of frequent English words, 1 at most."""
    own = F.regexp_extract_all(F.lower(paragraph), F.lit("[a-z]+"), F.lit(0))
    return F.least(F.lit(1.0), 4.0 * F.size(F.filter(own, lambda w: w.isin(*ENGLISH_WORDS))) / F.greatest(F.lit(1), F.size(own)))


def document_score(text: Column, score: Callable[[Column], Column] = english_share) -> Column:
    """Mean of the scores of a text's paragraphs (lines that aren't blank), by their lengths; null without any."""
    own = F.filter(F.split(text, "\n"), lambda p: tx.strip(p) != "")
    scored = F.transform(own, lambda p: F.struct((score(p) * F.length(p)).alias("s"), F.length(p).alias("n")))
    total = lambda xs: F.aggregate(xs, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["n"] + x["n"]).alias("n")))
    return tx.let(total(scored), lambda t: F.when(t["n"] > 0, t["s"] / t["n"]))


SECRETS = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----"


def code_quality(text: Column, max_avg_line: float = 80, max_line: int = 750, min_alnum: float = 0.35, min_alpha: float = 2.0) -> Column:
    """No secrets, lines of fair length, enough letters and digits."""
    s = tx.code_line_stats(text)
    return (F.regexp_count(text, F.lit(SECRETS)) == 0) & (s["avg_line"] <= max_avg_line) & (s["max_line"] <= max_line) & (s["alnum_share"] >= min_alnum) & (s["alpha_per_token"] >= min_alpha)


def replace_scored_span(text: Column, start: Column, end: Column, score: Column, least: float = 0.3, by: str = "") -> Column:
    """The text with its span replaced where the span's score is high enough."""
    cut = F.concat(F.substring(text, F.lit(1), start), F.lit(by), F.substring(text, end + 1, F.length(text)))
    return F.when(score >= least, cut).otherwise(text)


def replace_scored_spans(text: Column, spans: Column, least: float = 0.3, by: str = "") -> Column:
    """The text with all spans (s, e, score) replaced whose score is high enough; they don't overlap."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    chosen = F.array_sort(F.transform(F.filter(spans, lambda x: x["score"] >= least), lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))))
    step = lambda a, x: F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(by)).alias("out"))
    return F.aggregate(chosen, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def is_usable(metric: Column) -> Column:
    """A number, neither NaN nor infinite. (Null and NaN are different and both fail.)"""
    # one mention of the metric, so that an expensive one is computed once; NaN counts as greater than infinity
    return F.coalesce(F.abs(metric.try_cast("double")) < float("inf"), F.lit(False))


def token_weight(*counts: Column) -> Column:
    """The first positive count, else 0."""
    return F.coalesce(*[F.when(c > 0, c) for c in counts], F.lit(0))


def is_data_file(path: Column) -> Column:
    out = F.lit(False)
    for s in DATA_SUFFIXES:
        out = out | path.endswith(s)
    return out


def is_metric_key(key: Column, prefixes: tuple[str, ...] = ("train/", "eval/", "optim/", "throughput/")) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | key.startswith(p)
    return out


def is_backfilled(step: Column, keys: Column, first: int = 2205, last: int = 2222) -> Column:
    """Rows of the backfilled steps that hold evaluations but no training metric."""
    has = lambda p: F.exists(keys, lambda k: k.startswith(p))
    return step.between(first, last) & has("eval/") & ~has("train/")


def first_failure(rules: list[tuple[str, Column]], passed: str = "kept") -> Column:
    """Name of the first rule that drops the row, else `passed`."""
    out = None
    for name, keep in rules:
        out = F.when(~keep, name) if out is None else out.when(~keep, name)
    return out.otherwise(passed) if out is not None else F.lit(passed)


def reasons(df: DataFrame, rules: list[tuple[str, Column]], on_each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(reason, n): how many rows each rule is the first to drop, and how many are kept."""
    return df.groupBy(first_failure(rules).alias("reason")).agg(F.count("*").alias("n"))
