"""Aggregations: quality reports, roll-ups, losses, correlations, weighted merges."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.storage import checkpointed

from .filters import is_usable
from .prefix import SINGLE_TASK_ROWS, accumulated, is_small, lagged


def totals(df: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    return df.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(tokens), F.lit(0)).alias("n_tokens"))


def with_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str], others: list[Column], single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """By group: the other aggregates, and exact quantiles (linear between neighbours) of the values that aren't null.

    Spark's exact percentile holds all different values of a group in one buffer. Beyond small inputs the two ranks at a
    quantile's place are looked up instead, in ranks that no single task has to make.
    """
    if is_small(df, single_task_rows):
        return df.groupBy(*by).agg(*others, *[F.percentile(value, F.lit(q)).alias(k) for k, q in quantiles.items()])
    df = checkpointed(df)
    ranked = accumulated(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), ["_v"], None, by, single_task_rows)

    def at(q: float) -> Column:
        place = (F.col("total") - 1) * F.lit(q)
        low = F.floor(place)
        share = F.when(F.col("rn") - 1 == low, 1 - (place - low)).when(F.col("rn") - 1 == low + 1, place - low)
        return F.sum(F.when(share > 0, F.col("_v") * share))

    found = ranked.groupBy(*by).agg(*[at(q).alias(k) for k, q in quantiles.items()]).withColumnsRenamed({b: f"_b_{b}" for b in by})
    rest = df.groupBy(*by).agg(*others)
    on = reduce(lambda x, b: x & F.col(b).eqNullSafe(F.col(f"_b_{b}")), by, F.lit(True))
    # without groups both sides are one row
    return rest.join(found if by else F.broadcast(found), on, "left").drop(*[f"_b_{b}" for b in by])


def quality_report(df: DataFrame, tokens: str = "n_tokens", facts: str | None = None, exact: bool = True) -> DataFrame:
    """Count, sum, mean, median and 95th percentile of tokens; facts per document and documents without any."""
    cols = [F.count("*").alias("n_docs"), F.coalesce(F.sum(tokens), F.lit(0)).alias("n_tokens"), F.avg(tokens).alias("avg_tokens")]
    if facts:
        cols += [F.avg(facts).alias("avg_facts"), F.count_if(F.col(facts) == 0).alias("n_without_facts")]
    places = {"p50_tokens": 0.5, "p95_tokens": 0.95}
    if exact:
        return with_quantiles(df.select(tokens, *([facts] if facts else [])), tokens, places, [], cols)
    return df.agg(*cols, *[F.percentile_approx(tokens, F.lit(q)).alias(k) for k, q in places.items()])


def by_group(df: DataFrame, by: str, tokens: str = "n_tokens") -> DataFrame:
    """Documents and tokens of each group, largest first."""
    return df.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(tokens).alias("n_tokens")).orderBy(F.desc("n_tokens"), by)


def within(n: Column, target: Column | float, tolerance: float) -> Column:
    target = target if isinstance(target, Column) else F.lit(float(target))
    return F.when(target == 0, n == 0).otherwise(F.abs(n - target) / target <= tolerance)


def placement(df: DataFrame, facts: str = "n_facts", placed: str = "n_facts_placed") -> DataFrame:
    """Totals and rate of placed facts; the rate is null without facts."""
    return df.agg(F.sum(facts).alias("n_facts"), F.sum(placed).alias("n_placed"), F.try_divide(F.sum(placed), F.sum(facts)).alias("rate"))


def shard_rollup(shards: DataFrame, by: str = "domain", path: str = "path", size: str = "bytes", tokens: str = "n_tokens") -> DataFrame:
    return shards.groupBy(by).agg(F.sum(size).alias("bytes"), F.sum(tokens).alias("n_tokens"), F.count("*").alias("n_shards"), F.array_sort(F.collect_list(path)).alias("shards"))


def acceptance(actual: DataFrame, budgets: DataFrame, by: str = "domain", tokens: str = "n_tokens", budget: str = "budget", tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(by domain: tokens, budget, ok; one row: totals, domains that fail, accepted). A domain without tokens counts 0."""
    each = budgets.select(by, budget).join(actual.groupBy(by).agg(F.sum(tokens).alias("n_tokens")), by, "left")
    each = each.select(by, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), budget).withColumn("ok", within(F.col("n_tokens"), F.col(budget), tolerance))
    whole = each.agg(F.sum("n_tokens").alias("n_tokens"), F.sum(budget).alias("budget"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col(by)))).alias("failed"), F.bool_and("ok").alias("accepted"))
    return each, whole


def nll(segments: DataFrame, by: list[str], loss: str = "loss", tokens: str = "n_tokens", cap: float = 80.0) -> DataFrame:
    """Mean loss by token of each document and its perplexity: infinite beyond the cap, null if the mean isn't finite."""
    mean = F.try_divide(F.sum(F.col(loss).cast("double")), F.sum(tokens))
    out = segments.groupBy(*by).agg(mean.alias("avg_nll"), F.sum(tokens).alias("n_loss_tokens"))
    return out.withColumn("perplexity", F.when(F.isnan("avg_nll") | (F.abs("avg_nll") == float("inf")), None).when(F.col("avg_nll") > cap, float("inf")).otherwise(F.exp("avg_nll")))


def learnability(early: DataFrame, late: DataFrame, on: str = "id") -> DataFrame:
    """Late minus early mean loss of documents that both sides have."""
    return early.select(on, F.col("avg_nll").alias("early")).join(late.select(on, F.col("avg_nll").alias("late")), on).withColumn("learnability", F.col("late") - F.col("early"))


def correlations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Each pair of metrics over rows with both: n, Pearson r, slope, intercept, R2; NaN under 2 rows or without variance.

    One pass: every pair's sums are columns of one aggregation.
    """
    nan, pairs, cols = F.lit(float("nan")), list(combinations(metrics, 2)), []
    for i, (a, b) in enumerate(pairs):
        ok = is_usable(F.col(a)) & is_usable(F.col(b))
        x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
        flat = (F.count_if(ok) < 2) | (F.var_pop(x) == 0) | (F.var_pop(y) == 0)
        of = lambda c, flat=flat: F.when(flat, nan).otherwise(F.coalesce(c, nan))
        cols.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count_if(ok).alias("n"), of(F.corr(x, y)).alias("r"), of(F.regr_slope(y, x)).alias("slope"), of(F.regr_intercept(y, x)).alias("intercept"), of(F.regr_r2(y, x)).alias("r2")).alias(f"p{i}"))
    return df.agg(*cols).select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))


def task_loss(df: DataFrame, by: list[str], label: str = "label", value: str = "bpb", labels: int = 20) -> DataFrame:
    """Macro mean, only if all labels are there; mean of the MMLU labels; mean of the other labels present."""
    mmlu = F.col(label).startswith("mmlu")
    return df.groupBy(*by).agg(F.count_distinct(label).alias("n_labels"), F.avg(value).alias("_all"), F.avg(F.when(mmlu, F.col(value))).alias("mmlu_avg"), F.avg(F.when(~mmlu, F.col(value))).alias("core_avg")).select(*by, "n_labels", F.when(F.col("n_labels") == labels, F.col("_all")).alias("macro"), "mmlu_avg", "core_avg")


def task_family(label: Column) -> Column:
    """The part of a label before its split name."""
    return F.regexp_replace(F.regexp_replace(label, r"_bpb\z", ""), r"(?s)_(?:val|test)_.*", "")


def eval_label(key: Column) -> Column:
    """The label in a metric key eval/.../label_bpb_bpb; null for other keys."""
    tail = F.regexp_extract(key, r"^eval/(?:.*/)?([^/]+_bpb)_bpb\z", 1)
    return F.when(tail != "", tail)


def family_macro(df: DataFrame, by: list[str], families: list[str], label: str = "label", value: str = "bpb") -> DataFrame:
    """Mean over families of each family's mean; null unless all families are there."""
    own = df.withColumn("family", task_family(F.col(label))).where(F.col("family").isin(families)).groupBy(*by, "family").agg(F.avg(value).alias("v"))
    return own.groupBy(*by).agg(F.when(F.count("*") == len(families), F.avg("v")).alias("macro"))


def bits_per_byte(nll: Column, text: Column) -> Column:
    return nll / F.log(F.lit(2.0)) / F.octet_length(text)


def choice_scores(df: DataFrame, item: str = "item", choice: str = "choice", bpb: str = "bpb", gold: str = "gold") -> DataFrame:
    """Mean bits by byte of the right choices, and how often the cheapest choice is the right one."""
    each = df.groupBy(item).agg(F.min_by(choice, F.struct(bpb, choice)).alias("picked"), F.max(gold).alias("gold"), F.max(F.when(F.col(choice) == F.col(gold), F.col(bpb))).alias("bpb"))
    return each.agg(F.count("*").alias("n"), F.avg("bpb").alias("bpb"), F.avg((F.col("picked") == F.col("gold")).cast("double")).alias("accuracy"))


def loss_summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return with_quantiles(df.select(*by, value), value, {"median": 0.5, "p90": 0.9, "p99": 0.99}, by, [F.avg(value).alias("mean")])


def plausibility(df: DataFrame, by: str, value: str, low: float, high: float, above: float) -> DataFrame:
    at = {f"p{int(100 * q)}": q for q in (0.05, 0.5, 0.95, 0.99)}
    return with_quantiles(df.select(by, value), value, at, [by], [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (100.0 * F.avg(F.col(value).between(low, high).cast("double"))).alias("pct_in_range"), F.count_if(F.col(value) > above).alias("n_above")])


def fit_errors(df: DataFrame, by: str, predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    """Errors of left-out predictions by family, beside the spread of what was observed."""
    e = F.col(predicted) - F.col(observed)
    return df.groupBy(by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_error"), F.min(observed).alias("min"), F.max(observed).alias("max"), F.stddev_pop(observed).alias("std")).withColumn("rmse_over_std", F.try_divide("rmse", "std"))


def peak_demand(allocated: DataFrame, by: str = "domain", tokens: str = "n_tokens", margin: float = 1.02) -> DataFrame:
    return allocated.groupBy(by).agg(F.ceil(F.max(tokens) * margin).alias("peak_tokens"))


def feasible_budget(weights: DataFrame, available: DataFrame, by: str = "domain", weight: str = "weight", tokens: str = "available") -> DataFrame:
    """One row: the largest budget that every mixture can draw without repeats, and the domain that binds it."""
    top = weights.groupBy(by).agg(F.max(weight).alias("max_weight")).where("max_weight > 0").join(available, by)
    cap = F.floor(F.col(tokens) / F.col("max_weight"))
    return top.agg(F.min(F.struct(cap.alias("cap"), by, "max_weight")).alias("b")).select(F.col("b.cap").alias("max_tokens"), F.col(f"b.{by}").alias("binding"), "b.max_weight")


def uniform(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n_values): fields that don't have exactly one value."""
    counts = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0null"))).alias(c) for c in fields])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values")) for c in fields]))).where("n_values <> 1")


def changes(df: DataFrame, key: str, order: list[str], by: list[str] | None = None, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """How many runs of one key the ordered rows have: the documents in a stream of tokens. No task gets a whole long group."""
    before = lagged(df, order, [key], by, single_task_rows)
    new = F.coalesce(F.col(key) != F.col(f"_before.{key}"), F.lit(True))
    return before.withColumn("_new", new.cast("int")).groupBy(*(by or [])).agg(F.sum("_new").alias("n_docs"))


def window_stats(df: DataFrame, by: str, token: str = "token", doc: str = "doc") -> DataFrame:
    return df.groupBy(by).agg(F.avg((F.col(token) != 0).cast("double")).alias("nonzero"), F.count_distinct(token).alias("n_distinct"), F.min(doc).alias("first_doc"), F.max(doc).alias("last_doc"))


def window_violations(df: DataFrame, by: str, token: str = "token", doc: str = "doc", min_nonzero: float = 0.5, min_distinct: int = 2) -> DataFrame:
    """(window, reason) of windows that are mostly zeros, hardly vary or whose documents go backwards."""
    s = window_stats(df, by, token, doc)
    reason = F.when(F.col("nonzero") < min_nonzero, "zeros").when(F.col("n_distinct") < min_distinct, "constant").when(F.col("first_doc") < 0, "document")
    return s.select(by, reason.alias("reason")).where("reason is not null")


def chunk_rollup(shards: DataFrame, by: str = "domain", tokens: str = "n_tokens", seq_len: int = 2048) -> DataFrame:
    """Chunks of each domain's shards and the tokens they hold."""
    n = F.greatest(F.lit(0), F.floor((F.col(tokens) - 1) / seq_len))
    return shards.groupBy(by).agg(F.count("*").alias("n_shards"), F.sum(n).cast("long").alias("n_chunks"), (F.sum(n) * seq_len).cast("long").alias("chunk_tokens"))


def ema_weights(n: int, alpha: float) -> list[float]:
    """Weights of n checkpoints, oldest first, that the recursion m <- alpha m + (1 - alpha) x gives."""
    return [alpha ** (n - 1) if i == 0 else alpha ** (n - 1 - i) * (1 - alpha) for i in range(n)]


def merged(states: DataFrame, alpha: float | None = None, ckpt: str = "ckpt", key: list[str] = ["key", "idx"], value: str = "value") -> DataFrame:  # noqa: B006
    """Weighted mean of checkpoints' values, by EMA weights in the order of checkpoints, or plain."""
    order = states.select(ckpt).distinct()  # few: one for each checkpoint
    n = order.count()
    place = order.withColumn("_i", F.row_number().over(Window.orderBy(ckpt)) - 1)
    weights = ema_weights(n, alpha) if alpha is not None else [1.0 / max(1, n)] * n
    weight = F.element_at(F.array(*map(F.lit, weights or [0.0])), F.col("_i") + 1)
    own = states.join(F.broadcast(place) if n <= 100_000 else place, ckpt).withColumn("_w", weight)
    return own.groupBy(*key).agg((F.sum(F.col("_w") * F.col(value).cast("double")) / F.sum("_w")).alias(value))


def last_written(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a hash aggregation, no sort of groups."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, "_row.*")


def demand(weights: DataFrame, available: DataFrame, budget: float, by: str = "domain", mix: str = "mix_id", weight: str = "weight", tokens: str = "available") -> DataFrame:
    """By domain: the largest need of any mixture, the mixture that has it, what is there, and whether it suffices."""
    need = weights.withColumn("need", F.col(weight) * budget)
    peak = need.groupBy(by).agg(F.max("need").alias("peak"), F.min_by(mix, F.struct(-F.col("need"), F.col(mix))).alias("binding_mix"))
    j = peak.join(available, by, "left").withColumn("margin", F.coalesce(tokens, F.lit(0)) - F.col("peak"))
    return j.withColumn("status", F.when(F.col("margin") < 0, "SHORT").otherwise("OK"))


def failing_mixtures(weights: DataFrame, available: DataFrame, budget: float, by: str = "domain", mix: str = "mix_id", weight: str = "weight", tokens: str = "available") -> DataFrame:
    short = weights.join(available, by, "left").where(F.col(weight) * budget > F.coalesce(tokens, F.lit(0)))
    return short.groupBy(mix).agg(F.array_sort(F.collect_list(by)).alias("short"))


def remeasured(manifest: DataFrame, measured: DataFrame, on: str = "path", estimate: str = "est_tokens", exact: str = "n_tokens") -> DataFrame:
    """The manifest with measured rows in place of estimated ones, sorted and numbered anew; `tokens` prefers the measure."""
    both = manifest.join(measured.select(on), on, "left_anti").unionByName(measured, allowMissingColumns=True)
    if exact not in both.columns:
        both = both.withColumn(exact, F.lit(None).cast("long"))
    numbered = accumulated(both, [on]).withColumn("index", F.col("rn") - 1).drop("rn", "incl", "excl", "total")
    return numbered.withColumn("tokens", F.coalesce(exact, estimate))
