"""Tables of rules compiled to Columns: which rows of a source go, and which domain a row belongs to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import text as tx


@dataclass(frozen=True)
class Exclusion:
    """Rules of one source. Substrings are looked for in any case; null languages pass."""

    fields: tuple[str, ...] = ("source", "dataset", "source_dataset", "id")
    substrings: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    configs: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    function_calls: bool = False


# The rules of each source.
EXCLUSIONS = {
    "tulu-v2": Exclusion(),
    "openhermes-25": Exclusion(languages=("en", "eng", "english")),
    "tulu-3": Exclusion(fields=("source", "id"), substrings=("wildguardmix", "wildjailbreak", "coconot", "tulu-3-sft-personas-instruction-following", "aya")),
    "hermes-3": Exclusion(),
    "smoltalk": Exclusion(configs=("apigen-80k", "smol-constraints")),
    "dolci": Exclusion(fields=("source_dataset", "id"), substrings=("coconot", "aya", "wildguard", "wildjailbreak", "tool use"), domains=("Safety", "Precise IF"), function_calls=True),
}


def keep(rule: Exclusion, columns: list[str], messages: str = "messages") -> Column:
    """Whether rows of a table with these columns pass."""
    own = F.lit(True)
    if rule.substrings and (have := [F.col(c) for c in rule.fields if c in columns]):
        own = own & ~tx.contains_any(tx.haystack(*have), list(rule.substrings))
    if rule.domains and "domain" in columns:
        own = own & ~F.coalesce(F.lower(tx.strip(F.col("domain"))).isin(*[d.lower() for d in rule.domains]), F.lit(False))
    if rule.configs and "config" in columns:
        own = own & ~skipped_config(F.col("config"), rule.configs)
    if rule.languages and "language" in columns:
        tag = F.lower(tx.strip(F.col("language")))
        own = own & F.coalesce((tag == "") | tag.isin(*rule.languages), F.lit(True))
    if rule.function_calls and messages in columns:
        filled = lambda v: F.coalesce(tx.strip(v.cast("string")) != "", F.lit(False))
        own = own & ~F.coalesce(F.exists(messages, lambda m: filled(m["function_calls"]) | filled(m["functions"])), F.lit(False))
    return own


def keep_by_source(columns: list[str], rules: dict[str, Exclusion] = EXCLUSIONS, rule_source: str = "rule_source") -> Column:
    """The rules of each row's source; an unknown source is an error."""
    out = None
    for name, rule in rules.items():
        out = (F if out is None else out).when(F.col(rule_source) == name, keep(rule, columns))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(F.col(rule_source), F.lit("null")))).cast("boolean"))


def skipped_config(config: Column, skip: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(tx.strip(config)).isin(*[s.lower() for s in skip]), F.lit(False))


@dataclass(frozen=True)
class DomainRule:
    """Columns to look in, ordered (substring, domain) pairs of which the first hit counts, and exact values before those."""

    fields: tuple[str, ...] = ()
    substrings: tuple[tuple[str, str], ...] = ()
    exact: dict[str, str] = field(default_factory=dict)
    exact_field: str = ""


# Domains of each source.
DOMAINS = ("general", "math", "code", "science", "chat")
DOMAIN_RULES = {
    "smoltalk": DomainRule(exact_field="config", exact={"numina-cot-100k": "math", "metamathqa-50k": "math", "self-oss-instruct": "code", "everyday-conversations": "chat", "systemchats-30k": "chat", "smol-magpie-ultra": "chat", "openhermes-100k": "general", "smol-summarize": "general", "smol-rewrite": "general", "explore-instruct-rewriting": "general", "longalign": "general"}),
    "tulu-3": DomainRule(
        ("source", "id"),
        (("personas-math", "math"), ("personas_math", "math"), ("math-grade", "math"), ("personas-algebra", "math"), ("personas_algebra", "math"), ("numina", "math"), ("personas-code", "code"), ("personas_code", "code"), ("evol-codealpaca", "code"), ("codealpaca", "code"), ("sciriff", "science"), ("wildchat", "chat"), ("no_robots", "chat"), ("no-robots", "chat"), ("oasst", "chat"), ("flan", "general"), ("table-gpt", "general"), ("tablegpt", "general"), ("hard-coded", "general"), ("hard_coded", "general")),
    ),
    "tulu-v2": DomainRule(("dataset", "source", "id"), (("code_alpaca", "code"), ("codealpaca", "code"), ("science", "science"), ("sharegpt", "chat"), ("hard_coded", "chat"), ("cot", "general"), ("flan", "general"), ("open_orca", "general"), ("gpt4_alpaca", "general"), ("wizardlm", "general"), ("lima", "general"))),
    "dolci": DomainRule(("source_dataset",), (("math", "math"), ("science", "science"), ("code", "code"), ("python", "code"), ("coding", "code"), ("wildchat", "chat"), ("chat", "chat")), {"math": "math", "science": "science", "coding": "code", "code": "code", "chat": "chat", "other": "general", "general": "general"}, "domain"),
    "openhermes-25": DomainRule(("category",), (("math", "math"), ("code", "code"), ("coding", "code"), ("science", "science"), ("roleplay", "chat"), ("general", "general"))),
    "hermes-3": DomainRule(),
}


def domain(rule: DomainRule, columns: list[str], default: str = "general") -> Column:
    cases = []
    if rule.exact and rule.exact_field in columns:
        table = F.create_map(*[F.lit(x) for kv in rule.exact.items() for x in kv])
        cases.append(F.element_at(table, F.lower(tx.strip(F.col(rule.exact_field)))))
    if have := [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rule.fields if c in columns]:
        seen = F.lower(F.concat_ws(" ", *have))
        cases += [F.when(seen.contains(needle), name) for needle, name in rule.substrings]
    return F.coalesce(*cases, F.lit(default))


def domain_by_source(columns: list[str], rules: dict[str, DomainRule] = DOMAIN_RULES, rule_source: str = "rule_source") -> Column:
    out = None
    for name, rule in rules.items():
        out = (F if out is None else out).when(F.col(rule_source) == name, domain(rule, columns))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(F.col(rule_source), F.lit("null")))).cast("string"))
