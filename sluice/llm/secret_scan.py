"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, the other of ordinary identifiers; both are order-1 chains over the characters of a
candidate token, trained from labelled samples (1: random). A candidate is a run of at least `min_chars` characters of
the token alphabet outside every pattern's span; it is a secret if the mean ratio by character is over the threshold,
which lies above every ordinary sample's. Counts of patterns hold whatever the models say.

Null texts count as empty; empty texts have no spans. Repeated rows are scanned each by itself. Texts are scanned whole.
An empty table gives no rows, and a detector of made-up names alone. Only ids and texts are read, so further columns may
have any name; `redacted` passes them on as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "markov")
# The patterns of the base scan.
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
#: Cheap tests of whole columns; texts that fail them can't match.
MAY_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
MAY_HEX = r"[0-9a-f]{24}"
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


@dataclass
class Markov:
    """Log-probabilities of a first character and of each next one given the last."""

    first: np.ndarray
    step: np.ndarray

    @classmethod
    def trained(cls, samples: list[str], damping: float = 0.5) -> Markov:
        n = len(ALPHABET)
        first, step = np.full(n, damping), np.full((n, n), damping)
        for s in samples:
            c = _CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)]
            c = c[c >= 0]
            if len(c):
                first[c[0]] += 1
                np.add.at(step, (c[:-1], c[1:]), 1)
        return cls(np.log(first / first.sum()), np.log(step / step.sum(1, keepdims=True)))

    def mean(self, s: str) -> float:
        c = _CODE[np.frombuffer(s.encode(), np.uint8)]
        return float(self.first[c[0]] + self.step[c[:-1], c[1:]].sum()) / len(c)


@dataclass
class Detector:
    random: Markov
    ordinary: Markov
    threshold: float
    min_chars: int

    def ratio(self, s: str) -> float:
        return self.random.mean(s) - self.ordinary.mean(s)


#: Words of which ordinary identifiers are made, besides those of the corpus: fixed values.
PARTS = "get set is has new old max min sum avg count index value name type list map key node tree user file path line text data time date page item event table column row field query index cache token parse read write open close start stop begin end next last first size length number string integer float double boolean config option default handler manager service factory builder client server request response message error warning status state code version update delete insert select create remove add find search sort filter group order merge join split format convert encode decode load save import export".split()


def samples(words: list[str], n: int, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled samples: n random strings (1) over usual alphabets, and n identifiers (0) made of words in usual styles."""
    rng = np.random.default_rng(seed)
    out, words = [], [w for w in [*PARTS * 3, *words] if w]
    sets = [np.array(list(ALPHABET[:62])), np.array(list(ALPHABET[:64])), np.array(list("0123456789abcdef")), np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), np.array(list(ALPHABET[26:62]))]
    for k in range(n):
        out.append(("".join(rng.choice(sets[k % len(sets)], rng.integers(20, 65))), 1))
        parts = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 8))]
        style = k % 6
        text = "_".join(parts) if style == 0 else "-".join(parts) if style == 1 else "/".join(parts) if style == 2 else "".join(p.capitalize() for p in parts) if style == 3 else "_".join(parts).upper() if style == 4 else "".join(parts)
        out.append((text + (str(rng.integers(0, 10000)) if k % 5 == 0 else ""), 0))
    return out


def trained(labelled: list[tuple[str, int]], min_chars: int = 20, quantile: float = 0.9995, floor: float = 0.45) -> Detector:
    """The detector of these (text, label) rows; the threshold is a high quantile of ordinary samples' ratios, at least `floor`."""
    random, ordinary = (Markov.trained([s for s, y in labelled if y == k]) for k in (1, 0))
    d = Detector(random, ordinary, 0.0, min_chars)
    of = [d.ratio(s) for s, y in labelled if y == 0 and len(s) >= min_chars and (_CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)] >= 0).all()]
    d.threshold = max(floor, float(np.quantile(of, quantile)) + 0.1 if of else floor)
    return d


def fit(docs: DataFrame, limit: int = 400, n: int = 6000, min_chars: int = 20, text_col: str = "text") -> Detector:
    """Identifiers are made of the words of at most `limit` documents (a documented bound) without any pattern's match."""
    own = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where(F.col("text") != "")  # for training only
    # hashes first, so that no task but the last gets texts of more than `limit` documents; copies count once
    first = own.select("h").distinct().orderBy("h").limit(limit)
    plain = own.join(F.broadcast(first), "h").groupBy("h").agg(F.first("text").alias("text"))
    plain = plain.where(~F.col("text").rlike(MAY_ASSIGN) & ~F.col("text").rlike(MAY_HEX) & ~F.col("text").contains("AKIA"))
    words = plain.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,20}"), F.lit(0)))).alias("w")).distinct().orderBy("w")
    return trained(samples([r.w for r in words.collect()], n), min_chars)


def base_spans(text: str, assign: bool = True, access: bool = True, hexa: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping for each kind; failing ones dropped."""
    out = []
    if assign:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexa:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


class Scanner:
    def __init__(self, detector: Detector):
        self.detector = detector
        n = detector.min_chars
        self.candidate = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{n},}}={{0,2}}")
        self.may = rf"[A-Za-z0-9+/_-]{{{n}}}"

    def scan(self, texts: pa.Array) -> tuple[list[list], list[list]]:
        """(base spans, all spans) of each text without nulls."""
        flags = [pc.match_substring_regex(texts, MAY_ASSIGN), pc.match_substring(texts, "AKIA"), pc.match_substring_regex(texts, MAY_HEX), pc.match_substring_regex(texts, self.may)]
        any_of = pc.or_(pc.or_(flags[0], flags[1]), pc.or_(flags[2], flags[3]))
        base: list[list] = [[]] * len(texts)
        full = list(base)
        rows = np.flatnonzero(any_of.to_numpy(zero_copy_only=False))
        at = [f.to_numpy(zero_copy_only=False) for f in flags]
        for i, text in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist(), strict=True):
            base[i] = base_spans(text, at[0][i], at[1][i], at[2][i])
            full[i] = sorted(base[i] + self._more(text, base[i])) if at[3][i] else base[i]
        return base, full

    def _more(self, text: str, spans: list) -> list[tuple[int, int, int]]:
        d, out = self.detector, []
        for m in self.candidate.finditer(text):
            if not any(a < m.end() and m.start() < b for a, _, b in spans) and d.ratio(m[0]) > d.threshold:
                out.append((m.start(), 3, m.end()))
        return out


FIELDS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def found(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts by kind, a digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(detector)
        for batch in batches:
            for part in common.pieces(batch):
                base, full = scanner.scan(common.as_array(part.column(1)))
                count = lambda k: pa.array([sum(s[1] == k for s in x) for x in full], pa.int64())
                digest = [hashlib.sha256(spelled(x).encode()).hexdigest() for x in base]
                yield pa.RecordBatch.from_arrays([part.column(0), count(0), count(1), count(2), pa.array(digest), pa.array([spelled(x) for x in full]), count(3)], [f.split()[0] for f in FIELDS.split(", ")])

    return common.id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, FIELDS)


def redacted(docs: DataFrame, detector: Detector, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows, all columns, with every span's text replaced by the mark; overlapping spans become one. Null stays null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(detector)
        for batch in batches:
            col = common.as_array(batch.column(at))
            _, full = scanner.scan(col.fill_null(""))
            if rows := [i for i, x in enumerate(full) if x]:
                new = []
                for i, text in zip(rows, col.take(pa.array(rows)).to_pylist(), strict=True):
                    parts, to = [], 0
                    for a, _, b in full[i]:
                        if a >= to:
                            parts += [text[to:a], mark]
                        to = max(to, b)
                    new.append("".join([*parts, text[to:]]))
                hit = np.zeros(len(col), bool)
                hit[rows] = True
                col = pc.replace_with_mask(col, pa.array(hit), pa.array(new, col.type))
            yield pa.RecordBatch.from_arrays([col if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)
