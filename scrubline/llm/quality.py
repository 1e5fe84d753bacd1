"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Two logistic heads (low quality, toxic) give each document's evidence from its shape, its words and their beginnings. They
are fitted on a sample of at most ``SAMPLE`` labelled documents, the ones with the smallest id hashes.
The evidence of all documents, not only the labelled ones, is then summed by host and by path (here:
source, and source with language). A host's share of bad documents is shrunk toward the global share and
a path's toward its host's, with strengths estimated from how much the groups differ beyond chance, so
sparse sites follow their priors. A document's log-odds are its evidence plus what its path adds to the
global log-odds; it is rejected from even odds on.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, small_enough, text_of, unused

#: Labelled documents that the heads are fitted on, at most.
SAMPLE = 20_000
#: Defaults of ``fit``: words kept as features are in at least so many sampled documents, with at least this chi-square, the strongest first.
LEAST_DOCS, LEAST_CHI, MOST_WORDS = 8, 60.0, 1024
PREFIXES = (4, 5, 6, 7)
#: Words counted at once in a task's memory.
COUNTED = 100_000
#: Sites broadcast to the documents, at most.
BROADCAST_SITES = 100_000
#: Bounds of each shape measure; a document has the feature of every bound it reaches.
STEPS = {
    "symbols": (0.03, 0.06, 0.09, 0.12, 0.16, 0.25, 0.4), "upper": (0.05, 0.1, 0.3, 0.6), "digits": (0.01, 0.03, 0.1, 0.3), "space": (0.05, 0.12, 0.2, 0.3),
    "bars": (0.005, 0.05, 0.15, 0.4), "stutter": (0.02, 0.1, 0.3), "same_lines": (0.05, 0.2, 0.4, 0.6, 0.8), "few_words": (0.2, 0.4, 0.6, 0.8), "odd_words": (0.02, 0.1, 0.3, 0.6),
    "word_length": (3, 4, 5, 7, 10), "log_words": (1, 2, 3, 4, 6, 8),
}
_EDGES = ".,;:!?\"'()[]{}<>|#*&%$@~^_=+-/\\`«»“”‘’"
_SYMBOLS = re.compile(r"[#*&%$@~^|<>{}=]")
_CLASS = np.array([4 if b in (9, 10, 11, 12, 13, 32) else 3 if 48 <= b < 58 else 1 if 65 <= b < 91 else 0 if 97 <= b < 123 or b > 127 else 2 for b in range(256)], np.uint8)


def words_of(text: str) -> set[str]:
    """The distinct words of a lower-cased text, without punctuation at their ends, and their beginnings of
    ``PREFIXES`` letters, marked by a hyphen."""
    words = {w.strip(_EDGES) for w in set(text.split())}
    return words.union(*([w[:k] + "-" for w in words if len(w) > k] for k in PREFIXES))


def shape_of(text: str) -> list[str]:
    """The shape features of a text."""
    counts = np.bincount(_CLASS[np.frombuffer(text.encode(), np.uint8)], minlength=5)
    size, words, lines = max(1, int(counts.sum())), text.split(), [x for x in text.split("\n") if x.strip()]
    n, kinds = max(1, len(words)), set(words)
    measures = {
        "symbols": counts[2] / size, "upper": counts[1] / size, "digits": counts[3] / size, "space": counts[4] / size,
        "bars": text.count("|") / n, "stutter": sum(map(eq, words, words[1:])) / n, "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "few_words": (1 - len(kinds) / n), "odd_words": sum(1 for w in kinds if _SYMBOLS.search(w)) / max(1, len(kinds)),
        "word_length": (counts[0] + counts[1]) / n, "log_words": np.log(n),
    }
    return [f"={name}:{k}" for name, value in measures.items() for k, step in enumerate(STEPS[name]) if value >= step]


@dataclass
class Heads:
    """Weights of the two heads by feature; shape features start with an equals sign."""

    bias: tuple[float, float] = (0.0, 0.0)
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)

    def evidence(self, text: str) -> tuple[float, float]:
        """Probabilities that a text is of low quality, and toxic."""
        low, toxic = self.bias
        known = self.weights.keys()
        for f in [*(words_of(text.lower()) & known), *(f for f in shape_of(text) if f in known)]:
            a, b = self.weights[f]
            low, toxic = low + a, toxic + b
        return tuple(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in (low, toxic))

    def badness(self, text: str) -> float:
        """The probability that a text is of low quality or toxic."""
        low, toxic = self.evidence(text)
        return 1 - (1 - low) * (1 - toxic)


def _logistic(features: list[list[int]], n: int, target: np.ndarray, rounds: int = 12, ridge: float = 0.3) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on presence features by Newton steps, each solved by conjugate gradients."""
    docs = len(features)
    rows = np.repeat(np.arange(docs), [len(f) for f in features])
    columns = np.array([c for f in features for c in f], np.int64)
    weight = np.append(np.full(n, ridge), 1e-3)  # the bias comes last
    at = lambda v: v[n] + np.bincount(rows, v[columns], minlength=docs)
    back = lambda r: np.append(np.bincount(columns, r[rows], minlength=n), r.sum())
    loss = lambda v: np.logaddexp(0, z := at(v)).sum() - (target * z).sum() + (weight * v * v).sum() / 2
    v = np.zeros(n + 1)
    now = loss(v)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at(v), -30, 30)))
        gradient, curve = back(p - target) + weight * v, p * (1 - p)
        scale = 1 / (back(curve) + weight)
        step, rest = np.zeros(n + 1), -gradient
        z = scale * rest
        way, size = z.copy(), rest @ z
        for _ in range(60):
            if size < 1e-10:
                break
            bent = back(curve * at(way)) + weight * way
            length = size / (way @ bent)
            step += length * way
            rest = rest - length * bent
            z = scale * rest
            way, size = z + (rest @ z) / size * way, rest @ z
        share = 1.0
        while share > 1e-3 and loss(v + share * step) > now:
            share /= 2
        v = v + share * step
        before, now = now, loss(v)
        if before - now < 1e-6 * abs(before):
            break
    return float(v[n]), v[:n]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def table() -> pa.RecordBatch:
        columns = [list(counts), *([c[k] for c in counts.values()] for k in range(3))]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["word", "n", "low", "toxic"])

    for batch in batches:
        for text, low, toxic in zip(batch.column("text"), batch.column("low").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in words_of(text.as_py().lower()):
                c = counts.setdefault(w, [0, 0, 0])
                c[0] += 1
                c[1] += low
                c[2] += toxic
            if len(counts) > COUNTED:
                yield table()
    yield table()


def _chi(n: Column, both: Column, docs: int, positive: int) -> Column:
    expected = n * (positive / docs)
    return F.when(F.lit(0 < positive < docs), (both - expected) ** 2 / expected / ((1 - n / docs) * (1 - positive / docs) + 1e-9)).otherwise(F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least_docs: int = LEAST_DOCS, least_chi: float = LEAST_CHI, most_words: int = MOST_WORDS) -> Heads:
    """Fit both heads on at most ``sample`` labelled documents, with the ``most_words`` words of the greatest chi-square among those
    of at least ``least_chi`` that at least ``least_docs`` sampled documents have.

    Repeated labels of a document count once (the worst of them); rows with a null id or a null label
    are not used. Without usable labels the heads are empty and no document is rejected.
    """
    bounded_batches(docs.sparkSession)
    rated = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q"), F.col("toxic").alias("t")).where("id is not null and q is not null and t is not null")
    rated = rated.groupBy("id").agg((F.min("q") == 0).cast("int").alias("low"), (F.max("t") > 0).cast("int").alias("toxic"))
    rated = rated.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(rated), "id")
    # an id that occurs many times gives one text, chosen where it is read
    texts = checkpoint(texts.groupBy("id", "low", "toxic").agg(F.min("text").alias("text")).select("text", "low", "toxic"))
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic")).first()
    if not total["n"]:
        return Heads(bias=(-5.0, -5.0))
    words = texts.mapInArrow(_counted, "word string, n long, low long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("toxic").alias("toxic"))
    strength = F.greatest(_chi(F.col("n"), F.col("low"), total["n"], total["low"]), _chi(F.col("n"), F.col("toxic"), total["n"], total["toxic"]))
    words = words.where((F.col("n") >= least_docs) & (F.col("word") != "")).withColumn("strength", strength).where(F.col("strength") >= least_chi)
    chosen = [r["word"] for r in words.orderBy(F.desc("strength"), "word").limit(most_words).collect()]
    names = [*chosen, *(f"={m}:{k}" for m, steps in STEPS.items() for k in range(len(steps)))]
    place = {f: k for k, f in enumerate(names)}

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                t = text.as_py()
                rows.append([place[f] for f in [*(words_of(t.lower()) & place.keys()), *shape_of(t)]])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column("low"), batch.column("toxic")], ["f", "low", "toxic"])

    table = texts.mapInArrow(featured, "f array<int>, low int, toxic int").toArrow()  # at most the sample
    rows = table.column("f").to_pylist()
    fitted = [_logistic(rows, len(names), np.asarray(table.column(c)).astype(float)) for c in ("low", "toxic")]
    return Heads(bias=(fitted[0][0], fitted[1][0]), weights={f: (float(fitted[0][1][k]), float(fitted[1][1][k])) for f, k in place.items()})


def badness_column(text: Column, heads: Heads) -> Column:
    """The probability that a document is bad, by its own evidence; null counts as empty."""

    @F.arrow_udf("double")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([heads.badness(t.as_py() or "") for t in texts], pa.float64())

    return udf(text)


def _strength(groups: DataFrame, n: str, bad: str, prior: Column) -> float:
    """The prior's weight in documents: large if groups differ from their prior no more than by chance."""
    rate = F.col(bad) / F.col(n)
    m = groups.agg(F.sum(n).alias("n"), F.sum(F.col(n) * (rate - prior) ** 2).alias("s"), F.sum(prior * (1 - prior)).alias("v"), F.sum(F.col(n) * prior * (1 - prior)).alias("nv"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not m["n"]:
        return 1e6
    spread = (m["s"] - m["v"]) / max(m["n"] - m["nn"] / m["n"], 1e-9)
    typical = m["nv"] / m["n"]
    return float(min(1e6, max(1.0, typical / spread - 1))) if spread > 0 else 1e6


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """From ``evidence(host, path, bad)`` of all documents: ``host``, ``path``, ``host_share``, ``path_share`` and ``shift``,
    the log-odds that the path adds to the global log-odds. Null hosts and paths are groups of their own."""
    paths = checkpoint(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").alias("bad")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_bad").alias("bad")).first()
    share = total["bad"] / total["n"] if total["n"] else 0.5
    k_host = _strength(hosts, "host_n", "host_bad", F.lit(share))
    hosts = hosts.withColumn("host_share", (F.col("host_bad") + k_host * share) / (F.col("host_n") + k_host))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "path", "n", "bad", "host_share")
    k_path = _strength(both, "n", "bad", F.col("host_share"))
    both = both.withColumn("path_share", (F.col("bad") + k_path * F.col("host_share")) / (F.col("n") + k_path))
    return both.select("host", "path", "host_share", "path_share", (_logit(F.col("path_share")) - _logit(F.lit(share))).alias("shift"))


def _posterior(rows: DataFrame, host: str, path: str, bad: str) -> tuple[DataFrame, dict[str, str]]:
    """``rows``, written, with what their site tells about them, and the names of the new columns ``host_share``, ``path_share`` and
    ``posterior``."""
    rows = checkpoint(rows)
    sites = checkpoint(site_posteriors(rows.select(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(bad).alias("bad"))))
    names = {c: unused(rows, c) for c in ("site_host", "site_path", "host_share", "path_share", "shift", "posterior")}
    named = sites.select(*(F.col(c).alias(names[n]) for c, n in (("host", "site_host"), ("path", "site_path"), ("host_share", "host_share"), ("path_share", "path_share"), ("shift", "shift"))))
    side = F.broadcast(named) if small_enough(sites.count(), BROADCAST_SITES) else named
    same = rows[host].cast("string").eqNullSafe(side[names["site_host"]]) & rows[path].cast("string").eqNullSafe(side[names["site_path"]])
    found = rows.join(side, same, "left")
    return found.withColumn(names["posterior"], 1 / (1 + F.exp(-(_logit(F.col(bad)) + F.col(names["shift"]))))), names


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Every document with its posterior and whether it is kept.

    Columns: ``doc_id``, ``evidence`` (probability of being bad by the text alone), ``host_share`` and
    ``path_share`` (shrunk shares of bad documents), ``posterior`` and ``kept`` (posterior under 0.5). Null
    and empty texts, null hosts or paths and repeated rows are scored like others; an empty table gives no
    rows; without labels all are kept.
    """
    heads = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), badness_column(text_of(text_col), heads).alias("bad"))
    found, _ = _posterior(rows, "host", "path", "bad")
    return found.select("doc_id", F.col("bad").alias("evidence"), "host_share", "path_share", "posterior", (F.col("posterior") < 0.5).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects; all columns stay. Texts are scored once and written with their
    scores, so no text is shuffled."""
    heads = fit(docs, labels, id_col, text_col)
    bad = unused(docs, "bad")
    found, names = _posterior(docs.withColumn(bad, badness_column(text_of(text_col), heads)), host_col, path_col, bad)
    return found.where(F.col(names["posterior"]) < 0.5).select(*docs.columns)
