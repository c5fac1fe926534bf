"""Quality classifier: evidence of each document, shrunk through its site and the path inside it.

Two outcomes are judged: ``bad`` (labelled quality 0) and ``toxic``. Features of a text are its words, their
4- and 5-letter beginnings and coarse surface measures. Grouped counts over labelled texts give each feature's
log-likelihood ratio where it speaks for the outcome beyond chance; a text's evidence is the sum of its strongest
three (a sum over all would grow with the length of a text), turned into a probability on labelled texts that
were not counted. Sites (``source``) and paths (``source``, ``lang``) then get posterior
rates: labels where known and the document probability elsewhere are added up per path and site over all
documents, and each rate is shrunk to the level above it, so a sparse site stays near the global rate. A
document's odds are its own evidence times the odds of its path against the global odds.

Null or empty text: only the surface features of no words. Null source or lang: a site or path of its own.
Labels with a null id or value are left out; several labels of one id count once, the worse one. No labels, or
only one outcome: that outcome rejects nothing and its probability is null. Repeated rows each get their own
result. Other columns are ignored or passed on, whatever their names. Fitting reads at most ``MAX_LABELLED``
labelled texts and keeps at most ``MAX_FEATURES`` features an outcome; the site statistics cover every row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import flat_map_rows, free_name, map_rows
from gridloom.session import materialise

MAX_LABELLED = 12_000
MAX_FEATURES = 4_000
#: A feature must be e^2 times as likely under the outcome, with a likelihood-ratio statistic of 12 (p = 0.0005).
MIN_RATIO, MIN_STATISTIC = 2.0, 12.0
STRONGEST = 3
#: Documents that a site's or path's own rate must outweigh to move half the way from the level above.
STRENGTH = 50.0
REJECT = 0.5
OUTCOMES = ("bad", "toxic")
WORD = re.compile(r"[^\W\d_]+")
_TENTH = 10


def features(text: str | None) -> set[str]:
    body = text or ""
    tokens = body.split()
    n = len(tokens)
    found = {f"={w}" for w in set(WORD.findall(body.lower())) if len(w) <= 24}
    found |= {f"^{w[1:5]}" for w in found} | {f"^{w[1:6]}" for w in found if w[0] == "="}
    share = lambda count: min(_TENTH, math.ceil(_TENTH * count / n)) if n else 0
    found.add(f"#length {n.bit_length()}")
    found.add(f"#marks {share(sum(map(body.count, '#*$%&|<>')))}")
    found.add(f"#shouts {share(body.count('!'))}")
    found.add(f"#capitals {share(sum(t.isupper() and len(t) > 1 for t in tokens))}")
    found.add(f"#distinct {share(len(set(tokens)))}")
    found.add(f"#again {share(sum(a == b for a, b in zip(tokens, tokens[1:])))}")
    return found


@dataclass
class Model:
    """Weights of features and the calibrated log odds of evidence in unit steps, for each outcome that can be judged."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    curve: dict[str, list[float]] = field(default_factory=dict)
    rate: dict[str, float] = field(default_factory=dict)

    def evidence(self, outcome: str, found: set[str]) -> float:
        own = self.weights[outcome]
        return sum(sorted((own[f] for f in found if f in own), reverse=True)[:STRONGEST])

    def probability(self, outcome: str, found: set[str]) -> float | None:
        if outcome not in self.curve:
            return None
        logit = self.curve[outcome][step_of(self.evidence(outcome, found))]
        return 1 / (1 + math.exp(-logit))


STEPS = 61


def step_of(evidence: float) -> int:
    return min(STEPS - 1, max(0, round(evidence) + STEPS // 2))


def labels_of(labels: DataFrame) -> DataFrame:
    """(label id, bad, toxic), one row an id."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(
        F.col("doc_id").alias("_label")
    ).agg(F.max((F.col("quality") == 0).cast("int")).alias("_bad"), F.max((F.col("toxic") != 0).cast("int")).alias("_toxic"))


def curve_of(steps: dict[int, tuple[int, int]], rate: float) -> list[float]:
    """Log odds for each step of evidence: counts pooled until they rise, with two documents' worth of prior.

    Steps that no text reached take the value of the nearest step below.
    """
    pools: list[list[float]] = []
    for step in sorted(steps):
        n, hit = steps[step]
        pools.append([step, n, hit])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            _, n, hit = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += hit
    level = lambda n, hit: math.log((hit + 2 * rate) / (n - hit + 2 * (1 - rate)))
    out, at = [], level(0, 0) if not pools else level(*pools[0][1:])
    for step in range(STEPS):
        while pools and pools[0][0] <= step:
            at = level(*pools.pop(0)[1:])
        out.append(at)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Weights from three quarters of the labelled texts (by hash of the id), calibration on the rest."""
    chosen = labels_of(labels).orderBy(F.xxhash64("_label"), "_label").limit(max_labelled)
    chosen = materialise(chosen)  # a small table of known size, so the texts need not be dealt out for it
    texts = docs.select(F.col("doc_id").alias("_label"), "text").join(chosen, "_label")
    held = F.pmod(F.xxhash64("_label", F.lit(1)), F.lit(4)) == 1
    rows = flat_map_rows(
        texts.where(~held).select("text", "_bad", "_toxic"), lambda r: ((f, r[1], r[2]) for f in [*features(r[0]), ""]),
        "feature string, bad int, toxic int",
    )
    counts = rows.groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(o).alias(o) for o in OUTCOMES]).persist()
    model = Model()
    try:
        total = counts.where("feature = ''").first()
        for outcome in OUTCOMES if total else ():
            positive, negative = total[outcome], total["n"] - total[outcome]
            if not positive or not negative:
                continue
            hit, miss = F.col(outcome), F.col("n") - F.col(outcome)
            ratio = F.log((hit + 0.5) / (positive + 1)) - F.log((miss + 0.5) / (negative + 1))
            part = lambda k, share: F.when(k > 0, k * F.log(k / F.col("n") / share)).otherwise(0.0)
            statistic = 2 * (part(hit, positive / total["n"]) + part(miss, negative / total["n"]))
            best = counts.where("feature <> ''").select("feature", ratio.alias("w"), statistic.alias("g"))
            best = best.where((F.col("w") >= MIN_RATIO) & (F.col("g") >= MIN_STATISTIC)).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).collect()
            model.weights[outcome] = {r["feature"]: min(6.0, r["w"]) for r in best}
            model.rate[outcome] = positive / total["n"]
    finally:
        counts.unpersist()

    def steps(row: tuple):
        found = features(row[0])
        return ((o, step_of(model.evidence(o, found)), row[1 + OUTCOMES.index(o)]) for o in model.weights)

    scored = flat_map_rows(texts.where(held).select("text", "_bad", "_toxic"), steps, "outcome string, step int, hit int")
    table = scored.groupBy("outcome", "step").agg(F.count("*").alias("n"), F.sum("hit").alias("hit")).collect() if model.weights else []
    for outcome in model.weights:
        model.curve[outcome] = curve_of({r["step"]: (r["n"], r["hit"]) for r in table if r["outcome"] == outcome}, model.rate[outcome])
    return model


def with_probabilities(docs: DataFrame, model: Model, text: str, names: tuple[str, str]) -> DataFrame:
    """The rows with the document-level probability of each outcome."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text)

    def score(row: tuple) -> tuple:
        found = features(row[at])
        return (*row, *(model.probability(o, found) for o in OUTCOMES))

    return map_rows(docs, score, f"{schema}, {names[0]} double, {names[1]} double")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def path_rates(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(site, path, bad, toxic): posterior rates of every path, through its site and the global rate."""
    known = scored.join(labels_of(labels), F.col("doc_id") == F.col("_label"), "left")
    # Written once: scoring every text is the cost, and the sums are read by path, by site and as a whole.
    sums = materialise(known.groupBy("source", "lang").agg(F.count("*").alias("n"), *[
        F.sum(F.coalesce(F.col(f"_{o}").cast("double"), F.col(f"p_{o}"))).alias(o) for o in OUTCOMES
    ]))
    sites = sums.groupBy(F.col("source").alias("_site")).agg(F.sum("n").alias("site_n"), *[F.sum(o).alias(f"site_{o}") for o in OUTCOMES])
    whole = sums.agg(F.sum("n").alias("all_n"), *[F.sum(o).alias(f"all_{o}") for o in OUTCOMES]).first()
    rates = sums.join(sites, F.col("source").eqNullSafe(F.col("_site")))
    out = [F.col("source").alias("site"), F.col("lang").alias("path")]
    for o in OUTCOMES:
        overall = (whole[f"all_{o}"] or 0.0) / max(1, whole["all_n"] or 0)
        overall = min(1 - 1e-6, max(1e-6, overall))
        site = (F.col(f"site_{o}") + STRENGTH * overall) / (F.col("site_n") + STRENGTH)
        path = (F.col(o) + STRENGTH * site) / (F.col("n") + STRENGTH)
        out.append((logit(path) - math.log(overall / (1 - overall))).alias(f"shift_{o}"))
    return rates.select(*out)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, Callable[[str], str]]:
    """The documents with p_bad, p_toxic (posteriors) and kept, and the names these columns have."""
    model = fit(docs, labels, max_labelled)
    narrow = with_probabilities(docs.select("doc_id", "source", "lang", text), model, text, ("p_bad", "p_toxic")).drop(text)
    rates = materialise(path_rates(narrow, labels))  # likewise
    own: list[str] = []
    for stem in ("p_bad", "p_toxic", "kept", "site", "path", "shift_bad", "shift_toxic"):
        own.append(free_name(docs, f"_{stem}"))
    name = dict(zip(("p_bad", "p_toxic", "kept", "site", "path", "shift_bad", "shift_toxic"), own)).__getitem__
    rates = rates.select(*[F.col(c).alias(name(c)) for c in rates.columns])
    rows = with_probabilities(docs, model, text, (name("p_bad"), name("p_toxic")))
    rows = rows.join(rates, docs_key(rows, "source", name("site")) & docs_key(rows, "lang", name("path")), "left")
    for o in OUTCOMES:
        p = F.col(name(f"p_{o}"))
        p = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9)))
        posterior = 1 / (1 + F.exp(-(logit(p) + F.coalesce(F.col(name(f"shift_{o}")), F.lit(0.0)))))
        rows = rows.withColumn(name(f"p_{o}"), posterior)
    bad = [F.coalesce(F.col(name(f"p_{o}")) >= REJECT, F.lit(False)) for o in OUTCOMES]
    return rows.withColumn(name("kept"), ~(bad[0] | bad[1])), name


def docs_key(rows: DataFrame, column: str, other: str) -> Column:
    return rows[column].eqNullSafe(F.col(other))


def quality_posteriors(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, lang, p_bad, p_toxic and kept of every document."""
    rows, name = judged(docs.select("doc_id", "source", "lang", text), labels, text)
    return rows.select("doc_id", "source", "lang", *[F.col(name(c)).alias(c) for c in ("p_bad", "p_toxic", "kept")])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    rows, name = judged(docs, labels)
    return rows.where(name("kept")).select(*[f"`{c}`" for c in docs.columns])
