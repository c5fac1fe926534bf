"""Personal data in texts: exact patterns, and further candidates chosen by boosted trees. Column expressions only.

High-recall generators propose spans, which may overlap. Proposals that a base pattern confirms (an address, a
number with a valid checksum, ...) are the examples a gradient-boosted classifier learns from, against proposals
that fail; its features are the format of the span and the text around it. A threshold a kind is calibrated on
held-out proposals to a target precision. Base spans stay whatever the model says; the model adds others.

Null or empty text: no spans. Repeated rows each get their own result. Other columns are ignored, whatever their
names. Where no model can be fitted (no proposals, or all alike) only base spans are returned. Places of matches
come from the gaps that ``split`` leaves between them, added up in a window over one text's matches of one kind.
Fitting reads at most ``TRAIN_ROWS`` proposals; everything else covers all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialise

KINDS = ["email", "ip", "card", "phone", "number", "email_words", "account", "net"]
N_BASE = 4
#: Proposals the trees are fitted on, at most.
TRAIN_ROWS = 20_000
PRECISION = 0.95
JOINT = "\x01"

_LOCAL = "[A-Za-z0-9._%+-]"
#: (kind, cheap condition, pattern). Lookbehind and \G keep the leftmost matches and make a run be read once.
PATTERNS = (
    ("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("card", r"[0-9](?:[ -]?[0-9]){11}", f"[0-9{JOINT}]{{12,}}"),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("number", r"[0-9(][0-9 ().\-/]{5}", r"[0-9(][0-9 ().\-/]{5,40}[0-9]"),
    ("email_words", r"[(\[ ]at[)\] ].{1,60}[(\[ ]dot[)\] ]", r"[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,60} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}"),
    ("account", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", "(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    ("net", "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"),
)
#: Words before a span that speak for personal data, in the four languages of the corpus.
CUES = "(?i)(phone|tel|call|fax|mobil|mail|contact|card|visa|account|konto|karte|anruf|carte|compte|tarjeta|cuenta|llam)"


def joined_digits(text: Column) -> Column:
    """The text with each single space or hyphen between two digits marked; places stay the same."""
    return F.regexp_replace(F.translate(text, JOINT, "\x02"), "(?<=[0-9])[ -](?=[0-9])", JOINT)


def matches(docs: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """Keys and, for each kind, its matches as (hit, gap, before, after); gap is the length of the text since the last."""
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    body = {kind: joined_digits(F.col("_t")) if kind == "card" else F.col("_t") for kind in KINDS}
    rows = rows.select(*keys, *[
        column
        for kind, cheap, pattern in PATTERNS
        for column in (
            F.when(F.col("_t").rlike(cheap), F.split(body[kind], pattern)).alias(f"_p_{kind}"),
            F.when(F.col("_t").rlike(cheap), F.regexp_extract_all(body[kind], F.lit(pattern), F.lit(0))).alias(f"_h_{kind}"),
        )
    ])

    def zipped(kind: str) -> Column:
        part = lambda i: F.get(F.col(f"_p_{kind}"), i)
        one = lambda h, i: F.struct(
            F.translate(h, JOINT, " ").alias("hit"), F.length(h).alias("len"), F.length(part(i)).alias("gap"),
            F.right(part(i), F.lit(24)).alias("before"), F.left(part(i + 1), F.lit(12)).alias("after"),
        )
        found = F.transform(f"_h_{kind}", one)
        return F.when(F.size(f"_h_{kind}") > 0, found)

    return rows.select(*keys, F.filter(
        F.array(*[F.struct(F.lit(i).alias("kind"), zipped(kind).alias("found")) for i, kind in enumerate(KINDS)]),
        lambda k: k["found"].isNotNull(),
    ).alias("matches"))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    worth = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
    values = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(worth(i).alias("v")))
    total = F.aggregate(values, F.lit(0), lambda acc, x: acc + F.when(x["v"] > 9, x["v"] - 9).otherwise(x["v"]))
    return F.coalesce(total % 10 == 0, F.lit(False))


def confirmed() -> Column:
    """Whether a match of a base kind passes its check."""
    digits, n = F.col("digits"), F.length("digits")
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
    return (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.forall(F.split("hit", "\\."), small))
        .when(F.col("kind") == 2, n.between(12, 19) & luhn(F.when(n <= 19, digits)))
        .when(F.col("kind") == 3, n.between(9, 15))
        .otherwise(False)
    )


def proposals(rows: DataFrame) -> DataFrame:
    """One row per match: row, kind, start, end, hit, before, after, digits, sure."""
    one = rows.select("_row", F.inline("matches")).select("_row", "kind", F.posexplode("found").alias("i", "f")).select("_row", "kind", "i", "f.*")
    past = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(past)
    one = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    one = one.withColumn("digits", F.regexp_replace("hit", "[^0-9]", ""))
    return one.select("_row", "kind", "start", "end", "hit", "before", "after", "digits", confirmed().alias("sure"))


FEATURES = ("f_len", "f_digits", "f_letters", "f_marks", "f_groups", "f_longest", "f_first", "f_spread", "f_cue", "f_glued", "f_kind")


def featured(found: DataFrame) -> DataFrame:
    groups = F.filter(F.split("hit", "[^0-9]+"), lambda g: g != "")
    n = F.length("digits")
    longest = F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))
    values = (
        F.length("hit"), n, F.length(F.regexp_replace("hit", "[^A-Za-z]", "")), F.length(F.regexp_replace("hit", "[A-Za-z0-9]", "")),
        F.size(groups), longest, F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)),
        F.size(F.array_distinct(F.split("digits", ""))), F.col("before").rlike(CUES).cast("int"),
        (F.col("before").rlike("[A-Za-z0-9]$").cast("int") + F.col("after").rlike("^[A-Za-z0-9]").cast("int")), F.col("kind"),
    )
    return found.select("*", *[v.cast("double").alias(name) for name, v in zip(FEATURES, values)])


def labelled(found: DataFrame) -> DataFrame:
    """Proposals of the wide generators, 1 where a confirmed span overlaps, 0 elsewhere; base ones by their own check.

    Overlaps are found in order of start within one text: the furthest end of a confirmed span before this one,
    or the nearest start of one after it.
    """
    w = Window.partitionBy("_row").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("sure"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("sure"), F.col("start"))).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    overlaps = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return found.withColumn("label", overlaps.cast("double"))


def scored(found: DataFrame, precision: float = PRECISION) -> DataFrame | None:
    """Proposals with ``score`` and the ``threshold`` of their kind; None where no model can be fitted."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(featured(found))
    held = F.pmod(F.xxhash64("hit", "before"), F.lit(4)) == 0
    train = rows.where(~held).select("vector", "label").limit(TRAIN_ROWS).persist()
    try:
        if len(train.groupBy("label").count().collect()) < 2:
            return None
        model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=6, maxDepth=3, stepSize=0.3, seed=7).fit(train)
    finally:
        train.unpersist()
    rows = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    bins = rows.where(held).groupBy("kind", F.floor(F.col("score") * 50).alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()

    def threshold(own: list) -> float | None:
        n = good = 0
        best = None
        for r in sorted(own, key=lambda r: -r["bin"]):
            n, good = n + r["n"], good + r["good"]
            if good >= precision * n:
                best = r["bin"] / 50
        return best

    pooled = threshold(bins)
    limits = {}
    for kind in range(N_BASE, len(KINDS)):
        own = [r for r in bins if r["kind"] == kind]
        limits[kind] = threshold(own) if any(r["good"] for r in own) else pooled
    cut = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, 2.0 if v is None else float(v))])
    return rows.withColumn("threshold", F.element_at(cut, F.col("kind")))


def personal_spans(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Keys, ``base`` and ``spans`` (base and added ones), arrays of (start, kind number, end) in order."""
    rows = materialise(matches(docs, keys, text).withColumn("_row", F.monotonically_increasing_id()))
    found = materialise(labelled(proposals(rows)))
    chosen = scored(found, precision)
    base = found.where("sure").select("_row", "start", "kind", "end", F.lit(True).alias("base"))
    if chosen is not None:
        # A proposal that a base span already covers in part adds nothing.
        added = chosen.where((F.col("kind") >= N_BASE) & (F.col("score") >= F.col("threshold")) & (F.col("label") == 0))
        base = base.unionByName(added.select("_row", "start", "kind", "end", F.lit(False).alias("base")))
    span = F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"))
    per_row = base.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans")
    )
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return rows.select(*keys, "_row").join(per_row, "_row", "left").select(
        *keys, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans")
    )


def written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(N_BASE)],
        F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the name of its first kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    joined = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(F.struct(
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"])).alias("out"), s["end"].alias("at"),
        )),
    )
    return reduce(lambda a, b: F.concat(a, b), [joined["out"], F.substring(text, (joined["at"] + 1).cast("int"), F.length(text))])


def brute_force(body: str | None) -> tuple[int, int, int, int, str]:
    """Base counts and digest of one text by plain regular expressions; for tests."""
    import hashlib
    import re

    body, spans = body or "", []
    spans += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", body)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", body) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", body):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", body) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    text = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(text.encode()).hexdigest())
