"""Secrets in texts: sure patterns, and weak parts linked by an interval join.

Sure spans (``assign``, ``access``, ``hex``) stand alone. Weak parts (an account name, an opaque token, an
endpoint) are reported only where a complementary part lies in the same scope of the same text. A scope is a run of
lines without an empty line between them. Parts in different lines of a scope belong together however far apart;
in one line at most ``reach`` code points lie between the end of one and the start of the other.

Null or empty text: no spans. Repeated rows each get their own result. A weak part that overlaps a sure span
is dropped. A text of any length is scanned whole, in time that grows with its length. Parts in other lines are found
by the first and last line of each role in a scope, parts in one line by a join on (row, line, bin of ``reach``
characters) with every bin that a part covers, so one long text is many small groups. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_rows, span_text
from gridloom.session import materialise

KINDS = ["assign", "access", "hex", "account", "opaque", "endpoint"]
ROLE = {"assign": "key", "access": "name", "hex": "key", "account": "name", "opaque": "key", "endpoint": "place"}
#: Role of a weak part, and the roles one of which must be near it.
NEEDS = {"name": ("key",), "key": ("name", "place"), "place": ("key",)}

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ACCOUNT = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name|_?id)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""",
    re.I | re.A,
)
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
# The look behind lets a run of such characters be tried once, at its begin.
ENDPOINT = re.compile(r"(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s\"'<>]+)")


def bits(token: str) -> float:
    """Shannon entropy of the characters, in bits a character."""
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in map(token.count, set(token)))


def sure_spans(body: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns that need no support."""
    spans = []
    low = body.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(body) if len(m[2]) >= 12]
    if "AKIA" in body:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(body) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(body)]
    return sorted(spans)


def weak_spans(body: str, sure: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    if ":" in body or "=" in body:
        found += [(m.start(1), 3, m.end(1)) for m in ACCOUNT.finditer(body)]
    found += [
        (m.start(), 4, m.end()) for m in OPAQUE.finditer(body)
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and bits(m[0]) >= 3.5
    ]
    if "://" in body:
        found += [(m.start(1), 5, m.end()) for m in ENDPOINT.finditer(body)]
    starts, ends = [], []  # the sure spans as stretches apart from each other
    for start, _, end in sure:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    free = lambda w: (at := bisect_left(starts, w[2])) == 0 or ends[at - 1] <= w[0]
    return [w for w in sorted(found) if free(w)]


def scan(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per text: keys, ``sure`` spans, and the ``parts`` of texts that hold two roles or more."""
    kinds = dict(docs.dtypes)
    span = "array<struct<start: long, kind: int, end: long>>"
    part = "array<struct<start: long, kind: int, end: long, scope: long, line: long>>"

    def one(row: tuple) -> tuple:
        *key, body = row
        body = body or ""
        sure = sure_spans(body)
        weak = weak_spans(body, sure)
        parts = sorted(sure + weak) if weak and len({ROLE[KINDS[k]] for _, k, _ in sure + weak}) > 1 else []
        breaks = [m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", body)] if parts else []
        lines = [m.end() for m in re.finditer("\n", body)] if parts else []
        scopes = [
            {"start": s, "kind": k, "end": e, "scope": bisect_right(breaks, s), "line": bisect_right(lines, s)} for s, k, e in parts
        ]
        return (*key, [{"start": s, "kind": k, "end": e} for s, k, e in sure], scopes)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", sure {span}, parts {part}"
    return map_rows(docs.select(*keys, text), one, schema)


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts with a complementary part in another line of their scope, or in their line within ``reach``."""
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])]), F.col("kind"))
    needs = F.element_at(
        F.create_map(*[x for r, n in NEEDS.items() for x in (F.lit(r), F.array(*map(F.lit, n)))]), F.col("role")
    )
    parts = parts.withColumn("role", role)
    weak = parts.where(F.col("kind") >= 3).withColumn("needs", needs)
    lines = parts.groupBy("row", "scope", F.col("role").alias("need")).agg(F.min("line").alias("first"), F.max("line").alias("last"))
    asked = weak.select("row", "scope", "line", "start", "kind", "end", F.explode("needs").alias("need"))
    apart = asked.join(lines, ["row", "scope", "need"]).where("first <> line OR last <> line").select("row", "start", "kind", "end")

    def bins(more: int):
        place = lambda c: F.floor(F.col(c) / reach)
        return F.explode(F.sequence(place("start") - more, place("end") + more)).alias("bin")

    weak = weak.select("row", "line", "role", "start", "kind", "end", "needs", bins(0)).alias("w")
    support = parts.select("row", "line", "role", "start", "end", bins(1)).dropDuplicates().alias("s")
    near = (
        (F.col("w.row") == F.col("s.row")) & (F.col("w.line") == F.col("s.line")) & (F.col("w.bin") == F.col("s.bin"))
        & F.array_contains(F.col("w.needs"), F.col("s.role"))
        & (F.col("w.start") - F.col("s.end") <= reach) & (F.col("s.start") - F.col("w.end") <= reach)
    )
    near = weak.join(support, near, "left_semi").select("row", "start", "kind", "end")
    return near.unionByName(apart).distinct()


def secret_spans(
    docs: DataFrame, reach: int = 200, keys: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Keys, ``sure`` and ``spans`` (sure and linked weak ones), arrays of (start, kind number, end) in order."""
    rows = materialise(scan(docs, keys, text).withColumn("row", F.monotonically_increasing_id()))
    parts = rows.select("row", F.inline("parts"))
    added = linked(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    spans = F.array_sort(F.concat("sure", F.coalesce("added", F.array().cast(dict(rows.dtypes)["sure"]))))
    return rows.join(added, "row", "left").select(*keys, "sure", spans.alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts, digest and text form of the spans of each row."""
    names = F.array(*map(F.lit, KINDS))

    def written(c: str):
        one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.concat_ws(",", F.transform(c, one))

    count = lambda k: F.size(F.filter("sure", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(written("sure").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"),
    )


def brute_force(body: str | None, reach: int = 200) -> tuple[int, int, int, str, str]:
    """The digest of one text from the plain patterns and by comparing every pair of parts; for tests."""
    body = body or ""
    base = [
        (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 1, 12), (r"AKIA[A-Z0-9]+", 0, 0, 18),
        (r"[0-9a-f]+", 0, 0, 16),
    ]
    sure = sorted((m.start(), k, m.end()) for k, (p, flags, group, least) in enumerate(base) for m in re.finditer(p, body, flags) if len(m[group]) >= least)
    strong = lambda t: re.search("[0-9]", t) and re.search("[A-Za-z]", t) and bits(t) >= 3.5
    weak = [(m.start(1), 3, m.end(1)) for m in ACCOUNT.finditer(body)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_-]+", body) if len(m[0]) >= 20 and strong(m[0])]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""", body)]
    weak = [w for w in weak if not any(s < w[2] and w[0] < e for s, _, e in sure)]
    scope = lambda at: len([m for m in re.finditer(r"\n[\x20\t\r]*\n", body) if m.end() <= at])
    line = lambda at: body.count("\n", 0, at)
    role = lambda k: ROLE[KINDS[k]]

    def together(w: tuple, p: tuple) -> bool:
        close = max(p[0], w[0]) - min(p[2], w[2]) <= reach
        return role(p[1]) in NEEDS[role(w[1])] and scope(p[0]) == scope(w[0]) and (line(p[0]) != line(w[0]) or close)

    kept = [w for w in weak if any(together(w, p) for p in sure + weak)]
    text, counts = span_text(KINDS), [sum(k == n for _, k, _ in sure) for n in range(3)]
    return (*counts, hashlib.sha256(text(sure).encode()).hexdigest(), text(sure + kept))
