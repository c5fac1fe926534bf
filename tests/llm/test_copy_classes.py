"""Classes of near copies against plain Jaccard components."""

from __future__ import annotations

from random import Random

from gridloom.llm.copy_classes import SIGNATURE, copy_classes, signature
from gridloom.llm.jaccard_join import shingle_set
from gridloom.session import materialise


def plain_classes(sets: list[set]) -> dict[int, int]:
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b) and part[i] != part[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return dict(enumerate(part))


def test_classes_equal_plain_components(spark):
    r = Random(11)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 8)))
    words = lambda n: [word() for _ in range(n)]
    shared, texts = words(100), []
    for size in (8, 60, 300, 2_000):
        for copies in (1, 2, 9):
            body = words(size)
            texts.append(body)
            for k in range(copies):
                texts.append(body[: size - size // 50] + words(size // 50 + k % 2))
            # Less than half alike: a class of its own.
            texts.append(body[: size // 2] + words(size // 2))
    texts += [shared + words(60) for _ in range(12)]
    bodies = [" ".join(t) for t in texts] + ["", " \n ", "one two"]
    sets = [shingle_set(t, 5) for t in bodies]
    expected = plain_classes([set(s.tolist()) for s in sets])
    frame = spark.createDataFrame([(i, *signature(s)) for i, s in enumerate(sets)], f"whole long, {SIGNATURE}")
    found = {r["whole"]: r["class"] for r in copy_classes(materialise(frame), 80).collect()}
    assert {i: found.get(i, i) for i in expected} == expected
    assert copy_classes(materialise(frame.limit(0)), 80).count() == 0


def test_near_duplicates_keep_no_table_that_nothing_reads(spark):
    from gridloom import session
    from gridloom.llm.jaccard_join import one_of_each

    words = [" ".join(f"w{d}x{i}" for i in range(40)) for d in range(6)]
    texts = [*words, *(w + " end" for w in words), words[0], None, "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = set(session._WRITTEN)
    kept = one_of_each(docs)
    # Profiles, lists, sets, links and stars are gone before the result is written; what is left names removed rows.
    left = [spark.read.parquet(p).count() for p in session._WRITTEN if p not in before]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 13, 14]
    assert len(left) <= 4 and max(left) <= 13
