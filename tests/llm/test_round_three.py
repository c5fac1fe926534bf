"""Substring dedup, exact clusters and the conversation trie against brute force."""

from random import Random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import conversation_trie, heap_clusters, queries, substring_dedup
from tests.llm.fixtures import SF, no_documents, odd_documents


def passages(seed, n=60):
    r = Random(seed)
    words = [f"w{i}" for i in range(3000)]
    line = lambda m: [r.choice(words) for _ in range(m)]
    shared = [line(m) for m in (49, 50, 51, 60, 75, 130, 400)]
    texts = []
    for _ in range(n):
        text = line(r.choice((0, 10, 90)))
        for _ in range(r.choice((1, 2, 4))):
            cut = r.choice(shared)
            a = r.randrange(max(1, len(cut) - 60))
            text += cut[a : a + r.choice((49, 50, 55, 400))] + line(r.choice((0, 3, 40)))
        texts.append(" ".join(text))
    for _ in range(15):  # near copies of one another
        base = r.choice(texts).split()
        for _ in range(3):
            base[r.randrange(len(base))] = r.choice(words)
        texts.append("\n".join(base))
    return texts


def removed(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_words_equal_brute_force(spark, seed):
    texts = passages(seed)
    order = list(range(len(texts)))
    Random(seed).shuffle(order)
    rows = [(order[i], t) for i, t in enumerate(texts)] + [(500, texts[0]), (500, texts[1]), (None, texts[2]), (3, texts[4]), (501, texts[9] + " " + texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sha": F.lit(1), "doc": F.lit(2), "p": F.lit(3)})
    wanted = substring_dedup.brute_force(rows)
    assert sum(r[2] > 0 for r in wanted) > 30
    assert removed(substring_dedup.digest(docs)) == sorted(wanted, key=str)


def test_removed_words_of_the_table_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert removed(queries.op11_substring_dedup(spark, SF)) == sorted(substring_dedup.brute_force(rows), key=str)


def test_removed_words_of_odd_texts(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(20, "a b c " * 20_000), (21, "c a b " * 300), (22, "x" * 50_000 + " y" * 60), (23, "y " * 60)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(substring_dedup.digest(more)) == sorted(substring_dedup.brute_force(rows), key=str)
    assert substring_dedup.digest(no_documents(spark)).collect() == []


def test_every_shift_has_a_common_cover_position():
    cover = set(substring_dedup.COVER.tolist())
    for i in range(substring_dedup.PERIOD):
        for j in range(substring_dedup.PERIOD):
            assert any((i + d) % substring_dedup.PERIOD in cover and (j + d) % substring_dedup.PERIOD in cover for d in range(substring_dedup.PERIOD))


def clustered(frame):
    return sorted(map(tuple, frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters_of_the_table_equal_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert clustered(queries.op12_heap_clusters(spark, SF)) == sorted(heap_clusters.brute_force(rows), key=str)


def test_clusters_with_ties_and_odd_vectors(spark):
    r = Random(3)
    rows = [(i, [r.choice((0.0, 0.25, 0.5)) for _ in range(4)]) for i in range(150)]
    rows += [(150, None), (151, []), (152, [1.0, 2.0, None, 1.0]), (153, [float("nan"), 0.0, 0.0, 0.0]), (154, [float("inf"), 0.0, 0.0, 0.0]), (155, [1.0] * 5)]
    rows += [rows[0], rows[0], (156, [-0.3, -7.7, 1e5, 3e5]), (157, [1e9, -1e9, 2e9, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "v": F.lit("x"), "cluster": F.lit(2)})
    for k, rounds in ((8, 10), (3, 1), (1, 2)):
        wanted = [(*x[:2], *(v if v < 1 << 63 else None for v in x[2:5]), x[5]) for x in heap_clusters.brute_force(rows, 4, k, rounds)]
        got = heap_clusters.digest(*heap_clusters.clusters(frame, dim=4, k=k, rounds=rounds))
        assert clustered(got) == sorted(wanted, key=str)
    few = frame.where("vec_id < 5")
    assert few.count() == heap_clusters.digest(*heap_clusters.clusters(few, dim=4)).count()
    assert heap_clusters.digest(*heap_clusters.clusters(frame.limit(0), dim=4)).collect() == []


def trie_rows(frame):
    return sorted(map(tuple, frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_of_the_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op13_conversation_trie(spark, SF)) == sorted(conversation_trie.brute_force(rows), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_of_shared_prefixes_equals_brute_force(spark, seed):
    r, rows = Random(seed), []
    for c in range(140):
        if c % 9 == 4:
            continue
        n = r.choice((1, 2, 3, 7, 30))
        rows += [(c, t, r.choice(("user", "bot")), r.choice(("yes", "no no"))) if t > 6 else (c, t, "user", f"turn {t} {r.randrange(1 + t % 3)}") for t in range(n)]
    rows += [(7, None, None, "null first"), (300, 1, "user", None), (301, 1, None, ""), (None, 1, "user", "nobody"), (-3, 1, "user", "negative")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"d": F.lit(1), "h": F.lit(2), "x1": F.lit(3)})
    assert trie_rows(conversation_trie.prefix_trie(frame, batches=((4, 2, 1), (1,), (64, 1))[seed - 1])) == sorted(conversation_trie.brute_force(rows), key=str)
    assert conversation_trie.prefix_trie(frame.limit(0)).collect() == []


def test_a_long_conversation_is_numbered_in_ranges(spark):
    rows = [(20, t, "user", f"t{t % 7}") for t in range(9000)] + [(21, t, "user", f"t{t % 7}") for t in range(9001)] + [(40, 1, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = conversation_trie.prefix_trie(frame)
    summary = got.agg(F.count("*"), F.sum("n_convs"), F.max("depth")).first()
    # The second is the first and one turn more.
    assert tuple(summary) == (9001 + 1 + 1, 9000 * 2 + 1 + 1 + 3, 9001)


def test_trie_of_repeated_turns(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (2, 1, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(conversation_trie.prefix_trie(frame)) == sorted(conversation_trie.brute_force(rows), key=str)
