"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.llm import (
    decontamination, jaccard_join, line_templates, mixing, page_text, personal_data, quality_model, quality_rules, secret_scan, token_counts,
)
from gridloom.llm.queries import MODEL
from tests.llm.fixtures import ODD_TEXTS, PROSE, documents, no_documents, odd_documents

N = len(ODD_TEXTS)
ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def model_file():
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def items(spark, rows=((1, "brew strong tea near the old stone bridge at dawn"), (2, "one"), (3, None), (None, "one two"), (4, ""))):
    return spark.createDataFrame([tuple(r) for r in rows], ITEMS)


def labels(spark, rows=((1, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, 0))):
    return spark.createDataFrame([tuple(r) for r in rows], LABELS)


OPERATORS = {
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "decontamination": lambda s, d: decontamination.digest(decontamination.contamination(d, items(s))),
    "model": lambda s, d: quality_model.quality_posteriors(d, labels(s)),
    "mixing": lambda s, d: mixing.mixture(d),
    "jaccard": lambda s, d: jaccard_join.near_duplicates(d, 3, 90),
    "lines": lambda s, d: line_templates.clean_lines(d)[0],
    "secrets": lambda s, d: secret_scan.digest(secret_scan.secret_spans(d)),
    "tokens": lambda s, d: token_counts.token_counts(d, model_file()),
    "personal": lambda s, d: personal_data.digest(personal_data.personal_spans(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(name, spark):
    assert OPERATORS[name](spark, odd_documents(spark)).count() == N


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, spark):
    assert OPERATORS[name](spark, no_documents(spark)).collect() == []


def test_defined_results_of_odd_texts(spark):
    docs = odd_documents(spark)
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert (rules[3].n_words, rules[4].n_words, rules[7].n_words, rules[3].kept) == (0, 0, 2, False)
    assert rules[8].n_repeat_words == rules[8].n_words == 60_000
    hit = {r.doc_id: r for r in decontamination.digest(decontamination.contamination(docs, items(spark))).collect()}
    assert (hit[1].n_hit, hit[6].n_hit, hit[7].n_items, hit[3].n_words) == (10, 1, 1, 0)
    comp = {r.doc_id: r for r in jaccard_join.near_duplicates(docs, 3, 90).collect()}
    assert (comp[2].component_id, comp[3].n_shingles, comp[3].component_id, comp[6].n_shingles, comp[8].n_shingles) == (1, 0, 3, 1, 3)
    tokens = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, model_file()).collect()}
    assert tokens[3] == tokens[4] == 0
    kept = quality_model.quality_posteriors(docs, labels(spark, ()))
    assert kept.where("kept AND p_bad IS NULL").count() == N


def test_join_path_equals_memory_path(spark):
    docs = odd_documents(spark)
    both = [
        sorted(map(str, decontamination.digest(decontamination.contamination(docs, items(spark), in_memory=m)).collect())) for m in (0, 1000)
    ]
    assert both[0] == both[1]
    texts = [f"{PROSE} {i} {j}\nall rights reserved by the firm {i}{j}\nline {'abc'[j]} of text number {i} ends {j}" for i in range(8) for j in range(3)]
    lines = [sorted(map(str, line_templates.clean_lines(documents(spark, texts), in_memory=m)[0].collect())) for m in (0, 1000)]
    assert lines[0] == lines[1]


def test_recurring_lines_go_and_copies_stay(spark):
    from random import Random

    r = Random(4)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, notice = line(60), "copyright {} by the example press all rights reserved"
    unrelated = ["\n".join([line(12), passage, line(15), notice.format(1990 + i), line(9)]) for i in range(12)]
    copied = "\n".join(line(14) for _ in range(6))
    copies = [copied] * 9 + [copied.replace(copied.split()[40], "changed")]
    rows = line_templates.drop_lines(documents(spark, [*unrelated, *copies, None])).orderBy("doc_id").collect()
    for i, row in enumerate(rows[:12]):
        assert passage not in row.text and "copyright" not in row.text and row.text.count("\n") == 2
        assert row.n_chars == len(row.text)
    assert [row.text for row in rows[12:]] == [*copies, None]


def test_prefix_counts_are_exact(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    texts = ["  two  spaces\nand lines ", "ﬁne ½ 日本語 🎉🎉 <s> <0x0A>", "▁▁ mark▁s", PROSE, ""]
    rows = token_counts.token_counts(documents(spark, texts), model_file(), limit=5, store_prefixes=True).collect()
    for row in rows:
        body = texts[row.doc_id]
        wanted = [len(library.encode(body[:i])) for i in range(len(body) + 1)]
        assert row.prefix_tokens == wanted
        assert row.fit_chars == max(i for i, n in enumerate(wanted) if n <= 5)


def test_weak_secret_parts_need_a_partner(spark):
    token = "aB3dE5fG7hJ9kL1mN0pQ"
    texts = [f"user: alice {token}", f"{token} alone", "user: alice alone", f"user: alice\n\n{token}", f"https://db.example.com/x {token}", f"user: bob {'x ' * 150}{token}"]
    rows = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.secret_spans(documents(spark, texts))).collect()}
    assert [bool(rows[i]) for i in range(6)] == [True, False, False, False, True, False]
    for i, body in enumerate(texts):
        assert rows[i] == secret_scan.brute_force(body)[4]


def test_base_patterns_and_redaction(spark):
    texts = ["a@b.c.d@e.f x a@b.com_x@y.org", "999.1.1.1.2.3.4 1.2.3.4.5.6.7.8 010.0256.1.1", "card 4532-0151-1283-0366 4532  015112830366", "+1 (2) 3 +49 30 1234567", "5" * 400, "é a@b.co é"]
    docs = documents(spark, texts)
    spans = personal_data.personal_spans(docs)
    for r in personal_data.digest(spans).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == personal_data.brute_force(texts[r.doc_id])
    clean = docs.join(spans, "doc_id").select("doc_id", personal_data.redacted(F.col("text"), F.col("base")).alias("t")).collect()
    assert {r.doc_id: r.t for r in clean}[5] == "é [EMAIL] é"


def test_page_furniture_and_templates(spark):
    page = (
        '<body class="nav-open"><header><h1>Site</h1></header><div>Join our club {host}</div><main><article><header><h1>Title {i} &amp; more</h1></header>'
        '<p>One <b>bold</b>ly<br>two&nbsp;three {i}<p>Four <span class="ad">x <b>y</b></span> five<ul><li>a<li>b</ul><script>var a="</p>";</script>'
        '<section id="comments"><p>bad</p></section></article></main><footer>f</footer>'
    )
    plain = "<html><body><div>Join our club</div><div><p>Own text {i} of this page</p></div><div>Made with care</div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i, host="a")) for i in range(4)]
    rows += [(10 + i, f"http://b.example/{i}", plain.format(i=i)) for i in range(4)] + [(20, None, None), (21, "x", ""), (21, "x", ""), (22, "http://c.example", "<p>a<div>b</div>c")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2))
    got = [(r.page_id, r.text) for r in page_text.main_text(frame).collect()]
    text = dict(got)
    assert len(got) == len(rows) and text[1] == "Title 1 & more\nOne boldly two three 1\nFour five\na\nb"
    assert text[12] == "Own text 2 of this page" and text[20] == text[21] == "" and text[22] == "a\nb\nc"
    assert page_text.main_text(frame.limit(0)).collect() == []


def jaccard_classes(texts, size, percent):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("percent", [80, 90])
def test_chains_and_families_equal_brute_force(spark, percent):
    from random import Random

    r, texts = Random(percent), []
    words = [f"w{i}" for i in range(400)]
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.choice((5, 40, 160)))]
        for _ in range(14):  # a chain: each differs a little from the one before
            base = list(base)
            base[r.randrange(len(base))] = r.choice(words)
            texts.append(" ".join(base))
    texts += ["same text of a few words"] * 5 + ["", None, "one", "one", "one two", "A b C", "a B c"]
    rows = jaccard_join.near_duplicates(documents(spark, texts), 3, percent).collect()
    assert sorted(tuple(x) for x in rows) == jaccard_classes(texts, 3, percent)


def test_one_document_of_each_class_stays(spark):
    docs = odd_documents(spark)
    kept = jaccard_join.one_of_each(docs, 3, 90)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    again = jaccard_join.one_of_each(docs.where("doc_id = 2"), 3, 90)
    assert again.count() == 1


def test_mixture_equals_plain_bisection(spark):
    texts = [("a", 40), ("b", 10), ("c", 3), (None, 2)]
    rows = [(i * 100 + k, "w " * (k % 7 + 1), s) for i, (s, n) in enumerate(texts) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit(1)).withColumn("place", F.lit(1))
    place = {r.key: r.place for r in mixing.placed(docs, "doc_id", "source", "text", 11).collect()}
    total, per = 0, {}
    for d, t, s in rows:
        per[s] = per.get(s, 0) + len(t.split())
        total += len(t.split())
    for kw in ({}, {"budget": total * 0.7, "max_epochs": 2.0}, {"max_epochs": 1.5}, {"budget": total * 2.0, "entropy": 0.9}):
        limit, budget, entropy = kw.get("max_epochs", 4.0), kw.get("budget"), kw.get("entropy")
        share = {s: n / total for s, n in per.items()}

        def good(a):
            z = sum(p**a for p in share.values())
            h = math.log(z) - a * sum(p**a * math.log(p) for p in share.values()) / z
            r = [p ** (a - 1) for p in share.values()]
            return (max(r) / min(r) if budget is None else budget / total * max(r) / z) <= limit * (1 + 1e-12) and (entropy is None or h <= entropy)

        low, high = 0.0, 0.0 if good(0.0) else 1.0
        for _ in range(24 if high else 0):
            mid = (low + high) / 2
            low, high = (low, mid) if good(mid) else (mid, high)
        z = sum(p**high for p in share.values())
        whole = budget or total * z / min(p ** (high - 1) for p in share.values())
        wanted = {}
        for s in per:
            epochs = share[s] ** high / z * whole / per[s]
            epochs = round(epochs) if abs(epochs - round(epochs)) < 1e-9 else epochs
            rest, used, full = math.floor((epochs % 1) * per[s]), 0, math.floor(epochs)
            for d, t, _ in sorted((x for x in rows if x[2] == s), key=lambda x: place[x[0]]):
                used += len(t.split())
                wanted[d] = full + (used <= rest)
        assert {r.doc_id: r.copies for r in mixing.mixture(docs, **kw).collect()} == wanted


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = known.where("doc_id % 4 <> 1")
    rows = quality_model.quality_posteriors(docs, seen).join(known.where("doc_id % 4 = 1"), "doc_id").collect()
    poor = [r for r in rows if r.quality == 0 or r.toxic == 1]
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(not r.kept for r in poor) >= 0.95 * len(poor)
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_sparse_sites_stay_near_the_global_rate(spark):
    rows = [(i, "x", "big" if i < 400 else f"s{i}", "en", 0.5 if i < 400 else 0.9, 0.0) for i in range(402)]
    scored = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p_bad double, p_toxic double")
    shift = {r.site: r.shift_bad for r in quality_model.path_rates(scored, labels(spark, ())).collect()}
    assert 0 < shift["s400"] < 0.2 and abs(shift["big"]) < 0.05


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.where("copies < 1").count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def random_lines(seed):
    from random import Random

    r = Random(seed)
    word = lambda: "".join(r.choice("bcdfgaeiou") for _ in range(r.randint(4, 9)))
    return lambda n: " ".join(word() for _ in range(n))


def test_a_header_of_several_lines_goes_in_every_document(spark):
    line = random_lines(5)
    header = [line(8) for _ in range(4)]
    texts = ["\n".join([*header, *(line(14) for _ in range(5))]) for _ in range(12)]
    family = [line(14) for _ in range(8)]
    near = ["\n".join([*family[:7], " ".join([*family[7].split()[:13], line(1)])]) for _ in range(12)]
    rows = {r.doc_id: r.text for r in line_templates.drop_lines(documents(spark, texts + near)).collect()}
    assert [rows[i] for i in range(12)] == [t.split("\n", 4)[4] for t in texts]
    assert [rows[12 + i] for i in range(12)] == near


def test_a_group_of_near_copies_keeps_no_template(spark):
    line = random_lines(6)
    notice = line(9)
    unrelated = ["\n".join([line(15), notice, line(15)]) for _ in range(6)]
    family = [line(14) for _ in range(8)]
    copies = ["\n".join([*family[:4], notice, *family[4:7], " ".join([*family[7].split()[:13], line(1)])]) for _ in range(30)]
    rows = line_templates.drop_lines(documents(spark, unrelated + copies)).collect()
    assert not any(notice in r.text for r in rows)
    assert all(r.text.count("\n") == (1 if r.doc_id < 6 else 7) for r in rows)


def test_a_crowded_leaf_loses_no_template(spark):
    line = random_lines(7)
    head = line(3)
    exact = [f"{head} {line(6)}" for _ in range(6)]
    varied = [f"{head} {line(4)} {{}} {line(1)}" for _ in range(6)]
    texts = ["\n".join([line(20), exact[i % 6], line(20), varied[i % 6].format(line(1)), line(20)]) for i in range(72)]
    rows = line_templates.drop_lines(documents(spark, texts)).collect()
    assert all(head not in r.text and r.text.count("\n") == 2 for r in rows)


def test_a_long_secret_part_reaches_from_its_end(spark):
    key = "aB3dE5fG7hJ9kL1mN0pQ" * 40
    texts = [f"{key} https://db.example.com/x", f"{key}{' x' * 120} https://db.example.com/x"]
    rows = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.secret_spans(documents(spark, texts))).collect()}
    assert rows[0] == "opaque:0:800,endpoint:801:825" and rows[1] == ""
