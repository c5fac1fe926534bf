"""Registered queries: against their SQL, or against brute force where SQL cannot say it."""

import re

import pytest

from gridloom.llm import decontamination, personal_data, queries, secret_scan
from tests.llm.fixtures import SF
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])[0] == ""


def test_secret_scan_equals_brute_force(spark, texts):
    for r in queries.op7_secret_scan(spark, SF).collect():
        assert tuple(r)[1:] == secret_scan.brute_force(texts[r.doc_id])


def test_personal_data_equals_brute_force(spark, texts):
    for r in queries.op10_personal_data(spark, SF).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == personal_data.brute_force(texts[r.doc_id])


def test_decontamination_equals_brute_force(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = queries.op2_decontamination(spark, SF).where("contaminated OR doc_id % 40 = 0").collect()
    assert any(r.contaminated for r in rows)
    for r in rows:
        assert tuple(r)[1:] == decontamination.brute_force(texts[r.doc_id], items)


def test_token_counts_equal_library(spark, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.MODEL))
    for r in queries.op8_token_counts(spark, SF).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 4096, len(texts[r.doc_id].encode()))


def test_page_text_is_the_article(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op9_page_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_every_query_has_its_columns(spark):
    wanted = {
        "op3_quality_model": {"doc_id", "p_bad", "p_toxic", "kept"}, "op4_mixing": {"doc_id", "source", "n_tokens", "weight", "copies", "block"},
        "op6_line_templates": {"doc_id", "n_lines", "n_dropped", "text"},
    }
    for name, columns in wanted.items():
        frame = queries.QUERIES[name](spark, SF)
        assert set(frame.columns) == columns
        assert frame.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
