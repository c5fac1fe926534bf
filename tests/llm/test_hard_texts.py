"""Long, nested and broken texts end soon, and what recurs in pages or belongs together in a scope does not depend on size."""

import time

import pytest

from gridloom.llm import page_text, secret_scan
from tests.llm.fixtures import documents

SECONDS = 6  # a megabyte takes about a second; what was quadratic took minutes


@pytest.mark.parametrize("html", [
    "<a" * 500_000, "<a " * 330_000, 'x <a "<b ' * 100_000, "<a \"<b '>" * 100_000, "if i<n do " * 100_000, "<!" * 500_000, "<!--" * 250_000,
    "<script></script " * 60_000, "<div>x" * 50_000, "<div>x" * 50_000 + "</span></section>" * 50_000,
    "<b hidden><div>" + "<i hidden>" * 50_000 + "</b>" * 100_000, "<p>x" * 150_000, "<div " + 'a="b ' * 160_000 + ">",
])
def test_broken_pages_end_soon(html):
    start = time.perf_counter()
    page_text.parse(html)
    assert time.perf_counter() - start < SECONDS


@pytest.mark.parametrize("body", ["a" * 1_000_000 + "://", "ab1://x y " * 100_000, "token: abcdefabcdef1234 user=bob1 " * 100_000, "user" + " " * 1_000_000])
def test_long_texts_with_secrets_end_soon(body):
    start = time.perf_counter()
    secret_scan.weak_spans(body, secret_scan.sure_spans(body))
    assert time.perf_counter() - start < SECONDS


def test_odd_pages(spark):
    rows = [(1, "http://a.example/1", "<p>a" * 2000), (2, None, "<"), (3, "http://a.example/2", "a < b > c"), (4, "x", "<p title='it>s'>in</p> out"), (5, "x", "<p title='it>s>broken</p> out")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.main_text(frame).collect()}
    assert got[1] == "\n".join("a" * 2000) and got[2] == "<" and got[3] == "a < b > c" and got[4] == "in\nout" and got[5] == "s>broken\nout"
    assert page_text.main_text(frame.limit(0)).collect() == []


def test_more_pages_of_a_host_never_bring_furniture_back(spark):
    page = "<html><body><div>Menu of section {s}</div><div><p>Own text {i} of this page</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i=i, s=0 if i < 5 else i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = {r.page_id: r.text for r in page_text.main_text(frame.where("page_id < 5")).collect()}
    many = {r.page_id: r.text for r in page_text.main_text(frame).collect()}
    assert all(few[i] == many[i] == f"Own text {i} of this page" for i in range(5))


def test_parts_in_different_lines_of_a_scope_belong_together(spark):
    token = "aB3dE5fG7hJ9kL1mN0pQ"
    far = "\n".join("some plain line of words here" for _ in range(12))
    texts = [
        f"user: alice\n{far}\n{token}", f"user: alice\n{far}\n\n{token}", f"{token}\n{far}\nhttps://db.example.com/x", f"user: alice\n{far}\nuser: bob",
        f"{token} {'x ' * 150} user: alice", f"password: abcdefghijkl99\n{far}\nuser: alice", "",
    ]
    rows = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.secret_spans(documents(spark, texts))).collect()}
    assert [bool(rows[i]) for i in range(7)] == [True, False, True, False, False, True, False]
    for i, body in enumerate(texts):
        assert rows[i] == secret_scan.brute_force(body)[4]


def test_condensed_pages_lose_the_same_blocks():
    from random import Random

    r = Random(1)
    for _ in range(60):
        html = "".join(r.choice(["<div>", "</div>", "<p>", "</p>", "<ul><li>", "</ul>", "word ", "more words ", "<section class=x>", "</section>"]) for _ in range(80))
        blocks, parents, hashes = page_text.parse(html)
        known = [h for h in hashes if h is not None]
        deleted = r.sample(known, len(known) // 3)
        full = page_text.kept_text([{"text": t, "place": p} for t, p in blocks], parents, hashes, deleted)
        few = page_text.condensed(blocks, parents, hashes)
        assert page_text.kept_text([{"text": t, "place": p} for t, p in few[0]], few[1], few[2], deleted) == full
