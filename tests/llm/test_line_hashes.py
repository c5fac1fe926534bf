"""Hashes and masks of lines in the template tree."""

from __future__ import annotations

from random import Random

import xxhash


def test_hashes_and_masks_of_lines():
    from gridloom.llm.line_templates import DEPTH, FIELD, MIN_TOKENS, line_leaves, number

    r = Random(3)
    alphabet = "ab1 \t\x0b\x1c\x85\xa0\u2003\u0665\ud800-9"
    texts = ["".join(r.choice(alphabet) for _ in range(60)) + "\n" + "a b c d e" for _ in range(300)]
    for text in [*texts, None, "", "one two three"]:
        expected = []
        for line in (text or "").split("\n"):
            tokens = [FIELD if set(t) & set("0123456789") else t for t in line.split()]
            if len(tokens) >= MIN_TOKENS:
                data = "\x00".join([str(len(tokens)), *tokens[:DEPTH]]).encode("utf-8", "surrogatepass")
                expected.append((tokens, xxhash.xxh3_64_intdigest(data)))
        found = list(line_leaves(text))
        assert [(t, leaf % (1 << 64)) for t, leaf in found] == expected
        assert all(-(1 << 63) <= leaf < 1 << 63 for _, leaf in found)
    assert number("a", "b") != number("ab")
