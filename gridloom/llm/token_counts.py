"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A pair-merging tokenizer cuts a text so that every two neighbouring pieces are stable: merging their
characters alone gives the same two pieces again. A prefix therefore has exactly one last piece that is
stable against the last piece of what comes before it, and ``count[i] = count[i - len(piece)] + 1``.
No piece of the vocabulary has a space mark behind another character, so a text falls into units
(space marks, then other characters) that never merge with each other, and the counts of the units add up.

Null text: no tokens and no bytes. Empty text: the same. Repeated rows each get their own result. Columns
other than the keys and the text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from gridloom.llm.common import map_rows

SPACE = "▁"
#: Units remembered by a worker. A full table is emptied; results do not depend on it.
REMEMBERED = 600_000


class PrefixCounter:
    """Prefix counts of units under one vocabulary; small tables of seen units and pairs are kept."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        self.rank = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.rank):
            raise ValueError("the vocabulary joins words across spaces")
        finder = ahocorasick.Automaton()
        for piece in self.rank:
            finder.add_word(piece, piece)
        finder.make_automaton()
        self.found = finder.iter
        self.known = {piece for piece in self.rank if len(piece) == 1}
        self.stable: dict[tuple[str, str], bool] = {}
        self.units = _Units(self)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a short string by repeated merging of the best pair, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_stable(self, left: str, right: str) -> bool:
        found = self.stable.get((left, right))
        if found is None:
            if len(self.stable) >= 4 * REMEMBERED:
                self.stable.clear()
            found = self.stable[left, right] = self.pieces(left + right) == [left, right]
        return found

    def prefix_counts(self, unit: str) -> list[int]:
        """Token count of each prefix of a unit, from the empty one to the whole."""
        if not self.known.issuperset(unit):  # a character outside the vocabulary is its bytes and joins nothing
            counts, begin = [0], 0
            for at, char in enumerate(unit):
                if char not in self.known:
                    counts += [counts[-1] + n for n in self.prefix_counts(unit[begin:at])[1:]]
                    counts.append(counts[-1] + len(char.encode("utf-8", "surrogatepass")))
                    begin = at + 1
            return counts + [counts[-1] + n for n in self.prefix_counts(unit[begin:])[1:]]
        stable, is_stable = self.stable, self.is_stable
        counts, last = [0] * (len(unit) + 1), [""] * (len(unit) + 1)
        for at, piece in self.found(unit):  # every piece that ends here, by rising end
            start = at + 1 - len(piece)
            if last[at + 1]:
                continue
            if not start:
                counts[at + 1], last[at + 1] = 1, piece
                continue
            before = last[start]
            fits = stable.get((before, piece))
            if fits if fits is not None else is_stable(before, piece):
                counts[at + 1], last[at + 1] = counts[start] + 1, piece
        return counts

    def split(self, text: str) -> list[str]:
        """Units of a text, each without its first space mark."""
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return words
        units, marks = [], 0
        for word in words[:-1]:
            if word or not units and not marks and text[:1] not in (" ", SPACE):
                units.append(SPACE * marks + word)
                marks = 0
            else:
                marks += 1
        units.append(SPACE * marks + words[-1])
        return units

    def count(self, text: str) -> int:
        return sum(map(self.units.__getitem__, self.split(text))) if text else 0

    def every_prefix(self, text: str) -> list[int]:
        """Token counts of all prefixes of a text, from the empty one to the whole."""
        counts = [0]
        for k, unit in enumerate(self.split(text) if text else ()):
            base, own = counts[-1], self.prefix_counts(SPACE + unit)
            counts.extend(base + n for n in own[1 + (k == 0) :])
        return counts

    def longest_within(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens."""
        if limit <= 0:
            return 0
        total = at = 0
        for k, unit in enumerate(self.split(text) if text else ()):
            size = self.units[unit]
            if total + size > limit:
                own = self.prefix_counts(SPACE + unit)
                fit = max((i for i, n in enumerate(own) if total + n <= limit), default=0)
                return max(0, at + fit - (k == 0))
            total, at = total + size, at + len(unit) + (k > 0)
        return len(text)


class _Units(dict):
    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.counter.prefix_counts(SPACE + unit)[-1]
        if len(unit) <= 64:
            self[unit] = n
        return n


@lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
    store_prefixes: bool = False,
) -> DataFrame:
    """Keys, n_bytes, n_tokens, fit_chars (code points of the longest prefix within ``limit``) and, on
    demand, prefix_tokens: the count at every prefix, one number per code point and one for the empty text.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_bytes long, n_tokens long, fit_chars long"

    def measure(row: tuple) -> tuple:
        *key, body = row
        body = body or ""
        own = counter(model_file)
        n_bytes = len(body.encode("utf-8", "surrogatepass"))
        if store_prefixes:
            counts = own.every_prefix(body)
            fit = len(body) if counts[-1] <= limit else max(i for i, n in enumerate(counts) if n <= limit)
            return (*key, n_bytes, counts[-1], fit, counts)
        n_tokens = own.count(body)
        return (*key, n_bytes, n_tokens, len(body) if n_tokens <= limit else own.longest_within(body, limit))

    frame = docs.select(*keys, text)
    return map_rows(frame, measure, schema + (", prefix_tokens array<int>" if store_prefixes else ""))
