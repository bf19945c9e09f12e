"""Exact token counts at every prefix of a text, by prefix dynamic programming over a word BPE.

A word BPE ends every pre-token with a marker, so the count of a prefix is the count of its whole
pre-tokens plus that of the broken one. Inside a pre-token, the encoding of a prefix ends with the one
vocabulary entry t for which BPE keeps (last entry before t, t) apart; as BPE encodings are exactly the
sequences whose neighbours are all kept apart, one table over prefixes gives every count in linear time.

White space separates pre-tokens and normalisation never crosses it, so each different word is worked out once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import Layout, WordTable

#: The tokenizer's white space (Unicode White_Space); fixed values.
SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")
#: The tokenizer's contractions, in its order; fixed values.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: A worker's memos are emptied at this many entries, and hold no longer prefixes than this.
MEMO_ENTRIES, MEMO_CHARS = 250_000, 64
#: What the bytes of a character add before its last one.
ZEROS = [[0] * k for k in range(4)]
#: Most entries are no longer than this.
USUAL = 8
#: No rank.
NEVER = 1 << 60


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PrefixCounter:
    """Token counts of prefixes, for a tokenizers file with NFC, lower case, words and an end-of-word BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("prefix counts need an end-of-word BPE over NFC, lower-case words")
        self.end = model["end_of_word_suffix"]
        self.vocab = frozenset(model["vocab"])
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.ending = frozenset(t[: -len(self.end)] for t in self.vocab if t.endswith(self.end))
        self.longest = max(map(len, self.vocab))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.symbols = byte_symbols()
        self.unknown: dict[str, str] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.states: dict[str, tuple[str, int, int]] = {}
        self.words = WordTable(np.dtype(np.int8), self.steps)

    def split(self, token: str) -> tuple[str, str, int] | None:
        """The last merge that makes a token out of its symbols, and its rank; none for a single symbol."""
        body, end = (token[: -len(self.end)], self.end) if token.endswith(self.end) else (token, "")
        parts = [*body]
        parts[-1] += end
        last = None
        while len(parts) > 1:
            rank, i = min((self.ranks.get(pair, NEVER), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                return None
            last = parts[i], parts[i + 1], rank
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at a token's right (1) or left (0) edge while BPE builds it, each with the rank that ends it."""
        if (known := self.spines.get((token, side))) is None:
            made = self.split(token)
            known = [(token, NEVER)]
            if made:
                inner = self.spine(made[side], side)
                known += [(made[side], made[2]), *inner[1:]]
            self.spines[token, side] = known
        return known

    def kept_apart(self, left: str, right: str) -> bool:
        """Whether BPE of both together ends as these two: no merge across the border comes before those inside."""
        if (known := self.apart.get((left, right))) is None:
            ranks = self.ranks
            known = not any((r := ranks.get((u, v))) is not None and r < u_end and r <= v_end for u, u_end in self.spine(left, 1) for v, v_end in self.spine(right, 0))
            if len(self.apart) > 2 * MEMO_ENTRIES:
                self.apart.clear()
            self.apart[left, right] = known
        return known

    def run(self, text: str) -> list[int]:
        """For each prefix of a pre-token (in characters, from 1) its count, with the end mark after it.

        States (last entry, count, count with the end mark) are kept by prefix: words share their beginnings.
        """
        simple = text.isascii() and text.isprintable()
        word = text if simple else "".join(map(self.symbols.__getitem__, text.encode()))
        states, vocab, ending, apart, end = self.states, self.vocab, self.ending, self.kept_apart, self.end
        n = len(word)
        k = min(n, MEMO_CHARS)
        while k and word[:k] not in states:
            k -= 1
        row = [("", 0, 0), *[states[word[:j]] for j in range(1, k + 1)]]
        for i in range(k + 1, n + 1):
            last = count = total = None
            for j in range(max(0, i - USUAL), i) if i <= USUAL else (*range(i - USUAL, i), *range(max(0, i - self.longest), i - USUAL)):
                t = word[j:i]
                if last is None and t in vocab and (not j or apart(row[j][0], t)):
                    last, count = t, row[j][1] + 1
                    if total is not None:
                        break
                if total is None and t in ending and (not j or apart(row[j][0], t + end)):
                    total = row[j][1] + 1
                    if last is not None:
                        break
            row.append((last, count, total))
            if i <= MEMO_CHARS:
                states[word[:i]] = row[-1]
        if len(states) > 2 * MEMO_ENTRIES:
            states.clear()
        if simple:
            return [x[2] for x in row[1:]]
        return [row[i][2] for i in accumulate(len(c.encode()) for c in text)]

    def kind(self, c: str) -> str:
        """L, N or another letter: the tokenizer's class, also of characters that this Python doesn't know yet."""
        kind = unicodedata.category(c)
        if kind == "Cn":
            if c not in self.unknown:
                from tokenizers import Regex, pre_tokenizers

                self.unknown[c] = next((k for k in "LN" if pre_tokenizers.Split(Regex(rf"\p{{{k}}}"), "removed", invert=True).pre_tokenize_str(c)), "C")
            return self.unknown[c]
        return kind[0]

    def plain(self, text: str) -> list[int]:
        """Counts at every prefix of normalised text without special strings."""
        out, i, total, n = [], 0, 0, len(text)
        while i < n:
            c = text[i]
            if c in SPACE:
                out.append(total)
                i += 1
                continue
            if c == "'" and (hit := next((x for x in CONTRACTIONS if text.startswith(x, i)), None)):
                counts, j = [1, self.run(hit)[-1]] if len(hit) == 2 else [1, 2, self.run(hit)[-1]], i + len(hit)
            else:
                kind, j = self.kind(c), i + 1
                if kind == "L":
                    while j < n and self.kind(text[j]) == "L":
                        j += 1
                elif kind != "N":
                    while j < n and text[j] not in SPACE and self.kind(text[j]) not in "LN":
                        j += 1
                counts = self.run(text[i:j])
            out += [total + x for x in counts]
            total += counts[-1]
            i = j
        return out

    def normalised(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and its length after each character; inside a composed cluster, before it."""
        if text.isascii():
            return text.lower(), [*range(1, len(text) + 1)]
        if unicodedata.is_normalized("NFC", text):
            low = [c.lower() for c in text]
            return "".join(low), [*accumulate(map(len, low))]
        low, sizes, i = [], [], 0
        while i < len(text):
            j = i + 1  # a cluster: up to the next character that nothing before it changes
            while j < len(text) and (unicodedata.combining(text[j]) or self.joins(text[i:j], text[j])):
                j += 1
            low.append("".join(c.lower() for c in unicodedata.normalize("NFC", text[i:j])))
            sizes += [0] * (j - i - 1) + [len(low[-1])]
            i = j
        return "".join(low), [*accumulate(sizes)]

    @staticmethod
    def joins(cluster: str, c: str) -> bool:
        """Whether c changes in composition with the end of a cluster."""
        end = unicodedata.normalize("NFC", cluster)[-1]
        return unicodedata.normalize("NFC", end + c) != end + unicodedata.normalize("NFC", c)

    def segment(self, text: str) -> list[int]:
        norm, at = self.normalised(text)
        counts = [0, *self.plain(norm)]
        return [counts[k] for k in at]

    def prefixes(self, text: str) -> list[int]:
        """Counts at every prefix of any text; a special string counts one once it is whole."""
        out, base = [], 0
        while True:
            hits = [(at, -len(s), s) for s in self.special if (at := text.find(s)) >= 0]
            if not hits:
                return out + [base + x for x in self.segment(text)]
            at, _, s = min(hits)
            counts = self.segment(text[: at + len(s) - 1])
            out += [base + x for x in counts]
            base += (counts[at - 1] if at else 0) + 1
            out.append(base)
            text = text[at + len(s) :]

    def steps(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How much each character of each word adds, as int8 at its last byte (a character adds few tokens, or takes few away)."""
        out, sizes = [], []
        for word in words:
            if word.isascii():
                counts = self.run(word) if word.isalpha() and word.islower() else self.prefixes(word)
                out += [b - a for a, b in zip([0, *counts], counts, strict=False)]
                sizes.append(len(word))
                continue
            last, start = 0, len(out)
            for c, n in zip(word, self.prefixes(word), strict=True):
                out += ZEROS[len(c.encode()) - 1]
                out.append(n - last)
                last = n
            sizes.append(len(out) - start)
        return np.array(out, np.int8), np.array(sizes, np.int64)

    def tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, starts, sizes): counts[start + k] is the tokens of the first k characters of a text, which has `size` of them."""
        layout = Layout(texts)
        added = np.zeros(len(layout.bytes), np.int8)
        added[~layout.gap] = self.words.of(layout)[0]
        total = np.cumsum(added, dtype=np.int64)
        last = np.ones(len(total), bool)  # of each character its last byte; the space after a text stands for its beginning
        last[:-1] = (layout.bytes[1:] & 0xC0) != 0x80
        counts = np.concatenate([[0], total[last]])
        stops = np.cumsum(last)[layout.stops]
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        sizes = stops - starts - 1
        return counts - np.repeat(counts[starts], np.diff(np.append(starts, len(counts)))), starts, sizes

    def table(self, text: str) -> np.ndarray:
        """table[k]: the tokens of the first k characters."""
        counts, _, sizes = self.tables([text])
        return counts[: sizes[0] + 1]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """The most characters that fit the budget; counts may fall as a prefix grows, so the last that fits counts."""
    return int(np.flatnonzero(table <= budget)[-1])


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, counts array<int>): counts[k] is the exact token count of the first k characters, k from 0.

    Null and empty texts give [0]. Rows are independent: repeated ids and texts give a row each, an empty table none.
    """
    path = tokenizer or default_tokenizer()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches):
            counts, starts, sizes = count.tables([t or "" for t in batch.column(1).to_pylist()])
            values = pa.ListArray.from_arrays(pa.array(np.append(starts, starts[-1] + sizes[-1] + 1).astype(np.int32)), pa.array(counts[: starts[-1] + sizes[-1] + 1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "counts"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(tables, f"id {kind}, counts array<int>").withColumnRenamed("id", id_col)


def token_budget(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars): answered from each text's prefix table, in the task that made it.

    n_bytes: of UTF-8. fit_chars: characters of the longest prefix with at most `budget` tokens. Nulls count as
    empty texts; rows are independent, an empty table gives none, other columns are ignored.
    """
    path = tokenizer or default_tokenizer()

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches):
            counts, starts, sizes = count.tables([t or "" for t in batch.column(1).to_pylist()])
            total, fits = counts[starts + sizes], sizes.copy()  # a text within the budget fits whole
            for i in np.flatnonzero(total > budget).tolist():
                fits[i] = longest_prefix(counts[starts[i] : starts[i] + sizes[i] + 1], budget)
            n_bytes = pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(total, pa.int64()), pa.array(total > budget), pa.array(fits, pa.int64())], names=["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(answers, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long").withColumnRenamed("id", id_col)



def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_budget(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2048).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
