"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and the acceptor.

The vocabulary is dealt by what an edit leaves alone: of two words one edit apart, either the first half is the same
or what follows the first half of the shorter. Each such half is a state that the composition starts from, and its
words are a partition of their own; a partition of too many words goes on to halves of the rest, until one letter is
left. In a partition the remainders of its words make a minimised acyclic acceptor. The composed machine's states are
pairs of its states, before the edit or after it; each pair's accepted remainders are worked out once and shared by all
paths that lead to it, as ranks: a remainder is known by how many remainders of its state come before it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, slices, written

#: Maximal runs of these are words.
LETTERS = "A-Za-zÀ-ÿ"
RUN, OTHER = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
#: Characters of a text read at once, and different words whose counts a task holds.
WINDOW, TALLY = 1 << 20, 1 << 17
#: A partition of more words goes on to halves of what is left of them.
PARTITION_WORDS = 1 << 14


class Acceptor:
    """A minimised acyclic acceptor of sorted words; several word lists share states.

    arcs: of each state (letter, next state, how many of the state's words come before those of this arc). count: words of a state.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.arcs: list[tuple[tuple[str, int, int], ...]] = []
        self.final: list[bool] = []
        self.count: list[int] = []

    def state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        if (at := self.known.get(key)) is None:
            at = self.known[key] = len(self.arcs)
            own, before = [], int(final)
            for letter, to in arcs:
                own.append((letter, to, before))
                before += self.count[to]
            self.arcs.append(tuple(own))
            self.final.append(final)
            self.count.append(before)
        return at

    def add(self, words: list[str]) -> int:
        """The state that accepts just these words, which are sorted and different."""
        path: list[tuple[str, bool, list[tuple[str, int]]]] = [("", False, [])]  # letter into the state, final, arcs
        last = ""
        for word in words:
            same = next((k for k, (x, y) in enumerate(zip(last, word, strict=False)) if x != y), min(len(last), len(word)))
            self.close(path, same + 1)
            path += [(letter, False, []) for letter in word[same:]]
            letter, _, arcs = path[-1]
            path[-1] = letter, True, arcs
            last = word
        self.close(path, 1)
        return self.state(path[0][1], path[0][2])

    def close(self, path: list, size: int) -> None:
        while len(path) > size:
            letter, final, arcs = path.pop()
            path[-1][2].append((letter, self.state(final, arcs)))


class Composition:
    """Pairs of words that the acceptor, one edit and the acceptor let pass, as pairs of ranks."""

    def __init__(self, acceptor: Acceptor):
        self.acceptor, self.known = acceptor, {}

    def solve(self, goal: tuple) -> list[tuple[int, int]]:
        """Works out what a goal rests on first; no recursion, as words may be long."""
        known, stack = self.known, [goal]
        while stack:
            at = stack[-1]
            if at not in known:
                parts = self.parts(at)
                missing = [p for p, _, _ in parts if p not in known]
                if missing:
                    stack += missing
                    continue
                found = self.own(at)
                for part, x, y in parts:
                    found += [(i + x, j + y) for i, j in known[part]]
                known[at] = found
            stack.pop()
        return known[goal]

    def own(self, goal: tuple) -> list[tuple[int, int]]:
        """The pair of empty remainders, where the goal accepts it: after the edit only."""
        final = self.acceptor.final
        return [(0, 0)] if goal[0] in ("same", "but") and final[goal[1]] and final[goal[2]] else []

    def parts(self, goal: tuple) -> list[tuple[tuple, int, int]]:
        """What a goal is the sum of: other goals, and the ranks that their remainders begin at.

        same p q: after the edit, both read the same. but p q letter: so, and don't begin with the letter. replace p: before
        a replacement. insert p q: before an insertion into the words of q; the inserted letter is not the next one, so of
        several places in a run of one letter it goes to the last.
        """
        kind, p = goal[:2]
        arcs = self.acceptor.arcs
        if kind == "replace":
            return [(("replace", to), x, x) for _, to, x in arcs[p]] + [(("same", a, b), x, y) for (_, a, x), (_, b, y) in itertools.combinations(arcs[p], 2)]
        q = goal[2]
        others = {letter: (to, y) for letter, to, y in arcs[q]}
        both = [(letter, a, x, *others[letter]) for letter, a, x in arcs[p] if letter in others]
        if kind == "insert":
            return [(("insert", a, b), x, y) for _, a, x, b, y in both] + [(("but", p, to, letter), 0, y) for letter, to, y in arcs[q]]
        return [(("same", a, b), x, y) for letter, a, x, b, y in both if kind == "same" or letter != goal[3]]


def one_edit_pairs(shorter: list[str], longer: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Among sorted different words of one length, and of one letter more: places of pairs within the first list that one replacement turns into each other, and of pairs across both that an insertion does."""
    acceptor = Acceptor()
    p, q = acceptor.add(shorter), acceptor.add(longer)
    composed = Composition(acceptor)
    return composed.solve(("replace", p)), composed.solve(("insert", p, q)) if longer else []


def word_counts(docs: DataFrame, least_letters: int = 6, misspelt: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each run of letters of at least so many occurs in all texts, A-Z in lower case.

    misspelt: where this number divides the CRC-32 of `<id>:<word>`, h, the word's letter at h modulo its length is left
    out first, the same one throughout a document; rows without id keep their words. Null texts have none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])
            tally.clear()
            return made

        for batch in slices(batches):
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, start = Counter(), 0
                text = (text or "").encode().lower().decode()
                while start < len(text):
                    cut = OTHER.search(text, start + WINDOW) if len(text) - start > WINDOW else None
                    stop = cut.start() if cut else len(text)
                    words.update(RUN.findall(text, start, stop))
                    start = stop
                before = zlib.crc32(f"{own}:".encode())
                for word, n in words.items():
                    if len(word) >= least_letters:
                        if misspelt and own is not None and not (h := zlib.crc32(word.encode(), before)) % misspelt:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_letters:
                                continue
                        tally[word] += n
                if len(tally) > TALLY:
                    yield out()
        if tally:
            yield out()

    src = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: What rows of a partition have in common: the length of its shorter words, where the edit lies, and what stands before and after that.
PARTITION = ["length", "low", "high", "before", "after"]


def halves(rows: DataFrame) -> DataFrame:
    """rows(word, n, length, longer, low, high, last), an edit lying between low and high of the shorter word: twice, with the edit in the later half, and in the earlier one.

    last: whether an insertion after the part's last letter counts; in an earlier half it doesn't, as the later one has it.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    later, earlier = F.struct(middle.alias("low"), "high", "last"), F.struct("low", middle.alias("high"), F.lit(False).alias("last"))
    both = rows.select("word", "n", "length", "longer", F.explode(F.array(later, earlier)).alias("part")).select("word", "n", "length", "longer", "part.*")
    return both.withColumn("before", F.expr("substring(word, 1, low)")).withColumn("after", F.expr("substring(word, high + longer + 1)"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of words(word, n), all different and of two letters at least: both directions of each pair that one inserted, deleted or replaced letter sets apart, once."""
    size = F.char_length("word")
    role = lambda length, longer: F.struct(length.cast("int").alias("length"), F.lit(longer).alias("longer"))
    rows = words.select("word", "n", F.explode(F.array(role(size, 0), role(size - 1, 1))).alias("role"))
    rows = halves(rows.select("word", "n", "role.*", F.lit(0).alias("low"), F.col("role.length").alias("high"), F.lit(True).alias("last")))
    while True:
        hot = rows.where("high - low > 1").groupBy(*PARTITION).count().where(F.col("count") > PARTITION_WORDS).drop("count")
        hot = written(hot, "hot")
        if not hot.take(1):
            break
        rows = written(rows.join(hot, PARTITION, "left_anti").unionByName(halves(rows.join(hot, PARTITION, "left_semi").drop("before", "after"))), "parts")
        drop_written(hot)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list, list] = [], [], []

        def out() -> pa.RecordBatch:
            nonlocal found
            made = pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], names=["word", "near", "near_n"])
            found = [], [], []
            return made

        def link(one: tuple[str, int], two: tuple[str, int]) -> None:
            for (word, _), (near, n) in ((one, two), (two, one)):
                for values, x in zip(found, (word, near, n), strict=True):
                    values.append(x)

        records = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, _, _, before, after), group in itertools.groupby(records, lambda r: r[:5]):
            group = [*group]
            if len(group) < 2 or group[0][6]:  # no shorter word
                continue
            rest: tuple[dict, dict] = {}, {}
            for *_, last, longer, word, n in group:
                rest[longer][word[len(before) : len(word) - len(after)]] = word, n
            shorter, longer = sorted(rest[0]), sorted(rest[1])
            replaced, inserted = one_edit_pairs(shorter, longer)
            for i, j in replaced:
                link(rest[0][shorter[i]], rest[0][shorter[j]])
            for i, j in inserted:
                if last or longer[j][:-1] != shorter[i]:
                    link(rest[0][shorter[i]], rest[1][longer[j]])
            if len(found[0]) > 1 << 15:
                yield out()
        if found[0]:
            yield out()

    dealt = rows.select(*PARTITION, "last", "longer", "word", "n").repartition(*PARTITION).sortWithinPartitions(*PARTITION, "longer", "word")
    return dealt.mapInArrow(compose, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links(word, form), which have no cycle: the last word that each one's forms lead to. Steps double in each round."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_written(now)
        now = after.drop("moved")
        if not after.where("moved").take(1):
            return now


def spelling_forms(docs: DataFrame, least_letters: int = 6, least_count: int = 5, ratio: int = 5, misspelt: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least so many letters and occurrences.

    Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case. Two are near if one inserted,
    deleted or replaced letter sets them apart. A word's form is its most frequent near word, the first in code-point
    order among equals, if that is at least `ratio` times as frequent as the word; the root is the last word that forms
    lead to, the word itself where it has none. Forms always rise in frequency, so they have no cycle. misspelt: see
    word_counts. Null and empty texts have no words, repeated rows count again, an empty table gives none, and other
    columns are ignored.
    """
    words = written(word_counts(docs, least_letters, misspelt, id_col, text_col).where(F.col("n") >= least_count), "vocabulary")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    has_form = -F.col("first.less") >= ratio * F.col("n")
    forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("first.near")).alias("form"), F.when(has_form, -F.col("first.less")).alias("form_n"))
    forms = written(forms, "forms")
    drop_written(words)
    found = roots(forms.where("form is not null"))
    return forms.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet"), misspelt=199)
