"""Grouping spelling variants: near words by forward and backward minimal acyclic automata.

One edit leaves the first or the second half of a word as it is. So each word is
looked up twice: its first half is matched exactly in a forward automaton and the
rest completed with one error, and its reversed second half is matched exactly in a
backward automaton (of reversed words) and completed with one error. An automaton
holds words of one length, is minimal (states of equal endings are one) and numbers
its words: a path's number is the sum of the words that its transitions skip, which
is the word's place in the sorted list.

1. ``vocabulary`` counts words over whole texts in the JVM, combined before the shuffle.
2. Words go to partitions by the half that has to match, once for each half length
   that a word within one edit can have (four rows a word to be found, two to look
   up). Partitions hold about ``part_chars`` code points. Halves that more than
   ``hot_words`` words share are split by a hash of the word, and what looks them up
   goes to every split.
3. A task builds the automata of its partition and walks all its words through them
   at once. A pair that both directions find is kept by the forward one only.
4. Pairs are counted and the best of each word is taken, combined before the shuffle.
5. Forms are followed by pointer doubling, a written table a round.

Defined cases: null texts have no words; a null id counts as an empty text where a
change of runs asks for it; repeated rows are documents of their own; an empty table
gives an empty result; of near words with equal counts the first in code-point order
is the form. A document's long words are held beside its text while it is split.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_column, beside, lower_ascii

LETTERS = "A-Za-zÀ-ÿ"
_PAIRS = "word string, n long, near string, near_n long"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): maximal runs of letters with A-Z lower-cased, of so many code points and occurrences. change(id, run) may alter a run first, but never lengthen it."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"([{LETTERS}]{{{least_chars},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", as_column(lower_ascii(F.col("run"))).alias("run"))
    words = runs.select(as_column(change(F.col("id"), F.col("run")) if change else F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def one_letter_lost(one_in: int) -> Callable[[Column, Column], Column]:
    """A change for vocabulary: of the runs whose crc32 of "<id>:<run>" is divisible by one_in, one code point is deleted."""

    def change(key: Column, run: Column) -> Column:
        h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return change


class Automaton:
    """The minimal acyclic automaton of distinct words of one length, given as sorted rows of code points.

    States are numbered by depth. At each depth ``keys`` holds the transitions as state << 21 | code point, in order, ``to`` the states they lead to,
    ``skip`` the words that leave the state by earlier transitions, and ``first`` each state's first transition.
    """

    def __init__(self, letters: np.ndarray) -> None:
        rows, self.size = letters.shape
        opens = np.ones((rows, self.size), bool)  # the row begins a node below this depth
        opens[1:] = np.logical_or.accumulate(letters[1:] != letters[:-1], axis=1)
        self.keys, self.to, self.skip, self.first = ([None] * self.size for _ in range(4))
        state, words = np.zeros(rows, np.int64), np.ones(1, np.int64)  # of the nodes below, and the words that end through each state
        kids = np.arange(rows)
        for depth in range(self.size - 1, -1, -1):
            nodes = np.flatnonzero(opens[:, depth - 1]) if depth else np.zeros(1, np.int64)
            begin = np.searchsorted(kids, nodes)
            n_kids = np.diff(np.append(begin, len(kids)))
            letter = letters[kids, depth].astype(np.int64)
            _, code = np.unique(letter * len(words) + state, return_inverse=True)
            alike, known = np.zeros(len(nodes), np.int64), 1  # nodes with the same first transitions
            for k in range(n_kids.max()):
                more = np.flatnonzero(n_kids > k)
                _, found = np.unique(alike[more] * len(kids) + code[begin[more] + k], return_inverse=True)
                alike[more] = known + found
                known += found.max() + 1
            _, shown, merged = np.unique(alike, return_index=True, return_inverse=True)
            n_moves = n_kids[shown]
            first = np.append(0, np.cumsum(n_moves))
            moves = np.repeat(begin[shown] - first[:-1], n_moves) + np.arange(first[-1])
            self.keys[depth] = np.repeat(np.arange(len(shown)), n_moves) << 21 | letter[moves]
            self.to[depth], self.first[depth] = state[moves], first
            total = np.append(0, np.cumsum(words[state[moves]]))
            self.skip[depth] = total[:-1] - np.repeat(total[first[:-1]], n_moves)
            state, words, kids = merged, np.diff(total[first]), nodes

    def step(self, depth: int, paths: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The paths (who, state, number) that go on with the letter."""
        key = paths[1] << 21 | letter
        at = np.searchsorted(self.keys[depth], key)
        at[at == len(self.keys[depth])] = 0
        on = self.keys[depth][at] == key
        at = at[on]
        return np.stack([paths[0][on], self.to[depth][at], paths[2][on] + self.skip[depth][at]])

    def spread(self, depth: int, paths: np.ndarray, but: np.ndarray | None = None) -> np.ndarray:
        """The paths by every transition, but for the letter given for each."""
        begin = self.first[depth][paths[1]]
        n = self.first[depth][paths[1] + 1] - begin
        ends = np.cumsum(n)
        at = np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        out = np.stack([np.repeat(paths[0], n), self.to[depth][at], np.repeat(paths[2], n) + self.skip[depth][at]])
        return out if but is None else out[:, (self.keys[depth][at] & 0x1FFFFF) != np.repeat(but, n)]

    def near(self, asked: np.ndarray, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(row asked, number of a word): all words that keep the first ``exact`` letters and are one edit away, each once."""
        shift, length = self.size - asked.shape[1], asked.shape[1]
        right = np.stack([np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)])
        for depth in range(exact):
            right = self.step(depth, right, asked[right[0], depth])
        wrong = right[:, :0]
        for at in range(exact, length):
            mine = asked[right[0], at]
            if shift > 0:
                wrong = np.concatenate([wrong, self.spread(at, right, mine)], axis=1)
            wrong = self.step(at + shift, wrong, asked[wrong[0], at]) if wrong.size else wrong
            if shift == 0:
                wrong = np.concatenate([wrong, self.spread(at, right, mine)], axis=1)
            elif shift < 0:  # of equal neighbours the last is left out
                last = mine != asked[right[0], at + 1] if at + 1 < length else np.ones(len(mine), bool)
                wrong = np.concatenate([wrong, right[:, last]], axis=1)
            right = self.step(at, right, mine) if at < self.size else right[:, :0]
        if shift > 0:
            wrong = np.concatenate([wrong, self.spread(length, right)], axis=1)
        return wrong[0], wrong[2]


def _letters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)


def _look_up(table: pa.Table) -> pa.Table:
    """The pairs of one partition's words: what is asked meets the automata of what can be found."""
    groups: dict[tuple[bool, int, bool, int], list[tuple[str, int]]] = {}
    for back, exact, asks, word, n in zip(*(table[c].to_pylist() for c in ("back", "exact", "asks", "word", "n")), strict=True):
        groups.setdefault((back, exact, asks, len(word)), []).append((word[::-1] if back else word, n))
    out = []
    for (back, exact, asks, size), held in groups.items():
        if asks:
            continue
        asking = [rows for k in (size - 1, size, size + 1) if (rows := groups.get((back, exact, True, k)))]
        if not asking:
            continue
        held = sorted(held)
        found = _letters([w for w, _ in held])
        automaton = Automaton(found)
        texts, counts = pa.array([w[::-1] if back else w for w, _ in held]), np.array([n for _, n in held])
        for rows in asking:
            asked = _letters([w for w, _ in rows])
            who, number = automaton.near(asked, exact)
            if back:  # a pair with an equal first half as well is the forward automaton's
                other = (asked[who, exact:] != found[number, size - asked.shape[1] + exact :]).any(axis=1)
                who, number = who[other], number[other]
            word = pa.array([w[::-1] if back else w for w, _ in rows]).take(pa.array(who))
            out.append(pa.table([word, pa.array(np.array([n for _, n in rows])[who]), texts.take(pa.array(number)), pa.array(counts[number])], ["word", "n", "near", "near_n"]))
    return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, hot_words: int = 20_000, part_chars: int = 1 << 20) -> DataFrame:
    """(word, n, near, near_n): every two of the distinct words that are one inserted, deleted or replaced code point apart, each way. words: (word, n), a written table."""
    size = F.length("word")

    def keys(asks: bool) -> Column:
        lengths = [size] if asks else [size - 1, size, size + 1]
        def way(back: bool) -> Column:
            exact = F.array_distinct(F.array(*[F.ceil(n / 2).cast("int") if back else F.floor(n / 2).cast("int") for n in lengths]))
            return F.transform(exact, lambda k: F.struct(F.lit(back).alias("back"), k.alias("exact"), (F.right(F.col("word"), k) if back else F.left(F.col("word"), k)).alias("half")))
        return F.concat(way(False), way(True))

    scratch = Scratch(words.sparkSession, "spelling")
    parts = 1 + 6 * (words.agg(F.sum(size)).first()[0] or 0) // part_chars
    found, asked = (words.select("word", "n", F.inline(keys(asks))).withColumn("asks", F.lit(asks)) for asks in (False, True))
    key = ["back", "exact", "half"]
    hot = found.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > hot_words).select(*key, F.ceil(F.col("held") / hot_words).cast("int").alias("splits"))
    hot = beside(scratch.keep(hot, "hot"))
    splits = F.coalesce("splits", F.lit(1))
    found = found.join(hot, key, "left").withColumn("split", F.pmod(F.xxhash64("word"), splits).cast("int"))
    asked = asked.join(hot, key, "left").withColumn("split", F.explode(F.sequence(F.lit(0), splits - 1)))
    rows = found.unionByName(asked).select(F.pmod(F.xxhash64(*key, "split"), F.lit(parts)).alias("part"), "split", "back", "exact", "asks", "word", "n")
    return rows.groupBy("part", "split").applyInArrow(_look_up, _PAIRS)


def variants(words: DataFrame, times: int = 10, hot_words: int = 20_000, part_chars: int = 1 << 20) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct (word, n): the form is the most frequent near word if it is so many times as frequent, the root the last form reached."""
    scratch = Scratch(words.sparkSession, "variants")
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(words, hot_words, part_chars).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    has = -F.col("best.less") >= times * F.col("n")
    best = scratch.keep(best.select("word", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "best")
    last, k, moved = best.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0, True
    last = scratch.keep(last, "root-0")
    while moved:  # a form is so many times as frequent as its word, so chains are short
        k += 1
        on = last.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last = scratch.keep(last.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"root-{k}")
        moved, last = last.where("moved").limit(1).count() > 0, last.drop("moved")
    out = words.join(best.hint("merge"), "word", "left").join(last.hint("merge"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
