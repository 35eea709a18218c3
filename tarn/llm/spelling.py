"""Spelling variant grouping (operator 13): forward and backward minimal acyclic automata.

Words that differ by one inserted, deleted or replaced code point agree in one half:
the error lies either in the second half or in the first. So a forward automaton over
words matches a word's first half exactly and completes it with one error, a backward
automaton over reversed words does the same from the other end. Both are minimal and
number their words by perfect hashing: an edge knows how many words go before it, so
the sum along a path is a word's place in order. A pair whose words agree in the first
half is taken from the forward automaton only, so nothing is found twice.

Words are dealt to automata by the half that must match, so one automaton holds a
bounded share of all words. Where more words than that share a half, the other half is
halved in turn: one of its parts must match as well, and so on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut, document_columns, table

_RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """A minimal acyclic automaton over sorted distinct words, with word numbers.

    State ``s`` has ``edges[s]``: character -> (target, words that sort before the
    edge's in ``s``); ``final[s]`` says that a word ends there.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # open states: final, [(character, target)]; the last target is still open
        last = ""
        for word in words:
            k = 0
            while k < len(word) and k < len(last) and word[k] == last[k]:
                k += 1
            self._close(path, k, known)
            for c in word[k:]:
                path[-1][1].append([c, -1])
                path.append([False, []])
            path[-1][0] = True
            last = word
        self._close(path, 0, known)
        self.start = self._state(path[0], known)

    def _close(self, path: list[list], depth: int, known: dict[tuple, int]) -> None:
        """Replaces open states below ``depth`` by equal ones that exist already."""
        while len(path) - 1 > depth:
            state = self._state(path.pop(), known)
            path[-1][1][-1][1] = state

    def _state(self, node: list, known: dict[tuple, int]) -> int:
        key = (node[0], tuple(map(tuple, node[1])))
        found = known.get(key)
        if found is None:
            found = known[key] = len(self.edges)
            size, edges = int(node[0]), {}
            for c, target in node[1]:
                edges[c] = (target, size)
                size += self._sizes[target]
            self.edges.append(edges)
            self.final.append(node[0])
            self._sizes.append(size)
        return found

    def walk(self, text: str, state: int, number: int) -> tuple[int, int] | None:
        """State and number after ``text``; nothing where it leads nowhere."""
        edges = self.edges
        for c in text:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, exact: int, tail: int = 0) -> Iterator[int]:
        """Numbers of words one error away from ``word``, some of them more than once.

        The first ``exact`` and the last ``tail`` characters match as they are.
        """
        at = self.walk(word[:exact], self.start, 0)
        end = len(word) - tail
        for k in range(exact, end + 1):
            if at is None:
                return
            state, number = at
            rest, after = word[k:], word[k + 1 :]
            for c, (target, before) in self.edges[state].items():
                found = self.walk(rest, target, number + before)  # c inserted
                if found and self.final[found[0]]:
                    yield found[1]
                if k < end and c != word[k]:  # c for word[k]
                    found = self.walk(after, target, number + before)
                    if found and self.final[found[0]]:
                        yield found[1]
            if k < end:
                found = self.walk(after, state, number)  # word[k] deleted
                if found and self.final[found[0]]:
                    yield found[1]
                at = self.walk(word[k], state, number)


def _near(words: list[str], counts: list[int], asks: list[bool], level: list[int], part: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """Of each asking word: near words found here, the largest n among them, and its first word."""
    for key in sorted(set(zip(level, part, strict=True))):
        rows = [k for k in range(len(words)) if (level[k], part[k]) == key]
        last = 2 ** key[0] - 1
        backward = key[1] == 0  # the error is in the first part: read from the end
        turn = (lambda w: w[::-1]) if backward else (lambda w: w)
        n = {turn(words[k]): counts[k] for k in rows}
        ordered = sorted(n)
        automaton = Automaton(ordered)
        for k in rows:
            if not asks[k]:
                continue
            w = words[k]
            cuts = [i * len(w) // (last + 1) for i in (key[1], key[1] + 1)]
            exact, tail = (len(w) - cuts[1], cuts[0]) if backward else (cuts[0], len(w) - cuts[1])
            numbers = set(automaton.one_error(turn(w), exact, tail))
            near = [turn(ordered[i]) for i in numbers]
            # an error between two parts is found in both: the later part has it
            near = [v for v in near if key[1] == last or v[: cuts[1]] != w[: cuts[1]]]
            if near:
                top = max(n[turn(v)] for v in near)
                yield w, len(near), top, min(v for v in near if n[turn(v)] == top)


def _key(word: Column, length: Column, level: int, part: int) -> Column:
    """What a word of this length must share outside of a part, and where the part lies."""
    start = F.floor(length * part / 2**level).cast("int")
    tail = length - F.floor(length * (part + 1) / 2**level).cast("int")
    head = F.substring(word, F.lit(1), start)
    rest = F.when(tail > 0, F.substring(word, F.length(word) - tail + 1, tail)).otherwise("")
    return F.concat_ws("/", F.lit(f"{level}.{part}"), head, rest)


def _dealt(words: DataFrame, level: int, parts: list[int]) -> DataFrame:
    """``word, n, level, part, key, asks``: a word under its own key, and those of words one longer or shorter."""
    def under(part: int) -> Column:
        own = _key(F.col("word"), F.length("word"), level, part)
        keys = F.array_distinct(F.array(own, *[_key(F.col("word"), F.length("word") + d, level, part) for d in (-1, 1)]))
        return F.transform(keys, lambda k: F.struct(F.lit(part).alias("part"), k.alias("key"), (k == own).alias("asks")))

    made = [under(part) for part in parts]
    x = F.explode(F.concat(*made)).alias("x")
    return words.select("word", "n", F.lit(level).alias("level"), x).select("word", "n", "level", "x.part", "x.key", "x.asks")


def _balanced(words: DataFrame, most: int) -> DataFrame:
    """Words under keys of at most ``most`` words each; a larger key is cut into finer ones."""
    rows, done, level = _dealt(words, 1, [0, 1]), None, 1
    while True:
        sizes = rows.groupBy("key").count()
        large = cut(sizes.where(F.col("count") > most).select("key"), 50_000)
        if level >= 6 or large.isEmpty():  # at 64 parts of a word a part has few characters, and a key few words
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        hot = cut(rows.join(large, "key", "left_semi"))
        finer = [_refined(hot.where(F.col("part") == p), level + 1, [2 * p, 2 * p + 1]) for p in range(2**level)]
        rows, level = functools.reduce(DataFrame.unionByName, finer), level + 1


def _refined(hot: DataFrame, level: int, parts: list[int]) -> DataFrame:
    asked = hot.groupBy("word", "n").agg(F.bool_or("asks").alias("asked"))
    made = _dealt(asked.select("word", "n"), level, parts)
    # a word whose own coarse key was not large asks there already
    return made.join(asked.select("word", "asked"), "word").select("word", "n", "level", "part", "key", (F.col("asks") & F.col("asked")).alias("asks"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, shortest: int = 5) -> DataFrame:
    """``word, n``: words of the texts, after the deletions that the contract plants, by how often they occur."""
    runs = F.regexp_extract_all(F.translate(F.col("text"), _UPPER, _LOWER), F.lit(_RUN), F.lit(0))
    made = document_columns(docs, id_col, text_col).select("doc_id", F.explode(runs).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    made = made.select("run", h.alias("h"))
    place = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    word = F.when(F.col("h") % 97 == 0, shorter).otherwise(F.col("run"))
    counts = made.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


def variants(words: DataFrame, most: int = 20_000, share: int = 40_000) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of ``word, n``.

    ``word``: distinct, not null, at least five code points. ``most`` words may share a
    key and about ``share`` an automaton; neither changes a result.
    """
    words = table(words.select("word", F.col("n").cast("long").alias("n")))
    rows = _balanced(words, most)
    total = words.count()
    shards = max(1, -(-8 * total // share))
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("top", pa.int64()), ("best", pa.string())])

    def search(shard: pa.Table) -> pa.Table:
        columns = [shard.column(c).to_pylist() for c in ("word", "n", "asks", "level", "part")]
        found = list(_near(*columns))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else schema.empty_table()

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("level", "part", "key"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(search, "word string, near long, top long, best string")
    best = F.min(F.struct((-F.col("top")).alias("less"), F.col("best")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("x"))
    found = found.select("word", "n_near", F.col("x.best").alias("best"), (-F.col("x.less")).alias("top"))
    formed = F.col("top") >= 2 * F.col("n")
    joined = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("top")).alias("form_n"),
    )
    made = table(joined)
    return made.join(_roots(made.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def _roots(steps: DataFrame) -> DataFrame:
    """``word, root``: each word's last form. A form has twice the word's n, so steps are few; each round doubles them."""
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = cut(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word of all texts with its near words' number, its form and its root.

    Runs of letters of whole texts, A-Z lower-cased, one in 97 short of a code point by
    the checksum of document and run; those of five code points or more that occur
    three times or more are the words. Two are near if one code point is inserted,
    deleted or replaced. ``form`` is the near word of largest ``n``, the smallest of
    equal ones, if that is twice the word's or more; ``root`` follows forms to the last.

    Null and empty texts have no words; whole texts count, however long; repeated rows
    count again; a null id counts as an empty one; extra columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    return variants(word_counts(docs, id_col, text_col))
