"""Finding many phrases in texts: an n-gram equi-join in the JVM, and an automaton for streams of symbols."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_text, text_blocks
from ..runtime import broadcast_limit, join_small, materialize, measured, spread


def ngram_matches(texts: DataFrame, key: str, text: str, patterns: DataFrame, normalise=match_text) -> DataFrame:
    """Every occurrence, overlapping ones too, of every pattern: ``key, id, start, length``.

    ``patterns``: ``id, pattern``. Long texts are cut into overlapping blocks, so that one text is many rows. The first
    characters of every place meet those that patterns begin with, and what follows meets the patterns of each length that
    such a beginning has: two equi-joins, whatever the number of patterns. The patterns' bytes are measured: within the
    broadcast limit places stay in their blocks and only those that a pattern may begin at are cut out, at the lengths of
    that beginning, so a long pattern costs nothing elsewhere. Beyond it places are sent by classes of length (doubling),
    each as long as its class, and both joins are salted, so that frequent beginnings split. Texts and patterns are compared
    normalised.
    """
    pats = patterns.where(F.col("pattern").isNotNull()).select("id", normalise(F.col("pattern")).alias("__p")).where("__p <> ''").distinct()
    pats = materialize(pats.withColumn("length", F.length("__p")), "patterns")
    shape = pats.agg(F.min("length").alias("low"), F.max("length").alias("high")).first()
    low, high = shape["low"] or 1, shape["high"] or 1
    rows = spread(texts.where(F.col(text).isNotNull()).select(key, text)).select(key, normalise(F.col(text)).alias("__t"))
    blocks = text_blocks(rows, [key], "__t", high - 1, 64).where("own > 0")
    at = blocks.select(key, "block_start", "block", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("__i"))
    start = (F.col("block_start") + F.col("__i") - 1).alias("start")
    cut = lambda n: F.substring(F.col("block"), F.col("__i"), n)
    if measured(pats)[1] <= broadcast_limit(texts.sparkSession):
        head = min(2, low)
        begins = pats.groupBy(F.substring("__p", 1, head).alias("__g")).agg(F.collect_set("length").alias("__lengths"))
        some = at.withColumn("__g", cut(F.lit(head))).join(F.broadcast(begins), "__g").select(key, start, "block", "__i", F.explode("__lengths").alias("length"))
        some = some.where(F.length("block") >= F.col("__i") + F.col("length") - 1).select(key, "start", cut(F.col("length")).alias("__p"))
        return some.join(F.broadcast(pats), "__p").select(key, "id", "start", "length")
    found = None
    size = 1
    while size <= high:
        own = materialize(pats.where(F.col("length").between(size, 2 * size - 1)), "patterns")
        if not own.isEmpty():
            begins = own.groupBy(F.substring("__p", 1, size).alias("__g")).agg(F.collect_set("length").alias("__lengths"))
            places = at.where(F.length("block") >= F.col("__i") + size - 1).select(key, start, cut(F.lit(size)).alias("__g"), cut(F.lit(2 * size - 1)).alias("__s"))
            some = join_small(places, materialize(begins, "beginnings"), ["__g"]).select(key, "start", "__s", F.explode("__lengths").alias("__n"))
            some = some.where(F.length("__s") >= F.col("__n")).select(key, "start", F.substring(F.col("__s"), F.lit(1), F.col("__n")).alias("__p"))
            part = join_small(some, own, ["__p"]).select(key, "id", "start", "length")
            found = part if found is None else found.unionByName(part)
        size *= 2
    return found


def longest_matches(matches: DataFrame, key: str) -> DataFrame:
    """At every start, the longest match; ties by id."""
    w = Window.partitionBy(key, "start").orderBy(F.col("length").desc(), "id")
    return matches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class Automaton:
    """Phrases over any hashable symbols, with failure links; flat lists, so that it is small to send to tasks."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.fail: list[int] = [0]
        self.depth: list[int] = [0]
        self.own: list[set] = [set()]
        self.out: list[tuple] = [()]
        self.shortest: dict = {}
        self.spelt: dict = {}
        self._below: dict = {}
        self.arrays: dict = {}  # forms of the trie that others made of it, by what they need to know it by

    def add(self, path, phrase) -> None:
        if not path:
            return
        node = 0
        for symbol in path:
            following = self.next[node].get(symbol)
            if following is None:
                following = len(self.next)
                self.next[node][symbol] = following
                self.next.append({})
                self.fail.append(0)
                self.depth.append(self.depth[node] + 1)
                self.own.append(set())
                self.out.append(())
            node = following
        self.own[node].add(phrase)
        self.spelt.setdefault(phrase, []).append(tuple(path))
        self.shortest[phrase] = min(len(path), self.shortest.get(phrase, len(path)))

    def freeze(self) -> Automaton:
        """Failure links and outputs, breadth first."""
        self._below.clear()
        self.arrays.clear()
        self.out[0] = tuple(sorted(self.own[0]))
        queue = deque(self.next[0].values())
        for child in self.next[0].values():
            self.fail[child] = 0
        while queue:
            node = queue.popleft()
            self.out[node] = tuple(sorted(self.own[node] | set(self.out[self.fail[node]])))
            for symbol, child in self.next[node].items():
                self.fail[child] = self.step(self.fail[node], symbol)
                queue.append(child)
        return self

    def step(self, node: int, symbol) -> int:
        while True:
            following = self.next[node].get(symbol)
            if following is not None:
                return following
            if not node:
                return 0
            node = self.fail[node]

    def below(self, node: int, limit: int = 256) -> tuple:
        """Up to ``limit`` phrases that end at or under a node, depth first in symbol order; remembered."""
        found = self._below.get((node, limit))
        if found is None:
            seen: dict = {}
            stack = [node]
            while stack and len(seen) < limit:
                at = stack.pop()
                for phrase in sorted(self.own[at]):
                    if len(seen) < limit:
                        seen.setdefault(phrase)
                stack += [self.next[at][s] for s in sorted(self.next[at], key=str, reverse=True)]
            found = self._below[node, limit] = tuple(seen)
        return found

    def paths(self):
        stack = [(0, ())]
        while stack:
            node, path = stack.pop()
            yield from ((path, p) for p in sorted(self.own[node]))
            stack += [(child, (*path, symbol)) for symbol, child in self.next[node].items()]


def automaton_matches(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]], normalise=match_text) -> DataFrame:
    """``ngram_matches`` by an automaton over characters, sent to every task: for patterns of many lengths.

    ``patterns``: distinct ``(id, normalised pattern)``. Every task builds the automaton once; send only catalogs that fit
    there (about 1 KB a phrase). It runs in native code where ``ahocorasick`` is installed.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    rows = spread(texts.where(F.col(text).isNotNull()).select(key, text)).select(key, normalise(F.col(text)).alias("__t"))
    shared = texts.sparkSession.sparkContext.broadcast(list(patterns))
    schema = T.StructType([rows.schema[key], T.StructField("id", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])

    def run(batches):
        find = character_finder(shared.value)
        for batch in batches:
            which: list[int] = []
            out: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for end, phrases in find(t):
                    which += [i] * len(phrases)
                    out += [(p, end + 1 - n, n) for p, n in phrases]
                if len(out) > 200_000 or i + 1 == batch.num_rows and out:
                    ids, starts, sizes = zip(*out)
                    keys = batch.column(0).take(pa.array(which, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array(ids, pa.string()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], names=[key, "id", "start", "length"]
                    )
                    which, out = [], []

    return rows.mapInArrow(run, schema)


def character_finder(patterns: list[tuple[str, str]]):
    """A function from a text to (last place, [(id, length), ...]) of all occurrences of ``(id, pattern)``."""
    if not patterns:
        return lambda text: ()
    try:
        import ahocorasick
    except ImportError:
        a = build_automaton(patterns)

        def find(text: str):
            node = 0
            for at, symbol in enumerate(text):
                node = a.step(node, symbol)
                if a.out[node]:
                    yield at, a.out[node]

        return find
    by_pattern: dict[str, list] = {}
    for phrase, pattern in patterns:
        by_pattern.setdefault(pattern, []).append((phrase, len(pattern)))
    native = ahocorasick.Automaton()
    for pattern, phrases in by_pattern.items():
        native.add_word(pattern, phrases)
    native.make_automaton()
    return native.iter


def build_automaton(patterns: list[tuple[str, str]]) -> Automaton:
    """From ``(id, normalised pattern)``: phrases are (id, length), as an id may have several spellings."""
    a = Automaton()
    for phrase, pattern in patterns:
        a.add(tuple(pattern), (phrase, len(pattern)))
    return a.freeze()
