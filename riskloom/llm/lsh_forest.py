"""Near-duplicates by Jaccard similarity of word n-grams: banded MinHash LSH, then verification.

Documents with the same set of n-grams are one class; everything below works on classes, so exact
copies cost one row each. This is not an LSH forest: no sorted trees or tries are built and no
prefix is shortened by what the data match. One depth is computed once, by formula: the longest of
at most ``deepest`` with which a pair at the threshold shares the prefix of some of ``trees`` bands
with a probability of at least ``recall``. Every class has one hash of ``depth`` minima for each
band; classes that share one are candidates, by an equi-join.

Candidates of a prefix that few classes share become pairs. Where more than ``CROWD`` classes
share one, no pairs are made: those classes are joined into candidate components, each
component is dealt into blocks (by documents and by n-grams), and two blocks at a time are compared inside a task by matrix
products, which returns counts and a spanning forest. Work there grows with the square of a
component of different, mutually similar texts (all its links are counted), in tasks of bounded
size. Similarities are exact: intersections of whole n-gram sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bloom_dedup import possible_members
from riskloom.llm.components import components
from riskloom.llm.frames import join_groups, located, packed, place, small_batches, text_or_empty, unpacked
from riskloom.session import settle

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEEPEST = 8
RECALL = 0.9999
CROWD = 16
BLOCK = 256
BLOCK_NGRAMS = 200_000
COLUMNS = 16384
RESULTS = ("class_id", "copy_id", "n_copies", "n_links", "kept")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 2**18:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = _Words()


def ngrams(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word n-grams in order; a shorter text is one n-gram of all its words;
    a text without a word has none. Words are lower-cased and split at white space."""
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = min(words, len(found))
    mixed = np.full(len(found) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _PRIME + each[i : len(found) - n + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _PRIME
    return mixed ^ (mixed >> np.uint64(32))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct n-grams, sorted."""
    return np.unique(ngrams(text, words))


def prefix_depth(trees: int, deepest: int, threshold: float, recall: float) -> int:
    """The longest prefix with which a pair at the threshold is found with the wanted recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@lru_cache(maxsize=8)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20011)
    return random.integers(0, 2**32, (count, 1), dtype=np.uint32), random.integers(0, 2**31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def prefixes(hashes: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The prefix of each tree (a band), as one 64-bit hash of its ``depth`` minima."""
    flips, factors = _functions(trees * depth)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    minima = np.full(trees * depth, 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(low), 512):
        mixed = (low[None, start : start + 512] ^ flips) * factors
        mixed ^= mixed >> np.uint32(15)
        minima = np.minimum(minima, (mixed * np.uint32(0x2C1B3C6D)).min(axis=1))
    path = np.zeros(trees, dtype=np.uint64)
    for level in minima.reshape(trees, depth).T.astype(np.uint64):
        path = (path ^ (path >> np.uint64(31))) * _PRIME + level + np.uint64(1)
    return path ^ (path >> np.uint64(32))


def block_links(sets: list[np.ndarray], side: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each set to sets of another side (side -1: any other), their weight, and the
    smallest index reached through links."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    used = times[column] > 1
    owner, column = owner[used], shared[column[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((n, COLUMNS), dtype=np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        common += part @ part.T
    linked = common / np.maximum(1, sizes[:, None] + sizes[None, :] - common) >= threshold
    linked &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    np.fill_diagonal(linked, False)
    root = np.arange(n)
    while True:
        reached = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1))
        reached = reached[reached]
        if (reached == root).all():
            return linked.sum(axis=1), (linked * weights[None, :]).sum(axis=1), root
        root = reached


def _signed(docs: DataFrame, key: str, text: str, words: int, trees: int, depth: int) -> DataFrame:
    """One narrow row per document: place, key, hash of its n-gram set, set size, prefixes."""

    def sign(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch.pop("t")]
            batch["same"] = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            batch["size"] = [len(s) for s in sets]
            batch["paths"] = [prefixes(s, trees, depth).view(np.int64) for s in sets]
            yield batch

    kind = docs.schema[key].dataType.simpleString()
    at = place(docs)
    rows = docs.select(at.getField("file").alias("file"), at.getField("row").alias("row"), docs[key].alias("k"), text_or_empty(docs, text).alias("t"))
    return rows.mapInPandas(sign, f"file long, row long, k {kind}, same binary, size long, paths array<long>")


def _first(*more: str) -> Column:
    """Orders rows by key, null keys last, then by place."""
    return F.struct(F.col("k").isNull().alias("none"), F.col("k"), F.col("file"), F.col("row"), *more)


_PAIRS = """explode(flatten(transform(s, (x, i) -> transform(
    filter(slice(s, i + 2, size(s)), y -> y.size >= {t} * x.size AND (x.comp IS NULL OR y.comp IS NULL OR x.comp <> y.comp)),
    y -> struct(x.c AS a, y.c AS b)))))"""


def near_links(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL,
) -> DataFrame:
    """One row (place, key as k, class_id, copy_id, n_copies, n_links, kept) per row of ``docs``.

    ``docs`` must be located (``frames.located``). class_id: the smallest key of the group of
    documents connected by links (similarity of at least ``threshold``); copy_id and n_copies: the
    smallest key and the number of the documents with the same n-gram set; n_links: the number of
    other documents linked, copies included. kept: exactly one row of each group, that with the
    smallest key (null last; among repeated rows the first). Texts without words are copies of
    each other and of nothing else. A null text counts as empty.
    """
    small_batches(docs)
    depth = prefix_depth(trees, deepest, threshold, recall)
    signed = settle(_signed(docs, key, text, words, trees, depth))
    classes = signed.groupBy("same").agg(
        F.min(_first()).alias("rep"), F.count(F.lit(1)).alias("members"), F.first("size").alias("size"), F.first("paths").alias("paths")
    )
    classes = settle(classes.withColumn("c", F.monotonically_increasing_id()))

    entries = classes.where("size > 0").select("c", "size", F.posexplode("paths").alias("tree", "path"))
    crowds = entries.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("head")).where("m > 1")
    hits = settle(entries.join(crowds, ["tree", "path"]))
    crowded = settle(components(hits.where(F.col("m") > CROWD).select(F.col("c").alias("a"), F.col("head").alias("b"))).withColumnRenamed("label", "comp"))

    few = hits.where(F.col("m") <= CROWD).join(crowded, hits.c == crowded.node, "left").groupBy("tree", "path").agg(
        F.sort_array(F.collect_list(F.struct("size", "c", "comp")), asc=False).alias("s")
    )
    pairs = few.select(F.expr(_PAIRS.format(t=threshold)).alias("p")).select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b"))
    pairs = settle(pairs.distinct())

    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    reps = settle(wanted.join(classes, "c").select("c", "members", F.col("rep.file").alias("f"), F.col("rep.row").alias("r")))

    def to_sets(batches):
        for batch in batches:
            yield pd.DataFrame({"c": batch["c"], "members": batch["members"], "s": [shingles(t, words).view(np.int64) for t in batch["t"]]})

    at = place(docs)
    texts = docs.select(at.getField("file").alias("f"), at.getField("row").alias("r"), text_or_empty(docs, text).alias("t"))
    texts = possible_members(texts, reps, ["f", "r"]).where("maybe")
    sets = settle(texts.join(reps, ["f", "r"]).select("c", "members", "t").mapInPandas(to_sets, "c long, members long, s array<long>"))

    left = sets.select(F.col("c").alias("a"), F.col("members").alias("ma"), F.col("s").alias("sa"))
    right = sets.select(F.col("c").alias("b"), F.col("members").alias("mb"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    links = settle(
        pairs.join(left, "a").join(right, "b").where(common / (F.size("sa") + F.size("sb") - common) >= threshold).select("a", "b", "ma", "mb")
    )
    inside = settle(_crowd_links(sets, crowded, threshold))

    edges = links.select("a", "b").unionByName(inside.select(F.col("c").alias("a"), F.col("root").alias("b")))
    groups = components(edges)
    counted = (
        links.select(F.col("a").alias("c"), F.col("mb").alias("n"))
        .unionByName(links.select(F.col("b").alias("c"), F.col("ma").alias("n")))
        .unionByName(inside.select("c", F.col("docs").alias("n")))
        .groupBy("c").agg(F.sum("n").alias("linked"))
    )
    named = classes.join(groups, classes.c == groups.node, "left").join(counted, "c", "left").select(
        "same", "rep", "members", F.coalesce("label", "c").alias("g"), (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    )
    named = settle(named)
    best = named.groupBy("g").agg(F.min("rep").alias("best"))
    named = named.join(best, "g").select("same", "rep", "members", "n_links", "best")
    rows = signed.select("file", "row", "k", "same")
    return join_groups(rows, settle(named), "same", "members", rows.count()).select(
        F.struct("file", "row").alias("place"), "k", F.col("best.k").alias("class_id"), F.col("rep.k").alias("copy_id"),
        F.col("members").alias("n_copies"), "n_links",
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"),
    )


def _crowd_links(sets: DataFrame, crowded: DataFrame, threshold: float) -> DataFrame:
    """Links inside candidate components, two blocks at a time: (c, docs, root)."""
    sizes = sets.select(F.col("c").alias("node"), F.size("s").cast("long").alias("size"))
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_NGRAMS))
    blocks = crowded.join(sizes, "node").groupBy("comp").agg(needed.alias("blocks"))
    dealt = crowded.join(blocks, "comp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = dealt.join(sets, dealt.node == sets.c).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "c", "members", "s")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("c")
        same = frame["low"].iloc[0] == frame["high"].iloc[0]
        side = np.full(len(frame), -1) if same else (frame["own"] == frame["high"]).to_numpy().astype(int)
        number, docs, root = block_links(list(frame["s"]), side, frame["members"].to_numpy(), threshold)
        hit = number > 0
        c = frame["c"].to_numpy()
        return pd.DataFrame({"c": c[hit], "docs": docs[hit], "root": c[root[hit]]})

    return spread.groupBy("comp", "low", "high").applyInPandas(compare, "c long, docs long, root long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with class_id, copy_id, n_copies, n_links and kept (see ``near_links``).

    Columns named like a result are replaced; an empty table stays empty; all rows are returned.
    """
    docs = located(docs)
    found = near_links(docs, key, text, **options)
    rows = packed(docs, place=place(docs))
    return unpacked(rows.join(found.drop("k"), "place"), docs.columns, *RESULTS)
