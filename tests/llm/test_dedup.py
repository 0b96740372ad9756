import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from riskloom.llm import bloom_dedup, lsh_forest
from riskloom.llm.components import components


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        assert r.text_sha256 == hashlib.sha256(fold(r.text).encode()).hexdigest()
        groups[r.text_sha256].append(r)
    for own in groups.values():
        largest = max((r.doc_id for r in own if r.doc_id is not None), default=None)
        assert [r.keep_id for r in own] == [largest] * len(own) and {r.group_size for r in own} == {len(own)}
        assert [r.doc_id for r in own if r.kept] == [largest]


def test_exact_groups(docs, edges, clashing, nothing):
    for frame in (docs, edges, clashing, edges.union(edges)):
        rows = bloom_dedup.exact_groups(frame).collect()
        check_groups(rows)
        assert len(rows) == frame.count()
    assert bloom_dedup.exact_groups(nothing).count() == 0


def test_a_saturated_filter_changes_nothing(docs):
    few = bloom_dedup.exact_groups(docs, functions=1, most_bits=1).collect()
    check_groups(few)
    assert len(few) == docs.count()


def test_the_filter_lets_lone_rows_pass(docs):
    """Only rows that may be repeated are written and shuffled."""
    shas = docs.selectExpr("sha2(text, 256) AS sha")
    slots = bloom_dedup.repeated_slots(shas, 2, 2**20)
    repeated = docs.count() - docs.select("text").distinct().count()
    assert slots.selectExpr("sum(bitmap_count(bits))").first()[0] <= 4 * repeated


def test_native(docs):
    plan = bloom_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute(rows, threshold=0.8):
    def grams(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(r.text) for r in rows]
    parent, links = list(range(len(rows))), Counter()
    by_gram = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or [()]:
            by_gram[g].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s or [()] for j in by_gram[g]).items():
            if j != i and (s == sets[j] or n / len(s | sets[j]) >= threshold):
                links[i] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    smallest = {}
    for own in groups.values():
        ids = [rows[i].doc_id for i in own if rows[i].doc_id is not None]
        for i in own:
            smallest[i] = min(ids, default=None)
    return sorted(((r.doc_id is None, r.doc_id or 0, smallest[i], links[i]) for i, r in enumerate(rows)), key=str), len(groups)


def check_links(frame, **options):
    rows = lsh_forest.near_duplicates(frame, **options).collect()
    wanted, groups = brute(frame.collect())
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links) for r in rows), key=str) == wanted
    assert sum(r.kept for r in rows) == groups and len(rows) == frame.count()
    assert all(r.doc_id == r.class_id for r in rows if r.kept)


def test_links_of_the_table(docs, edges, clashing, nothing):
    check_links(docs)
    check_links(edges)
    check_links(clashing.limit(6))
    assert lsh_forest.near_duplicates(nothing).count() == 0


def test_a_crowd_of_different_near_copies(spark):
    """More classes than a block holds, all in one candidate component, with chance misses."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(10**6)}" for _ in range(50))) for i in range(50)]
    check_links(spark.createDataFrame(rows, "doc_id long, text string"))


def test_recall_of_the_prefix():
    depth = lsh_forest.prefix_depth(32, 8, 0.8, 0.9999)
    assert depth == 6
    rng, found = np.random.default_rng(1), 0
    for _ in range(300):
        union = rng.integers(0, 2**63, 100, dtype=np.uint64)
        one, two = np.unique(union[:90]), np.unique(union[10:])
        found += (lsh_forest.prefixes(one, 32, depth) == lsh_forest.prefixes(two, 32, depth)).any()
    assert found >= 299


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (7, 1000), (1000, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(1000, 1100)}}
    assert components(edges.where("false")).count() == 0
