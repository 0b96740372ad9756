import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import merkle, queries


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, tamper=lambda r: False):
    """Manifest by the contract, level by level in Python: {doc_id: (leaf, subroot, root, proof_sha256, folded, verified)}."""
    def tree(leaves):
        """Levels of node digests and, per leaf, its (left, right) siblings per level."""
        levels, nodes = [], list(leaves)
        while len(nodes) > 1:
            levels.append(nodes)
            nodes = [_h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        return levels, nodes[0]

    def path(levels, i):
        out = []
        for nodes in levels:
            s = i - i % 3
            run = nodes[s:s + 3]
            out.append(("".join(run[: i - s]), "".join(run[i - s + 1:])))
            i //= 3
        return out

    keyed = []
    for r in rows:
        d, text, lang, source, n_chars = r
        leaf = _h(*map(_field, (d, source, lang, n_chars, text)))
        changed = text if not tamper(r) or text is None else text.replace("\n", "")
        keyed.append((source, d, leaf, _h(*map(_field, (d, source, lang, n_chars, changed)))))
    groups = {}
    for row in keyed:
        groups.setdefault(row[0], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        levels, sub = tree([m[2] for m in members])
        subtrees[s] = (members, levels, sub)
    top_levels, root = tree([subtrees[s][2] for s in order])
    out = {}
    for gi, s in enumerate(order):
        members, levels, sub = subtrees[s]
        for i, m in enumerate(members):
            proof = path(levels, i) + path(top_levels, gi)
            node = m[3]
            for left, right in proof:
                node = _h(left, node, right)
            out.setdefault(m[1], []).append((m[2], sub, root, _h(*(a + b for a, b in proof)), node, node == root))
    return out


def _tampered(r) -> bool:
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0


def _rows(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, []).append((r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified))
    return {k: sorted(v) for k, v in got.items()}


def test_query_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    want = {k: sorted(v) for k, v in brute(rows, _tampered).items()}
    got = _rows(queries.op11_manifest(spark, folder))
    assert got == want
    assert any(not v[5] for vs in got.values() for v in vs) and any(v[5] for vs in got.values() for v in vs)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_and_groups(spark, n):
    """Lone leaves, full and partial runs, several groups of different depths."""
    rows = [(i, f"t\n{i}", "en", ["a", None, "b"][i % 3] if n > 3 else "a", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(docs, F.regexp_replace("text", "\n", ""), parts=3).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")
    want = {k: sorted(v) for k, v in brute(rows, lambda r: True).items()}
    assert _rows(got) == want


def test_edges_repeats_and_clashes(spark, edges):
    docs = edges.withColumn("n_chars", F.length("text").cast("long"))
    rows = [(r.doc_id, r.text, r.lang, r.source, None if r.text is None else len(r.text)) for r in edges.collect()]
    want = {k: sorted(v) for k, v in brute(rows).items()}
    for frame in (docs, docs.withColumns({c: F.lit("x") for c in ("g", "idx", "h", "n", "proof", "checked", "leaf")})):
        got = merkle.manifest(frame).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")
        assert _rows(got) == want
        assert all(v[5] for vs in _rows(got).values() for v in vs)


def test_empty(spark, edges):
    docs = edges.withColumn("n_chars", F.length("text").cast("long")).where("false")
    assert merkle.manifest(docs).count() == 0
