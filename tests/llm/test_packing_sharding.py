import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import packing, sharding, token_counts
from riskloom.llm.encoders import encoder, default_path

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_rank_file_gives_the_ids_of_the_library(edges, docs):
    for row in edges.collect() + docs.collect():
        assert encoder(default_path()).ids(row.text or "").tolist() == library_ids(row.text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_rank_file_on_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert encoder(default_path()).ids(text).tolist() == library_ids(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
def test_sequences_are_never_overfull(lengths):
    lengths = np.array(lengths)
    bins, places = packing.sum_of_squares(lengths, 64)
    for b in set(bins.tolist()):
        at = np.argsort(places[bins == b])
        own, start = lengths[bins == b][at], places[bins == b][at]
        assert start[0] == 0 and (start[1:] == np.cumsum(own)[:-1]).all() and own.sum() <= 64
    assert bins.max() + 1 <= 2 * -(-lengths.sum() // 64)


def check_packing(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    for doc, own in by_doc.items():
        wanted = sorted(texts[doc], key=len)
        seen = sorted(sum(([r.length] for r in own), []))
        assert sum(seen) == sum(len(library_ids(t)) + 1 for t in wanted)
        if len(wanted) == 1:
            ids = np.array(library_ids(wanted[0]) + [2], dtype="<u4")
            for i, r in enumerate(sorted(own, key=lambda r: r.piece)):
                assert r.piece == i and (i == 0 or r.length == 1024)
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return len(by_sequence), -(-sum(r.length for r in rows) // 1024)


@pytest.mark.parametrize("group", [packing.GROUP, 40])
def test_packing_of_the_table(docs, group):
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    used, least = check_packing(packing.pack(docs, group=group).collect(), texts)
    assert used <= 1.05 * least + 1


def test_packing_of_edges(edges, clashing, nothing):
    texts = {}
    for r in edges.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    check_packing(packing.pack(edges).collect(), texts)
    assert packing.pack(clashing).count() == packing.pack(edges).count()
    assert packing.pack(nothing).count() == 0


def test_token_counts(edges, clashing, nothing, docs):
    for frame, chunk, overlap in [(edges, 1000, 16), (docs, 700, 8), (clashing, 2**15, 512)]:
        for r in token_counts.token_counts(frame, chunk=chunk, overlap=overlap).collect():
            ids = library_ids(r.text)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), len(ids), len(ids) > 1024)
    assert token_counts.token_counts(nothing).count() == 0


def test_counted_rows_are_all_there(edges):
    got = sorted((r.doc_id or -1) for r in token_counts.token_counts(edges, chunk=100, overlap=8).collect())
    assert got == sorted((r.doc_id or -1) for r in edges.collect())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(-(2**63), 2**63 - 1))
def test_permutation(size, key):
    n = np.arange(size)
    assert sorted(sharding.permuted(n, np.full(size, size), np.full(size, key)).tolist()) == n.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(1, 17), st.integers(0, 99))
def test_matrix_has_exact_margins(rows, shards, seed):
    matrix = sharding.communication_matrix(rows, shards, seed)
    assert (matrix >= 0).all() and matrix.sum(axis=1).tolist() == rows
    sizes = matrix.sum(axis=0)
    assert sizes.max() - sizes.min() <= 1


def test_matrix_of_a_huge_table():
    matrix = sharding.communication_matrix([10**10, 3, 10**10], 16, 1)
    assert matrix.sum() == 2 * 10**10 + 3 and np.ptp(matrix.sum(axis=0)) <= 1
    assert abs(matrix[0, 0] / 10**10 - 1 / 16) < 1e-3


def check_shards(rows, shards):
    slots = {s: [] for s in range(shards)}
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(x) for x in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding(spark, docs, edges, clashing, nothing, tmp_path):
    for frame, shards in [(docs, 16), (edges, 3), (clashing, 5), (docs.where("doc_id % 3 = 1"), 4), (nothing, 4)]:
        rows = sharding.shard(frame, shards).collect()
        check_shards(rows, shards)
        assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((r.doc_id, r.text)) for r in frame.collect())
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs).collect()}
    assert again != {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, seed=8).collect()}
    sharding.write_shards(sharding.shard(docs, 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_places_are_uniform():
    """Where a row goes does not depend on where it came from."""
    hits = np.zeros((6, 3))
    for seed in range(400):
        matrix = sharding.communication_matrix([6], 3, seed)
        number = sharding.permuted(np.arange(6), np.full(6, 6), np.full(6, seed))
        cut = np.cumsum(matrix[0]) - matrix[0]
        hits[np.arange(6), (cut[None, :] <= number[:, None]).sum(axis=1) - 1] += 1
    assert (abs(hits - 400 / 3) < 5 * (400 * 2 / 9) ** 0.5).all()


def test_no_row_is_lost_where_the_overlap_is_longer_than_every_text(spark):
    frame = spark.createDataFrame([(1, "abcdefgh" * 500), (2, "one two " * 400), (3, "short")], "doc_id long, text string")
    wanted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame).collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame, chunk=1000, overlap=5000).collect()}
    assert len(got) == 3 and got == wanted
