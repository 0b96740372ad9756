import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from riskloom.llm import interpolation, language, piece_lattice, quality, weighted_sampling
from riskloom.llm.queries import QUERIES


def grams(text, n=5):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def generalised(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(3)
    for repeat in (1, 4):
        words = [f"w{i}" for i in rng.integers(0, 40, 300)]
        one, two = " ".join(words[:220]), " ".join(words[80:] + words[100:130] * repeat)
        a, b = (weighted_sampling.fingerprint(t, 1, 4096) for t in (one, two))
        s = generalised(grams(one, 1), grams(two, 1))
        assert abs(weighted_sampling.likeness(a, b) - s) < 5 * math.sqrt(s * (1 - s) / 4096)


def check_edited(frame, spark_rows):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in frame.collect())[::-1]
    prints = {}
    for r in spark_rows:
        prints.setdefault(r.doc_id, []).append(r)
    keys = [k for k, _ in rows]
    for i, (k, text) in enumerate(rows):
        if keys.count(k) > 1 or keys.count(keys[(i + 1) % len(keys)]) > 1:
            continue
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        (r,) = prints[k[1] if k[0] else None]
        import hashlib

        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        for got, other in ((r.near_edited, changed), (r.near_next, following)):
            s = generalised(grams(text), grams(other))
            assert abs(got - s) < 6 * math.sqrt(s * (1 - s) / 64) + 0.04


@pytest.mark.parametrize("bucket_bytes", [2**20, 2**12])
def test_edited(docs, edges, clashing, nothing, bucket_bytes, monkeypatch):
    monkeypatch.setattr(weighted_sampling, "BUCKET_BYTES", bucket_bytes)
    for frame in (docs, edges, clashing, edges.limit(1)):
        rows = weighted_sampling.compare_edited(frame).collect()
        assert len(rows) == frame.count()
        check_edited(frame, rows)
    assert weighted_sampling.compare_edited(nothing).count() == 0


def test_a_key_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(weighted_sampling, "BUCKET_BYTES", 2**8)
    frame = spark.createDataFrame([(7 if i % 3 else i, f"text {i} " * 20) for i in range(300)], "doc_id long, text string")
    rows = weighted_sampling.compare_edited(frame).collect()
    assert len(rows) == 300 and len({r.edited_sha256 for r in rows}) == 300


def test_fingerprints_of_equal_texts(docs, edges):
    for frame in (docs, edges):
        by_text = {}
        rows = {r.doc_id: r for r in weighted_sampling.fingerprints(frame).collect()}
        for r in frame.collect():
            by_text.setdefault(r.text or "", set()).add(rows[r.doc_id].fingerprint)
        assert all(len(x) == 1 for x in by_text.values())


def test_sentencepiece(docs, edges, clashing, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for frame in (docs, edges, clashing):
        texts = {}
        for r in frame.collect():
            texts.setdefault(r.doc_id, []).append(r.text or "")
        coded = piece_lattice.encode(frame)
        rows = coded.withColumn("again", piece_lattice.decoded(coded.ids)).collect()
        assert len(rows) == frame.count()
        for r in rows:
            assert list(r.ids) in [library.encode(t) for t in texts[r.doc_id]]
            assert r.again in [t.replace("▁", " ") for t in texts[r.doc_id]]
    assert piece_lattice.encode(nothing).count() == 0


def test_only_substrings_that_can_be_a_piece_are_joined(spark):
    """Beyond two characters those that begin as a piece of their length; every piece is among them."""
    table = piece_lattice.pieces(piece_lattice.default_path())
    found = ["▁internationalisation", "▁qzxjkvwq", "\n", "日本語", "▁"]
    frame = spark.createDataFrame([(u, len(u), s) for u in found for s in range(len(u))], "unit string, n int, s int")
    got = {(r.unit, r.s, r.e, r.span) for r in frame.transform(lambda x: piece_lattice.spans(x.withColumn("u", x.unit), table)).withColumnRenamed("u", "unit").collect()}
    beginnings = {(p[:3], len(p)) for p, *_ in table.rows}
    wanted = {
        (u, s, e, u[s:e]) for u in found for s in range(len(u)) for e in range(s + 1, len(u) + 1)
        if ((u[s : s + 3], e - s) in beginnings if e - s > 2 else e - s == 2 or s == 0)
    }
    assert got == wanted and {p for p, *_ in table.rows if len(p) > 1 and any(p in u for u in found)} <= {r[3] for r in got}


def test_sentencepiece_digests_in_the_tasks(docs, edges):
    """The columns of ``digests``, from ids that leave no task."""
    for frame in (docs.limit(50), edges):
        coded = piece_lattice.encode(frame)
        wanted = coded.select("doc_id", F.size("ids").cast("long").alias("n"), piece_lattice.digests(F.col("ids")).alias("d")).select("doc_id", "n", "d.*")
        got = piece_lattice.encode(frame, results=piece_lattice.digest_results(), schema=piece_lattice.DIGESTS)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, wanted.collect())))


ODD = ["", "a b", " a", "a ", "a  b", "a\nb c\n\nd", "▁a ▁ b", "\n", " ", "   ", "a b a", "internationalisation internationalism", "\x00 \x00", "é 漢字 𠮷"]


def test_segments_of_many_texts_at_once():
    every, starts, sizes = piece_lattice._segmented([t.encode() for t in ODD])
    flat = every.to_pylist()
    assert [flat[a : a + n] for a, n in zip(starts, sizes)] == [piece_lattice.segments(t) for t in ODD]
    assert piece_lattice._segmented([])[0].to_pylist() == []


def test_numbers_of_a_block_in_any_order_of_rows():
    """Rows that arrive in another order give the same packets; they stand for the units of the texts."""
    z = [zstandard.ZstdCompressor(level=3).compress(t.encode()) for t in ODD]
    frame = pd.DataFrame({"place": [i // 3 for i in range(len(z))], "z": z})
    for bits in (0, 3):
        (own, packets), (again, same) = piece_lattice._numbered(frame, bits), piece_lattice._numbered(frame.iloc[::-1].reset_index(drop=True), bits)
        assert packets == same and own.ranges == again.ranges and len(packets) == len(own.ranges)
        units = [u.decode() for packet in packets for u in packet]
        assert len(set(units)) == len(units)
        ends = np.cumsum(own.sizes_of_segments)
        for i, numbers in zip(own.rows, own.texts):
            parts = [units[u] for x in numbers for u in own.units_of_segments[ends[x] - own.sizes_of_segments[x] : ends[x]]]
            assert parts == piece_lattice.units(ODD[i])


def test_ids_of_a_range_at_once():
    """Paths, single characters, bytes and units without a path, all units of a range in one go."""
    path = piece_lattice.default_path()
    library, table = sentencepiece.SentencePieceProcessor(model_file=path), piece_lattice.pieces(path)
    number = {p: i for p, i, _, _ in table.rows}
    units = ["▁the", "\n", "▁a漢\U000e0001é", "▁qzx", "▁" + "ab" * 40, "▁\U000e0001"]
    paths = [[number["▁the"]], [-1], None, [-1, -1, -1, -1], None, [-1, -1]]
    known = [i for i, x in enumerate(paths) if x is not None]
    for turn in (known, known[::-1], []):
        lists = pa.array([paths[i] for i in turn], pa.list_(pa.int32()))
        sizes, flat = piece_lattice._ids(pa.array(units, pa.large_string()), np.array(turn, dtype=np.int64), lists, piece_lattice._spelling(table), path)
        ends = np.cumsum(sizes)
        got = [flat[e - n : e].tolist() for e, n in zip(ends, sizes)]
        assert got[2] == library.encode("\n" + units[2])[2:] and got[4] == library.encode("\n" + units[4])[2:]
        assert got[0] == [number["▁the"]]
        assert library.decode(got[5]) == "\U000e0001" and library.decode(got[3]) == "qzx"
        if turn:
            assert got[3] == [number[c] for c in "▁qzx"] and got[5][1:] == [table.byte_ids[b] for b in "\U000e0001".encode()]


def test_viterbi_fold_of_a_unigram_table(spark):
    score = {"▁": -2.0, "a": -3.0, "b": -3.5, "c": -4.0, "ab": -4.5, "bc": -5.0, "▁a": -4.0, "abc": -9.0, "ca": -6.0, "▁ab": -7.2}
    table = piece_lattice.Pieces([(p, i, s, False) for i, (p, s) in enumerate(score.items())], True, 3, [])
    found = ["▁abcab", "▁", "cabcab", "abx", "▁aabbcca"]

    def best(unit):
        if not unit:
            return 0.0
        return max((score[unit[:n]] + best(unit[n:])) if unit[:n] in score else (-19.0 + best(unit[1:])) for n in range(1, len(unit) + 1) if unit[:n] in score or n == 1)

    frame = spark.createDataFrame([(0, g, unit) for g, unit in enumerate(found)], "range long, g long, unit string")
    got = {r.g: r.path for r in piece_lattice.lattice(frame, table, 2).collect()}
    pieces = list(score)
    for g, unit in enumerate(found):
        at, total = 0, 0.0
        for s, i in got[g]:
            assert s == at
            total += -19.0 if i is None else score[pieces[i]]
            at += 1 if i is None else len(pieces[i])
        assert at == len(unit) and abs(total - best(unit)) < 1e-9


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<end>"]


def brute_scores(rows, order, blocks):
    """The model by its definition, from plain counts."""
    crc = [zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 for r in rows]
    counts, documents = Counter(), 0
    for r, c in zip(rows, crc):
        if c != 2:
            documents += 1
            words = ["<s>"] * (order - 1) + tokens(r.text)
            for k in range(1, order + 1):
                counts.update(tuple(words[i - k + 1 : i + 1]) for i in range(order - 1, len(words)))
    single = {g: n for g, n in counts.items() if len(g) == 1}
    total, types = sum(single.values()), len(single)

    def seen(gram):
        return documents if gram and set(gram) == {"<s>"} else counts[gram]

    def steps(words, i, deleted):
        p = (max(counts[(words[i],)] - deleted, 0) + 1) / (total - deleted + types + 1)
        for k in range(2, order + 1):
            context = seen(tuple(words[i - k + 1 : i])) - deleted
            ratio = (counts[tuple(words[i - k + 1 : i + 1])] - deleted) / context / p if context > 0 else 0.0
            yield k, (int(math.log2(context)) + 1 if context > 0 else 0), ratio
            weight = weights[k][int(math.log2(context)) + 1 if context > 0 else 0] if k in weights else 0.0
            p *= 1 - weight + weight * ratio
        yield 0, 0, p

    weights = {}
    for k in range(2, order + 1):
        ratios = {}
        for r, c in zip(rows, crc):
            if c != 2:
                words = ["<s>"] * (order - 1) + tokens(r.text)
                for i in range(order - 1, len(words)):
                    for level, bucket, ratio in steps(words, i, 1):
                        if level == k:
                            ratios.setdefault(bucket, []).append(ratio)
        weights[k] = [0.0] * 64
        for bucket, found in ratios.items():
            found, w = np.array(found), 0.5
            for _ in range(500):
                w = (w * found / (w * found + 1 - w)).mean()
            weights[k][bucket] = w if bucket else 0.0
    out = {}
    for r, c in zip(rows, crc):
        words = ["<s>"] * (order - 1) + tokens(r.text)
        score = sum(math.log10(list(steps(words, i, 0))[-1][2]) for i in range(order - 1, len(words)))
        base = sum(math.log10((counts[(w,)] + 1) / (total + types + 1)) for w in tokens(r.text))
        out[(r.doc_id, r.text)] = (c == 2, len(tokens(r.text)), sum(counts[(w,)] > 0 for w in tokens(r.text)), total, base, score)
    return out


@pytest.mark.parametrize("order, block_bytes", [(2, 2**23), (2, 20_000), (3, 50_000), (1, 2**23)])
def test_interpolation(docs, order, block_bytes, monkeypatch):
    frame = docs.limit(80)
    monkeypatch.setattr(interpolation, "RANGE_BYTES", block_bytes)
    wanted = {k[0]: v for k, v in brute_scores(frame.collect(), order, block_bytes).items()}
    for r in interpolation.score(frame, order=order, block_bytes=block_bytes).collect():
        held, n, known, total, base, score = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=2e-3)


def test_interpolation_beats_single_tokens_on_held_out_texts(docs):
    held = [r for r in interpolation.score(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_of_edges(edges, clashing, nothing):
    assert interpolation.score(edges).count() == interpolation.score(clashing).count() == edges.count()
    assert interpolation.score(nothing).count() == 0
    only_held_out = edges.where("doc_id IS NOT NULL AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 7) = 2")
    assert all(r.base_score == 0 and r.n_known == 0 for r in interpolation.score(only_held_out).collect())


def test_totals_beyond_32_bits(spark):
    """Two blocks of three thousand million "a" each: totals, types, weights and scores stay exact."""
    text, big = "a b", 3 * 10**9
    lengths, grams = interpolation._ngrams([text], 2)
    known = np.unique(grams.reshape(-1))
    own = np.full(len(known), 7, dtype=np.uint32)
    own[np.searchsorted(known, grams[:, 0])] = big  # "a", and "a" after the start
    steps = np.diff(known, prepend=np.uint64(0))
    asked = pd.DataFrame({"range": [0, 0], "block": [0, 1], "grams": [interpolation.packed(steps)] * 2, "counts": [interpolation.packed(own)] * 2})
    answers = interpolation._answered(asked)
    for totals in answers["totals"]:
        assert interpolation.unpacked(totals, interpolation.TOTALS).tolist() == (own.astype(np.int64) * 2).tolist()
    frame = pd.DataFrame({"k": [1], "train": [True], "place": [0], "t": [text]})
    found = interpolation._looked_up(frame, answers[:1], 2)
    counts = interpolation.unpacked(found["counts"][0], interpolation.TOTALS).reshape(2, -1)
    assert counts[:, 0].tolist() == [2 * big] * 2 and counts[:, 1:].tolist() == [[14, 14]] * 2
    assert math.isclose(found["types"][0], 1 / (2 * big) + 2 / 14)
    counted = spark.createDataFrame(found, "k long, train boolean, tokens long, known long, types double, counts binary")
    learned = interpolation.learn(counted, 2)
    assert learned.weights[2][int(math.log2(2 * big - 1)) + 1] > 0  # the bucket of "a" as a context
    model = interpolation.Model(2 * big + 28, 3, 2 * big)
    model.weights = {2: np.full(interpolation.BUCKETS, 0.25)}
    (row,) = interpolation._scored(counted, model, 2).collect()
    single = [(c + 1) / (model.total + 4) for c in (2 * big, 14, 14)]
    pair = [0.25 * r + 0.75 * p for r, p in zip((1, 14 / (2 * big), 1), single)]
    assert math.isclose(row.base_score, sum(map(math.log10, single)), rel_tol=1e-12)
    assert math.isclose(row.score, sum(map(math.log10, pair)), rel_tol=1e-12)


def test_language(spark, folder, docs, edges, clashing, nothing):
    rows = QUERIES["op10_language"](spark, folder).collect()
    truth = {r.doc_id: r for r in docs.collect()}
    held = [r for r in rows if r.held_out and re.search(r"[^\W\d_]", truth[r.doc_id].text or "")]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) >= 0.98 * len(held)
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows} == {True}
    model = language.learn(edges)
    for frame in (edges, clashing):
        found = language.identify(frame, model).collect()
        assert len(found) == frame.count()
        assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in found)
        assert {r.lang_pred for r in found} <= {"en", "fr", "und"}
    assert language.identify(nothing, model).count() == 0
    assert {r.lang_pred for r in language.identify(edges, language.learn(nothing)).collect()} == {"und"}


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = "Ünïcode and some more words " * 40
    whole = sorted(np.concatenate(list(language.grams(text, 2**16))).tolist())
    monkeypatch.setattr(language, "SLICE", 100)
    assert sorted(np.concatenate(list(language.grams(text, 2**16))).tolist()) == whole


def test_quality(spark, folder, docs, edges, clashing, nothing):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = {r.doc_id: r for r in QUERIES["op6_quality"](spark, folder).collect()}
    known = labels.collect()
    assert len(rows) == docs.count()
    right = [rows[r.doc_id].kept == (r.quality == 1) for r in known if r.doc_id in rows]
    assert sum(right) >= 0.97 * len(right)
    model = quality.fit(docs, labels)
    for frame in (edges, clashing):
        assert quality.classify(frame, model).count() == frame.count()
    assert quality.classify(nothing, model).count() == 0
    blank = quality.fit(docs, labels.where("false"))
    assert all(abs(r.document_prob - 0.5) < 1e-9 for r in quality.classify(edges, blank).collect())


def test_a_repeated_label_is_fitted_on_once(spark, docs, folder):
    """A key that holds many rows weighs as much as any other, in documents and in labels."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality IN (0, 1)").orderBy("doc_id").limit(40)
    own = docs.select("doc_id", "text").join(labels, "doc_id")
    (one,) = own.limit(1).collect()
    crowd = spark.range(500).selectExpr(f"{one.doc_id}L AS doc_id").crossJoin(docs.where(docs.doc_id == one.doc_id).select("text"))
    wanted = quality.fit(docs, labels)
    again = labels.where(labels.doc_id == one.doc_id).crossJoin(spark.range(500)).drop("id")
    for found in (
        quality.fit(docs.select("doc_id", "text").unionByName(crowd), labels, fit_rows=40),
        quality.fit(docs, labels.unionByName(again), fit_rows=40),
    ):
        assert np.allclose(found.mean, wanted.mean) and np.allclose(found.weights, wanted.weights)


def test_sites_pull_scores_toward_their_own_evidence(spark):
    """Sparse sites stay near the table's mean, large ones near their own."""
    rows = [("bad", "x", 0.1)] * 400 + [("good", "x", 0.9)] * 400 + [("new", "x", 0.1)] + [("good", "poor", 0.2)] * 100
    sites = {(r.host, r.path): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    base = sites["bad", "x"].base
    assert abs(sites["bad", "x"].host_posterior - 0.1) < 0.05
    assert abs(sites["new", "x"].host_posterior - base) < abs(sites["bad", "x"].host_posterior - base)
    assert sites["good", "poor"].path_posterior < sites["good", "x"].path_posterior


def test_units_by_segment():
    """Texts are cut at blanks first; their units are the same, also around runs of blanks and line breaks."""
    rng = random.Random(5)
    for _ in range(20000):
        text = "".join(rng.choices(["a", "b", " ", "\n", piece_lattice.BLANK, "é", " x", "  "], k=rng.randint(0, 9)))
        assert [unit for x in piece_lattice.segments(text) for unit in piece_lattice.units_of(x)] == piece_lattice.units(text), repr(text)


def test_decoding_in_slices(monkeypatch):
    """Ids are decoded slice by slice, and a character's bytes may lie in two slices."""
    path = piece_lattice.default_path()
    library = piece_lattice._library(path)
    text = "one two  three\n 漢字 𠮷 é\u0e01 ▁z"
    ids = np.array(library.encode(text), dtype=np.int32)
    whole = library.decode(ids.tolist())
    for size in (1, 2, 3, 1000):
        monkeypatch.setattr(piece_lattice, "SLICE", size)
        assert piece_lattice._text_of(ids, path) == whole == text.replace("▁", " ")
    assert piece_lattice._text_of(ids[:0], path) == ""
