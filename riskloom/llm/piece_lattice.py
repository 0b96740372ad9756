"""SentencePiece encoding and decoding as a relational lattice.

Text is cut into units that no piece crosses: a run of blanks with what follows it, or a line
break. Only distinct units are encoded:

 1. from every place of a unit the substrings that can be a piece are exploded and equi-joined to
    the piece table (bounded, broadcast); what matches are the edges of the unit's lattice. A
    substring of ``PREFIX`` characters and more can be one if some piece of its length begins with
    the same ``PREFIX`` characters: a join of the places to a table of those (bounded, broadcast);
 2. edges are grouped by unit (units are partitioned once before, so this needs no shuffle);
 3. a higher-order ``aggregate`` folds the edges into the best path.

The fold depends on the model. For unigram models it is Viterbi: the best sum of scores up to
each place. A byte-pair model has no such sum; there the fold takes the edges in order of rank and
place, and applies an edge if exactly one boundary is left inside it. That equals merging the
best pair again and again, because boundaries only vanish: if none of an edge's ends is crossed
by then, its inside has come to two parts exactly as it does for the piece alone. Pieces for
which that fails alone (``late``) are found when the model is read. Units with such an edge, or
longer than the 62 places of the boundary mask, go to the library itself.

Documents and units meet as in ``interpolation``: blocks of documents ask for their distinct units
in packets by ranges of the unit's hash, and get the ids back in order.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.frames import located, place, small_batches, text_or_empty
from riskloom.llm.interpolation import packed, unpacked

BLANK = "▁"
UNIT = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n")
SEGMENT = re.compile(f"{BLANK}({BLANK}*[^{BLANK}]*)")
MASK_PLACES = 62
BLOCK_BYTES = 2**24
RANGE_BYTES = 2**21
PIECES_AT_MOST = 2**18
PREFIX = 3
SLICE = 2**16  # ids that are decoded at once


@dataclass(frozen=True)
class Pieces:
    rows: list[tuple[str, int, float, bool]]  # piece, id, score, late
    unigram: bool
    longest: int
    byte_ids: list[int]


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _forms_alone(piece: str, score: dict[str, float]) -> bool:
    size = len(piece)
    edges = sorted((-score[piece[s:e]], s, e) for s in range(size) for e in range(s + 2, size + 1) if piece[s:e] in score)
    ends = (1 << (size + 1)) - 1
    for _, s, e in edges:
        inside = ends & ((1 << e) - (1 << (s + 1)))
        if ends >> s & 1 and ends >> e & 1 and inside and inside & (inside - 1) == 0:
            ends &= ~inside
    return ends == 1 | 1 << size


def pieces(path: str) -> Pieces:
    """The piece table of a model file with byte fallback and the identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as format_

    model = format_.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal = model.normalizer_spec
    if normal.name != "identity" or not normal.add_dummy_prefix or normal.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("the model must have byte fallback and keep its text as it is")
    kinds = format_.ModelProto.SentencePiece
    score = {p.piece: p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
    if len(score) > PIECES_AT_MOST or any("\n" in p or BLANK in p.lstrip(BLANK) for p in score):
        raise ValueError("too many pieces, or pieces that cross a unit")
    unigram = model.trainer_spec.model_type == format_.TrainerSpec.UNIGRAM
    rows = [(p.piece, i, p.score, not unigram and not _forms_alone(p.piece, score)) for i, p in enumerate(model.pieces) if p.piece in score]
    of_byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    return Pieces(rows, unigram, max(map(len, score), default=1), [of_byte[f"<0x{b:02X}>"] for b in range(256)])


def units(text: str) -> list[str]:
    return UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []


def segments(text: str) -> list[str]:
    """The text cut before each run of blanks, without the first blank of the run; as ``units``, a
    text has one more blank in front. A text with single blanks only is cut at these."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and BLANK not in text:
        return text.split(" ")
    return SEGMENT.findall(BLANK + text.replace(" ", BLANK))


def units_of(segment: str) -> list[str]:
    """The units of a segment, one at least; those of a text are those of its segments in order."""
    return UNIT.findall(BLANK + segment) if "\n" in segment else [BLANK + segment]


# An edge of a byte-pair lattice is one number: rank, start, end, id, from the highest bits down, so that
# numbers sort by rank and place. Single characters merge nothing; the one that names its unit is -1.
_EDGE = """CASE WHEN e - s = 1 THEN -1L
    ELSE shiftleft(rank, 30) + shiftleft(CAST(s AS BIGINT), 24) + shiftleft(CAST(e AS BIGINT), 18) + id END"""
_S, _E, _ID = "CAST(shiftright(x, 24) & 63L AS INT)", "CAST(shiftright(x, 18) & 63L AS INT)", "CAST(x & 262143L AS INT)"
_BIT = "shiftright(b, {0}) & 1L = 1L"
_INSIDE = f"(b & (shiftleft(1L, {_E}) - shiftleft(1L, {_S} + 1)))"
_MERGES = f"""aggregate(sort_array(filter(edges, x -> x >= 0L)), shiftleft(1L, n + 1) - 1L,
    (b, x) -> CASE WHEN {_BIT.format(_S)} AND {_BIT.format(_E)} AND {_INSIDE} <> 0L AND ({_INSIDE} & ({_INSIDE} - 1L)) = 0L
                   THEN b & ~{_INSIDE} ELSE b END)"""
_PATH_OF_MASK = f"""sort_array(concat(
    transform(filter(edges, x -> x >= 0L AND {_BIT.format(_S)} AND {_BIT.format(_E)} AND {_INSIDE} = 0L), x -> struct({_S} AS s, {_ID} AS id)),
    transform(filter(sequence(0, n - 1), s -> shiftright(b, s) & 3L = 3L), s -> struct(s, CAST(NULL AS INT) AS id))))"""
_VITERBI = """aggregate(sequence(1, n), array(struct(0D AS score, -1 AS s, CAST(NULL AS INT) AS id)),
    (best, p) -> concat(best, array(array_max(transform(filter(edges, x -> x.e = p),
        x -> struct(best[x.s].score + x.score AS score, x.s AS s, x.id AS id))))))"""
_PATH_OF_BEST = """reverse(aggregate(sequence(1, n), struct(n AS at, array_repeat(struct(0 AS s, CAST(NULL AS INT) AS id), 0) AS path),
    (a, p) -> CASE WHEN a.at <= 0 THEN a
                   ELSE struct(best[a.at].s AS at, concat(a.path, array(struct(best[a.at].s AS s, best[a.at].id AS id))) AS path) END).path)"""


def spans(places: DataFrame, table: Pieces) -> DataFrame:
    """Places (unit, n, s, ...) to the substrings from s on that can be a piece: (..., s, e, span).

    All of fewer than ``PREFIX`` characters; of longer ones those as long as a piece with their beginning.
    Byte-pair models merge no single characters: there a unit's first stands for all of them.
    """
    lengths: dict[str, set[int]] = {}
    for piece, *_ in table.rows:
        if len(piece) >= PREFIX:
            lengths.setdefault(piece[:PREFIX], set()).add(len(piece))
    known = places.sparkSession.createDataFrame([(p, sorted(x)) for p, x in lengths.items()], "prefix string, lengths array<int>")
    kept = [c for c in places.columns if c not in ("unit", "s")]
    short = F.array(*[F.lit(i) for i in range(1, PREFIX)])
    if not table.unigram:
        short = F.when(F.col("s") == 0, short).otherwise(F.array(*[F.lit(i) for i in range(2, PREFIX)]))
    each = F.explode(F.concat(short, F.coalesce("lengths", F.array().cast("array<int>")))).alias("size")
    sized = (
        places.withColumn("prefix", F.expr(f"substring(unit, s + 1, {PREFIX})")).join(F.broadcast(known), "prefix", "left")
        .select(*kept, "unit", "s", each).where("s + size <= n")
    )
    return sized.select(*kept, "s", (F.col("s") + F.col("size")).alias("e"), F.expr("substring(unit, s + 1, size)").alias("span"))


def lattice(found: DataFrame, table: Pieces, ranges: int) -> DataFrame:
    """Units (range, g, unit) to (range, g, path): the start and id of each piece in order; id
    null for a character that is no piece, and, with a byte-pair model, for any single character.
    Units that the library must encode are left out.

    Ranges of units are partitioned once; grouping the edges by unit needs no further shuffle.
    """
    spark = found.sparkSession
    order = {score: i for i, score in enumerate(sorted({r[2] for r in table.rows}, reverse=True))}
    schema = "span string, id int, score double, late boolean, rank long"
    pieces_ = F.broadcast(spark.createDataFrame([(*r, order[r[2]]) for r in table.rows], schema))  # PIECES_AT_MOST rows at most
    dealt = found.repartition(ranges, "range").withColumn("n", F.length("unit")).where((F.col("n") > 0) & (F.col("n") <= MASK_PLACES))
    places = dealt.select("range", "g", "n", "unit", F.explode(F.expr("sequence(0, n - 1)")).alias("s"))
    unknown = min((r[2] for r in table.rows), default=0.0) - 10.0
    edges = spans(places, table).join(pieces_, "span", "left").where((F.col("e") - F.col("s") == 1) | F.col("id").isNotNull())
    scored = F.struct("s", "e", F.coalesce("score", F.lit(unknown)).alias("score"), "id")
    edges = edges.groupBy("range", "g", "n").agg(
        F.collect_list(scored if table.unigram else F.expr(_EDGE)).alias("edges"), F.max(F.coalesce("late", F.lit(False))).alias("late")
    ).where("NOT late")
    if table.unigram:
        best = edges.select("range", "g", "n", F.expr(_VITERBI).alias("best"))
        return best.select("range", "g", F.expr(_PATH_OF_BEST).alias("path"))
    masks = edges.select("range", "g", "n", "edges", F.expr(_MERGES).alias("b"))
    return masks.select("range", "g", F.expr(_PATH_OF_MASK).alias("path"))


def _as_they_are(every: Iterator[np.ndarray]) -> dict[str, list]:
    return {"ids": list(every)}


def encode(
    docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
    results: Callable[[Iterator[np.ndarray]], dict[str, list]] = _as_they_are, schema: str = "ids array<int>",
) -> DataFrame:
    """One row per document: doc_id and ids (array of int), as the library encodes the text.

    A null text counts as empty and has no ids; a literal U+2581 counts as a blank, as it does in
    the library. Repeated rows are encoded each; an empty table stays empty. Where only something
    derived from the ids is wanted, ``results`` gives its columns (of ``schema``) from the ids of
    some documents, in the tasks that have them.
    """
    small_batches(docs)
    path = path or default_path()
    table = pieces(path)
    docs = located(docs)
    kind = docs.schema[key].dataType.simpleString()

    @F.pandas_udf("binary")
    def squeezed(texts: pd.Series) -> pd.Series:
        tight = zstandard.ZstdCompressor(level=3)
        return pd.Series([tight.compress(t.encode("utf-8", "surrogatepass")) for t in texts])

    t = text_or_empty(docs, text)
    size = docs.agg(F.sum(F.octet_length(t) + 1).alias("n")).first()["n"] or 0
    blocks, bits = size // block_bytes + 1, min(24, (size // RANGE_BYTES).bit_length())
    rows = docs.select(docs[key].alias("k"), F.xxhash64(place(docs)).alias("place"), squeezed(t).alias("z"))
    rows = rows.withColumn("block", F.pmod(F.col("place"), F.lit(blocks)))

    spelling = _spelling(table)

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        own, by_range = _numbered(frame, bits)
        return pd.DataFrame({"range": own.ranges, "block": frame["block"].iloc[0], "units": [_joined(u) for u in by_range]})

    def distinct(asked: pa.Table) -> pa.Table:
        found, _ = _asked(asked)
        own = asked["range"][0].as_py()
        g = np.arange(len(found)) + (own << 40)
        return pa.table([np.full(len(found), own), g, found.cast(pa.string())], names=["range", "g", "unit"])

    def answer(asked: pa.Table, codes: pa.Table) -> pa.Table:
        found, each = _asked(asked)
        sizes, flat = _ids(found, codes["g"].to_numpy() & ((1 << 40) - 1), codes["ids"].combine_chunks(), spelling, path)
        starts = np.cumsum(sizes) - sizes
        out = [(packed(sizes[at].astype(np.uint32)), packed(_gathered(flat, starts, sizes, at).astype(np.uint32))) for _, at in each]
        columns = [[block for block, _ in each], [asked["range"][0].as_py()] * len(each), [a for a, _ in out], [b for _, b in out]]
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["block", "range", "sizes", "ids"])

    def fill(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = _numbered(frame, bits)[0]
        got = {r: (s, i) for r, s, i in zip(answers["range"], answers["sizes"], answers["ids"])} if len(answers) else {}
        sizes = np.concatenate([np.empty(0, dtype=np.uint32), *(unpacked(got[r][0], np.uint32) for r in own.ranges)]).astype(np.int64)
        flat = np.concatenate([np.empty(0, dtype=np.uint32), *(unpacked(got[r][1], np.uint32) for r in own.ranges)]).astype(np.int32)
        # Segments are gathered once each, texts from these.
        starts, at = np.cumsum(sizes) - sizes, own.units_of_segments
        places = np.append(0, np.cumsum(sizes[at]))[np.append(0, np.cumsum(own.sizes_of_segments))]
        flat, starts, sizes = _gathered(flat, starts, sizes, at), places[:-1], np.diff(places)
        return pd.DataFrame({"doc_id": frame["k"].iloc[own.rows], **results(_gathered(flat, starts, sizes, x) for x in own.texts)})

    # Partitioned once; what follows by range, the lattice included, finds its rows in place.
    asked = rows.groupBy("block").applyInPandas(ask, "range long, block long, units binary").repartition(1 << bits, "range")
    found = asked.groupBy("range").applyInArrow(distinct, "range long, g long, unit string")
    codes = lattice(found, table, 1 << bits).select("range", "g", F.transform("path", lambda x: F.coalesce(x.id, F.lit(-1))).alias("ids"))
    answers = asked.groupBy("range").cogroup(codes.groupBy("range")).applyInArrow(answer, "block long, range long, sizes binary, ids binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(fill, f"doc_id {kind}, {schema}")


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs numbered ``at`` of ``flat``, one after the other."""
    own = sizes[at]
    before = np.cumsum(own) - own
    return flat[np.repeat(starts[at] - before, own) + np.arange(own.sum())]


def _segmented(texts: list[bytes]) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """All segments of the texts one after the other, where each text's begin and how many they are.

    Texts with single blanks only are split at once; the others follow one by one, at the end. The list is emptied.
    """
    whole = pa.array(texts, pa.large_binary()).cast(pa.large_string())
    count = len(texts)
    texts.clear()
    uneven = pc.or_(pc.starts_with(whole, " "), pc.or_(pc.match_substring(whole, "  "), pc.match_substring(whole, BLANK)))
    even = pc.and_(pc.invert(uneven), pc.greater(pc.binary_length(whole), 0)).to_numpy(zero_copy_only=False)
    uneven = uneven.to_numpy(zero_copy_only=False)
    others = [segments(t) for t in whole.filter(pa.array(uneven)).to_pylist()]
    cut = pc.split_pattern(whole if even.all() else whole.filter(pa.array(even)), " ")
    sizes = np.zeros(count, dtype=np.int64)
    sizes[even] = pc.list_value_length(cut).to_numpy()
    sizes[uneven] = [len(x) for x in others]
    order = np.concatenate([np.flatnonzero(even), np.flatnonzero(uneven)])
    starts = np.zeros(count, dtype=np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    rest = pa.array(chain.from_iterable(others), pa.large_string())
    return pa.chunked_array([cut.flatten(), rest]), starts, sizes


@dataclass
class _Numbered:
    """A block's texts as numbers of distinct segments, these as numbers of distinct units (by range, then in order)."""

    rows: np.ndarray  # the order of the rows
    texts: list[np.ndarray]
    units_of_segments: np.ndarray
    sizes_of_segments: np.ndarray
    ranges: list[int]


def _numbered(frame: pd.DataFrame, bits: int) -> tuple[_Numbered, list[list[bytes]]]:
    """The texts of a block in numbers, and the units of each range.

    The same for the same rows in any order: equal places are told apart by their text.
    """
    open_, places, squeezed = zstandard.ZstdDecompressor(), frame["place"].to_numpy(), frame["z"].to_numpy()
    rows = np.array(sorted(range(len(frame)), key=lambda i: (places[i], squeezed[i])), dtype=np.int64)
    every, starts, sizes = _segmented([open_.decompress(squeezed[i]) for i in rows])
    coded = every.dictionary_encode().combine_chunks()
    del every
    pa.default_memory_pool().release_unused()  # two workers and more share an executor's memory
    numbers, known = coded.indices.to_numpy(), coded.dictionary
    broken = pc.match_substring(known, "\n")
    plain = known.filter(pc.invert(broken))
    parts = [units_of(x) for x in known.filter(broken).to_pylist()]
    found = pa.concat_arrays([
        pc.binary_join_element_wise(pa.scalar(BLANK, pa.large_string()), plain, pa.scalar("", pa.large_string())),
        pa.array(chain.from_iterable(parts), pa.large_string()),
    ]).dictionary_encode()
    # Segments without a line break come first.
    broken = broken.to_numpy(zero_copy_only=False)
    at = np.empty(len(known), dtype=np.int32)
    at[np.concatenate([np.flatnonzero(~broken), np.flatnonzero(broken)])] = np.arange(len(known), dtype=np.int32)
    numbers, coded = at[numbers], None
    units_ = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    range_ = np.fromiter(map(zlib.crc32, units_), dtype=np.int64, count=len(units_)) >> (32 - bits)
    # By range, then roughly sorted: neighbours with much in common are packed into less.
    heads = units_.astype("S16").view(">u8").reshape(-1, 2)
    order = np.lexsort((heads[:, 1], heads[:, 0], range_))
    turn = np.empty(len(order), dtype=np.int32)
    turn[order] = np.arange(len(order), dtype=np.int32)
    ranges, begin = np.unique(range_[order], return_index=True)
    found, known, plain = found.indices.to_numpy(), None, len(plain)
    pa.default_memory_pool().release_unused()
    own = _Numbered(
        rows, [numbers[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())], turn[found],
        np.array([1] * plain + [len(x) for x in parts], dtype=np.int64), ranges.tolist(),
    )
    return own, [x.tolist() for x in np.split(units_[order], begin[1:])] if len(ranges) else []


def _joined(found: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(b" ".join(found))


def _asked(asked: pa.Table) -> tuple[pa.Array, list[tuple[int, np.ndarray]]]:
    """The distinct units that the packets of a range hold, and per block which of them it asks for, in its order."""
    asked = asked.sort_by("block")
    open_ = zstandard.ZstdDecompressor()
    split = pc.split_pattern(pa.array([open_.decompress(x) for x in asked["units"].to_pylist()], pa.large_binary()).cast(pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(split).to_numpy())
    return coded.dictionary, list(zip(asked["block"].to_pylist(), np.split(coded.indices.to_numpy(), ends[:-1])))


@dataclass(frozen=True)
class _Spelling:
    lengths: np.ndarray  # characters of each id
    singles: np.ndarray  # characters that are pieces, ascending
    single_ids: np.ndarray
    byte_ids: np.ndarray


def _spelling(table: Pieces) -> _Spelling:
    lengths = np.ones(max((i for _, i, _, _ in table.rows), default=0) + 1, dtype=np.int64)
    lengths[[i for _, i, _, _ in table.rows]] = [len(p) for p, *_ in table.rows]
    singles = sorted((ord(p), i) for p, i, _, _ in table.rows if len(p) == 1)
    return _Spelling(lengths, *np.array(singles, dtype=np.int32).reshape(-1, 2).T, np.array(table.byte_ids, dtype=np.int32))


def _ids(found: pa.Array, known: np.ndarray, paths: pa.Array, spelling: _Spelling, path: str) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each unit has, and all of them in order, from the paths of the units numbered ``known``.

    Single characters (-1) get their own piece or bytes; units without a path are encoded by the library.
    """
    turn = np.argsort(known)
    known, sizes = known[turn], pc.list_value_length(paths).to_numpy()[turn].astype(np.int64)
    starts = paths.offsets.to_numpy()[:-1][turn].astype(np.int64)
    ids = _gathered(paths.values.to_numpy(), starts, sizes, np.arange(len(known)))
    # Pieces cover their units, so their lengths give the place of each in the units' characters.
    width = np.where(ids < 0, 1, spelling.lengths[ids])
    characters = np.frombuffer("".join(found.take(pa.array(known)).to_pylist()).encode("utf-32-le"), dtype=np.int32)
    single = np.flatnonzero(ids < 0)
    codes = characters[(np.cumsum(width) - width)[single]]
    at = np.searchsorted(spelling.singles, codes)
    hit = np.append(spelling.singles, -1)[at] == codes
    ids[single] = np.where(hit, np.append(spelling.single_ids, -1)[at], -1)
    counts, data = np.ones(len(ids), dtype=np.int64), [chr(c).encode() for c in codes[~hit].tolist()]
    counts[single[~hit]] = [len(b) for b in data]
    of_unit = np.add.reduceat(counts, np.cumsum(sizes) - sizes) if len(sizes) else sizes
    if data:
        spelled = np.repeat(ids < 0, counts)
        ids = np.repeat(ids, counts)
        ids[spelled] = spelling.byte_ids[np.frombuffer(b"".join(data), dtype=np.uint8)]
    if len(known) == len(found):
        return of_unit, ids
    # Blank and line break come first.
    missing = np.setdiff1d(np.arange(len(found)), known)
    spelt = [np.array(_library(path).encode("\n" + u)[2:], dtype=np.int32) for u in found.take(pa.array(missing)).to_pylist()]
    every = np.concatenate([known, missing])
    own = np.concatenate([of_unit, [len(x) for x in spelt]]).astype(np.int64)
    ids, place_ = np.concatenate([ids, *spelt]), np.cumsum(own) - own
    at = np.argsort(every)
    return own[at], _gathered(ids, place_, own, at)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text that ids stand for: blanks again, bytes joined, without the first blank; null for
    null. Bytes that are no UTF-8 become U+FFFD."""
    path = path or default_path()

    @F.pandas_udf(T.StringType())
    def apply(column: pd.Series) -> pd.Series:
        return pd.Series([None if each is None else _text_of(each, path) for each in column])

    return apply(ids)


def _text_of(ids: np.ndarray, path: str) -> str:
    table = _bytes_of(path)
    data = b"".join(_gathered(*table, ids[i : i + SLICE]).tobytes() for i in range(0, len(ids), SLICE))
    return data.decode("utf-8", "replace").replace(BLANK, " ").removeprefix(" ")


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces one after the other, where those of each id start and how many they are."""
    library = _library(path)
    out = []
    for i in range(library.piece_size()):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if library.is_control(i) or library.is_unknown(i) else piece.encode())
    sizes = np.array([len(b) for b in out], dtype=np.int64)
    return np.frombuffer(b"".join(out), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def digests(ids: Column, path: str | None = None) -> Column:
    """A struct of ids_crc32 (the ids as little-endian unsigned 32-bit numbers) and decoded_sha256
    (what they decode to), without sending the text back."""
    path = path or default_path()

    @F.pandas_udf("ids_crc32 long, decoded_sha256 string")
    def apply(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(x, path) for x in column], columns=["ids_crc32", "decoded_sha256"])

    return apply(ids)


def _digest(ids: np.ndarray, path: str) -> tuple[int, str]:
    return zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(_text_of(ids, path).encode()).hexdigest()


#: What ``digest_results`` gives.
DIGESTS = "n_pieces long, ids_crc32 long, decoded_sha256 string"


def digest_results(path: str | None = None) -> Callable[[Iterator[np.ndarray]], dict[str, list]]:
    """The same columns and the number of ids as ``results`` of ``encode``: the ids stay in the task."""
    path = path or default_path()

    def results(every: Iterator[np.ndarray]) -> dict[str, list]:
        rows = [(len(ids), *_digest(ids, path)) for ids in every]
        return {name: [row[i] for row in rows] for i, name in enumerate(("n_pieces", "ids_crc32", "decoded_sha256"))}

    return results
