"""Fill-in-the-middle over seekable compressed frames.

Store: every text is cut into frames of at most ``FRAME_CHARS`` code points, each compressed as an
independent zstandard frame, with cumulative unit counts: code points and line starts before the
frame and inside it, and whether its first character starts a line. With these counts any line's
start is found without reading a frame; only the frame holding it is decompressed.

Transform: a document's cuts are line numbers (prefix ends after ``a`` lines, middle after ``b``).
Selection decompresses only the cut frames, at most two, to turn the cuts into code-point offsets.
The output, markers and the three parts in the form's order, is streamed frame by frame into new
frames and into its digest; it is never one string. The round trip reads the output frames once
to find the markers and then seeks the parts in the text's order to rebuild and digest the text.
A task holds one document's compressed frames and one frame of text.

Lines are the matches of ``[^\\n]*\\n|[^\\n]+``; a null text is stored as the empty text, one
empty frame, with no lines. Each row is a document of its own, so repeated rows are
documents each. Other columns are carried, not read; an empty table gives no frames. A document's
frames are one row (arrays), so the transform needs no shuffle and no group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.llm.frames import small_batches, text_or_empty

FRAME_CHARS = 1 << 16
LEVEL = 3
#: The form's markers (fixed by the output format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FRAME_SCHEMA = "first_char long, chars long, first_line long, lines long, opens boolean, blob binary"
RESULTS = ("prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "n_frames", "cut_frames", "output_frames")


def cut_frames(text: str, size: int = FRAME_CHARS) -> Iterator[tuple[int, int, int, int, bool, bytes]]:
    """(first_char, chars, first_line, lines, opens, blob) of each frame of ``text``."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    if not text:
        yield 0, 0, 0, 0, False, packer.compress(b"")
        return
    before, last = 0, len(text) - 1
    for start in range(0, len(text), size):
        chunk = text[start : start + size]
        opens = start == 0 or text[start - 1] == "\n"
        lines = text.count("\n", max(start - 1, 0), min(start + size - 1, last)) + (start == 0)
        yield start, len(chunk), before, lines, opens, packer.compress(chunk.encode("utf-8"))
        before += lines


def store(docs: DataFrame, text: Column, carry: list[Column], size: int = FRAME_CHARS) -> DataFrame:
    """One row per document: the ``carry`` columns and its frames as arrays of FRAME_SCHEMA's fields."""
    small_batches(docs)
    kept = docs.select(*carry, text.alias("_text"))
    names = [c for c in kept.columns if c != "_text"]
    fields = [f.split(" ") for f in FRAME_SCHEMA.split(", ")]
    arrays = ", ".join(f"{name} array<{kind}>" for name, kind in fields)
    schema = StructType(kept.drop("_text").schema.fields + StructType.fromDDL(arrays).fields)

    def frames(batches):
        for batch in batches:
            cut = [list(zip(*cut_frames(t or "", size))) for t in batch["_text"]]
            out = batch[names].copy()
            for i, (name, _) in enumerate(fields):
                out[name] = [list(c[i]) for c in cut]
            yield out

    return kept.mapInPandas(frames, schema)


class Frames:
    """A document's frames, read by seeking: one decompressed frame is kept."""

    def __init__(self, first_char, chars, first_line, lines, opens, blobs):
        self.first_char, self.chars = np.asarray(first_char, np.int64), np.asarray(chars, np.int64)
        self.first_line, self.lines = np.asarray(first_line, np.int64), np.asarray(lines, np.int64)
        self.opens, self.blobs = list(opens), list(blobs)
        self.total = int(self.first_char[-1] + self.chars[-1]) if len(self.chars) else 0
        self.n = int(self.first_line[-1] + self.lines[-1]) if len(self.lines) else 0
        self._reader, self._at, self._text, self.opened = zstandard.ZstdDecompressor(), -1, "", 0

    def frame(self, i: int) -> str:
        if i != self._at:
            self._at, self._text, self.opened = i, self._reader.decompress(self.blobs[i]).decode("utf-8"), self.opened + 1
        return self._text

    def line_start(self, a: int) -> int:
        """Code points before line ``a`` (the total for a >= n); decompresses the cut frame only."""
        if a <= 0 or a >= self.n:
            return 0 if a <= 0 else self.total
        i = int(np.searchsorted(self.first_line, a, side="right")) - 1
        k, chunk = a - int(self.first_line[i]), self.frame(i)
        if self.opens[i]:
            if k == 0:
                return int(self.first_char[i])
            k -= 1
        at = -1
        for _ in range(k + 1):
            at = chunk.index("\n", at + 1)
        return int(self.first_char[i]) + at + 1

    def pieces(self, start: int, end: int) -> Iterator[str]:
        """The text of code points [start, end), frame by frame."""
        if end <= start:
            return
        i = int(np.searchsorted(self.first_char, start, side="right")) - 1
        while i < len(self.chars) and self.first_char[i] < end:
            base = int(self.first_char[i])
            yield self.frame(i)[max(start - base, 0) : end - base]
            i += 1


class _Writer:
    """Streams text into frames of ``size`` code points and a digest."""

    def __init__(self, size: int):
        self.size, self.buffer, self.blobs, self.first_char, self.chars = size, [], [], [], []
        self.held, self.written, self.digest = 0, 0, hashlib.sha256()
        self._packer = zstandard.ZstdCompressor(level=LEVEL)

    def write(self, piece: str) -> None:
        self.digest.update(piece.encode("utf-8"))
        if self.held + len(piece) < self.size:
            self.buffer.append(piece)
            self.held += len(piece)
            return
        at = self.size - self.held
        self._flush("".join(self.buffer) + piece[:at])
        while len(piece) - at >= self.size:
            self._flush(piece[at : at + self.size])
            at += self.size
        self.buffer, self.held = [piece[at:]], len(piece) - at

    def _flush(self, chunk: str) -> None:
        self.blobs.append(self._packer.compress(chunk.encode("utf-8")))
        self.first_char.append(self.written)
        self.chars.append(len(chunk))
        self.written += len(chunk)

    def close(self) -> Frames:
        if self.held or not self.blobs:
            self._flush("".join(self.buffer))
        self.buffer, self.held = [], 0
        zeros = [0] * len(self.blobs)
        return Frames(self.first_char, self.chars, zeros, zeros, [False] * len(self.blobs), self.blobs)


def _markers(frames: Frames) -> dict[str, int]:
    """Code-point offset of the first occurrence of each marker, reading each frame once."""
    found, carry = {}, ""
    for i in range(len(frames.blobs)):
        chunk = carry + frames.frame(i)
        base = int(frames.first_char[i]) - len(carry)
        for marker in (PREFIX, SUFFIX, MIDDLE):
            if marker not in found and (at := chunk.find(marker)) >= 0:
                found[marker] = base + at
        carry = chunk[-2:]
    return found


def _digest(parts: Iterator[str]) -> str:
    h = hashlib.sha256()
    for piece in parts:
        h.update(piece.encode("utf-8"))
    return h.hexdigest()


def restore(output: Frames, form: str) -> str:
    """Digest of the text rebuilt from the output: the parts between markers, in the order prefix, middle, suffix."""
    if form == "plain":
        return _digest(output.pieces(0, output.total))
    at = _markers(output)
    p, s, m = at[PREFIX], at[SUFFIX], at[MIDDLE]
    if form == "psm":
        ranges = [(p + 3, s), (m + 3, output.total), (s + 3, m)]
    else:
        ranges = [(p + 3, m), (m + 3, output.total), (s + 3, p)]
    return _digest(piece for start, end in ranges for piece in output.pieces(start, end))


def transform(frames: Frames, a: int, b: int, form: str, size: int = FRAME_CHARS) -> tuple[int | None, int | None, int, Frames]:
    """Prefix and middle code points (None if plain), frames decompressed to find them, and the
    output's frames (digest in ``.digest``)."""
    out = _Writer(size)
    if form == "plain":
        for piece in frames.pieces(0, frames.total):
            out.write(piece)
        done = out.close()
        done.digest = out.digest.hexdigest()
        return None, None, 0, done
    x, y = frames.line_start(a), frames.line_start(b)
    cut = frames.opened
    parts = {"p": (0, x), "m": (x, y), "s": (y, frames.total)}
    order = [(PREFIX, "p"), (SUFFIX, "s"), (MIDDLE, "m")] if form == "psm" else [(SUFFIX, "s"), (PREFIX, "p"), (MIDDLE, "m")]
    for marker, part in order:
        out.write(marker)
        for piece in frames.pieces(*parts[part]):
            out.write(piece)
    done = out.close()
    done.digest = out.digest.hexdigest()
    return x, y - x, cut, done


def fill_in_middle(stored: DataFrame, carry: list[str], keep_output: bool = False, size: int = FRAME_CHARS) -> DataFrame:
    """Per document of ``stored`` (frames with ``a``, ``b``, ``form`` and ``carry``): the carried
    columns and RESULTS; with ``keep_output`` also ``output`` (binary frames) and ``output_chars``.
    Row by row: no document's frames meet another's.
    """
    kept = list(dict.fromkeys(carry))
    extra = ", output array<binary>, output_chars array<long>" if keep_output else ""
    results = "prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, n_frames long, cut_frames long, output_frames long"
    schema = StructType(stored.select(*kept).schema.fields + StructType.fromDDL(results + extra).fields)
    names = [n for n, _ in (f.split(" ") for f in FRAME_SCHEMA.split(", "))]

    def each(batches):
        for batch in batches:
            out = {k: [] for k in ("prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "n_frames", "cut_frames", "output_frames", "output", "output_chars")}
            for row in batch[[*names, "a", "b", "form"]].itertuples(index=False):
                frames = Frames(*row[: len(names)])
                a, b, form = int(row[-3]), int(row[-2]), str(row[-1])
                prefix, middle, cut, output = transform(frames, a, b, form, size)
                for k, v in (("prefix_chars", prefix), ("middle_chars", middle), ("output_sha256", output.digest), ("restored_sha256", restore(output, form)),
                             ("n_frames", len(frames.blobs)), ("cut_frames", cut), ("output_frames", len(output.blobs)),
                             ("output", list(output.blobs)), ("output_chars", [int(c) for c in output.chars])):
                    out[k].append(v)
            done = batch[kept].copy()
            for k, v in out.items():
                if keep_output or k not in ("output", "output_chars"):
                    done[k] = pd.Series(v, index=batch.index, dtype=object if k in ("prefix_chars", "middle_chars", "output", "output_chars") else None)
            yield done

    return stored.mapInPandas(each, schema)


def hashed_cuts(key: Column, n: Column, text: Column) -> dict[str, Column]:
    """a, b and form of the contract: h1..h4 from the hex sha256 of ``7:`` and the key."""
    hexed = F.sha2(F.concat(F.lit("7:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    one, two = F.pmod(h[0], n + 1), F.pmod(h[1], n + 1)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (F.pmod(h[2], F.lit(100)) >= 100), F.lit("plain")).when(F.pmod(h[3], F.lit(100)) < 50, F.lit("spm")).otherwise(F.lit("psm"))
    return {"a": F.least(one, two), "b": F.greatest(one, two), "form": form}


def line_count(text: Column) -> Column:
    """Matches of ``[^\\n]*\\n|[^\\n]+``: one per newline, and one for a last line without one."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def fim_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_output: bool = False, size: int = FRAME_CHARS) -> DataFrame:
    """Every row of ``docs``: ``key``, n, form and RESULTS (see module docstring for nulls and repeats)."""
    body = text_or_empty(docs, text)
    n = line_count(body)
    cuts = hashed_cuts(docs[key], n, body)
    carry = [docs[key].alias("_key"), n.alias("n"), *[c.alias(k) for k, c in cuts.items()]]
    stored = store(docs, body, carry, size)
    done = fill_in_middle(stored, ["_key", "n", "form"], keep_output, size)
    return done.withColumnRenamed("_key", key)
