import hashlib
import re

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from riskloom.llm import fim_frames, queries


def _sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    """The contract in plain Python: n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256."""
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    n = len(lines)
    hx = _sha("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(hx[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, t, _sha(t), _sha(t)
    form = "spm" if h[3] % 100 < 50 else "psm"
    out = "<P>" + p + "<S>" + s + "<M>" + m if form == "psm" else "<S>" + s + "<P>" + p + "<M>" + m
    return n, form, len(p), len(m), out, _sha(out), _sha(t)


def _got(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in df.collect()), key=repr)


def _want(rows):
    out = []
    for d, t in rows:
        n, form, p, m, _, osha, rsha = brute(d, t)
        out.append((d is None, d or 0, n, form, p, m, osha, rsha))
    return sorted(out, key=repr)


def test_query_equals_sql_and_brute_force(spark, folder):
    got = _got(queries.op13_fill_in_middle(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got == _want([(r.doc_id, r.text) for r in docs])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    sql = con.sql(queries.ORACLES["op13_fill_in_middle"]).fetchall()
    assert sorted(((d is None, d or 0, *rest) for d, *rest in sql), key=repr) == got
    assert {g[3] for g in got} >= {"psm", "spm"}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_small_frames_and_edges(spark, edges, size):
    """Frames far smaller than lines and texts: cuts in the middle of frames, at their borders and across markers."""
    extra = [(20, "a\nb\n\nc"), (21, "\n\n\n"), (22, "x\n" * 50), (23, "one<P>two\n"), (24, "<\nS>\n<S\n"), (25, "漢字\n𠮷\né\n" * 9)]
    frame = edges.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    frame = frame.withColumns({"row": F.lit("own"), "a": F.lit(1), "form": F.lit("x"), "_key": F.lit(0)})
    got = fim_frames.fim_documents(frame, size=size)
    assert _got(got) == _want([(r.doc_id, r.text) for r in frame.collect()])


def test_output_frames_round_trip(spark, edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = fim_frames.fim_documents(edges.select("doc_id", "text"), keep_output=True, size=5).collect()
    wanted = {}
    for d, t in rows:
        wanted.setdefault(d, []).append(brute(d, t)[4])
    reader = zstandard.ZstdDecompressor()
    for r in got:
        text = "".join(reader.decompress(b).decode() for b in r.output)
        assert text in wanted[r.doc_id]
        assert sum(r.output_chars) == len(text) and all(c <= 5 for c in r.output_chars)
        assert r.output_frames == len(r.output)
        if r.form != "plain":
            assert r.cut_frames <= 2


def test_empty(nothing):
    assert fim_frames.fim_documents(nothing).count() == 0
