"""Lexical search, WARC archives and whitening against brute force."""

import collections
import gzip
import hashlib
import math
import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from phrasestream.llm import lexical_search, warc, whitening
from phrasestream.plans.stage import shared_folder

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CLASH = ("1 AS n", "'x' AS sketch", "2 AS item", "3 AS score", "'y' AS digest", "4 AS bytes", "5 AS chunk", "6 AS last")


def terms_of(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


# ---- search ----------------------------------------------------------------------------


def texts(seed=3, n=120):
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "Lo", "é", "mi", "9", "ß") for b in ("n", "Tor", "", "x1", "-y", "ö")]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, text(rng.choice([0, 1, 4, 30, 200]))) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(0, n, 7)]  # ties
    long = " ".join(f"t{rng.randrange(4000)}" for _ in range(30_000)) + " kan" * 300
    return rows + [(None, "kan Lotor"), (None, None), (900, None), (901, ""), (902, "-- \n"), (903, long), (904, "kan"), (904, "kan")]


def brute_search(docs, items, top=10):
    split = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = collections.Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in split:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scored, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=str)


def frame(spark, rows, schema, *extra):
    return spark.createDataFrame(rows, schema).repartition(5).selectExpr("*", *extra)


@pytest.mark.parametrize("cells,block", [(lexical_search.CELLS, lexical_search.BLOCK_BYTES), (40, 60)])
def test_search_equals_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    docs = texts()
    items = [(1, "kan kan KAN lotor é"), (2, "9x1 ßö t17 t18 unseen"), (3, None), (4, ""), (5, docs[8][1] or "mi"), (None, "mitor"), (7, "unseen")]
    indexed = lexical_search.index(frame(spark, docs, "doc_id long, text string", *CLASH))
    got = lexical_search.search(indexed, frame(spark, items + items[:1], "item_id long, text string", *CLASH))
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    none, some = frame(spark, [], "doc_id long, text string"), frame(spark, [(1, "kan")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.index(none), some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert lexical_search.search(lexical_search.index(some), none.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_sketches_bound_every_count_from_above(spark):
    rows = texts(seed=5, n=40)
    for part in lexical_search.W.slices([pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})]):
        made = lexical_search._indexed(part)
        words = sorted({t for _, text in rows for t in terms_of(text)})
        h, first = lexical_search.hashed_terms(pa.array(words, pa.string()))
        assert first.tolist() == list(range(len(words) + 1))
        allowed = lexical_search.allowed(made.column("sketch"), h)
        counts = [collections.Counter(terms_of(t)) for t in part.column("text").to_pylist()]
        exact = np.array([[min(c[w], lexical_search.MOST) for w in words] for c in counts])
        assert (allowed >= exact).all()
        assert ((allowed > 0) & (exact == 0)).sum() < 0.1 * exact.size  # terms a document does not have hardly count


def test_common_words_are_rescored_for_few_documents(spark, monkeypatch):
    """Bounds carry the search: most documents with a query's words are never rescored."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(2000)] + [(5000 + i, "w1 w2 w3 w4 w5 " * 3) for i in range(12)]
    indexed = lexical_search.index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    counted = spark.sparkContext.accumulator(0)
    plain = lexical_search._rescored

    def counting(*args):
        of = plain(*args)
        return lambda row: (counted.add(1), of(row))[1]

    monkeypatch.setattr(lexical_search, "_rescored", counting)
    got = lexical_search.search(indexed, spark.createDataFrame([(1, "w1 w2 w3 w4 w5")], "item_id long, text string")).collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(k + 1, 5000 + k) for k in range(10)]
    assert 10 <= counted.value < 600


# ---- archives --------------------------------------------------------------------------


def page_rows():
    big = "é" * 90_000 + "end"
    same = "<html>" + "s" * 200 + "</html>"
    rows = [(i, f"http://h/{i % 7}?a b", same if i % 3 == 0 else f"<p>{i}</p>" * (i % 40)) for i in range(1, 200)]
    rows += [(500, "u", big), (501, None, big), (502, "u\r\nX-Page-Id: 7", "x" * 99), (503, "u", "x" * 99), (504, "u", "y" * 100), (505, "u", "y" * 100)]
    rows += [(506, "u", None), (507, "u", ""), (None, "n", same), (None, "n", None), (None, "n", "only null ids " * 20), (None, "n", "only null ids " * 20)]
    return rows + [(508, "u", "WARC/1.1\r\n\r\nin a page\r\n\r\n" * 9), (700, "a", "t" * 300), (700, "b", "t" * 300), (701, "b", "t" * 300), (-5, "u", "m" * 150), (9, "u", "m" * 150)]


def expected_pages(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if i is not None and len(data) >= 100:
            first[data] = min(first.get(data, i), i)
    out = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        to = None if to is None or to == i else to
        out[i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


@pytest.mark.parametrize("chunk,file_bytes", [(warc.CHUNK_BYTES, warc.FILE_BYTES), (7, 2000)])
def test_archives_round_trip(spark, chunk, file_bytes):
    rows = page_rows() if chunk > 7 else [r for r in page_rows() if len(r[2] or "") < 5000]
    files = warc.write_archives(frame(spark, rows, "page_id long, url string, html string", *CLASH), chunk_bytes=chunk, file_bytes=file_bytes)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    if chunk == 7:
        assert files.count() > 5 and all(r["bytes"] < 2 * 2000 + 4000 for r in files.collect())
    got = warc.page_records(warc.read_archives(spark, files, chunk))
    assert collections.Counter(map(tuple, got.collect())) == expected_pages(rows)
    whole = warc.read_archives(spark, files, chunk).filter("record_type = 'response'").orderBy("file", "record", "chunk").collect()
    parts = collections.defaultdict(list)
    for r in whole:
        parts[r["file"], r["record"]].append(r)
    for chunks in parts.values():
        data = b""
        for k, r in enumerate(chunks):
            data += bytes(r["data"])
            assert r["chunk"] == k and len(r["data"]) <= chunk and r["bytes_so_far"] == len(data)
            assert r["digest_so_far"] == hashlib.sha256(data).hexdigest() and r["last"] == (k == len(chunks) - 1)
        assert chunks[-1]["declared_digest"] == "sha256:" + chunks[-1]["digest_so_far"]
    left = collections.Counter(b"".join(bytes(r["data"]) for r in c) for c in parts.values())
    types = expected_pages(rows)
    assert sum(left.values()) == sum(n for k, n in types.items() if k[3] == "response")
    path = files.first()["path"]
    with warc.opened(path)[0].open_input_stream(warc.opened(path)[1], compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_archives_of_an_empty_table_and_foreign_archives(spark, tmp_path):
    files = warc.write_archives(frame(spark, [], "page_id long, url string, html string"))
    assert warc.page_records(warc.read_archives(spark, files)).count() == 0
    # Not compressed, other field order and case, no HTTP header, a record of no bytes.
    plain = tmp_path / "a.warc"
    plain.write_bytes(b"WARC/1.0\r\ncontent-length: 5\r\nWARC-TYPE: resource\r\nwarc-record-id: <urn:x:1>\r\n\r\nhello\r\n\r\n"
                      b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    one = spark.createDataFrame([(str(plain),)], "path string")
    got = warc.read_archives(spark, one, 2).orderBy("record", "chunk").collect()
    assert [(r["record"], r["record_type"], r["chunk"], bytes(r["data"]), r["last"]) for r in got] == [
        (0, "resource", 0, b"he", False), (0, "resource", 1, b"ll", False), (0, "resource", 2, b"o", True), (1, "response", 0, b"", True)]
    plain.write_bytes(plain.read_bytes()[:70])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, one).collect()
    packed = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 90000\r\n\r\n" + b"a" * 90_000 + b"\r\n\r\n")
    for cut, fails in ((len(packed), False), (len(packed) - 9, True)):
        plain.write_bytes(packed[:cut])
        if fails:
            with pytest.raises(Exception, match="cut off"):
                warc.read_archives(spark, one).collect()
        else:
            assert warc.read_archives(spark, one).filter("last").first()["bytes_so_far"] == 90_000


def test_readers_hold_one_piece_at_a_time():
    """A record of 40 MB, which deflates to almost nothing, never exists whole."""
    class Source:
        closed, at = False, 0
        data = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 40000000\r\n\r\n" + bytes(40_000_000) + b"\r\n\r\n")

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            return out

    assert max(map(len, warc.inflated(Source(), 1000))) <= 1000
    sizes = [len(data) for _, _, _, data, _ in warc.records(Source(), 64 << 10)]
    assert sum(sizes) == 40_000_000 and max(sizes) == 64 << 10


def test_files_of_lost_attempts_do_not_count(spark):
    folder = f"{shared_folder(spark)}/warc-of-two-{uuid.uuid4().hex}"
    files = warc.write_archives(frame(spark, page_rows()[:20], "page_id long, url string, html string"), folder)
    fs, at = warc.opened(folder)
    with fs.open_output_stream(f"{at}/part-00000-1-lost-00000.warc.gz", compression=None) as out:
        out.write(b"\x1f\x8b half a record")
    assert warc.page_records(warc.read_archives(spark, files)).count() == 20


# ---- whitening -------------------------------------------------------------------------


def check_whitening(spark, vectors, expect):
    rows = frame(spark, list(enumerate(vectors)), "vec_id long, embedding array<float>", "1 AS n", "2 AS dim", "3 AS r")
    got = collections.defaultdict(dict)
    for r in whitening.whiten(rows).collect():
        got[r["vec_id"]][r["component"]] = r
    kept = [(i, np.array(v, np.float32).astype(float)) for i, v in enumerate(vectors)
            if v and None not in v and np.isfinite(v).all() and len(v) == 12]
    x = np.array([np.floor(1024 * v) + 100_000 for _, v in kept])
    n = len(x)
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert set(got) == {i for i, _ in kept} and all(set(c) == set(range(1, expect + 1)) for c in got.values())
    total = [int(t) for t in x.sum(axis=0)]
    white = np.array([[got[i][k + 1]["whitened"] for k in range(expect)] for i, _ in kept])
    for (i, _), row in zip(kept, x):
        r = got[i][1]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(row, total))
    assert np.abs(white.T @ white / n - np.eye(expect)).max() < 1e-9
    assert all(r["identity_error"] < 1e-9 for c in got.values() for r in c.values())
    for k in range(expect):
        assert got[kept[0][0]][k + 1]["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        if all(abs(e[k] - e[j]) > 1e-6 * e[0] for j in range(12) if j != k):
            want = centred @ v[:, k] / np.sqrt(e[k])
            assert np.abs(want - np.sign(want @ white[:, k]) * white[:, k]).max() < 1e-6


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    plain = (rng.standard_normal((150, 12)) * np.logspace(0, -1.5, 12) @ np.linalg.qr(rng.standard_normal((12, 12)))[0]).tolist()
    odd = [None, [], plain[0][:5], [float("nan")] * 12, plain[1][:-1] + [float("inf")], plain[2][:-1] + [None], plain[3], plain[3]]
    check_whitening(spark, plain + odd + [plain[7]] * 80, 8)


def test_whitening_of_few_directions(spark):
    rng = np.random.default_rng(5)
    flat = np.zeros((40, 12))
    flat[:, 2], flat[:, 7] = rng.integers(-50, 50, 40) / 1024, rng.integers(-50, 50, 40) / 1024
    check_whitening(spark, flat.tolist(), 2)
    same = frame(spark, [(i, [0.5] * 12) for i in range(9)] + [(99, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["plain", "graded", "equal pairs", "rank 3", "identity", "clusters", "zero", "one"])
def test_solver(kind):
    rng = np.random.default_rng(6)
    d = 1 if kind == "one" else 40
    a = rng.standard_normal((90, d))
    if kind == "graded":
        a = a * np.logspace(0, -12, d)
    elif kind == "equal pairs":
        a = np.repeat(a[:, : d // 2], 2, axis=1)
    elif kind == "rank 3":
        a = a[:, :3] @ rng.standard_normal((3, d))
    elif kind == "identity":
        a = 3 * np.eye(d)
    elif kind == "clusters":
        a = np.diag(np.r_[5, 5, 5, 5 - 1e-9, 3, 3, 1 + 1e-13, 1, np.full(d - 8, 0.1)]) @ np.linalg.qr(rng.standard_normal((d, d)))[0].T
    elif kind == "zero":
        a = np.zeros((90, d))
    r = np.linalg.qr(a, mode="r")
    want = np.linalg.svd(r, compute_uv=False)
    diagonal, above, _ = whitening.bidiagonal(r)
    assert np.abs(whitening.singular_values(diagonal, above) - want).max() <= 1e-13 * max(want[0], 1)
    values, basis = whitening.directions(r, 8)
    assert len(values) == {"rank 3": 3, "zero": 0, "one": 1}.get(kind, 8)
    assert np.abs(basis.T @ basis - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(np.linalg.norm(r @ basis, axis=0) - values).max(initial=0) <= 1e-12 * max(want[0], 1)


def test_bidiagonal_values_keep_their_digits():
    """Small singular values of a graded bidiagonal matrix to relative accuracy."""
    diagonal, above = 10.0 ** -np.arange(0, 24, 2), 10.0 ** -np.arange(1, 23, 2)
    got = whitening.singular_values(diagonal, above)
    assert np.prod(got / diagonal) == pytest.approx(1, rel=1e-10)  # the determinant


def test_deviations_are_exact_beyond_longs():
    x = np.array([[2**50, 5], [3, 4]], np.int64)
    n, total = 10**6, [2**60, 9]
    d = whitening.deviations(x, n, total)
    assert d.tolist() == [[n * 2**50 - 2**60, n * 5 - 9], [n * 3 - 2**60, n * 4 - 9]]
    assert whitening.squared(d)[0] is None
    assert whitening.squared(np.array([[2**31, 1]])) == [2**62 + 1]
