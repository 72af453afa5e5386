"""Every registered query of the subpackage on a small scale factor, against plain Python, the libraries or SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from assize.llm import queries
from tests.llm.test_duplicates import bits_of, brute, components
from tests.llm.test_tokens import check_bins

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.project(", ".join(names)).fetchall())


def test_shards(spark, documents):
    rows = rows_of(spark, "op1_ring_shards")
    by = defaultdict(list)
    for r in rows:
        text = (documents[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 8, zlib.crc32(text)) and r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert len(rows) == len(documents) and set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_repeats(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows_of(spark, "op2_substring_dedup")}
    order = sorted(documents)
    for i, (left, gone, runs) in zip(order, brute([(i, (documents[i] or "").encode()) for i in order], 100)):
        assert got[i] == (len((documents[i] or "").encode()), gone, runs, hashlib.sha256(left).hexdigest())


def test_packing(spark, documents):
    rows = rows_of(spark, "op4_residual_packing")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in documents.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert check_bins(rows, 4096) <= 1.02 * -(-sum(w[3] for w in want) // 4096) + 1


def test_classes(spark, documents):
    rows = {r.doc_id: r for r in rows_of(spark, "op6_simhash")}
    order = sorted(documents)
    fp = [bits_of(documents[i]) for i in order]
    root = components(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    assert all((rows[i].fingerprint, rows[i].component_id) == (f"{fp[n]:016x}", order[root[n]]) for n, i in enumerate(order))


def test_token_counts(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows_of(spark, "op7_token_counts"):
        n = len(library.encode(documents[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((documents[r.doc_id] or "").encode()), n, n > 512)


def test_perplexity(spark, documents):
    rows = {r.doc_id: r for r in rows_of(spark, "op8_perplexity")}
    assert set(rows) == set(documents) and all(r.n_tokens == len((documents[i] or "").encode().split()) + 1 for i, r in rows.items())
    junk = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    good = [rows[i].kept for i, q in junk.items() if q == 1]
    bad = [rows[i].kept for i, q in junk.items() if q == 0]
    assert sum(good) / len(good) > sum(bad) / len(bad)


def test_encoding(spark, documents):
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in rows_of(spark, "op9_byte_bpe"):
        t = documents[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_winnowing(spark, documents):
    rows = {r.doc_id: r for r in rows_of(spark, "op10_winnowing")}
    order = sorted(documents, reverse=True)
    marks = lambda fp: {fp[i : i + 8] for i in range(0, len(fp), 8)}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    seen = {}
    for n, i in enumerate(order):
        t, following = documents[i] or "", order[(n + 1) % len(order)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + (documents[following] or "")[:cut]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(marks(r.fingerprint), marks(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(like(marks(r.fingerprint), marks(rows[following].fingerprint)))
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint and r.n_marks == len(r.fingerprint) // 8
        places = [int(p) for p in r.places.split(",") if p]
        assert len(places) == r.n_marks and places == sorted(set(places)) and (not places or places[-1] < max(1, len(t.encode().split())))
