"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from assize.llm import byte_bpe, packing, pretokens, token_counts

JSON, RANKS, CLIP = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))
ODD = "abIxS  '.,\n\té世 Σσİ'll12<|endoftext|>\x1c\x85　́K-"


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(2)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>a<|endoftext|>", "a" * 3000, "!" * 3001, " \n \n ", "<|ENDOFTEXT|> x.", "", None]


def test_counts_are_the_library_s(texts, strange):
    counter = token_counts.TokenCounter(open(JSON, "rb").read())
    all_ = texts + strange
    assert counter.of_texts(all_) == [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch([t or "" for t in all_], add_special_tokens=False)]


def test_memory_forgets():
    counter = token_counts.TokenCounter(open(JSON, "rb").read())
    counter.pieces.most = counter.pretokens.most = 5
    texts = ["one two three four five six seven", "eight nine ten one"] * 2
    assert [counter.of_texts([t])[0] for t in texts] == [7, 4, 7, 4]


def test_ids_are_the_library_s_and_decode_back(texts, strange):
    data = open(RANKS, "rb").read()
    bpe = byte_bpe.ByteBpe(data, public_tokenizers.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t, ids in zip(texts + strange, bpe.encoded(texts + strange)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert bpe.decoded(ids) == (t or "").encode()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_perfect_hash(n):
    keys = [f"key{i}".encode() for i in range(n)]
    table = byte_bpe.PerfectHash(keys)
    if n:
        assert table.find(keys).tolist() == list(range(n))
        assert sorted(table.key_at.tolist()) == list(range(n))
        assert set(table.find([b"other", b"", b"key"]).tolist()) == {-1}


def test_operators_over_frames(docs, odd_docs, no_docs, texts):
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, JSON).collect()}
    library = Tokenizer.from_file(JSON)
    assert counts == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    digests = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts))
    for f in (lambda d: token_counts.token_counts(d, JSON), lambda d: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN)):
        assert f(odd_docs).count() == 8 and f(no_docs).count() == 0


# ---------------------------------------------------------------- packing


def test_word_ids_are_the_library_s(texts, strange):
    mine = packing.WordTokenizer(open(CLIP, "rb").read())
    all_ = texts + strange
    want = [e.ids for e in Tokenizer.from_file(CLIP).encode_batch([t or "" for t in all_], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in mine.of_texts(all_)] == want


def test_pieces_and_packing(docs, odd_docs, no_docs, texts):
    rows = packing.pack(packing.token_pieces(docs, CLIP, capacity=256), capacity=256).collect()
    library = Tokenizer.from_file(CLIP)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        part = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.start, r.length, r.ids_crc32) == (len(whole.get(r.doc_id, [])), len(part), zlib.crc32(bytes(r.ids)))
        whole.setdefault(r.doc_id, []).extend(part)
    assert whole == ids
    check_bins(rows, 256)
    assert packing.pack(packing.token_pieces(odd_docs, CLIP)).count() == 8
    assert packing.pack(packing.token_pieces(no_docs, CLIP)).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert all(v <= capacity for v in bins.values())
    return len(bins)


def test_rounds_merge_what_partitions_leave(spark):
    rng = random.Random(3)
    lengths = [rng.randint(1, 400) for _ in range(3000)] + [1000] * 5
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id int, length bigint, bin string").repartition(40)
    out = packing.pack(rows, capacity=1000, fan_in=4)
    got = out.collect()
    assert len(got) == len(lengths) and got[0].bin == "x"
    assert check_bins(got, 1000) <= 1.02 * -(-sum(lengths) // 1000) + 1
    large = spark.createDataFrame([(i, 600) for i in range(50)], "id int, length bigint").repartition(7)
    assert check_bins(packing.pack(large, capacity=1000, fan_in=2).collect(), 1000) == 50


def test_lengths_are_checked(spark):
    with pytest.raises(Exception, match="lengths must lie"):
        packing.pack(spark.createDataFrame([(0,)], "length bigint"), capacity=10).collect()


def test_word_tokenizer_remembers_a_million_words():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        words = packing.WordTokenizer(f.read()).words
    for first in (0, 500_000):
        words.learn([b"%d" % i for i in range(first, first + 500_000)], lambda new: [b""] * len(new))
    # Before, half of them were forgotten; there still is a bound.
    assert len(words) == 1_000_000
    words.learn([b"x%d" % i for i in range(600_000)], lambda new: [b""] * len(new))
    assert len(words) == 600_000


def test_memory_keeps_what_is_asked_for_again():
    memory, asked = pretokens.Memory(most=10), []

    def compute(new):
        asked.extend(new)
        return [len(x) for x in new]

    for i in range(40):
        memory.learn(["often", *(f"{i} {j}" for j in range(3))], compute)
    assert asked.count("often") == 1 and len(memory) <= 10 and memory["often"] == 5
    # What fills more than half is forgotten as a whole.
    for _ in range(2):
        memory.learn([f"x{i}" for i in range(9)], compute)
    memory.learn(["y", "z"], compute)
    assert set(memory) == {"y", "z"}


def test_word_tokenizer_s_memory_is_bounded_and_handed_on(texts):
    data = open(CLIP, "rb").read()
    first = packing.WordTokenizer(data)
    want = [first.of_texts(texts) for _ in range(2)][0]
    second = packing.WordTokenizer(data, first.kept())
    assert len(second.words) and second.of_texts(texts) == want
    for i in range(12):
        second.words.learn([b"%012d" % j for j in range(i * 100_000, (i + 1) * 100_000)], lambda new: [b""] * len(new))
    assert sum(map(len, second.words)) <= 10 << 20


def test_words_of_letters_leave_the_library_s_expressions_out():
    rng, mine, library = random.Random(4), packing.WordTokenizer(open(CLIP, "rb").read()), Tokenizer.from_file(CLIP)
    words = ["".join(rng.choice("abstzß\xb5éÿ\xf7\xbá'|.,#<>-12Ǆ") for _ in range(rng.randint(1, 9))).encode().lower() for _ in range(5000)]
    whole, seen = mine.of_library, []
    mine.of_library = lambda texts: seen.extend(texts) or whole(texts)
    got = mine.of_words(words + [b"straw", b"na\xc3\xafve,", b"word.###"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:-3]] == [e.ids for e in library.encode_batch([w.decode() for w in words], add_special_tokens=False)]
    assert not any(x in t for t in seen for x in ("straw", "naïve", "word"))


def test_one_worker_makes_the_pieces_and_packs_them(docs, odd_docs, no_docs):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    two = packing.pack(packing.token_pieces(docs, CLIP, capacity=256, with_ids=False), capacity=256).collect()
    for lasting in (True, False):
        one = packing.packed_documents(docs, CLIP, capacity=256, lasting=lasting)
        rows = one.collect()
        assert sorted([r[c] for c in columns] for r in rows) == sorted([r[c] for c in columns] for r in two)
        assert check_bins(rows, 256) == check_bins(two, 256)
    assert packing.packed_documents(odd_docs, CLIP).count() == 8
    assert packing.packed_documents(no_docs, CLIP).count() == 0
