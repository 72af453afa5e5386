"""Collocations against plain Python; fingerprints that collide, texts cut into parts."""

import random
import re
from collections import Counter

import pytest

from assize.llm.collocations import Block, collocations, phrase_counts, segments


def pieces(text):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)) if w]


def counted(rows):
    out = {}
    for text, lang in rows:
        f = out.setdefault(lang or "und", Counter())
        for w in pieces(text):
            f[()] += len(w)
            for k in range(1, 6):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return out


def brute(rows, least, most, within=100):
    out = []
    for lang, f in counted(rows).items():
        n, found = f[()], {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= within * f[p[i : i + k]]}
        made = []
        for p, a in found.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in gone:
                made.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(made)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = "the of and Fair play é ÉA x1 well-known \x00 a\x1cb".split(" ")
    stock = ["over the moon and back again", "fair play", "New York City", "a\tb  c"]

    def text():
        return "".join(rng.choice([*words, rng.choice(stock)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\x0b"]) for _ in range(rng.randint(0, 60)))

    out = [(text(), rng.choice(["en", "en", "de", None, "und"])) for _ in range(150)]
    return [*out, (None, "en"), ("", "en"), ("...", "xx"), (" \t\n", None), *[(out[0][0], "en")] * 30, ("over the moon " * 400, "de")]


def frame(spark, rows):
    return spark.createDataFrame([(t, x, "p", 1, "r", "k") for t, x in rows], "text string, lang string, phrase string, n int, rank string, k string").repartition(3)


@pytest.mark.parametrize("bits", [64, 9])
@pytest.mark.parametrize("least, most, within", [(3, 2000, 100), (5, 7, 60)])
def test_against_brute_force(spark, rows, bits, least, most, within):
    """With 9 bits most fingerprints stand for several phrases."""
    got = [tuple(r) for r in collocations(frame(spark, rows), least, most, within, bits=bits).collect()]
    assert sorted(got) == brute(rows, least, most, within)


def test_counts(spark, rows):
    got = {(r.lang, r.phrase): r.n for r in phrase_counts(frame(spark, rows), 2).collect()}
    assert got == {(lang, " ".join(p)): n for lang, f in counted(rows).items() for p, n in f.items() if n >= 2 or (not p and n)}


def test_parts_of_long_texts():
    rng = random.Random(6)
    for size in (1, 5, 17, 64):
        for _ in range(40):
            text = "".join(rng.choice(["ab", "c", "dddddddd", " ", " ", "\t", ".", "\n"]) for _ in range(rng.randint(0, 120)))
            parts = list(segments(text.encode(), size))
            assert b"".join(p[:own] for own, p in parts) == text.encode()
            got = Counter()
            for own, p in parts:
                b = Block([(0, own, p, 0)], 64)
                for k in range(1, 6):
                    got.update((b.text(i, k) for i in range(len(b.begins(k))) if b.begins(k)[i] and b.own[i]))
            assert got == Counter({" ".join(p).encode(): n for p, n in counted([(text, "x")])["x"].items() if p})


def test_products_beyond_64_bits(spark):
    """floor(1000 a n / (l r)) is exact however large the counts are."""
    from pyspark.sql import functions as F

    a, n, left, right = 7 * 10**11 + 3, 9 * 10**14 + 1, 8 * 10**11 + 7, 9 * 10**11 + 1
    score = F.expr(f"(1000 * cast({a}L as decimal(19,0)) * cast({n}L as decimal(19,0))) div (cast({left}L as decimal(19,0)) * cast({right}L as decimal(19,0)))")
    assert spark.range(1).select(score).first()[0] == 1000 * a * n // (left * right)


def test_no_documents(spark):
    assert collocations(frame(spark, [])).count() == 0
