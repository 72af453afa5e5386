"""What the byte-level BPE operators share: pre-tokens, vocabularies shipped to the tasks, and bounded memories."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Unicode's White_Space, as the tokenizer libraries read \s.
WHITE = r"\t-\r \x85\xa0  -     　"
#: A vocabulary file is a few MB whatever the corpus; anything larger is refused rather than broadcast.
MOST_VOCABULARY_BYTES = 64 << 20

#: ASCII punctuation: at a word's end, after a letter, a run of it is one pre-token of all the patterns here.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_unsafe = re.compile(rf" (?=[{WHITE}]|\Z)(?<=[{WHITE}] )")


def compiled(pattern: str) -> regex.Pattern:
    r"""The pattern with \s and \S written out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"))


def pieces(text: str) -> list[str] | None:
    """The text cut before each space, if that cuts no pre-token of the usual byte-level pattern in two, else None.

    Pre-tokens take at most one space, at their start, except in runs of white space: a space with white space on both
    sides (or at the end of the text) may lie inside a run's pre-token."""
    if _unsafe.search(text):
        return None
    first, *rest = text.split(" ")
    found = [" " + x for x in rest]
    if first:
        found.insert(0, first)
    return found


class Memory(dict):
    """A dict that computes what it lacks, of at most `most` entries and `most_chars` in its keys (one call's keys may be more).

    Beyond that it forgets all keys but those that a later call has asked for again, unless these fill half of it: words that
    one text has go, frequent ones stay and aren't learnt anew."""

    def __init__(self, most: int = 600_000, most_chars: int = 32 << 20):
        super().__init__()
        self.most, self.most_chars, self.chars, self.again = most, most_chars, 0, set()

    def frequent(self) -> dict:
        """What a later call has asked for again; nothing if that fills more than half."""
        small = 2 * len(self.again) <= self.most and 2 * sum(map(len, self.again)) <= self.most_chars
        return {k: self[k] for k in self.again} if small else {}

    def recall(self, known: dict) -> None:
        self.update(known)
        self.chars += sum(map(len, known))

    def learn(self, keys: Iterable, compute: Callable[[list], Iterable]) -> None:
        """Afterwards all keys are present."""
        wanted = set(keys)
        new = wanted.difference(self)
        wanted -= new
        self.again |= wanted
        if not new:
            return
        size = sum(map(len, new))
        if len(self) + len(new) > self.most or self.chars + size > self.most_chars:
            kept = self.frequent()
            self.clear()
            self.again, self.chars = set(), 0
            self.recall(kept)
            new |= wanted.difference(self)
            size = sum(map(len, new))
        self.chars += size
        ordered = list(new)
        self.update(zip(ordered, compute(ordered)))


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a vocabulary file, for every task."""
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


_made: dict = {}


def made(kind: str, data: bytes, make: Callable[[bytes], object]) -> object:
    """make(data), once in a Python worker."""
    key = (kind, hashlib.sha1(data).digest())
    if key not in _made:
        _made[key] = make(data)
    return _made[key]
