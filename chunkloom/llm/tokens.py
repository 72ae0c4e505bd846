"""Byte-pair encoding by a prefix-sharing trie, and decoding.

The encoding of a word is fixed by one token at each of its prefixes: the last token of that prefix's own encoding.
Of the vocabulary's tokens that end a prefix, it is the only one that the encoding of what precedes it may be followed
by, which two tokens alone decide. So distinct words go into a trie of bytes, a depth-first walk hands each node's
last token down, and what words share at their beginnings is worked out once. Decoding looks each id's bytes up.

Words of more than LONG_WORD bytes share nothing worth a trie and are walked alone, with two numbers for each byte. The library's
own tables of letters, numbers and white space decide about words: texts with a code point on which Python's tables differ are
cut into words by the library.

Edge cases: null texts are empty and have no tokens; strings of added tokens in a text become those tokens, as in the
library; ids outside the vocabulary decode to nothing; equal texts give equal ids; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import arrow_map, gathered, read

#: How byte-level tokenizers of this family cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Distinct words, and letters of them, that a Python worker remembers the encodings of; beyond either, it starts afresh.
CACHE_WORDS, CACHE_LETTERS = 1_000_000, 16 << 20
LONG_WORD = 2048


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabularies: printable Latin-1 for itself, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The most frequent code points, on which all tables agree.
AGREED = re.compile("[^\x00-\u024f\u0370-\u0377\u0400-\u052f\u2010-\u2027\u20ac]")


@lru_cache(1)
def disputed() -> frozenset[str]:
    """The code points that the library puts into another class than Python's tables do."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    differ: set[str] = set()
    for theirs, ours in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        # Runs of the class and of the rest take turns; the first code point is in none.
        runs = [span for _, span in pre_tokenizers.Split(Regex(theirs), "contiguous").pre_tokenize_str(every)]
        of_library = {every[i] for a, b in runs[1::2] for i in range(a, b)}
        differ |= of_library ^ set(regex.findall(ours, every))
    return frozenset(differ)


class Codec:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        # The vocabulary's tokens spelt backwards, as a trie of numbered nodes: what ends a prefix is found by one walk.
        self.back: dict[int, int] = {}
        self.back_token: list[int] = [-1]
        for b, i in self.id_of.items():
            node = 0
            for byte in reversed(b):
                at = node << 8 | byte
                node = self.back.get(at, 0)
                if not node:
                    node = self.back[at] = len(self.back_token)
                    self.back_token.append(-1)
            self.back_token[node] = i
        # The pair that makes each token, and the order in which pairs merge.
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.age: dict[int, int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = (self.id_of[bytes(letters[c] for c in s)] for s in (a, b))
            z = self.id_of[self.bytes_of[x] + self.bytes_of[y]]
            self.rank.setdefault((x, y), n)
            self.halves.setdefault(z, (x, y))
            self.age.setdefault(z, n)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.cut, self.odd = regex.compile(WORDS), disputed()
        self.cut_added = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.letters = 0

    def words(self, text: str) -> list[str]:
        if text.isascii() or not AGREED.search(text) or self.odd.isdisjoint(text):
            return self.cut.findall(text)
        from tokenizers import pre_tokenizers

        return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is a, b: no merge across the border comes before the merges
        that make the two. Undoes the later of the two last merges at the border, and asks again."""
        if (got := self.fits.get(a << 32 | b)) is not None:
            return got
        x, y, limit, ok = a, b, len(self.rank), True
        while True:
            joined = self.rank.get((x, y))
            if joined is not None and joined < limit:
                ok = False
                break
            left, right = self.age.get(x, -1), self.age.get(y, -1)
            if left < 0 and right < 0:
                break
            # Until merge number `limit`, the border stood between what x and y are now. Of equal merges the left one is earlier.
            if left > right:
                limit, x = left, self.halves[x][1]
            else:
                limit, y = right + 1, self.halves[y][0]
                if left == right:
                    limit = right
        self.fits[a << 32 | b] = ok
        return ok

    def encode_long(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word, by the walk of `learn` on a path without branches."""
        last, size = array("i"), array("i")
        for depth in range(len(word)):
            at, here, ends = depth, 0, []
            while at >= 0 and (here := self.back.get(here << 8 | word[at], 0)):
                if self.back_token[here] >= 0:
                    ends.append((self.back_token[here], at))
                at -= 1
            token, at = next(((t, a) for t, a in reversed(ends) if not a or self.follows(last[a - 1], t)), (-1, 0))
            if token < 0:
                raise ValueError(f"the vocabulary has no token for byte {word[depth]}")
            last.append(token)
            size.append(depth + 1 - at)
        ids, at = array("i"), len(word)
        while at:
            ids.append(last[at - 1])
            at -= size[at - 1]
        return tuple(reversed(ids))

    def learn(self, words: set[str]) -> None:
        """Encodes distinct words by one walk over their trie. A node is the dict of its children by byte; at -1 it
        has the word that ends there."""
        root: dict = {}
        for word in words:
            self.letters += len(word)
            if len(word) > LONG_WORD:
                self.known[word] = self.encode_long(word.encode())
                continue
            node = root
            for byte in word.encode():
                child = node.get(byte)
                if child is None:
                    child = node[byte] = {}
                node = child
            node[-1] = word
        path, last, size = bytearray(), [], []  # the bytes above a node; the last token and its length at each of them
        back, back_token, fits, follows, known = self.back.get, self.back_token, self.fits.get, self.follows, self.known
        stack = [(byte, node, 0) for byte, node in root.items()]
        while stack:
            byte, node, depth = stack.pop()
            del path[depth:], last[depth:], size[depth:]
            path.append(byte)
            at, here, ends = depth, 0, []
            while at >= 0 and (here := back(here << 8 | path[at], 0)):
                if back_token[here] >= 0:
                    ends.append((back_token[here], at))
                at -= 1
            while ends:
                token, at = ends.pop()
                if not at:
                    break
                before = last[at - 1]
                ok = fits(before << 32 | token)
                if follows(before, token) if ok is None else ok:
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {byte}")
            depth += 1
            last.append(token)
            size.append(depth - at)
            for b, child in node.items():
                if b >= 0:
                    stack.append((b, child, depth))
                else:
                    ids, at = [], depth
                    while at:
                        ids.append(last[at - 1])
                        at -= size[at - 1]
                    known[child] = tuple(reversed(ids))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        pieces: list[list[str | int]] = []  # of each text: lists of words, and ids of added tokens
        missing: set[str] = set()
        if len(self.known) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.known.clear()
            self.letters = 0
        if len(self.fits) > 4 * CACHE_WORDS:
            self.fits.clear()
        find = self.words
        for text in texts:
            parts, at = [], 0
            for m in self.cut_added.finditer(text or "") if any(x in (text or "") for x in self.added) else ():
                parts += [find(text[at : m.start()]), self.added[m[0]]]
                at = m.end()
            parts.append(find((text or "")[at:]))
            for p in parts:
                if not isinstance(p, int):
                    missing.update(p)
            pieces.append(parts)
        missing -= self.known.keys()
        if missing:
            self.learn(missing)
        get = self.known.__getitem__
        return [list(chain.from_iterable(chain.from_iterable([(p,)] if isinstance(p, int) else map(get, p) for p in parts))) for parts in pieces]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text."""

    def work(it):
        for cols in gathered(it, "_text"):
            yield {id_col: cols[id_col], "ids": codec(vocabulary).encode_batch(cols["_text"])}

    return arrow_map(df.select(id_col, F.col(text_col).alias("_text")), work, f"{id_col} {dict(df.dtypes)[id_col]}, ids array<int>")


def bpe_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text string) of each row's ids."""

    def work(it):
        for cols in it:
            yield {id_col: cols[id_col], "ids": cols["_ids"], "text": [codec(vocabulary).decode(x or []) for x in cols["_ids"]]}

    return arrow_map(df.select(id_col, F.col(ids_col).alias("_ids")), work, f"{id_col} {dict(df.dtypes)[id_col]}, ids array<int>, text string")


def bpe_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens long, ids_sha256, decoded_sha256) of each row: encoded and decoded in one pass, so that the ids
    of large corpora need not leave the worker. Equal to digests of `bpe_encode` and `bpe_decode`."""
    import hashlib

    def work(it):
        bpe = codec(vocabulary)
        decimal = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        for cols in gathered(it, "_text"):
            ids = bpe.encode_batch(cols["_text"])
            yield {
                id_col: cols[id_col],
                "n_tokens": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode_bytes(x).decode("utf-8", "replace").encode()).hexdigest() for x in ids],
            }

    return arrow_map(df.select(id_col, F.col(text_col).alias("_text")), work, f"{id_col} {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))




QUERIES = {"op1_bpe": op1_bpe}
