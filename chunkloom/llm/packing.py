"""Best-fit packing of token sequences by minimum bin slack.

Per bin, the longest available piece is taken and a subset-sum program over the other available lengths, with bitsets,
finds the fullest feasible combination; it is then removed. Only how many pieces have each length matters, so the
plan is made from a histogram of at most `capacity` numbers and a combination is repeated as long as its lengths last.
Each combination leaves less of some length than it takes of it, half at most of what there was, so their number is
bounded by about four times `capacity`, whatever the number of pieces. Pieces find their places by their rank among those of their length.

Edge cases: a null or empty text is a document of the end id alone; documents longer than a sequence are cut into full
pieces and a last one that may be shorter; repeated rows are packed each; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import arrow_map, gathered, materialise, rank_within, read
from chunkloom.llm.tokens import byte_letters

CAPACITY, END_ID = 4096, 1
#: Code points that need no Unicode normalisation, as spans: texts with others go through the library whole.
PLAIN = ((0x00, 0x24F), (0x2010, 0x2027), (0x20AC, 0x20AC))
#: Words whose ids are remembered.
CACHE_WORDS = 400_000


@lru_cache(1)
def plain_words() -> re.Pattern:
    """How the tokenizer cuts normalised texts of PLAIN code points into words; the library tells letters, numbers and blanks."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for a, b in PLAIN for c in range(a, b + 1))

    def of(kind: str) -> str:
        # Runs of the kind and of the rest take turns; the first code point is in none.
        runs = pre_tokenizers.Split(Regex(kind), "contiguous").pre_tokenize_str(every)[1::2]
        return "".join(re.escape(every[i]) for _, (a, b) in runs for i in range(a, b))

    letters, numbers, blanks = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


class Known(dict):
    """Numbers words as they are looked up; `new` has those that came last."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordTokenizer:
    """Token ids as little-endian 32-bit bytes; remembers the ids of words, which the library's model finds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words = plain_words()
        self.odd = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in PLAIN) + "]")
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known, self.ids = Known(), []

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        spelt = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))
        return b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.ids = Known(), []
        found: list[list[int] | bytes] = []
        number, cut = self.known.__getitem__, self.words.findall
        for text in texts:
            if (not text.isascii() and self.odd.search(text)) or any(s in text for s in self.added):
                found.append(self.whole(text))
            else:
                found.append(list(map(number, cut(text.lower()))))
        self.ids += map(self.word, self.known.new)
        self.known.new.clear()
        ids = self.ids.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(ids, x)) for x in found]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces_of(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece int, start long, length long, ids_crc32 long, ids binary): each document's ids, cut to `capacity`."""

    def work(it: Iterator[dict]) -> Iterator[dict]:
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for cols in gathered(it, "_text", 2 << 20):
            out: dict[str, list] = {k: [] for k in (id_col, "piece", "start", "length", "ids_crc32", "ids")}
            for i, ids in zip(cols[id_col], tokenizer(vocabulary).encode([x or "" for x in cols["_text"]]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for k, v in zip(out, (i, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        out[k].append(v)
            yield out

    return arrow_map(df.select(id_col, F.col(text_col).alias("_text")), work, f"{id_col} {dict(df.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long, ids binary")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, copies) whose sum comes closest to `room`, by a bitset of reachable sums; longer ones first."""
    reach, steps, goal = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= (reach << length * copies) & goal
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + copies
            at -= length * copies
    return list(taken.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, copies)], repetitions) of bins that take all of `counts` (length: pieces)."""
    counts, bins = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = dict(fullest(counts, capacity - longest) if longest < capacity else [])
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in taken.items())
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        bins.append((sorted(taken.items(), reverse=True), times))
    return bins


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id long and offset long to rows that have a length of 1 to `capacity`; `order` tells rows apart.
    `pieces` must give the same rows when it is computed again."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans, used, first = [], dict.fromkeys(counts, 0), 0
    for items, times in plan(counts, capacity):
        at = 0
        for length, copies in items:
            spans.append((length, used[length], used[length] + copies * times, times, first, at))
            used[length] += copies * times
            at += length * copies
        first += times
    # Combinations are bounded (see above), and so are the different lengths of each, sqrt(2 * capacity) at most.
    places = pieces.sparkSession.createDataFrame(spans, "length long, _lo long, _hi long, _times long, _first long, _at long")
    ranked = rank_within(pieces, ["length"], [F.col(c) for c in order], "_rank")
    inside = (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = ranked.join(F.broadcast(places), "length").where(inside)
    nth = F.col("_rank") - F.col("_lo")
    return placed.withColumn("sequence_id", F.col("_first") + nth % F.col("_times")).withColumn("offset", F.col("_at") + F.floor(nth / F.col("_times")) * F.col("length")).drop("_rank", "_lo", "_hi", "_times", "_first", "_at")


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document."""
    pieces = materialise(pieces_of(df, vocabulary, id_col, text_col, capacity).drop("ids"), "pieces")
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
