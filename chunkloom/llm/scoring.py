"""Language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts up to `ORDER` bytes long holds how often each byte followed. A byte's probability in a context
that has n followers, d of them different, is (count - 1/2) / n; d / 2n is left for escaping to the next shorter context,
where the bytes that the longer one has seen are excluded; below the empty context, what is left is dealt evenly. The model is
pretrained on the training rows; contexts that it has not seen cost no escape. A word model with add-one smoothing serves
as the base to compare with.

Scale: counts are summed over all training rows, words by a shuffle; words are joined back to blocks of documents, not
broadcast. The trie lies in the shared folder in slices of bounded size, by the two latest bytes of the context, and
workers go through the slices one at a time: none holds more than one, and the driver none, however large the corpus.

Edge cases: a null text is an empty one and has the end alone; with no training rows each byte is dealt evenly;
repeated rows are scored each, and learned from each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import arrow_map, drop_table, gathered, materialise, read, shared_dir
from chunkloom.llm.warc import file_system
from chunkloom.llm.words import LOWER, hashes

#: Bytes of the longest context. One byte that UTF-8 never has stands for the end of a text, and before its beginning.
ORDER, END = 5, b"\xff"
#: Entries of a slice of the trie; text bytes of a block of documents.
SLICE_ENTRIES, BLOCK_BYTES = 1_000_000, 32 << 20
#: Text bytes that are scored at once.
PART_BYTES = 512 << 10
SYMBOLS = 256
END_HASH = np.int64(0)


def keys_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte, as a number whose lowest byte is the byte, of each byte and end; place of each text's first)."""
    pad = END * ORDER
    data = LOWER[np.frombuffer(pad + pad.join(texts) + pad + b"\0" * 8, np.uint8)].tobytes()
    n = len(data) - 8 - ORDER
    keys = np.ndarray(n, ">u8", data, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (7 - ORDER))
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(np.r_[0, sizes + ORDER])
    wanted = np.ones(n, bool)
    for i in range(1, ORDER):  # the padding after each end is no symbol
        wanted[first[1:] - ORDER + i] = False
    return keys[wanted], np.cumsum(np.r_[0, sizes + 1])


class Level:
    """The contexts of one length: entries (context and byte), and of each context its followers, different ones, and
    how often its bytes followed the next shorter context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, below: Level | None):
        self.keys, self.counts = keys, counts
        owner = keys >> np.uint64(8)
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.contexts = owner[at]
        self.n = np.add.reduceat(counts, at) if len(at) else counts
        self.d = np.diff(np.r_[at, len(keys)])
        if below is None:
            self.seen_below = np.zeros(len(at), np.int64)
        else:
            under = below.counts[np.searchsorted(below.keys, keys & np.uint64((1 << below.bits) - 1))]
            self.seen_below = np.add.reduceat(under, at) if len(at) else under
        self.bits = 8 + (below.bits if below else 0)


def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each x in a sorted table."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class Model:
    """Log10 probabilities under the trie of the longest contexts' counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray):
        """keys: sorted entries of the longest contexts; low_: entries of contexts of one byte, over the whole corpus."""
        self.levels: list[Level] = []
        for k in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            src, n = (low_keys, low_counts) if k < 2 else (keys, counts)
            u, inverse = np.unique(src & mask, return_inverse=True)
            self.levels.append(Level(u, np.bincount(inverse, n, len(u)).astype(np.int64), self.levels[-1] if k else None))
        top = self.levels[-1]
        owner = np.repeat(np.arange(len(top.contexts)), top.d)
        self.top_log = np.log10((top.counts - 0.5) / top.n[owner]) if len(owner) else np.zeros(0)
        # Entries of the longest contexts by a hash, so that most bytes are found with a few steps.
        self.bits = max(10, int(2 * len(top.keys)).bit_length())
        slot = self.slot(top.keys)
        order = np.argsort(slot, kind="stable")
        self.slot_keys, self.slot_log = top.keys[order], self.top_log[order].astype(np.float32)
        self.slot_first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.slot_first).max())

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), np.nan)
        if len(self.slot_keys):
            slot = self.slot(keys)
            at, stop = self.slot_first[slot], self.slot_first[slot + np.uint64(1)]
            todo = np.flatnonzero(at < stop)
            at, stop = at[todo], stop[todo]
            for _ in range(self.deepest):
                hit = self.slot_keys[at] == keys[todo]
                out[todo[hit]] = self.slot_log[at[hit]]
                on = ~hit & (at + 1 < stop)
                todo, at, stop = todo[on], at[on] + 1, stop[on]
                if not len(todo):
                    break
        rare = np.flatnonzero(np.isnan(out))
        if len(rare):
            u, inverse = np.unique(keys[rare], return_inverse=True)
            out[rare] = self.escaped(u)[inverse]
        return out

    def escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same, the long way: from the longest known context down, with exclusion of what longer ones have seen."""
        total, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        seen_n, seen_d = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            entry = keys & np.uint64((1 << level.bits) - 1)
            c, known = find(level.contexts, entry >> np.uint64(8))
            e, there = find(level.keys, entry)
            known &= open_
            n = np.where(known, level.n[c] - seen_n, 0) if len(level.n) else seen_n * 0
            d = np.where(known, level.d[c] - seen_d, 0) if len(level.d) else seen_d * 0
            hit, miss = known & there, known & ~there & (d > 0)
            total[hit] += np.log10((level.counts[e[hit]] - 0.5) / n[hit])
            total[miss] += np.log10(0.5 * d[miss] / n[miss])
            open_ &= ~hit
            left = known & open_
            if left.any():
                seen_n[left], seen_d[left] = level.seen_below[c[left]], level.d[c[left]]
        total[open_] -= np.log10(np.maximum(SYMBOLS - seen_d[open_], 1))
        return total


#: The slice that a worker holds, by its path and number.
_MODELS: dict[tuple[str, int], Model] = {}


def entries(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of a table in the shared folder; empty if it has no rows."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, path = file_system(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["key", "n"])
    keys, counts = got["key"].to_numpy().astype(np.uint64), got["n"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def slice_of(keys, slices: int):
    """The slice of an entry: by the two latest bytes of its context. Works on numpy arrays and on columns."""
    if isinstance(keys, np.ndarray):
        return ((keys >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65536) % np.uint64(slices)
    return F.shiftright(keys, 8).bitwiseAND(F.lit(0xFFFF).cast("long")) * 40503 % 65536 % slices




def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train", slice_entries: int = SLICE_ENTRIES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens long, base_score, score double) of each row; rows whose
    `train_col` is true are learned from. Scores are log10 probabilities of the text with A-Z in lower case, and its end."""
    spark = df.sparkSession
    per_scan = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB")) if spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("bB").isdigit() else 128 << 20
    parts, scans = max(1, -(-per_scan // BLOCK_BYTES)), max(1, BLOCK_BYTES // per_scan)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    docs = docs.withColumn("block", F.floor(F.spark_partition_id() / scans) * parts + F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    # A folder for each block: its texts are read where its words are, without a shuffle.
    blocks, schema = shared_dir(spark, "blocks"), docs.schema
    docs.write.partitionBy("block").parquet(blocks)
    docs = spark.read.schema(schema).parquet(blocks)

    def count(it: Iterator[dict]) -> Iterator[dict]:
        """Rows (kind, block, key, n): 0, a word of the block and how often the training rows there have it; 1, an entry of
        the longest contexts; 2, the number of training tokens; the end counts as a word with hash 0."""

        def grouped(held: list) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            u, inverse = np.unique(keys, return_inverse=True)
            return u, np.bincount(inverse, counts, len(u)).astype(np.int64)

        _MODELS.clear()
        words: dict[int, list] = {}
        grams: list = []
        tokens = 0
        for cols in gathered(it, "text", PART_BYTES):
            raw = [t.encode() for t in cols["text"]]
            train, block = np.array(cols["train"]), np.array(cols["block"])
            h, first = hashes(raw)
            of = np.repeat(np.arange(len(raw)), np.diff(first))
            for b in np.unique(block):
                mine = (block == b)[of]
                u, inverse = np.unique(np.r_[h[mine].view(np.int64), END_HASH], return_inverse=True)
                n = np.bincount(inverse, np.r_[train[of[mine]], (train & (block == b)).sum()], len(u))
                words.setdefault(int(b), []).append((u, n))
            tokens += int(train[of].sum() + train.sum())
            learn = [r for r, t in zip(raw, train, strict=True) if t]
            if learn:
                grams.append(np.unique(keys_of(learn)[0], return_counts=True))
                if len(grams) > 8:
                    grams = [grouped(grams)]
        out = [(0, b, *grouped(held)) for b, held in words.items()]
        if grams:
            out.append((1, 0, *grouped(grams)))
        out.append((2, 0, np.zeros(1, np.int64), np.array([tokens])))
        for kind, b, keys, n in out:
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000].astype(np.int64)
                yield {"kind": [kind] * len(part), "block": [b] * len(part), "key": part.tolist(), "n": n[i : i + 100_000].astype(np.int64).tolist()}

    counted = materialise(arrow_map(docs.select("text", "train", "block"), count, "kind int, block long, key long, n long"), "counts")
    of_word = Window.partitionBy("key")
    # A block that several tasks read has several rows of a word; each gets the same count.
    words = counted.where("kind = 0").select("block", "key", F.sum("n").over(of_word).alias("c"), (F.row_number().over(of_word.orderBy("block")) == 1).alias("first"))
    words = materialise(words, "words")
    kinds = int(words.agg(F.count_if(F.col("first") & (F.col("c") > 0))).first()[0])
    tokens = int(counted.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])

    grams = counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "grams")
    slices = max(1, -(-grams.count() // slice_entries))
    path = shared_dir(spark, "trie")
    # Counts stay in the shared folder, a file set for each slice; each worker makes its tables of them.
    grams.withColumn("slice", slice_of(F.col("key"), slices).cast("int")).repartition(slices, "slice").write.partitionBy("slice").parquet(f"{path}/high")
    low = grams.groupBy((F.col("key").bitwiseAND(F.lit(0xFFFF).cast("long"))).alias("key")).agg(F.sum("n").alias("n"))
    low.coalesce(1).write.parquet(f"{path}/low")

    def model(i: int) -> Model:
        if (path, i) not in _MODELS:
            _MODELS.clear()
            _MODELS[path, i] = Model(*entries(f"{path}/high/slice={i}"), *entries(f"{path}/low"))
        return _MODELS[path, i]

    def block(words_of):
        import pandas as pd
        import pyarrow.dataset as ds

        known = words_of.sort_values("key")
        keys, counts = known["key"].to_numpy(np.int64), known["c"].to_numpy(np.int64)
        system, place_of = file_system(f"{blocks}/block={words_of['block'].iloc[0]}")
        ids, train, raw = [], [], []
        for batch in ds.dataset(place_of, filesystem=system, format="parquet").to_batches(columns=["id", "text", "train"], batch_size=1024):
            ids += batch["id"].to_pylist()
            train += batch["train"].to_pylist()
            raw += [t.encode() for t in batch["text"].to_pylist()]
        parts, at = [], 0
        while at < len(raw):
            stop, size = at, 0
            while stop < len(raw) and (stop == at or size + len(raw[stop]) <= PART_BYTES):
                size += len(raw[stop])
                stop += 1
            parts.append((at, stop))
            at = stop
        cols = np.zeros((4, len(raw)))
        for a, b in parts:
            h, first = hashes(raw[a:b])
            c = counts[np.searchsorted(keys, h.view(np.int64))] if len(h) else np.zeros(0, np.int64)
            logs = np.r_[0.0, np.cumsum(np.log10(c + 1.0))]
            seen = np.r_[0, np.cumsum(c > 0)]
            cols[:3, a:b] = np.diff(first), seen[first[1:]] - seen[first[:-1]], logs[first[1:]] - logs[first[:-1]]
        for i in range(slices):
            for a, b in parts:
                symbols, place = keys_of(raw[a:b])
                found = np.zeros(len(symbols))
                mine = slice(None) if slices == 1 else np.flatnonzero(slice_of(symbols, slices) == i)
                found[mine] = model(i).log10(symbols[mine])
                cols[3, a:b] += np.add.reduceat(found, place[:-1])
        return pd.DataFrame({"id": pd.Series(ids, dtype=object), "train": train, "words": cols[0].astype(np.int64), "known": cols[1].astype(np.int64), "logs": cols[2], "score": cols[3]})

    ends = int(counted.where("kind = 0 and key = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    drop_table(counted)
    kind = dict(df.dtypes)[id_col]
    scored = words.select("block", "key", "c").groupBy("block").applyInPandas(block, f"id {kind}, train boolean, words long, known long, logs double, score double")
    of_all = math.log10(tokens + kinds + 1)
    return scored.select(
        F.col("id").alias(id_col), "train", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) - (F.col("words") + 1) * of_all).alias("base_score"), "score",
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train"))
    return score_documents(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
