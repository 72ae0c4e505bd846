"""N-gram Jaccard join by signature trees: which texts share at least 80 % of their five-word shingles.

In a signature tree a leaf holds a set's size and its tokens folded into a bitmap, and a node holds the OR of its
children's bitmaps and the range of their sizes. Two trees are traversed together: the sets below two nodes can have no more
in common than the bits that both have allow, and a pair of nodes whose bound is below the needed overlap is dropped
whole. Pairs of leaves that are left are compared by their whole sets. Sets that are already known to be in one component
are not compared again.

Trees over a whole corpus would have full bitmaps near the root and prune nothing, so a forest is built: two sets
can only be similar if they share one of their n - ceil(0.8 n) + 1 rarest tokens, so sets chained by such tokens (and
by sizes within 0.8) form blocks, found by a shuffle of those tokens alone; each block has a tree. Blocks of more than
TILE_TOKENS tokens are cut by size into tiles, each a subtree, and pairs of tiles with compatible sizes are traversed in
tasks of their own. Rarity is by counts in a fixed number of buckets, over all documents, so the larger the corpus, the more tokens
of a few sets pass for rare, and chains of texts that quote one another would run through the corpus. So a token of up to PAIRED
sets links only those pairs whose bitmaps allow it; these bitmaps are as wide as a set is large. Trees are traversed twice: with the leaves'
bitmaps alone, which splits blocks into smaller ones, and then, for what is left in blocks, with whole sets.

Equal sets are one class, told by 128 bits of a hash of the set. One plan holds at every size: texts are never shuffled, they are read
three times and a task gives each class once. Tokens that are frequent, as those of a large group of near copies are, are dealt out
by salts and chained in two steps. Of the token sets only those of blocks travel, which a bitmap of FILTER_BITS bits tells on the
executors. The table of BUCKETS bytes and the bitmap are all that goes through the driver.

Edge cases: null texts and texts without words have empty sets and are linked with nothing; fewer than five words are one
shingle; every row counts by itself, so rows that repeat an id, or have none, may have different texts; component_id is the least id
that is not null, and null if a component has none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import arrow_map, components, gathered, materialise, read
from chunkloom.llm.words import hashes, mix

SHINGLE, BUCKETS = 5, 1 << 22
#: 64-bit words of a bitmap; children of a node; tokens of a tile.
BITMAP_WORDS, FANOUT, TILE_TOKENS = 32, 8, 2_000_000
#: Pieces of counts that one task adds up; parts that the counts are cut into.
PIECES, SEGMENTS = 256, 64
#: Occurrences up to which a bucket's tokens are dealt as they are, and times the mean; more frequent ones are salted.
HOT_TOKENS, HOT_MEAN = 1 << 16, 8
FILTER_BITS = 1 << 26
#: Sets up to which those that share a token are held against one another, in pairs; rows that are searched for such at once.
PAIRED, CHAIN_ROWS = 32, 1 << 18
WEIGHTS = np.random.default_rng(5).integers(1, 1 << 62, SHINGLE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = hashes([(t or "").encode() for t in texts])
    if len(h) >= SHINGLE:
        n = len(h) - SHINGLE + 1
        every = h[:n] * WEIGHTS[0]
        for k in range(1, SHINGLE):
            every += h[k : n + k] * WEIGHTS[k]
        every = mix(every)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * WEIGHTS[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def similar(overlap, a, b):
    """100 * intersection >= 80 * union, in whole numbers."""
    return 9 * overlap >= 4 * (a + b)


def bitmap(tokens: np.ndarray, words: int = BITMAP_WORDS) -> bytes:
    """Tokens folded into some 64-bit words."""
    row = np.zeros(64 * words, np.uint8)
    row[((tokens >> np.uint64(20)) % np.uint64(64 * words)).astype(np.int64)] = 1
    return np.packbits(row, bitorder="little").tobytes()


def wide_bitmap(tokens: np.ndarray) -> bytes | None:
    """A bitmap of two to four bits a token; none where that is not more than BITMAP_WORDS words."""
    words = BITMAP_WORDS << (max(len(tokens) - 1, 0) // (32 * BITMAP_WORDS)).bit_length()
    return bitmap(tokens, words) if words > BITMAP_WORDS else None


def may_be_similar(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Whether bitmaps allow two sets of n and m tokens to be similar; the wider one is folded into the other's width."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    x, y = (np.bitwise_or.reduce(z.reshape(-1, min(len(x), len(y))), axis=0) for z in (x, y))
    ones = [int(np.bitwise_count(z).sum(dtype=np.int64)) for z in (x, y, x & y)]
    return bool(similar(ones[2] + min(n - ones[0], m - ones[1]), n, m))


class Tree:
    """A signature tree over sets in the order given, of their sizes and bitmaps: levels of bitmaps and size ranges, the leaves
    first. Without the sets themselves, leaves whose bitmaps allow it count as similar."""

    def __init__(self, sizes: list[int], bitmaps: list[bytes], sets: list[np.ndarray] | None = None):
        self.sets, sizes = sets, np.array(sizes, np.int64)
        bits = np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), BITMAP_WORDS)
        self.bits, self.low, self.high = [bits], [sizes], [sizes]
        # How many tokens of a set share a bit with another of its tokens: what a count of common bits may miss.
        self.folded = [sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)]
        while len(self.bits[-1]) > 1:
            at = np.arange(0, len(self.bits[-1]), FANOUT)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], at))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.folded.append(np.maximum.reduceat(self.folded[-1], at))

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.bits[level - 1])))

    def leaves(self, level: int, node: int) -> range:
        wide = FANOUT**level
        return range(node * wide, min((node + 1) * wide, len(self.bits[0])))


class Groups:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def one(self, a: range, b: range, shift: int) -> bool:
        """Whether all of them are in one group already."""
        root = self.root(a.start)
        return all(self.root(x) == root for x in a) and all(self.root(x + shift) == root for x in b)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def traverse(a: Tree, b: Tree, groups: Groups, shift: int, same: bool) -> None:
    """Joins the groups of similar sets of two trees; b's sets have the numbers from `shift` on."""
    start = (len(a.bits) - 1, 0, len(b.bits) - 1, 0)
    stack = [start]
    while stack:
        la, x, lb, y = stack.pop()
        # Opens the higher node, or both, and tests all pairs of children at once.
        xs = a.children(la, x) if la >= lb and la else range(x, x + 1)
        ys = b.children(lb, y) if lb >= la and lb else range(y, y + 1)
        na, nb = la - (la >= lb and la > 0), lb - (lb >= la and lb > 0)
        ia, ib = np.arange(xs.start, xs.stop), np.arange(ys.start, ys.stop)
        common = np.bitwise_count(a.bits[na][ia][:, None, :] & b.bits[nb][ib][None, :, :]).sum(axis=2, dtype=np.int64)
        most = common + np.minimum(a.folded[na][ia][:, None], b.folded[nb][ib][None, :])
        low = np.maximum(a.low[na][ia][:, None], 0) + b.low[nb][ib][None, :]
        fit = similar(most, low, 0) & (5 * a.high[na][ia][:, None] >= 4 * b.low[nb][ib][None, :]) & (5 * b.high[nb][ib][None, :] >= 4 * a.low[na][ia][:, None])
        for i, j in zip(*np.nonzero(fit), strict=True):
            p, q = xs.start + int(i), ys.start + int(j)
            if same and na == nb and p > q:
                continue
            if na or nb:
                if not groups.one(a.leaves(na, p), b.leaves(nb, q), shift):
                    stack.append((na, p, nb, q))
            elif not (same and p == q) and groups.root(p) != groups.root(q + shift):
                if a.sets is None or similar(len(np.intersect1d(a.sets[p], b.sets[q], assume_unique=True)), len(a.sets[p]), len(b.sets[q])):
                    groups.join(p, q + shift)


def node_of(key: bytes) -> int:
    """48 bits of a class's key. Classes that share them by chance come into one block and are still told apart there."""
    return int.from_bytes(key[:6], "little")


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, most of which are below 255, in little room."""
    import zlib

    big = np.flatnonzero(counts >= 255)
    return zlib.compress(np.array([len(big)], "<u8").tobytes() + big.astype("<u8").tobytes() + counts[big].astype("<u8").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    import zlib

    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    big, values = np.frombuffer(raw, "<u8", 2 * n, 8).reshape(2, n)
    counts = np.frombuffer(raw, np.uint8, offset=8 + 16 * n).astype(np.uint64)
    counts[big.astype(np.int64)] = values
    return counts


def set_rows(docs: DataFrame) -> DataFrame:
    """Of (rid, text): rows (rid, n, key, node, bits, wide, null...) for sets, and (null, ..., segment, piece, counts) for a task's token
    counts. Only the first row of a class in a task has its bitmaps."""

    def work(it: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        count, seen = np.zeros(BUCKETS, np.uint32), set()
        for cols in gathered(it, "text", 2 << 20):
            sets = shingle_sets(cols["text"])
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            np.add(count, np.bincount((every % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.uint32), out=count)
            none, keys, bits, wide = [None] * len(sets), [set_key(s) for s in sets], [], []
            for key, s in zip(keys, sets, strict=True):
                bits.append(None if key in seen else bitmap(s))
                wide.append(None if key in seen else wide_bitmap(s))
                seen.add(key)
            yield {"rid": cols["rid"], "n": [len(s) for s in sets], "key": keys, "node": [node_of(k) for k in keys], "bits": bits, "wide": wide, "segment": none, "piece": none, "counts": none}
        step = BUCKETS // SEGMENTS
        for i in range(SEGMENTS if count.any() else 0):
            yield {"rid": [None], "n": [None], "key": [None], "node": [None], "bits": [None], "wide": [None], "segment": [i], "piece": [TaskContext.get().partitionId()], "counts": [pack_counts(count[i * step : (i + 1) * step])]}

    return arrow_map(docs, work, "rid long, n long, key binary, node long, bits binary, wide binary, segment int, piece int, counts binary")


def rarity(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rarity level of each bucket of tokens, a byte; number of salts of each level). Tasks' counts are added PIECES at a time, in as
    many rounds as that takes; the driver gets one segment after the other and keeps the levels alone."""

    def add(pdf):
        import pandas as pd

        total = np.zeros(BUCKETS // SEGMENTS, np.uint64)
        for c in pdf["counts"]:
            total += unpack_counts(c)
        return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "piece": pdf["piece"].iloc[:1] // PIECES, "counts": [pack_counts(total)]})

    parts = rows.where("segment is not null").select("segment", "piece", "counts")
    last = parts.agg(F.max("piece")).first()[0] or 0
    while True:
        parts = parts.groupBy("segment", F.floor(F.col("piece") / PIECES).alias("_piece")).applyInPandas(add, "segment int, piece int, counts binary")
        last //= PIECES
        if not last:
            break
    levels, total = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.uint8), 0
    for r in parts.toLocalIterator():
        counts = unpack_counts(r["counts"])
        total += int(counts.sum())
        levels[r["segment"]] = np.minimum(np.floor(np.log2(counts + 1.0) * 6), 255)
    hot = max(HOT_TOKENS, HOT_MEAN * total / BUCKETS)
    return levels.reshape(-1), np.ceil(2.0 ** ((np.arange(256) + 1) / 6) / hot).astype(np.int64)


def prefix_rows(docs: DataFrame, levels) -> DataFrame:
    """(token, salt, node, n) of the rarest tokens of each class in a task; salt is -1 for tokens that are not frequent. 48 bits of
    a token will do to find blocks."""

    def work(it: Iterator[dict]) -> Iterator[dict]:
        import pyarrow as pa

        level, salts = levels.value
        seen: set[bytes] = set()
        for cols in gathered(it, "text", 2 << 20):
            tokens, salt, node, size = [], [], [], []
            for s in shingle_sets(cols["text"]):
                n = len(s)
                if not n or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                k = n - -(-4 * n // 5) + 1
                rank = level[(s % np.uint64(BUCKETS)).astype(np.int64)]
                order = np.lexsort((s, rank))[:k]
                tokens.append(s[order])
                many = salts[rank[order]]
                salt.append(np.where(many > 1, node_of(key) % many, -1))
                node.append(np.full(k, node_of(key)))
                size.append(np.full(k, n))
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield {"token": pa.array((join(tokens) >> np.uint64(16)).view(np.int64) if tokens else join(tokens)), "salt": pa.array(join(salt).astype(np.int32)), "node": pa.array(join(node).astype(np.int64)), "n": pa.array(join(size).astype(np.int64))}

    return arrow_map(docs, work, "token long, salt int, node long, n long")


class Numbered(Groups):
    """Union-find over any longs, numbered as they come."""

    def __init__(self):
        super().__init__(0)
        self.index: dict[int, int] = {}

    def link(self, a: int, b: int) -> None:
        for x in (a, b):
            if x not in self.index:
                self.index[x] = len(self.index)
                self.up.append(len(self.up))
        self.join(self.index[a], self.index[b])

    def edges(self) -> list[tuple[int, int]]:
        names = list(self.index)
        return [(x, names[self.root(i)]) for i, x in enumerate(names) if self.root(i) != i]


def chains(prefixes: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between sets that share a rare token and whose sizes are within 0.8, or chained by such. Where up to PAIRED sets
    share it, edges are those of the pairs of `classes` (node, n, bits, wide) that may be similar.

    Of a salted token, each part gives its runs of sizes, and a second step chains runs that come within 0.8 of one another."""
    kind = "u long, v long, sure boolean, token long, lo long, hi long"

    def rows(u, v, sure) -> dict:
        none = [None] * len(u)
        return {"u": u, "v": v, "sure": [sure] * len(u), "token": none, "lo": none, "hi": none}

    def whole_groups(it: Iterator[dict]) -> Iterator[np.ndarray]:
        held, size = [], 0
        for cols in it:
            held.append(np.array([cols[k] for k in ("token", "salt", "node", "n")], np.int64))
            size += held[-1].shape[1]
            if size >= CHAIN_ROWS:
                now = np.concatenate(held, axis=1)
                ends = np.flatnonzero((now[:2, 1:] != now[:2, :-1]).any(axis=0))
                cut = int(ends[-1]) + 1 if len(ends) else 0
                if cut:
                    yield now[:, :cut]
                held, size = [now[:, cut:]], 0
        if held:
            yield np.concatenate(held, axis=1)

    def pairs(run, node, n) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of nodes of one run whose sizes are within 0.8; runs are short."""
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, PAIRED):
            at = np.flatnonzero((run[d:] == run[:-d]) & (5 * n[:-d] >= 4 * n[d:]) & (node[d:] != node[:-d]))
            us.append(np.minimum(node[at], node[at + d]))
            vs.append(np.maximum(node[at], node[at + d]))
        u, v = np.concatenate(us), np.concatenate(vs)
        by = np.lexsort((v, u))
        u, v = u[by], v[by]
        new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])][: len(u)]
        return u[new], v[new]

    def first(it: Iterator[dict]) -> Iterator[dict]:
        groups = Numbered()
        for now in whole_groups(it):
            # Of a class, several tasks may have given the same row.
            token, salt, node, n = now = now[:, np.r_[True, (now[:, 1:] != now[:, :-1]).any(axis=0)]]
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (5 * n[:-1] >= 4 * n[1:])
            begin = np.r_[0, np.flatnonzero(~same) + 1]
            size = np.diff(np.r_[begin, len(token)])
            run = np.repeat(np.arange(len(begin)), size)
            few = (size <= PAIRED) & (salt[begin] < 0)
            for i in np.flatnonzero(same & ~few[run[1:]] & (node[1:] != node[:-1])).tolist():
                groups.link(int(node[i]), int(node[i + 1]))
            short = np.flatnonzero((few & (size > 1))[run])
            yield rows(*(x.tolist() for x in pairs(run[short], node[short], n[short])), False)
            done = np.flatnonzero(salt[begin] >= 0)
            at, end = begin[done], begin[done] + size[done] - 1
            yield {"u": node[at].tolist(), "v": [None] * len(at), "sure": [None] * len(at), "token": token[at].tolist(), "lo": n[at].tolist(), "hi": n[end].tolist()}
        edges = groups.edges()
        yield rows([a for a, _ in edges], [b for _, b in edges], True)

    def second(it: Iterator[dict]) -> Iterator[dict]:
        groups, token, top, node = Numbered(), None, 0, 0
        for cols in it:
            for t, lo, hi, u in zip(cols["token"], cols["lo"], cols["hi"], cols["u"], strict=True):
                if t == token and 4 * lo <= 5 * top:
                    if u != node:
                        groups.link(node, u)
                    top = max(top, hi)
                else:
                    token, top, node = t, hi, u
        edges = groups.edges()
        yield rows([a for a, _ in edges], [b for _, b in edges], True)

    def allowed(it: Iterator[dict]) -> Iterator[dict]:
        for cols in it:
            fit = [i for i, x in enumerate(zip(cols["n_u"], cols["bits_u"], cols["n_v"], cols["bits_v"], strict=True)) if may_be_similar(*x)]
            yield {"u": [cols["u"][i] for i in fit], "v": [cols["v"][i] for i in fit]}

    dealt = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")
    found = materialise(arrow_map(dealt, first, kind, numbers=True), "chains")
    runs = found.where("token is not null").repartition("token").sortWithinPartitions("token", "lo")
    sure = found.where("sure").select("u", "v").union(arrow_map(runs, second, kind).select("u", "v"))
    both = found.where("not sure").select("u", "v").distinct()
    for x in ("u", "v"):
        both = both.join(classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.coalesce("wide", "bits").alias(f"bits_{x}")), x)
    return sure.union(arrow_map(both, allowed, "u long, v long"))


def tree_links(members: DataFrame) -> DataFrame:
    """Edges (u, v) of the similar sets of tile pairs: members (task, side, key, n, bits, tokens), side 2 for a tile with itself;
    without the column of tokens, of those whose bitmaps allow it."""
    whole = "tokens" in members.columns

    def pair(pdf):
        import pandas as pd

        sides, keys = [], []
        for side in (0, 1, 2):
            part = pdf[pdf["side"] == side]
            sets = [np.frombuffer(b, np.uint64) for b in part["tokens"]] if whole else None
            bits, sizes = list(part["bits"]), part["n"].tolist()
            # Similar sets come next to each other: by size, and where it is known by their least token.
            order = sorted(range(len(part)), key=lambda i: (int(sets[i][0]) >> 32, sizes[i]) if whole else (sizes[i], bits[i]))
            keys += [part["key"].iloc[i] for i in order]
            sides.append(Tree([sizes[i] for i in order], [bits[i] for i in order], [sets[i] for i in order] if whole else None) if order else None)
        groups = Groups(len(keys))
        if sides[2]:
            traverse(sides[2], sides[2], groups, 0, True)
        elif sides[0] and sides[1]:
            traverse(sides[0], sides[1], groups, len(sides[0].bits[0]), False)
        return pd.DataFrame([(keys[i], keys[groups.root(i)]) for i in range(len(keys)) if groups.root(i) != i], columns=["u", "v"])

    return members.groupBy("task").applyInPandas(pair, "u binary, v binary")


def id_filter(nodes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, packed: set where a node (long) of the table falls. Its size does not depend on the table's."""
    place = F.pmod("node", F.lit(FILTER_BITS)) + 1
    parts = nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    found = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for r in parts:
        found[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return found.reshape(-1)


def token_rows(docs: DataFrame, wanted) -> DataFrame:
    """(key, tokens binary) of the classes that pass the bitmap `wanted`, each once for a task."""

    def work(it: Iterator[dict]) -> Iterator[dict]:
        bits, seen = wanted.value, set()
        for cols in gathered(it, "text", 2 << 20):
            keys, tokens = [], []
            for s in shingle_sets(cols["text"]):
                key = set_key(s)
                place = node_of(key) % FILTER_BITS
                if len(s) and bits[place >> 3] >> (place & 7) & 1 and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    tokens.append(s.tobytes())
            yield {"key": keys, "tokens": tokens}

    return arrow_map(docs, work, "key binary, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_tokens: int = TILE_TOKENS) -> DataFrame:
    """(id, n_shingles long, component_id long) of each row; component_id is the least id reachable by links."""
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(id_col).cast("long").alias("rid"), F.col(text_col).alias("text"))
    rows = materialise(set_rows(docs), "sets")
    sets = rows.where("segment is null").select("rid", "n", "key")
    levels = sc.broadcast(rarity(rows))
    of_class = rows.where("n > 0").groupBy("key").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("node").alias("node"), F.first("bits", ignorenulls=True).alias("bits"), F.first("wide", ignorenulls=True).alias("wide"))
    classes = materialise(of_class, "classes")

    edges = components(chains(prefix_rows(docs, levels), classes))
    # Classes that are chained with others, in their blocks; large blocks are cut into tiles.
    chained = materialise(classes.drop("rid", "wide").join(edges.select("node", F.col("root").alias("block")), "node"), "blocks")
    edges = components(tree_links(tiles(chained, tile_tokens)))
    # What the bitmaps leave together.
    chained = materialise(chained.drop("block").join(edges.select(F.col("node").alias("key"), F.xxhash64("root").alias("block")), "key"), "blocks")
    wanted = sc.broadcast(id_filter(chained))
    links = components(tree_links(token_rows(docs, wanted).join(tiles(chained, tile_tokens), "key")))

    linked = classes.join(links, classes["key"] == links["node"]).select("key", "root", "rid")
    least = linked.groupBy("root").agg(F.min("rid").alias("component"))
    label = linked.join(least, "root").select("key", "component", F.lit(True).alias("linked"))
    label = classes.join(label, "key", "left").select("key", F.when(F.col("linked"), F.col("component")).otherwise(F.col("rid")).alias("component"))
    found = sets.join(label, "key", "left")
    kind = dict(df.dtypes)[id_col]
    return found.select(F.col("rid").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("rid")).alias("component_id"))


def tiles(found: DataFrame, tile_tokens: int) -> DataFrame:
    """(task, side, key, n, bits): the tile pairs that each set takes part in, of sets (key, n, bits, block).

    A tile is a band of sizes, a factor of 1.25 wide, and of a band with more than `tile_tokens` tokens one of several parts
    by a hash. Similar sets lie in one band or in neighbouring ones, so a tile meets the tiles of its own band and of the next."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    small = found.groupBy("block").agg(F.sum("n").alias("tokens")).where(F.col("tokens") <= tile_tokens).select("block", F.lit(True).alias("small"))
    found = found.select("key", "n", "bits", "block")
    banded = found.join(small, "block", "left").withColumn("band", F.when(F.col("small"), F.lit(-1)).otherwise(band)).drop("small")
    size = banded.groupBy("block", "band").agg(F.ceil(F.sum("n") / F.lit(tile_tokens)).cast("int").alias("parts"))
    after = size.select("block", (F.col("band") - 1).alias("band"), F.col("parts").alias("next_parts")).where("band >= -1")
    before = size.select("block", (F.col("band") + 1).alias("band"), F.col("parts").alias("prior_parts"))
    known = size.join(after, ["block", "band"], "left").join(before, ["block", "band"], "left")
    known = known.withColumns({c: F.when(F.col("band") >= 0, F.coalesce(c, F.lit(0))).otherwise(0) for c in ("next_parts", "prior_parts")})
    placed = banded.join(known, ["block", "band"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    me = F.struct(F.col("band").alias("b"), F.col("part").alias("p"))

    def meets(other_band, count, side: int):
        other = lambda p: F.struct(other_band.alias("b"), p.cast("int").alias("p"))
        every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda p: F.struct(F.xxhash64("block", F.least(me, other(p)), F.greatest(me, other(p))).alias("task"), F.when(me == other(p), 2).when(me < other(p), 0).otherwise(1).alias("side")))

    tasks = F.concat(meets(F.col("band"), F.col("parts"), 0), meets(F.col("band") + 1, F.col("next_parts"), 0), meets(F.col("band") - 1, F.col("prior_parts"), 0))
    return placed.select("key", "n", "bits", F.explode(tasks).alias("t")).select("t.task", "t.side", "key", "n", "bits")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}

ORACLE_SQL = {
    "op10_ngram_jaccard": r"""WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words),
    keyed AS (SELECT r, doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM sets),
    classes AS (SELECT k, min(doc_id) AS least, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY k),
    tokens AS (SELECT k, unnest(s) AS t FROM classes),
    pairs AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.k < b.k GROUP BY 1, 2),
    links AS (SELECT p.a, p.b FROM pairs p JOIN classes x ON x.k = p.a JOIN classes y ON y.k = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
    ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT k, k AS m FROM classes UNION SELECT reach.k, ends.b FROM reach JOIN ends ON reach.m = ends.a),
    labels AS (SELECT reach.k, min(classes.least) AS component FROM reach JOIN classes ON classes.k = reach.m GROUP BY 1)
    SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component END AS component_id FROM keyed LEFT JOIN labels USING (k)"""
}
