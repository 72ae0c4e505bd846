"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over windows of a fixed number of bytes, each filter's largest
answer feeds a softmax over the labels. It is trained on windows of labelled texts and applied to all windows of each
text, in batches; windows vote by their number of bytes. Since a filter's answer is a sum over its bytes, filters are
applied as sums of rows of tables over byte pairs.

Edge cases: a null text, or one without a letter, is `und` with score 0, and so is every text if there is nothing to learn from; the
texts learned from are a bounded number of different ones for each label, the first by a hash of the text; equal texts get equal
answers; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import arrow_map, gathered, read

WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 12, 6
#: Bounds of the sample that the network is trained on: texts of each label, and windows of each text.
TEXTS_PER_LABEL, WINDOWS_PER_TEXT = 600, 4
UNKNOWN = "und"
#: Parts of the range of hashes, for finding the least ones of each label.
HASH_PARTS = 1024


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # byte, dimension
    filters: list[np.ndarray]  # of each width: offset, dimension, filter
    bias: np.ndarray  # filter
    out: np.ndarray  # filter, label
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Of each width: (offset, table of answers) for byte pairs, and for a single byte at the end of an odd width."""
        found = []
        for w in self.filters:
            single = [self.embed @ w[i] for i in range(len(w))]
            pairs = [(i, (single[i][:, None, :] + single[i + 1][None, :, :]).reshape(65536, -1)) for i in range(0, len(w) - 1, 2)]
            found.append([(i, t.astype(np.float32)) for i, t in pairs + ([(len(w) - 1, single[-1])] if len(w) % 2 else [])])
        return found

    def hidden(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Largest answer of each filter on each window; x: windows of bytes."""
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        best = []
        for parts in tables:
            width = parts[-1][0] + (2 if len(parts[-1][1]) == 65536 else 1)
            n = x.shape[1] - width + 1
            answer = None
            for i, table in parts:
                rows = np.take(table, pair[:, i : i + n] if len(table) == 65536 else x[:, i : i + n], axis=0)
                answer = rows if answer is None else answer.__iadd__(rows)
            best.append(answer.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        logits = np.concatenate([self.hidden(x[i : i + 64], tables) for i in range(0, len(x), 64)]) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def windows(text: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], steps: int = 900, batch: int = 48, seed: int = 7) -> Network:
    """Adam on the cross entropy; gradients of the largest answers go to the bytes that gave them."""
    rng = np.random.default_rng(seed)
    k = len(WIDTHS) * FILTERS
    p = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "bias": np.zeros(k), "out": rng.normal(0, 0.3, (k, len(labels))), "out_bias": np.zeros(len(labels))}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    m, s = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        xb, yb = x[pick], y[pick]
        e = p["embed"][xb]
        best, where = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            patches = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
            answer = patches @ p[f"w{w}"]
            at = answer.argmax(axis=1)
            best.append(np.take_along_axis(answer, at[:, None, :], 1)[:, 0])
            where.append((patches, at))
        raw = np.concatenate(best, axis=1) + p["bias"]
        h = np.maximum(raw, 0)
        logits = h @ p["out"] + p["out_bias"]
        q = np.exp(logits - logits.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(batch), yb] -= 1
        q /= batch
        g = {"out": h.T @ q, "out_bias": q.sum(axis=0)}
        dh = (q @ p["out"].T) * (raw > 0)
        g["bias"], g["embed"] = dh.sum(axis=0), np.zeros_like(p["embed"])
        for j, w in enumerate(WIDTHS):
            patches, at = where[j]
            d = dh[:, j * FILTERS : (j + 1) * FILTERS]
            chosen = patches[np.arange(batch)[:, None], at]  # window, filter, patch
            g[f"w{w}"] = np.einsum("bfp,bf->pf", chosen, d)
            back = (d[:, :, None] * p[f"w{w}"].T[None]).reshape(batch, FILTERS, w, EMBEDDING)
            for i in range(w):
                np.add.at(g["embed"], np.take_along_axis(xb, at + i, 1), back[:, :, i])
        rate = 0.01 * (1 - step / (steps + 1))
        for n, v in g.items():
            m[n] = 0.9 * m[n] + 0.1 * v
            s[n] = 0.999 * s[n] + 0.001 * v * v
            p[n] -= (rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(labels, p["embed"], [p[f"w{w}"].reshape(w, EMBEDDING, FILTERS) for w in WIDTHS], p["bias"], p["out"], p["out_bias"])


def least_hashes(rows: DataFrame, most: int) -> DataFrame:
    """The `most` least of the different hashes (_label, _hash) of each label. Counts by the hashes' highest bits, HASH_PARTS for each label, tell
    which may be among them, so that no task gets all hashes of a label."""
    part = F.shiftright("_hash", 64 - (HASH_PARTS - 1).bit_length())
    counts = rows.groupBy("_label", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < most).groupBy("_label").agg(F.max("_part").alias("_last"))
    few = rows.join(F.broadcast(last), "_label").where(part <= F.col("_last"))
    first = Window.partitionBy("_label").orderBy("_hash")
    return few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("_label", "_hash")


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", texts_per_label: int = TEXTS_PER_LABEL) -> Network | None:
    """A network for the labels of rows that have a text and a label; None if there are none. The sample is bounded by
    `texts_per_label` different texts of each label and WINDOWS_PER_TEXT windows of each of these."""
    rows = df.select(F.col(text_col).alias("_text"), F.col(label_col).alias("_label")).where("_text is not null and _label is not null and length(_text) > 0")
    # Copies of a text are one: a large group of them would fill the label's sample. Hashes are ranked, so few texts are shuffled.
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    chosen = least_hashes(rows.select("_label", "_hash").distinct(), texts_per_label)
    rows = rows.join(F.broadcast(chosen), ["_label", "_hash"], "left_semi").dropDuplicates(["_label", "_text"])

    def cut(it: Iterator[dict]) -> Iterator[dict]:
        for cols in it:
            out: dict[str, list] = {"label": [], "bytes": []}
            for text, label in zip(cols["_text"], cols["_label"], strict=True):
                all_of = windows(text.encode())
                for i in sorted({len(all_of) * j // WINDOWS_PER_TEXT for j in range(WINDOWS_PER_TEXT)}):
                    out["label"].append(label)
                    out["bytes"].append(all_of[i].tobytes())
            yield out

    got = arrow_map(rows.select("_text", "_label"), cut, "label string, bytes binary").toPandas().sort_values(["label", "bytes"], ignore_index=True)
    if got.empty:
        return None
    labels = sorted(got["label"].unique())
    by = got.groupby("label").indices
    # Labels weigh alike: each is repeated up to the most frequent one's windows.
    most = max(map(len, by.values()))
    pick = np.concatenate([np.resize(by[n], most) for n in labels])
    x = np.frombuffer(b"".join(bytes(b) for b in got["bytes"]), np.uint8).reshape(-1, WINDOW)
    return train(x[pick], np.repeat(np.arange(len(labels)), most), labels)


def predict(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred string, score double) of each row's whole text."""

    def work(it: Iterator[dict]) -> Iterator[dict]:
        tables = net.tables() if net else None
        for cols in gathered(it, "_text", 1 << 20):
            texts = cols["_text"]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
            if rows:
                raw = [texts[i].encode() for i in rows]
                stacks = [windows(b) for b in raw]
                first = np.cumsum([0, *map(len, stacks)])
                weight = np.full(first[-1], WINDOW, np.float64)
                weight[first[1:] - 1] = [len(b) - (len(w) - 1) * WINDOW for b, w in zip(raw, stacks, strict=True)]
                votes = net.probabilities(np.concatenate(stacks), tables) * weight[:, None]
                votes = np.add.reduceat(votes, first[:-1], axis=0)
                votes /= votes.sum(axis=1, keepdims=True)
                for i, v in zip(rows, votes, strict=True):
                    lang[i], score[i] = net.labels[int(v.argmax())], min(1.0, float(v.max()))
            yield {id_col: cols[id_col], "lang_pred": lang, "score": score}

    return arrow_map(df.select(id_col, F.col(text_col).alias("_text")), work, f"{id_col} {dict(df.dtypes)[id_col]}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
