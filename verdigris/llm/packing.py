"""Mixture-controlled packing: deficit round-robin over source queues.

1. Documents are tokenised where they are read. The tokenizer treats words alone, so each worker keeps the ids of common words. A document's place in its source's queue follows from sums of narrow rows: the queue goes through the partitions in order, and through each in the order of its rows.
2. A window of WINDOW ids takes from each queue what its deficit counter holds: a window adds the queue's target share of it to the counter, whole tokens are taken, and what is left of the counter is carried to the next window. Documents are cut where a quota ends and go on in the next window.
3. The counters need no pass over all windows: at every STRETCH windows they follow from the number of the stretch (the tokens of all queues in order of (2m + 1) / (2 * tokens), exactly), so a task lays out the stretches that its documents are in, and nothing but the documents' own rows takes part.
4. By default a queue's share is that of its tokens, so all queues last to the end. With given proportions queues end at different times; then the others share the windows, and a window goes on across such an end.
5. Only the rest after the last whole window is short. It is cut at powers of two, which need no padding, so there is none at all.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, small_batches, written
from .words import Batch, Encoded

WINDOW = 4096
END_ID = 2
#: Windows whose counters are carried on from one to the next; the next stretch's start anew from the exact sums.
STRETCH = 256
#: Queues that a window can hold and the driver counts; sources beyond so many share queues by hash.
MOST_QUEUES = 4096
#: Partitions whose tokens one task adds up.
SUMMED = 1024
TOKENS = "doc_id bigint, source string, shard int, before bigint, n bigint, ids binary"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"


class WordTokenizer:
    """Ids of whole texts, by way of the ids of their words; ``path`` names a file of the tokenizers library.

    The tokenizer at hand composes, turns white space into blanks, lower-cases, parts a text by a pattern into words and then merges within words only, so that words can be encoded alone. A text in Latin script is parted here and common words are encoded once for the worker. Any other text, and any other tokenizer, goes through the library whole: texts that hold a special token, characters from U+0250 on, capitals whose small letters are from there on, separators whose class differs between libraries, or that composition would change.
    """

    LIMIT = "\u0250"
    #: Fixed value: the pattern of the word-level vocabulary. Below it the same words for characters below LIMIT, first the commonest kind (kinds differ in their first character, but for the contractions, which come before other signs).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _L, _N = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    PARTS = re.compile(f"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_L}{_N}]+")

    def __init__(self, path: str, end_id: int | None = END_ID) -> None:
        import json
        import unicodedata

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.end = np.array([] if end_id is None else [end_id], self.kind).tobytes()
        rules = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        whole = rest == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.words = None
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and whole:
            self.words = self.PARTS if split["pattern"]["Regex"] == self.PATTERN else None
        self.special = [x["content"] for x in rules["added_tokens"]]
        self.odd = re.compile(r"[\x1c-\x1f\x85\xa0]")
        self.composed = lambda s: unicodedata.is_normalized("NFC", s)
        bytewise, merged = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str, self.tokenizer.model.tokenize
        code = "H" if self.kind == "<u2" else "I"
        if array(code).itemsize != np.dtype(self.kind).itemsize or sys.byteorder != "little":
            raise ValueError("ids are packed on little-endian machines only")
        # The byte level changes nothing in printable ASCII.
        encode = lambda word: array(code, [x.id for x in merged(word if word.isascii() and word.isprintable() else bytewise(word)[0][0])]).tobytes()
        self.known, self.encoded = Kept(encode), Encoded(encode, self.kind, 1 << 18)

    def ids(self, text: str | None) -> bytes:
        """The ids, little-endian, in ``kind``."""
        if not text:
            return self.end
        lower = text.lower()
        # Some capitals below LIMIT have small letters above it.
        if self.words is None or (not text.isascii() and (max(lower) >= self.LIMIT or not self.composed(text))) or self.odd.search(text) or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + self.end
        return b"".join(map(self.known.__getitem__, self.words.findall(lower))) + self.end

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of many texts. Those whose characters lie below U+0100 are parted together, and each distinct word of theirs is looked up once."""
        if self.words is None:
            return [self.ids(x.as_py()) for x in texts]
        out: list[bytes] = []
        _, ends, data = texts.buffers()
        bounds = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            # As many texts as make up SLICE bytes.
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + self.SLICE, "right")) - 1)
            out += self._slice(texts.slice(at, to - at), np.frombuffer(data or b"", np.uint8)[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            at = to
        return out

    SLICE = 1 << 21

    def _slice(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        if not len(data):
            return [self.end] * len(texts)
        found = Batch(data, bounds)
        every, counts = self.encoded(found)
        begins = np.concatenate([[0], counts.cumsum()])
        cuts = begins[np.searchsorted(found.starts, bounds)].tolist()
        return [self.ids(texts[i].as_py()) if strange else every[a:b].tobytes() + self.end for i, (strange, a, b) in enumerate(zip(found.strange.tolist(), cuts, cuts[1:], strict=False))]


def _tokenised(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, shard, sent = WordTokenizer(path, end_id), TaskContext.get().partitionId(), {}
        width = np.dtype(tokenizer.kind).itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = tokenizer.batch(part["text"])
                sizes, before = [len(x) // width for x in ids], []
                for source, n in zip(part["source"].to_pylist(), sizes, strict=True):
                    before.append(sent.get(source, 0))
                    sent[source] = before[-1] + n
                columns = [part["doc_id"], part["source"], pa.array([shard] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in TOKENS.split(", ")])

    return run


def sequences(total: int, window: int = WINDOW) -> list[int]:
    """The lengths into which a stream is cut: full windows, then powers of two."""
    out = [window] * (total // window)
    rest = total % window
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def first_tokens(amounts: list[int], seats: int) -> list[int]:
    """How many of the first ``seats`` tokens are each queue's, when token m of a queue of t comes at (2m + 1) / (2t), ties in the order of the queues. Whole numbers, so exact; a later seat never takes one away."""
    grid = 1 << 80
    of = lambda x: [(2 * x * t + grid) // (2 * grid) for t in amounts]
    low, high = 0, grid
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(of(mid)) <= seats else (low, mid)
    out = of(low) if sum(of(high)) > seats else of(high)
    for i, more in enumerate(of(high)):
        take = min(more - out[i], seats - sum(out))
        out[i] += take
    return out


def round_robin(amounts: list[int], rooms: list[int]) -> np.ndarray:
    """Deficit round-robin: what each window, of the given rooms, takes from each queue. Counters are in units of a token / sum of the rooms, so nothing is rounded; in the end each queue has given its amount."""
    share, total = np.array(amounts, np.int64), sum(rooms)
    credit, left = np.zeros_like(share), share.copy()
    out = np.zeros((len(rooms), len(share)), np.int64)
    for v, room in enumerate(rooms):
        credit += share * room
        take = np.clip(credit // total, 0, left)
        spare = room - int(take.sum())
        while spare > 0:  # one more to the greatest counters
            order = np.argsort(take * total - credit, kind="stable")
            order = order[take[order] < left[order]][:spare]
            take[order] += 1
            spare -= len(order)
        while spare < 0:  # one less to the least
            order = np.argsort(credit - take * total, kind="stable")
            order = order[take[order] > 0][:-spare]
            take[order] -= 1
            spare += len(order)
        credit -= take * total
        left -= take
        out[v] = take
    return out


class Layout:
    """Where each token of each queue goes. ``totals`` has the tokens of each queue, ``proportions`` its parts of a window; by default its tokens."""

    def __init__(self, totals: dict, window: int = WINDOW, proportions: dict | None = None) -> None:
        self.names = sorted(totals, key=lambda s: (s is None, s or ""))
        self.number = {s: i for i, s in enumerate(self.names)}
        self.window, self.total = window, sum(totals.values())
        self.whole = self.total // window * window
        #: Sequences of the rest: first token and number.
        self.rest = [self.whole + int(x) for x in np.cumsum([0, *sequences(self.total - self.whole, window)])[:-1]]
        #: Phases, each until a queue ends: first token of all, tokens of each queue in it and before it.
        self.phases, left, begin = [], [totals[s] for s in self.names], 0
        # A part of nothing still gives a queue its turn, after all others.
        parts = None if not proportions else [max(proportions.get(s, min(proportions.values())), 1e-9 * max(proportions.values())) for s in self.names]
        done = [0] * len(left)
        while any(left):
            amounts = left[:]
            if parts is not None:
                lasts = min(x / p for x, p in zip(left, parts, strict=True) if x) * (1 + 1e-9)
                amounts = [min(x, int(lasts * p)) if x > lasts * p else x for x, p in zip(left, parts, strict=True)]
            self.phases.append((begin, amounts, done))
            begin, done, left = begin + sum(amounts), [a + b for a, b in zip(done, amounts, strict=True)], [a - b for a, b in zip(left, amounts, strict=True)]
        self.bounds, self.stretch = lru_cache(1024)(self._bounds), lru_cache(4)(self._stretch)
        self.at: dict = {}

    def _bounds(self, phase: int, k: int) -> tuple[int, list[int]]:
        """The first token of a phase's part of stretch k, and the tokens of each queue before it."""
        begin, amounts, done = self.phases[phase]
        x = min(max(k * STRETCH * self.window, begin), begin + sum(amounts))
        return x, [a + b for a, b in zip(done, first_tokens(amounts, x - begin), strict=True)]

    def _stretch(self, phase: int, k: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
        """For each window (or part of one) of a phase's part of stretch k: each queue's first token there, the first one's place; the sequence and its first place."""
        (x, before), (y, after) = self.bounds(phase, k), self.bounds(phase, k + 1)
        first = x // self.window * self.window
        cuts = sorted({x, y, *range(first + self.window, min(y, self.whole) + 1, self.window), *(r for r in self.rest if x < r < y)})
        taken = round_robin([b - a for a, b in zip(before, after, strict=True)], [b - a for a, b in zip(cuts, cuts[1:], strict=False)])
        starts = np.vstack([np.zeros_like(taken[:1]), taken.cumsum(axis=0)]) + np.array(before, np.int64)
        places = np.array(cuts[:-1], np.int64)[:, None] + taken.cumsum(axis=1) - taken
        numbers, origins = [], []
        for c in cuts[:-1]:
            i = bisect_right(self.rest, c) - 1
            numbers.append(c // self.window if c < self.whole else self.whole // self.window + i)
            origins.append(c // self.window * self.window if c < self.whole else self.rest[i])
        return starts, places, numbers, origins

    def _around(self, q: int, at: int) -> tuple[np.ndarray, ...]:
        """The stretch of token ``at`` of a queue: the windows' first tokens of the queue, their places, sequences and first places."""
        held = self.at.get(q)
        if held and held[0][0] <= at < held[0][-1]:
            return held
        phase = next(i for i, (_, amounts, done) in enumerate(self.phases) if done[q] <= at < done[q] + amounts[q])
        begin, amounts, done = self.phases[phase]
        k = (begin + (at - done[q]) * sum(amounts) // amounts[q]) // (STRETCH * self.window)
        while self.bounds(phase, k)[1][q] > at:
            k -= 1
        while self.bounds(phase, k + 1)[1][q] <= at:
            k += 1
        starts, places, numbers, origins = self.stretch(phase, k)
        self.at[q] = held = starts[:, q], places[:, q], np.array(numbers, np.int64), np.array(origins, np.int64)
        return held

    def _windows(self, q: int, low: int, high: int) -> list[np.ndarray]:
        """Of all windows that hold the tokens from ``low`` to ``high`` of a queue: its first tokens there and one bound more, their places, the sequences and their first places."""
        found, at = [], low
        while at < high:
            found.append(self._around(q, at))
            at = found[-1][0][-1]
        starts = np.concatenate([*(f[0][:-1] for f in found), found[-1][0][-1:]])
        return [starts, *(np.concatenate([f[k] for f in found]) for k in (1, 2, 3))]

    def pieces(self, name: str | None, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces of documents that have ``sizes`` tokens from ``begins`` on of a queue: number of the document, start, length, sequence, offset."""
        q, out = self.number[name], []
        order = np.argsort(begins, kind="stable")
        order = order[sizes[order] > 0]
        b, e = begins[order], begins[order] + sizes[order]
        # Documents that lie far apart are looked up apart.
        far = np.flatnonzero(b[1:] - e[:-1] > STRETCH * self.window) + 1
        for low, high in zip([0, *far.tolist()], [*far.tolist(), len(b)], strict=True):
            if low == high:
                continue
            starts, places, numbers, origins = self._windows(q, int(b[low]), int(e[high - 1]))
            first, last = np.searchsorted(starts, b[low:high], "right") - 1, np.searchsorted(starts, e[low:high], "left") - 1
            count = last - first + 1
            doc = np.repeat(np.arange(low, high), count)
            at = np.arange(len(doc)) - np.repeat(count.cumsum() - count, count) + np.repeat(first, count)
            s, t = np.maximum(starts[at], b[doc]), np.minimum(starts[at + 1], e[doc])
            some = t > s  # a window may take nothing of a queue
            s, t, doc, at = s[some], t[some], doc[some], at[some]
            out.append((order[doc], s - b[doc], t - s, numbers[at], places[at] + s - starts[at] - origins[at]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5


def _packed(totals: dict, window: int, proportions: dict | None, kind: str):
    names = [x.split()[0] for x in PIECES.split(", ")]
    schema = pa.schema([(c, pa.string() if c == "source" else pa.int64()) for c in names])
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(totals, window, proportions)
        for batch in batches:
            if not batch.num_rows:
                continue
            queues, ids = np.array(batch["queue"].to_pylist(), object), batch["ids"]
            begins, sizes = batch["begin"].to_numpy(), batch["n"].to_numpy()
            _, ends, data = ids.buffers()
            firsts = np.frombuffer(ends, np.int32)[ids.offset : ids.offset + len(ids)] // width
            data = memoryview(np.frombuffer(data or b"", kind).astype("<u4").tobytes())
            found = []
            for queue in dict.fromkeys(queues):
                own = np.array([i for i, x in enumerate(queues) if x is None]) if queue is None else np.flatnonzero(queues == queue)
                doc, *places = layout.pieces(queue, begins[own], sizes[own])
                found.append((own[doc], *places))
            doc, start, length, number, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            at = 4 * (firsts[doc] + start)
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(rows), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), batch["n"].take(rows), pa.array(number), pa.array(offset), batch["source"].take(rows)], schema=schema)

    return run


def before(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """The rows with the sum of the earlier rows' values of their key: within SUMMED rows by order, then over those sums."""
    rows = rows.withColumn("block", F.floor(F.col(order) / SUMMED).cast("int"))
    inside = W.partitionBy(key, "block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    over = rows.groupBy(F.col(key).alias("of"), F.col("block").alias("sums")).agg(F.sum(value).alias("held"))
    over = over.select("of", "sums", F.coalesce(F.sum("held").over(W.partitionBy("of").orderBy("sums").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    # Keys are compared null-safe: a null source is one of them.
    both = rows.join(over, (F.col("block") == F.col("sums")) & F.col(key).eqNullSafe(F.col("of")))
    return both.select(*(F.col(c) for c in rows.columns if c != "block"), (F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col("ahead")).alias(name))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int | None = END_ID, proportions: dict | None = None, most_queues: int = MOST_QUEUES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``proportions``: the tokens of each source in a window, in proportion; by default each source's share of all tokens, so that all queues last to the end. A source that they do not name gets the least of them. Null and empty texts have the end id only; without an end id they have no piece. A null source is a queue of its own; of more than ``most_queues`` sources some share a queue. Rows that repeat a doc_id, or have none, are packed one by one. Longer documents than a window are cut. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = WordTokenizer(tokenizer_path, end_id).kind
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    tokens = written(rows.mapInArrow(_tokenised(tokenizer_path, end_id), TOKENS), "tokens")
    queue = F.col("source")
    if tokens.select("source").distinct().limit(most_queues + 1).count() > most_queues:
        queue = F.concat(F.lit("queue "), F.pmod(F.xxhash64("source"), F.lit(most_queues)).cast("string"))
    each = written(tokens.groupBy("shard", "source", queue.alias("queue")).agg(F.sum("n").alias("held")), "queues")
    totals = {r["queue"]: r["held"] for r in each.groupBy("queue").agg(F.sum("held").alias("held")).collect()}  # most_queues rows at most
    shards = before(each.groupBy("shard", "queue").agg(F.sum("held").alias("held")), "queue", "shard", "held", "ahead").select(F.col("shard").alias("in_shard"), F.col("queue").alias("in_queue"), "ahead")
    # Sources that share a queue follow each other in each partition.
    others = F.coalesce(F.sum("held").over(W.partitionBy("shard", "queue").orderBy("source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = each.withColumn("others", others).join(shards, (F.col("shard") == F.col("in_shard")) & F.col("queue").eqNullSafe(F.col("in_queue")))
    # Written, so that the optimizer knows its size and need not move the ids while it is small.
    ahead = written(ahead.select(F.col("shard").alias("of_shard"), F.col("source").alias("of_source"), "queue", (F.col("ahead") + F.col("others")).alias("ahead")), "ahead")
    placed = tokens.join(ahead, (F.col("shard") == F.col("of_shard")) & F.col("source").eqNullSafe(F.col("of_source")))
    placed = placed.select("doc_id", "source", "queue", (F.col("before") + F.col("ahead")).alias("begin"), "n", "ids")
    return placed.mapInArrow(_packed(totals, window, proportions, kind), PIECES)
