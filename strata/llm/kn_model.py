"""Quality classifier (2): interpolated modified Kneser-Ney over byte n-grams, trained on trusted text.

Symbols are the bytes of the UTF-8 text, with three start symbols before and one end symbol behind it (values that UTF-8
never uses), so an n-gram of up to seven bytes is one integer and the model needs no word list in any language. The order is an argument:
with four bytes (the operator's default) contexts hardly cross a word and the distinct n-grams saturate, so the registered query
takes seven, whose contexts of six bytes see the word before. Such a model knows the texts it has counted too well for a limit: with
`held_out` (as in the query) limits come from a tenth of the trusted documents, by a hash of the id, scored by a second model of the
other nine tenths. A language without a trusted document in the tenth has its limit from all its trusted ones by the first model.

Training counts the n-grams of every trusted document; lower orders count distinct left neighbours (n-grams that begin with
a start symbol keep plain counts). Counts are dealt once, by the two bytes before the last, and travel packed: such a shard has every suffix and
context of its n-grams down to three bytes, so lower orders, discounts, back-off weights and interpolated probabilities are made inside it.
Orders one and two have 65 792 n-grams at most and go with the code.

Scoring: up to `MOST_HELD` n-grams and contexts, a task reads the model from the shared folder and scores the texts where it scans
them, so nothing moves but the figures. Of a larger model documents stand in chunks of consecutive rows. A chunk asks for its distinct n-grams,
the distinct n-grams of all chunks meet the shards, and each chunk gets the answers it asked for, next to its texts.
Perplexity is exp of the mean negative log-probability of a text's bytes and its end.

A document stays if its perplexity is at most the `QUANTILE` of the trusted documents of its language times `slack` (1 in the
registered query; the operator's default is `SLACK`); quantiles come from counts over cells of 1 % (mergeable, independent of
order), so a limit lies up to 1 % above the quantile. The model has not seen a language without trusted text: with `own_limits`
(as in the registered query) the quantile of all its own documents is its limit, else that of the trusted documents of all
languages, which rejects most of such a language, clean documents too.

Defined results: null and empty texts have the end symbol alone; labels with null ids do not match; a document is trusted if any
of its labels says quality 1 and none says toxic; rows that repeat an id share its labels; with no trusted text at all the model is uniform and
all documents stay; empty tables give empty results. Chunks are found again by file and place
in the stored table; a frame that is none is stored first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import counted, cut, fresh, numbered, open_fs, shared_path, stored, text_batches
from strata.session import StrataError

ORDER = 4
START, END = 0xFF, 0xFE
VOCABULARY = 256
QUANTILE = 0.99
SLACK = 1.25
#: Consecutive rows of one task that share their n-gram requests.
CHUNK_ROWS = 2048
CELLS = 100
#: One document in so many is held out.
FOLDS = 10
#: Shards of a model; a prime, so that both bytes of a shard's key count.
SHARDS = 251
#: Distinct n-grams that a task gathers before it adds them up or sends them.
TASK_GRAMS = 3_000_000
#: N-grams and contexts of a model that a task may hold, 16 bytes each; of a larger model chunks ask for what they need.
MOST_HELD = 16_000_000
#: Trusted ids that are sent to the scan of the texts; more of them meet the texts by a merge join.
MOST_SENT = 4_000_000
#: Bytes of text that are scored at once.
SCORED_BYTES = 1 << 20


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some texts one after the other, and how many each text has."""
    padded = b"".join(bytes([START]) * (order - 1) + t + bytes([END]) for t in texts)
    data = np.frombuffer(padded, np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    n = len(data) - order + 1
    keys = np.zeros(n, np.int64)
    for i in range(order):
        keys = (keys << 8) | data[i : i + n]
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return keys[inside], sizes


def held(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("held"), F.col(id_col)), F.lit(FOLDS)) == 0


def _shard(gram: np.ndarray) -> np.ndarray:
    """The shard of an n-gram by the two bytes before its last: with it go its suffixes and contexts of all orders from three up."""
    return ((gram >> 8) & 0xFFFF) % SHARDS


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, the first ascending, as one Zstandard frame: differences, low bytes first."""
    table = np.stack([np.diff(columns[0], prepend=0), *columns[1:]]).astype(np.int64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    table = np.array(planes.T, order="C").view(np.int64).reshape(columns, -1)
    table[0] = np.cumsum(table[0])
    return table


def _added(tables: list[np.ndarray]) -> np.ndarray:
    """Tables whose first row is the key, as one with ascending keys and the other rows added up per key."""
    table = np.concatenate(tables, axis=1) if tables else np.zeros((3, 0), np.int64)
    if not table.shape[1]:
        return table
    table = table[:, np.argsort(table[0])]
    first = np.flatnonzero(np.diff(table[0], prepend=table[0][0] - 1))
    return np.stack([table[0][first], *(np.add.reduceat(row, first) for row in table[1:])])


def shard_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """shard, counts: the packed n-grams of a shard with n and rest, as in `count_grams`. Tasks add up and pack before they send."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()

        def sent(table: np.ndarray) -> pa.RecordBatch:
            shard = _shard(table[0])
            at = np.argsort(shard, kind="stable")
            table, (names, begin) = table[:, at], np.unique(shard[at], return_index=True)
            data = [_pack(*table[:, i:j]) for i, j in zip(begin, [*begin[1:], len(at)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(data, pa.binary())], ["shard", "counts"])

        parts, held_back = [], 0
        for batch in batches:
            data = batch.column(0).to_pylist()
            data = [opened.decompress(d) for d in data] if pa.types.is_binary(batch.column(0).type) else [t.encode() for t in data]
            marked = batch.column(1).to_pylist() if batch.num_columns > 1 else [False] * len(data)
            for mark in (False, True):
                some = [d for d, m in zip(data, marked, strict=True) if m is mark]
                if some:
                    gram, n = np.unique(grams_of(some, order)[0], return_counts=True)
                    parts.append(np.stack([gram, n, n * (not mark)]))
                    held_back += len(gram)
            if held_back > TASK_GRAMS:
                parts = [_added(parts)]
                held_back = parts[0].shape[1]
                if held_back > TASK_GRAMS // 2:
                    yield sent(parts[0])
                    parts, held_back = [], 0
        if parts:
            yield sent(_added(parts))

    def add(table: pa.Table) -> pa.Table:
        parts, held_back = [], 0
        for data in table.column("counts").to_pylist():
            parts.append(_unpack(data, 3))
            held_back += parts[-1].shape[1]
            if held_back > TASK_GRAMS:
                parts = [_added(parts)]
                held_back = 0
        return pa.table({"shard": table.column("shard").slice(0, 1), "counts": pa.array([_pack(*_added(parts))], pa.binary())})

    schema = "shard int, counts binary"
    return texts.mapInArrow(work, schema).groupBy("shard").applyInArrow(add, schema)


def count_grams(frames: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n over all rows of `frames` (a text, or a Zstandard frame of one) and rest, n without those that a second column marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unpack(data, 3)], ["gram", "n", "rest"])

    return shard_counts(frames, order).mapInArrow(work, "gram bigint, n bigint, rest bigint")


def _lower(gram: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the next lower order: distinct left neighbours, plain counts where a start symbol begins the n-gram."""
    suffix = gram & ((1 << (8 * (order - 1))) - 1)
    lower, neighbours, total = _added([np.stack([suffix, np.ones_like(n), n])])
    return lower, np.where(lower >> (8 * (order - 2)) == START, total, neighbours)


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and more, from the counts of counts; 0.5, 1 and 1.5 where those are too few."""
    if all(n.get(i) for i in (1, 2, 3, 4)):
        y = n[1] / (n[1] + 2 * n[2])
        d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        if all(0 < x < i for i, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def _interpolated(gram: np.ndarray, n: np.ndarray, off_by: tuple[float, float, float], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of n-grams of whole contexts, their contexts and the back-off weights, from the probabilities of their suffixes."""
    if not len(gram):
        return np.zeros(0), gram, np.zeros(0)
    off = np.array(off_by)[np.minimum(n, 3) - 1]
    contexts, first, size = np.unique(gram >> 8, return_index=True, return_counts=True)
    total = np.add.reduceat(n, first)
    weight = np.add.reduceat(off, first) / total
    return (n - off) / np.repeat(total, size) + np.repeat(weight, size) * lower, contexts, weight


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each asked key, NaN where there is none; keys ascend."""
    if not len(keys):
        return np.full(len(asked), np.nan)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], np.nan)


#: Of an order: its n-grams and their probabilities, its contexts and their weights.
Shares = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _log_p(shares: Shares, gram: np.ndarray, order: int) -> np.ndarray:
    """Logarithms of the probabilities of distinct ascending n-grams; an order is asked for what no higher one has."""
    value, factor, left = np.empty(len(gram)), np.ones(len(gram)), np.arange(len(gram))
    for k in range(order, 0, -1):
        keys, chances, contexts, weights = shares[k]
        asked = gram[left] & ((1 << (8 * k)) - 1)
        p = _found(keys, chances, asked)
        seen = ~np.isnan(p)
        value[left[seen]] = factor[left[seen]] * p[seen]
        left, asked = left[~seen], asked[~seen]
        w = _found(contexts, weights, asked >> 8)
        factor[left] *= np.where(np.isnan(w), 1.0, w)
    value[left] = factor[left] / VOCABULARY
    return np.log(value)


def _share(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What rows of the table of a model, all of one order, have together; ascending."""
    out = []
    for keys, values in (("grams", "chances"), ("contexts", "weights")):
        key = np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_py(), 1)[0] for x in rows.column(keys))])
        value = np.concatenate([np.zeros(0), *(np.frombuffer(x.as_py()) for x in rows.column(values))])
        if rows.num_rows > 1:
            at = np.argsort(key)
            key, value = key[at], value[at]
        out += [key, value]
    return tuple(out)


#: The model that this worker has read last.
_read: dict[str, Shares] = {}


def _whole(path: str, small: Shares, order: int) -> Shares:
    if path not in _read:
        _read.clear()
        fs, folder = open_fs(path)
        shares = dict(small)
        columns = ["grams", "chances", "contexts", "weights"]
        for k in range(3, order + 1):
            shares[k] = _share(pq.read_table(folder, columns=columns, filesystem=fs, partitioning=None, filters=[("order", "=", k)], use_threads=False))
            pa.default_memory_pool().release_unused()
        _read[path] = shares
    return _read[path]


class Model:
    """`table` (shard, order, grams, chances, contexts, weights) for orders from three up, packed and stored; `small` has the orders 1 and 2.

    Two bytes before the last name the shard, so that a shard has all that its n-grams need of these orders.
    """

    def __init__(self, counts: DataFrame, most: int = ORDER):
        def pack(table: pa.Table) -> pa.Table:
            gram, n = (table.column(c).to_numpy() for c in ("gram", "n"))
            return pa.table({"shard": table.column("shard").slice(0, 1), "counts": pa.array([_pack(*_added([np.stack([gram, n, n])]))], pa.binary())})

        shard = F.pmod(F.shiftright("gram", 8).bitwiseAND(0xFFFF), F.lit(SHARDS)).cast("int").alias("shard")
        self._learn(cut(counts.select(shard, "gram", "n").groupBy("shard").applyInArrow(pack, "shard int, counts binary"), "counts"), most, 1)

    @classmethod
    def of(cls, counts: DataFrame, most: int, rest: bool = False) -> Model:
        """The model of stored `shard_counts`; with `rest` of what is not marked."""
        model = cls.__new__(cls)
        model._learn(counts, most, 2 if rest else 1)
        return model

    def _learn(self, counts: DataFrame, most: int, column: int) -> None:
        self.order = most

        def levels(data: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
            table = _unpack(data, 3)
            table = table[:, table[column] > 0]
            out = {most: (table[0], table[column])}
            for k in range(most, 2, -1):
                out[k - 1] = _lower(*out[k], k)
            return out

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(1).to_pylist():
                    for k, (gram, n) in levels(data).items():
                        if k > 2:
                            gram, n = np.arange(1, 5), np.bincount(np.minimum(n, 5), minlength=6)[1:5]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k, np.int32)), pa.array(gram), pa.array(n)], ["order", "gram", "n"])

        # At most 65 536 n-grams of two bytes, and four counts of counts per order.
        sums = counts.mapInArrow(summed, "order int, gram bigint, n bigint").groupBy("order", "gram").agg(F.sum("n").alias("n")).collect()
        off = {k: _discounts({r["gram"]: r["n"] for r in sums if r["order"] == k}) for k in range(3, most + 1)}
        k = min(most, 2)
        own = sorted((r["gram"], r["n"]) for r in sums if r["order"] == k)
        small = {k: tuple(np.array([r[i] for r in own], np.int64) for i in (0, 1))}
        if k == 2:
            small[1] = _lower(*small[2], 2)
        self.small: Shares = {}
        for k, (gram, n) in sorted(small.items()):
            low = np.full(len(gram), 1 / VOCABULARY) if k == 1 else _found(*self.small[1][:2], gram & 0xFF)
            chances, contexts, weights = _interpolated(gram, n, _discounts({i: int((n == i).sum()) for i in range(1, 5)}), low)
            self.small[k] = (gram, chances, contexts, weights)
        small = self.small

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, data in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                    tables = levels(data)
                    below = small.get(2)
                    for k in range(3, most + 1):
                        gram, n = tables[k]
                        low = _found(*below[:2], gram & ((1 << (8 * (k - 1))) - 1))
                        chances, contexts, weights = _interpolated(gram, n, off[k], low)
                        below = (gram, chances)
                        row = (shard, k, _pack(gram), chances.tobytes(), _pack(contexts), weights.tobytes(), len(gram) + len(contexts))
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        names = ["shard", "order", "grams", "chances", "contexts", "weights", "entries"]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        self.path = shared_path(counts.sparkSession, "model")
        schema = "shard int, order int, grams binary, chances binary, contexts binary, weights binary, entries bigint"
        counts.mapInArrow(learn, schema).write.parquet(self.path)
        self.table = counts.sparkSession.read.schema(schema).parquet(self.path)
        self.entries = self.table.agg(F.sum("entries")).first()[0] or 0

    def score(self, grams: DataFrame) -> DataFrame:
        """gram, log_p of each distinct n-gram of `grams`, shard by shard."""
        small, order = self.small, self.order

        def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
            gram = np.sort(asked.column("gram").to_numpy())
            shares = small | {k: _share(rows.filter(pc.equal(rows.column("order"), k))) for k in range(3, order + 1)}
            return pa.table({"gram": gram, "log_p": _log_p(shares, gram, order)})

        shard = F.pmod(F.shiftright("gram", 8).bitwiseAND(0xFFFF), F.lit(SHARDS)).cast("int").alias("shard")
        asked = grams.select("gram").distinct().select(shard, "gram")
        return asked.groupBy("shard").cogroup(self.table.groupBy("shard")).applyInArrow(work, "gram bigint, log_p double")


def _chunked(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    docs = stored(docs)
    place = fresh(docs, "__row")
    rows = numbered(docs, place).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text, F.col(place).alias("row"))
    # The high bits of a row number are its file; its chunk keeps them.
    return rows.withColumn("chunk", F.expr(f"(row >> 33 << 33) + (row & 8589934591) DIV {CHUNK_ROWS}"))


def requests(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """chunk, gram: the distinct n-grams of each chunk, from the scan itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(chunk: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            gram = np.unique(np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), chunk)), pa.array(gram)], ["chunk", "gram"])

        now, parts = None, []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for c in np.unique(chunk):
                at = np.flatnonzero(chunk == c)
                texts = batch.column(1).slice(int(at[0]), len(at)).to_pylist()
                if c != now and parts:
                    yield asked(now, parts)
                    parts = []
                now = int(c)
                parts.append(np.unique(grams_of([t.encode() for t in texts], order)[0]))
        if parts:
            yield asked(now, parts)

    return rows.select("chunk", "text").mapInArrow(work, "chunk bigint, gram bigint")


def _compressed(rows: DataFrame) -> DataFrame:
    """Texts as Zstandard frames: where they move to the labels or to the answers, this saves a third of what moves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data = pa.array([pack(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, batch.column(3)], ["row", "doc_id", "data", "chunk"])

    return rows.select("row", "doc_id", "text", "chunk").mapInArrow(work, "row bigint, doc_id bigint, data binary, chunk bigint")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, lang, n_symbols, perplexity of every document of `rows`, by a model that a task can hold."""
    path, small, order = model.path, model.small, model.order

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(ids: list[pa.RecordBatch], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            keys, n = grams_of(texts, order)
            gram, at = np.unique(keys, return_inverse=True)
            means = np.add.reduceat(_log_p(_whole(path, small, order), gram, order)[at], np.cumsum(n) - n) / n
            done = 0
            for batch in ids:
                upto = done + batch.num_rows
                columns = [*batch.columns, pa.array(n[done:upto]), pa.array(np.exp(-means[done:upto]))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "lang", "n_symbols", "perplexity"])
                done = upto

        ids, texts, size = [], [], 0
        for batch in batches:
            data = [t.encode() for t in batch.column(3).to_pylist()]
            at = 0
            for i, d in enumerate(data):
                texts.append(d)
                size += len(d)
                if size >= SCORED_BYTES:
                    yield from judged([*ids, batch.select([0, 1, 2]).slice(at, i + 1 - at)], texts)
                    ids, texts, size, at = [], [], 0, i + 1
            if at < len(data):
                ids.append(batch.select([0, 1, 2]).slice(at))
        if texts:
            yield from judged(ids, texts)

    return rows.select("row", "doc_id", "lang", "text").mapInArrow(work, "row bigint, doc_id bigint, lang string, n_symbols bigint, perplexity double")


def perplexities(rows: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, n_symbols, perplexity of every document of `rows`."""
    asked = cut(requests(rows, model.order), "requests")
    answers = asked.join(model.score(asked), "gram")
    schema = "row bigint, doc_id bigint, n_symbols bigint, perplexity double"
    model_order = model.order

    def work(docs: pa.Table, table: pa.Table) -> pa.Table:
        opened = zstandard.ZstdDecompressor()
        order = np.argsort(table.column("gram").to_numpy())
        known, log_p = table.column("gram").to_numpy()[order], table.column("log_p").to_numpy()[order]
        texts = [opened.decompress(d) for d in docs.column("data").to_pylist()]
        sizes, means = [], []
        for at in range(0, len(texts), 64):
            keys, n = grams_of(texts[at : at + 64], model_order)
            found = np.searchsorted(known, keys)
            if len(keys) and (found.max() >= len(known) or (known[found] != keys).any()):
                raise ValueError("the rows of the input changed their places between two scans")
            sizes.append(n)
            means.append(np.add.reduceat(log_p[found], np.cumsum(n) - n) / n)
        size, mean = np.concatenate(sizes), np.concatenate(means)
        return pa.table({"row": docs.column("row"), "doc_id": docs.column("doc_id"), "n_symbols": size, "perplexity": np.exp(-mean)})

    def empty_safe(docs: pa.Table, table: pa.Table) -> pa.Table:
        return work(docs, table) if docs.num_rows else pa.table({"row": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "n_symbols": pa.array([], pa.int64()), "perplexity": pa.array([], pa.float64())})

    return _compressed(rows).groupBy("chunk").cogroup(answers.select("chunk", "gram", "log_p").groupBy("chunk")).applyInArrow(empty_safe, schema)


def thresholds(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, own_limits: bool = False) -> DataFrame:
    """language, threshold from the trusted rows of `scored`; the row with `every` true is over all languages.

    With `own_limits` a language without trusted rows has one from all its rows.
    """
    cells = (
        scored.groupBy("lang", F.floor(F.log("perplexity") * CELLS).alias("cell")).agg(F.count_if("trusted").alias("docs"), F.count(F.lit(1)).alias("any"))
        .withColumn("every", F.explode(F.array(F.lit(False), F.lit(True))))
        .groupBy("every", F.when(~F.col("every"), F.col("lang")).alias("lang"), "cell").agg(F.sum("docs").alias("docs"), F.sum("any").alias("any"))
    )
    group = Window.partitionBy("every", "lang")
    if own_limits:
        untrusted = ~F.col("every") & (F.sum("docs").over(group) == 0)
        cells = cells.withColumn("docs", F.when(untrusted, F.col("any")).otherwise(F.col("docs")))
    cells = cells.where("docs > 0")
    upto = F.sum("docs").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    reached = cells.withColumn("upto", upto).withColumn("all", F.sum("docs").over(group)).where(F.col("upto") >= F.ceil(F.col("all") * quantile))
    return reached.groupBy("every", F.col("lang").alias("language")).agg((F.exp((F.min("cell") + 1) / CELLS) * slack).alias("threshold"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE, slack: float = SLACK, own_limits: bool = False, order: int = ORDER, held_out: bool = False,
) -> DataFrame:
    """One row per document: doc_id, row, lang, trusted, n_symbols, perplexity, threshold and kept.

    `labels` has doc_id, quality and toxic.
    """
    if not 1 <= order <= 7:
        raise StrataError("the order of the model is 1 to 7 bytes")
    text_batches(docs.sparkSession)
    rows = _chunked(docs, id_col, text_col, lang_col)
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good, n_good = counted(good.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id")), "trusted")
    few = n_good <= MOST_SENT
    frames = (rows if few else _compressed(rows)).join(F.broadcast(good) if few else good.hint("merge"), "doc_id", "left_semi")
    counts = cut(shard_counts(frames.select("text" if few else "data", held("doc_id").alias("held")), order), "counts")
    marks = good.withColumn("trusted", F.lit(True))

    def scored_by(model: Model, some: DataFrame) -> DataFrame:
        if model.entries <= MOST_HELD:
            named = cut(scored(some, model), "perplexities")
        else:
            named = some.select("row", "lang").join(cut(perplexities(some, model), "perplexities"), "row")
        named = named.join(F.broadcast(marks) if few else marks, "doc_id", "left")
        return named.withColumn("trusted", F.coalesce("trusted", F.lit(False)))

    named = scored_by(Model.of(counts, order), rows)
    limits = thresholds(named, quantile, slack, own_limits)
    if held_out:
        outside = scored_by(Model.of(counts, order, rest=True), rows.where(held("doc_id")))
        fresh = thresholds(outside, quantile, slack).select("every", F.col("language").alias("__language"), F.col("threshold").alias("__threshold"))
        same = (F.col("every") == F.col("__every")) & F.col("language").eqNullSafe(F.col("__language"))
        limits = limits.join(fresh.withColumnRenamed("every", "__every"), same, "left")
        limits = limits.select("every", "language", F.coalesce("__threshold", "threshold").alias("threshold"))
    limits = cut(limits.coalesce(1), "thresholds")
    overall = limits.where("every").collect()
    own = limits.where("NOT every").select("language", "threshold")
    judged = named.join(own, F.col("lang").eqNullSafe(F.col("language")), "left")
    limit = F.coalesce("threshold", F.lit(overall[0]["threshold"] if overall else math.inf))
    return judged.select("doc_id", "row", "lang", "trusted", "n_symbols", "perplexity", limit.alias("threshold"), (F.col("perplexity") <= limit).alias("kept"))
