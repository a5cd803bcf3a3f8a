"""Best-fit packing by a configuration linear program over the histogram of lengths.

Documents become token ids plus an end id; those longer than a sequence are cut into whole sequences and a remainder. The
remainders' lengths, at most MAX_LEN different ones, form a histogram. Over it, the linear program "fewest sequences whose
configurations cover all lengths" is solved by multiplicative weights: lengths still short of cover gain weight, and a
knapsack dynamic program prices the best configuration with each length under those weights, round after round until every
length is covered. The fractional solution is rounded down to whole repeats; what is left, a bounded number of pieces, is
packed best-fit by decreasing length. The plan holds a bounded number
of rows however many pieces there are. Each piece finds its place from its rank among pieces of the same length; ranks come
from counts by (length, salt), so a length that a third of all pieces share is spread over many tasks.

A null or empty text is one end id; a null doc_id is kept, and repeated rows are packed as often as they stand; pieces of one
length take their places in no order that matters. A very long text is tokenised alone and cut into many pieces. An empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_letters
from .common import give_back, literal_array, staged, table

MAX_LEN = 2048
#: A staged piece's own number, hashed.
ROW = "row_of_piece"
END_ID = 0
REMEMBERED, SLICE_BYTES = 400_000, 4 << 20
#: Characters on whose classes, case and composition all Unicode versions agree.
PLAIN = re.compile("[\t\n\r -~¡-ÿ–—‘-”…]*")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t\n\r "


class Known:
    """What make gives for each of many different strings, looked up all at once: the strings are one Arrow array, what make gave
    for them one array of ids. When more than `most` are held, the half that was asked for last stays. Strings of more than
    LONGEST bytes are not held, so what is held is bounded in bytes too."""

    LONGEST = 64

    def __init__(self, make, most: int):
        self.make, self.most, self.round = make, most, 0
        self.keys, self.sizes, self.used = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Of different strings: how many ids each has, and the ids of all."""
        at = pc.index_in(keys, value_set=self.keys)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        self.round += 1
        self.used[at[~new]] = self.round
        sizes = np.zeros(len(keys), np.int64)
        sizes[~new] = self.sizes[at[~new]]
        starts = np.cumsum(self.sizes) - self.sizes
        ids, source = self.ids, np.where(new, 0, starts[at] if len(starts) else 0)
        if new.any():
            missing = keys.filter(pa.array(new))
            made, more = self.make(missing)
            sizes[new], source[new] = made, len(ids) + np.cumsum(made) - made
            ids = np.concatenate([ids, more])
        out = taken(ids, source, sizes)
        if new.any():
            self._hold(missing, made, more)
        return sizes, out

    def _hold(self, keys: pa.LargeStringArray, sizes: np.ndarray, ids: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(keys), self.LONGEST)
        kept = short.to_numpy(zero_copy_only=False)
        starts = (np.cumsum(sizes) - sizes)[kept]
        self.keys = pa.concat_arrays([self.keys, keys.filter(short)])
        self.ids = np.concatenate([self.ids, taken(ids, starts, sizes[kept])])
        self.sizes, self.used = np.concatenate([self.sizes, sizes[kept]]), np.concatenate([self.used, np.full(len(starts), self.round)])
        if len(self.keys) > self.most:
            last = np.sort(np.argsort(self.used, kind="stable")[-(self.most // 2) :])
            self.ids = taken(self.ids, (np.cumsum(self.sizes) - self.sizes)[last], self.sizes[last])
            self.keys, self.sizes, self.used = self.keys.take(pa.array(last)), self.sizes[last], self.used[last]


def taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at starts, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordTokens:
    """The ids that the tokenizers library gives for the file. No word spans white space, so texts are cut there first, many
    at a time; the different chunks of them that are not known are cut into words by the file's pattern, all at once, and each
    different word that is not known is encoded once by the library's model. Recent short chunks and words are remembered,
    within a bound. Texts of other characters than PLAIN, or with special tokens, go through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        # a line break, which no chunk holds, is between chunks
        self.find = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+|\n").findall
        self.letters = {b: c for c, b in byte_letters().items()}
        self.model = self.library.model
        self.words = Known(self._words, REMEMBERED)
        self.chunks = Known(self._chunks, REMEMBERED)

    def _words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        ids = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] for w in words.to_pylist()]
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(itertools.chain.from_iterable(ids), "<u4")

    def _chunks(self, chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        words = pa.array(self.find("\n".join([*chunks.to_pylist(), ""]).lower()), pa.large_string()).dictionary_encode()
        each, which = words.dictionary, words.indices.to_numpy()
        breaks = pc.equal(each, "\n").to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(each), np.int64)
        sizes[~breaks], ids = self.words(each.filter(pa.array(~breaks)))
        ends = np.cumsum(sizes[which])
        return np.diff(ends[np.flatnonzero(breaks[which])], prepend=0), taken(ids, (np.cumsum(sizes) - sizes)[which], sizes[which])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Of each text its little-endian unsigned 32-bit ids."""
        plain = [bool(PLAIN.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        cut = pc.ascii_split_whitespace(pa.array([t if p else "" for t, p in zip(texts, plain, strict=True)], pa.large_string()))
        parts = cut.flatten().dictionary_encode()
        sizes, ids = self.chunks(parts.dictionary)
        which = parts.indices.to_numpy()
        data = taken(ids, (np.cumsum(sizes) - sizes)[which], sizes[which]).tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        bounds = (4 * ends[cut.offsets.to_numpy()]).tolist()
        return [data[lo:hi] if p else self._whole(t) for t, p, lo, hi in zip(texts, plain, bounds[:-1], bounds[1:], strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each worker, not for each task: its tables, and what it remembers, serve the tasks that follow."""
    return WordTokens(path)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SLICE_BYTES of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES)))
        yield batch.slice(at, end - at)
        at = end


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cuts docs (doc_id, text) into pieces of at most max_len ids; a null text counts as empty and has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, names = word_tokens(path), np.array([end_id], "<u4").tobytes(), [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
        for whole in batches:
            for batch in _slices(whole):
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * max_len)):
                        part = ids[at : at + 4 * max_len]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names + ["ids"] * with_ids)
                rows = ids = part = None
                give_back()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity up to the given one the highest total value that fits, and the length picked last (0: none)."""
    offered = np.where(value > 0, value, -np.inf)[::-1]  # so that a slice of it runs against best
    best, pick, n = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), len(value)
    for c in range(1, capacity + 1):
        low = max(0, c - n + 1)
        sums = best[low:c] + offered[n - 1 - c + low : n - 1]
        at = sums.argmax()
        if sums[at] > best[c - 1]:
            best[c], pick[c] = sums[at], c - low - at
        else:
            best[c] = best[c - 1]
    return best, pick


def _picked(pick: np.ndarray, capacity: int) -> list[int]:
    out, c = [], capacity
    while c > 0:
        if pick[c]:
            out.append(int(pick[c]))
            c -= pick[c]
        else:
            c -= 1
    return out


def _sweep(counts: np.ndarray, capacity: int, first: np.ndarray, rate: float, eta: float, slack: float) -> tuple[dict[tuple[int, ...], float], float, np.ndarray]:
    """One run of multiplicative weights until every length is covered: the configurations with their repeats, the highest
    lower bound that its prices prove, and the mean of the prices, each scaled so that the best configuration costs 1.

    The price of a length starts at `first` and falls by the factor exp(-eta * covered share): what lags gains weight. Each
    round is one knapsack, whose table prices the best configuration with each length in it. Those within `slack` of the best
    of all are used, best first, each until one of its lengths is covered by `rate` more than when the round began, but at
    least once if that much is still short. The best of all is always among them, so each round covers more."""
    demand, cover = np.maximum(counts, 1), np.zeros(len(counts))
    out, bound, mean, weight = {}, 0.0, np.zeros(len(counts)), 0.0
    while True:
        price = first * np.exp(-eta * cover / demand) * (cover < demand - 1e-9)
        offered = np.flatnonzero(price)
        if not len(offered):
            return out, bound, mean / max(weight, 1e-300)
        best, pick = _knapsack(price, capacity)
        total = price[offered] + best[capacity - offered]
        scaled = price / total.max()  # no configuration costs more than 1: what the demand costs is a lower bound
        bound, made = max(bound, float(scaled @ counts)), 0.0
        most = np.minimum(cover + np.maximum(rate * demand, 1.0), demand)
        near = np.flatnonzero(total >= (1 - slack) * total.max())
        for length in offered[near[np.argsort(-total[near], kind="stable")]].tolist():
            if cover[length] > most[length] - 1e-9:
                continue
            config = tuple(sorted([length, *_picked(pick, capacity - length)], reverse=True))
            kinds, n = np.unique(np.array(config), return_counts=True)
            room = most[kinds] - cover[kinds]
            if (room <= 1e-9).any():
                continue
            times = float((room / n).min())
            # whole repeats wherever what is short allows them, so that rounding loses little
            if times < 1 <= float(((demand - cover)[kinds] / n).min()):
                times = 1.0
            elif times > 1:
                times = float(np.floor(times + 1e-9))
            out[config] = out.get(config, 0.0) + times
            cover[kinds] += times * n
            made += times
        mean, weight = mean + made * scaled, weight + made


def _sure_prices(n: int, capacity: int, kinds: int = 30) -> Iterator[np.ndarray]:
    """Prices of lengths under which no configuration costs more than 1: shares of a sequence, and shares rounded down to
    k-ths of k + 1 (dual feasible functions; k = 1 counts lengths above a half as 1)."""
    lengths = np.arange(n)
    yield lengths / capacity
    for k in range(1, kinds + 1):
        yield np.where((k + 1) * lengths % capacity == 0, lengths / capacity, (k + 1) * lengths // capacity / k)


def solve(counts: np.ndarray, capacity: int, gap: float = 5e-4, sweeps: int = 3, rate: float = 0.2, eta: float = 4.0, slack: float = 0.004) -> tuple[dict[tuple[int, ...], float], float]:
    """Multiplicative weights for: minimise sum(x) with sum(x_c * c[l]) >= counts[l]. The repeats of the best sweep, and the
    highest lower bound on the program's value that any prices proved (those of _sure_prices among them).

    Sweeps repeat, each with half the steps and half the fall of prices of the one before, and from the mean prices of the
    sweep with the best bound, until value and bound are within `gap` of each other, a sweep has not
    brought them a third closer, or `sweeps` have run."""
    lengths, counts = np.arange(len(counts)) / capacity, np.where(np.arange(len(counts)) > 0, counts, 0).astype(float)
    # a little more than its share for a long length, which fits fewer places
    first = np.where(counts > 0, lengths * (1 + 0.1 * lengths), 0.0)
    found, value, apart = {}, np.inf, np.inf
    bound = max(float(price @ counts) for price in _sure_prices(len(counts), capacity))
    for _ in range(sweeps if counts.any() else 0):
        out, least, mean = _sweep(counts, capacity, first, rate, eta, slack)
        mean = np.where(counts > 0, np.maximum(mean, 1e-9), 0.0)
        proved = float(mean @ counts) / max(_knapsack(mean, capacity)[0][-1], 1e-300)
        if max(least, proved) > bound * (1 + 1e-6):
            first = mean
        bound = max(bound, least, proved)
        if sum(out.values()) < value:
            found, value = out, sum(out.values())
        if value <= bound * (1 + gap) or value - bound > 0.7 * apart:
            break
        apart = value - bound
        rate, eta, slack = rate / 2, eta / 2, slack / 2
    return found, bound


def best_fit(counts: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing on counts: all pieces of a length go to the fullest sequences that hold them, equal sequences
    together, so that the time does not grow with the number of pieces. Each configuration with its repeats."""
    spaces: list[int] = []  # sorted
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # by space left: configurations and how many

    def put(space: int, config: tuple[int, ...], n: int) -> None:
        if space not in groups:
            groups[space] = {}
            bisect.insort(spaces, space)
        groups[space][config] = groups[space].get(config, 0) + n

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):  # new sequences, as many as these pieces fill; the loop goes on to fill them
                opened = max(n // (capacity // length), 1)
                put(capacity - length, (length,), opened)
                n -= opened
                continue
            space = spaces[at]
            config, there = groups[space].popitem()
            used = min(there, n)
            if there > used:
                groups[space][config] = there - used
            elif not groups[space]:
                del groups[space], spaces[at]
            put(space - length, (*config, length), used)
            n -= used
    out: dict[tuple[int, ...], int] = {}
    for own in groups.values():
        for config, n in own.items():
            out[config] = out.get(config, 0) + n
    return out


def plan(counts: np.ndarray, capacity: int, program: dict[tuple[int, ...], float] | None = None) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, repeats) that hold exactly counts[l] pieces of each length l < capacity: the program's configurations
    in whole repeats, the fullest first, and best fit for the pieces that rounding left. How much of the program's solution
    the rounding keeps (its emptiest configurations may be better taken apart) is what needs the fewest sequences. `program` is
    a solution known already."""
    counts = np.where(np.arange(len(counts)) > 0, counts, 0).astype(np.int64)
    program = solve(counts, capacity)[0] if program is None else program
    whole, left, held = [], counts.copy(), 0
    for config, times in sorted(program.items(), key=lambda x: (-sum(x[0]), x[0])):
        kinds, n = np.unique(np.array(config), return_counts=True)
        if (repeats := int(min(np.floor(times + 1e-9), (left[kinds] // n).min()))) > 0:
            whole.append((config, repeats, held))
            left[kinds] -= repeats * n
            held += repeats
    best, least = [], np.inf
    for share in (1.0, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5, 0.3, 0.1):
        kept = [(config, repeats) for config, repeats, before in whole if before < share * held]
        rest = counts.copy()
        for config, repeats in kept:
            np.subtract.at(rest, list(config), repeats)
        made = kept + list(best_fit(rest, capacity).items())
        if (total := sum(n for _, n in made)) < least:
            best, least = made, total
    return best


def places(configs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """For each length in each configuration: length, first rank, copies, repeats, first sequence, offset."""
    rows, sequence, used = [], 0, {}
    for config, repeats in configs:
        offset = 0
        kinds, n = np.unique(np.array(config), return_counts=True)
        for length, copies in zip(kinds.tolist(), n.tolist(), strict=True):
            rows.append((length, used.get(length, 0), copies, repeats, sequence, offset))
            used[length] = used.get(length, 0) + copies * repeats
            offset += length * copies
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(cut: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...). cut is read several times: stage it first.

    Pieces of one length and salt are ranked by (doc_id, piece, ids_crc32), nulls first. Whole-sequence pieces stand alone. The
    histogram (max_len rows) and the plan reach the driver; counts by (length, salt) stay distributed.
    """
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(max_len, np.int64)
    for length, n in histogram.items():
        if length < max_len:
            counts[length] = n
    rows = places(plan(counts, max_len)) if counts.sum() else np.zeros((0, 6), np.int64)
    base = int((rows[:, 4] + rows[:, 3]).max()) if len(rows) else 0
    # as many salts for a length as each then has rows; a staged row's number tells rows of one id apart
    salts = literal_array([math.isqrt(histogram.get(n, 0)) + 1 for n in range(max_len + 1)], "int")
    spread = F.col(ROW) if ROW in cut.columns else F.xxhash64("doc_id", "piece")
    salted = cut.withColumn("salt", F.pmod(spread, F.get(salts, F.col("length").cast("int"))).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own)).join(starts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rank") - 1).drop("first", "salt")
    names = [c for c in cut.columns if c in PIECES and c != ROW or c == "ids"]
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = np.int64(1) << 44
        keys = rows[:, 0] * span + rows[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = base + rank, np.zeros(len(rank), np.int64)
            if len(at := np.flatnonzero(length < max_len)):
                row = rows[np.searchsorted(keys, length[at] * span + rank[at], "right") - 1]
                k = rank[at] - row[:, 1]
                sequence[at], offset[at] = row[:, 4] + k // row[:, 2], row[:, 5] + k % row[:, 2] * length[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, max_len: int = MAX_LEN) -> DataFrame:
    """One row for each piece of docs (doc_id, text), with its sequence and its place there; sequences are gapless from 0.

    An empty table gives an empty result; empty and null texts are one end id; repeated rows are packed as often as they
    stand; a null doc_id is kept; other columns are ignored.
    """
    cut = pieces(docs, path, max_len).withColumn(ROW, F.xxhash64(F.monotonically_increasing_id()))
    return pack(staged(cut, "pieces"), max_len)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
