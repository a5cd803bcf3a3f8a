"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece exactly one token can end its encoding. A suffix automaton over the vocabulary gives, at every
position, the tokens that end there; a token fits if the tokens before it, already known for the shorter prefix, end
with one that keeps the boundary when the two are encoded together. Following the back-pointers yields the exact ids, in
time linear in the piece, without merging anything.

Pieces come from the vocabulary's own splitting pattern. Where a text has characters outside Latin-1 and common punctuation,
whose classes could differ between Unicode versions, the tokenizer file's own splitter cuts the text; the ids still come from
the automaton. Each worker remembers the ids of recent pieces, a bounded number of them.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Characters whose classes all Unicode versions agree on, and the same pattern over them for the faster standard library.
PLAIN = re.compile("[\t\n\r -~¡-ÿ–—‘-”…]*")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t\n\r "
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
REMEMBERED = 400_000


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """Of a set of tokens: after reading a text, which tokens it ends in, the longest first. States are the tokens' prefixes;
    where a state cannot be prolonged, the longest suffix of it that is a state goes on (Aho and Corasick 1975). Moves found
    that way are remembered, a bounded number of them."""

    def __init__(self, tokens: dict[int, str]):
        self.next: dict[tuple[int, str], int] = {}
        own = [-1]
        order: list[list[tuple[int, str, int]]] = []  # by depth: parent, character, state
        for token, text in tokens.items():
            state = 0
            for depth, c in enumerate(text):
                if (to := self.next.get((state, c))) is None:
                    to = self.next[state, c] = len(own)
                    own.append(-1)
                    if depth == len(order):
                        order.append([])
                    order[depth].append((state, c, to))
                state = to
            own[state] = token
        size = max(tokens, default=0) + 1
        self.length, self.shorter = [0] * (size + 1), [-1] * (size + 1)
        for token, text in tokens.items():
            self.length[token] = len(text)
        self.fall, longest = [0] * len(own), list(own)
        for level in order:
            for parent, c, state in level:
                back = self.fall[parent]
                while parent and back and (back, c) not in self.next:
                    back = self.fall[back]
                self.fall[state] = back = self.next.get((back, c), 0) if parent else 0
                if own[state] >= 0:
                    self.shorter[own[state]] = longest[back]
                else:
                    longest[state] = longest[back]
        self.longest = longest
        #: (state, character): next state, longest token that the text then ends in
        self.moves = {k: (to, longest[to]) for k, to in self.next.items()}

    def move(self, state: int, c: str) -> tuple[int, int]:
        back = state
        while back and (back, c) not in self.next:
            back = self.fall[back]
        if len(self.moves) > len(self.next) + REMEMBERED:
            self.moves.clear()
        to = self.next.get((back, c), 0)
        self.moves[state, c] = out = to, self.longest[to]
        return out


class Remembered(dict):
    """What make gives for each key, for the most recently used keys of up to LONGEST characters: when `most` are held, the
    older half waits to be asked for again, and is then dropped. So what is held is bounded in bytes too."""

    LONGEST = 64

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key):
        got = self.old.pop(key, None)
        if got is None:
            got = self.make(key)
        if len(key) > self.LONGEST:
            return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class PrefixBpe:
    """Encodes and decodes as the tokenizers library does with the same file, without its truncation or padding."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        # a word's last byte carries the end mark, if the vocabulary has one: it is then a symbol of its own, 256 above
        self.mark = model.get("end_of_word_suffix") or ""
        symbols = {i: self._symbols(word, letters) for word, i in model["vocab"].items()}
        self.bytes_of = {i: bytes(ord(c) & 255 for c in x) for i, x in symbols.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = ids[left], ids[right], ids[left + right]
            self.merged[a, b] = rank
            self.parts.setdefault(made, (rank, a, b))
        self.suffixes = SuffixAutomaton({i: x for i, x in symbols.items() if len(x) == 1 or i in self.parts})
        self.find = re.compile(PLAIN_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.letters = letters
        self.known = Remembered(lambda p: pack_ids(self.piece(p.encode())), REMEMBERED)
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.all_bytes = {**self.bytes_of, **{i: s.encode() for s, i in self.special.items()}}

    def _symbols(self, word: str, letters: dict[str, int]) -> str:
        ends = self.mark and word.endswith(self.mark) and word != self.mark
        codes = [letters[c] for c in (word[: -len(self.mark)] if ends else word)]
        return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * bool(ends)) if codes else ""

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at a token's left (0) or right (1) edge while it is merged, smallest first, each with the
        rank of the merge that ends it."""
        if (known := self.edges[side].get(token)) is None:
            known, ends, piece = [], float("inf"), token
            while True:
                known.append((piece, ends))
                if piece not in self.parts:
                    break
                ends, piece = self.parts[piece][0], self.parts[piece][1 + side]
            known.reverse()
            self.edges[side][token] = known
        return known

    def fits(self, first: int, second: int) -> bool:
        """Whether encoding both tokens' bytes together gives the two tokens back: no merge may cross the boundary while
        the pieces at its two sides stand. Merges run by rank, and of equal ones the leftmost first."""
        pair = first << 20 | second
        if (known := self.pairs.get(pair)) is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            a, b, i, j, known = self._edge(first, 1), self._edge(second, 0), 0, 0, True
            while i < len(a) and j < len(b):
                rank = self.merged.get((a[i][0], b[j][0]))
                if rank is not None and rank < a[i][1] and rank <= b[j][1]:
                    known = False
                    break
                if a[i][1] <= b[j][1]:
                    i += 1
                else:
                    j += 1
            self.pairs[pair] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece, not empty."""
        text = data.decode("latin-1")
        if self.mark:
            text = text[:-1] + chr(256 + data[-1])
        moves, shorter, length, fitting = self.suffixes.moves.get, self.suffixes.shorter, self.suffixes.length, self.pairs.get
        last, state = [-1], 0  # the unique last token of each prefix
        for end, c in enumerate(text, 1):
            state, token = moves((state, c)) or self.suffixes.move(state, c)
            while (start := end - length[token]) > 0:
                if (before := last[start]) >= 0:
                    fit = fitting(before << 20 | token)
                    if self.fits(before, token) if fit is None else fit:
                        break
                token = shorter[token]
            last.append(token)
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def _plain(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.find(text)
        return [bytes(self.letters[c] for c in x).decode() for x, _ in self.splitter.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut and any(s in text for s in self.special):
            parts = self.cut(text)
            return b"".join(struct.pack("<I", self.special[x]) if i % 2 else self.encode(x) for i, x in enumerate(parts) if x)
        return b"".join(map(self.known.__getitem__, self._plain(text)))

    def decode(self, ids: bytes) -> str:
        """The text of the ids, special ones included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.all_bytes.__getitem__, array.array("I", ids))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def prefix_bpe(path: str) -> PrefixBpe:
    """One for each worker, not for each task: its tables, and what it remembers, serve the tasks that follow."""
    return PrefixBpe(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text of docs (doc_id, text) and decodes it again, in one pass without a shuffle.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256; with with_ids also ids (array<int>). A null text counts as empty:
    no tokens. Null or repeated doc_ids and other columns change nothing; one row out for each row in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = prefix_bpe(path)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                n, ids_sha, text_sha, lists = [], [], [], []
                for x in batch.column(1):
                    ids = bpe.encode(x.as_py() or "")
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    if with_ids:
                        lists.append(list(struct.unpack(f"<{len(ids) // 4}I", ids)))
                cols = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if with_ids:
                    cols["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
