"""SentencePiece's merge-type (BPE) encoding by a table over prefixes.

The model merges, again and again, the two neighbours whose joined text is the piece with the highest score, the leftmost of
equal ones. So what a text becomes is decided by neighbours: a row of pieces is a text's encoding exactly if each piece alone is
encoded as itself and no two neighbours, encoded together, merge across their border. The first merge across a border would
happen in that pair alone as it happens in the whole row, as nothing else has touched the two. A text has one encoding, hence
every prefix one last piece: the one that an automaton finds to end there, that is its own encoding, and that is compatible
with the last piece of the prefix before it. The table stores that piece for each prefix; the ids are read from its end.

Pieces take a space (the model's mark for it) at their left only, and no piece joins a line break to anything: between words
and at line breaks the text is cut, and the ids of recent words are remembered, a bounded number of them. What the vocabulary
lacks becomes bytes.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import REMEMBERED, Remembered, SuffixAutomaton, pack_ids
from .common import table

SPACE = "▁"


class PiecePrefix:
    """Encodes with an end id and decodes as the sentencepiece library does with the same model file. Models are refused that
    change the text otherwise than by marking spaces, lack bytes, or have pieces that this way cannot place."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        self.n, self.end = lib.get_piece_size(), lib.eos_id()
        pieces, self.bytes_of = {}, [b""] * self.n
        self.byte: dict[int, int] = {}
        for i in range(self.n):
            text = lib.id_to_piece(i)
            if lib.is_byte(i):
                value = int(text[3:5], 16)
                self.byte[value], self.bytes_of[i] = i, bytes([value])
            elif lib.is_unused(i):
                raise ValueError("unused pieces are not supported")
            elif lib.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not lib.is_control(i):
                pieces[i], self.bytes_of[i] = text, text.replace(SPACE, " ").encode()
        letters = {c for x in pieces.values() for c in x}
        if len(self.byte) != 256 or lib.normalize("  a  É\t　 ") != "▁▁▁a▁▁É\t　▁" or lib.encode("") or not letters <= set(pieces.values()):
            raise ValueError("not a merge-type model with byte fallback and an identity normalizer")
        self.text, self.score = pieces, {x: lib.get_score(i) for i, x in pieces.items()}
        self.starts = {i for i, x in pieces.items() if x.startswith(SPACE)}
        self.ends_in = SuffixAutomaton(pieces)
        words = not any(a != SPACE and b == SPACE for x in pieces.values() for a, b in zip(x, x[1:], strict=False)) and not any("\n" in x for x in pieces.values() if len(x) > 1)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if words else "(?s).+").findall
        self.merges: dict[int, list[tuple[float, str, str]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known = Remembered(lambda word: pack_ids(self.word(word)), REMEMBERED)
        self.names = [str(i) for i in range(self.n)]

    def _merges(self, piece: int) -> list[tuple[float, str, str]] | None:
        """How a piece comes about when it is encoded alone: before each merge its score and the pieces at the left and right
        edge, at last a score below all and the piece itself. None if it is not encoded as itself."""
        if piece not in self.merges:
            parts, out = list(self.text[piece]), []
            while True:
                best, at = float("-inf"), -1
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
                    if (score := self.score.get(a + b)) is not None and score > best:
                        best, at = score, i
                out.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.merges[piece] = out if len(parts) == 1 else None
        return self.merges[piece]

    def fits(self, first: int, second: int) -> bool:
        """Whether second alone is its own encoding and, after first (below 0: nothing, or bytes), no merge crosses the border.
        Both come about side by side, the higher score first, the left one of equal ones; a merge across is tried before each."""
        key = (first + 1) << 21 | second
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2 * REMEMBERED:
                self.pairs.clear()
            b = self._merges(second)
            known = b is not None
            if known and first >= 0:
                a, i, j = self._merges(first), 0, 0
                while True:
                    (left, _, edge), (right, other, _) = a[i], b[j]
                    across = self.score.get(edge + other)
                    if across is not None and across > left and across >= right:
                        known = False
                        break
                    if left == right == float("-inf"):
                        break
                    if left >= right:
                        i += 1
                    else:
                        j += 1
            self.pairs[key] = known
        return known

    def word(self, text: str) -> list[int]:
        """The ids of a text whose spaces are marked. last holds each prefix's unique last piece; -1 stands for a character that
        the vocabulary lacks (nothing merges with it), and for the beginning."""
        moves, shorter, length, tested = self.ends_in.moves.get, self.ends_in.shorter, self.ends_in.length, self.pairs.get
        last, state = [-1], 0
        for end, c in enumerate(text, 1):
            state, piece = moves((state, c)) or self.ends_in.move(state, c)
            while piece >= 0:
                before = last[end - length[piece]]
                fit = tested((before + 1) << 21 | piece)
                if self.fits(before, piece) if fit is None else fit:
                    break
                piece = shorter[piece]
            last.append(piece)
        out, at = [], len(text)
        while at:
            if (piece := last[at]) < 0:
                out += [self.byte[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                out.append(piece)
                at -= length[piece]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids, the end's included, as little-endian unsigned 32-bit integers."""
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        return b"".join(map(self.known.__getitem__, self.cut(marked))) + pack_ids([self.end])

    def decode(self, ids: bytes) -> str:
        """The text of the ids without the space that encoding puts in front; bytes that are no UTF-8 become replacement characters."""
        numbers = array.array("I", ids)
        said = b"".join(map(self.bytes_of.__getitem__, numbers))
        first = next((i for i in numbers if self.bytes_of[i]), -1)
        return said[first in self.starts :].decode("utf-8", "replace")

    def spelled(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, array.array("I", ids)))


@functools.lru_cache(maxsize=1)
def piece_prefix(path: str) -> PiecePrefix:
    """One for each worker: its tables, and what it remembers, serve the tasks that follow."""
    return PiecePrefix(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text of docs (doc_id, text) with an end id and decodes it again, in one pass without a shuffle.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by one space), decoded_sha256; with with_ids also ids
    (array<int>). A null text counts as empty: the end id alone. Texts of any length are encoded whole, in time linear in their
    length. Null or repeated doc_ids and other columns change nothing; one row out for each row in, none for none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_prefix(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                n, ids_sha, text_sha, lists = [], [], [], []
                for x in batch.column(1):
                    ids = model.encode(x.as_py() or "")
                    n.append(len(ids) // 4)
                    ids_sha.append(sha(model.spelled(ids)))
                    text_sha.append(sha(model.decode(ids)))
                    if with_ids:
                        lists.append(list(struct.unpack(f"<{len(ids) // 4}I", ids)))
                cols = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                if with_ids:
                    cols["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
