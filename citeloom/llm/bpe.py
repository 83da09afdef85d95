"""Corpus encoding with a public byte-level BPE vocabulary, as a bounded-lookahead streaming transducer.

The merges of a byte-level BPE are applied by rank inside each pretoken. Two runs over the same bytes, of
which one sees more bytes on the right, can differ only near the right end: going through the ranks in
order, the place up to which both runs agree moves left by the length of x when a merge (x, y) happens in
one run only, and the next such merge (x2, y2) needs a y2 that begins with x and a higher rank. The largest
sum of lengths over such chains, `lookahead(ranks)`, is computed from the merge list. A token that ends that
many bytes before the end of what was read is therefore stable: it is emitted, and reading goes on from its
end. Memory per pretoken is the lookahead and one block, whatever the pretoken's length.

Decoding goes token by token through an incremental UTF-8 state machine.

Defined cases: null and empty texts have no ids; a blank text is encoded like any other; strings of special
tokens are ordinary text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies by default; every function takes the path as a parameter.
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text into pretokens before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The largest vocabulary file that is sent to every executor.
MOST_VOCAB_BYTES = 64 << 20
#: Bytes read beyond the lookahead before stable tokens are emitted.
BLOCK = 2048
#: Pretokens kept in a worker's memo, and the longest pretoken that is kept; more only costs time.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48


def read_vocab(path: str = DEFAULT_VOCAB) -> bytes:
    """The vocabulary file. It is read on the driver only and sent to the workers, so it need not lie on their machines."""
    data = Path(path).read_bytes()
    if len(data) > MOST_VOCAB_BYTES:
        raise ValueError(f"a vocabulary of {len(data)} bytes is not broadcast")
    return data


def load_ranks(path: str = DEFAULT_VOCAB, data: bytes | None = None) -> dict[bytes, int]:
    """The vocabulary as bytes -> rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, (read_vocab(path) if data is None else data).splitlines())}


def lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes to the right of a token after which no further byte can change it (see the module's text)."""
    reach: dict[bytes, int] = {}
    most = 0
    for token, _ in sorted(ranks.items(), key=lambda kv: kv[1]):
        moves = []
        for cut in range(1, len(token)):
            x, y = token[:cut], token[cut:]
            if x in ranks and y in ranks:
                before = max((reach.get(y[:k], 0) for k in range(1, len(y) + 1)), default=0)
                moves.append((x, cut + before))
        for x, n in moves:
            if n > reach.get(x, 0):
                reach[x] = n
                most = max(most, n)
    return most


def merge_block(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one block of bytes: lowest rank first, leftmost first, by heap and linked list."""
    n = len(piece)
    if piece in ranks:
        return [piece]
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or end[i] >= n:
            continue
        j = end[i]
        if end[j] != stop:
            continue
        end[i] = stop
        alive[j] = False
        if stop < n:
            prev[stop] = i
            r = ranks.get(piece[i : end[stop]])
            if r is not None:
                heappush(heap, (r, i, end[stop]))
        h = prev[i]
        if h >= 0:
            r = ranks.get(piece[h:stop])
            if r is not None:
                heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


class Transducer:
    """Streams the ids of a text; holds the vocabulary and a bounded memo of short pretokens."""

    def __init__(self, ranks: dict[bytes, int], ahead: int | None = None, block: int = BLOCK):
        self.ranks = ranks
        self.ahead = lookahead(ranks) if ahead is None else ahead
        self.block = block
        self.split = regex.compile(PATTERN)
        self.bytes_of = {r: t for t, r in ranks.items()}
        outer = self

        class Memo(dict):
            def __missing__(self, pretoken: str) -> list[int]:
                ids = list(outer.pretoken(pretoken.encode("utf-8", "surrogatepass")))
                if len(pretoken) <= MEMO_CHARS:
                    if len(self) >= MEMO_ENTRIES:
                        self.clear()
                    self[pretoken] = ids
                return ids

        self.memo = Memo()

    def pretoken(self, piece: bytes) -> Iterator[int]:
        """Ids of one pretoken, each emitted as soon as it is stable."""
        start, step = 0, self.block + self.ahead
        while True:
            stop = min(len(piece), start + step)
            last = stop == len(piece)
            stable = stop if last else stop - self.ahead
            at = start
            for token in merge_block(piece[start:stop], self.ranks):
                if at + len(token) > stable:
                    break
                at += len(token)
                yield self.ranks[token]
            if last:
                return
            start, step = at, (self.block + self.ahead if at > start else 2 * step)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get = self.memo.__getitem__
        if len(text) < 1_000_000:
            return list(chain.from_iterable(map(get, self.split.findall(text))))
        return list(chain.from_iterable(get(m.group()) for m in self.split.finditer(text)))

    def decode(self, ids: list[int]) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("surrogatepass")
        parts = [machine.decode(self.bytes_of[i]) for i in ids]
        return "".join(parts) + machine.decode(b"", final=True)


_loaded: dict[tuple[str, int], Transducer] = {}


def transducer(path: str, ahead: int, data: bytes | None = None) -> Transducer:
    """The transducer of a worker, made once for each vocabulary path."""
    if (path, ahead) not in _loaded:
        _loaded[path, ahead] = Transducer(load_ranks(path, data), ahead)
    return _loaded[path, ahead]


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB
) -> DataFrame:
    """(id_col, ids array<int>): the ids of every text, in one pass without a shuffle.

    Null and empty texts give an empty list. Other columns, whatever their names, are not read.
    """
    data = read_vocab(vocab)
    ahead = lookahead(load_ranks(vocab, data))
    sent = docs.sparkSession.sparkContext.broadcast(data)
    d = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocab, ahead, sent.value)
        for b in batches:
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["k", "ids"])

    kind = d.schema["k"].dataType.simpleString()
    return d.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(id_col), "ids")


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB
) -> DataFrame:
    """(id_col, n_tokens bigint) of every text; 0 for null and empty texts."""
    return encode_documents(docs, id_col, text_col, vocab).select(id_col, F.size("ids").cast("bigint").alias("n_tokens"))


def decode_documents(
    encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocab: str = DEFAULT_VOCAB
) -> DataFrame:
    """(id_col, text string): the text of every list of ids; null and empty lists give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocab(vocab))
    d = encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocab, 0, sent.value)
        for b in batches:
            texts = [t.decode(x) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k", "text"])

    kind = d.schema["k"].dataType.simpleString()
    return d.mapInArrow(run, f"k {kind}, text string").select(F.col("k").alias(id_col), "text")
