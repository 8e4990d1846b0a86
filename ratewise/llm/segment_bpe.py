"""Byte-level BPE by rank file: a segment tree over byte positions holds the leftmost pair of least rank.

Leaf i holds (rank of the pair that starts at byte i, i) as one integer, so the
root is the pair to merge: least rank, leftmost of equals. A merge gives the
left token the new id, unlinks the right one and updates three leaves: the
dead position, the merged one and its live neighbour before. Short pieces of a
batch are merged together as numpy arrays, one tree a row; long pieces have a
tree of their own, so a piece of n bytes takes n log n steps.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest piece, in bytes, that is merged in a batch of trees.
SHORT = 64
#: Bytes of memory for the pieces that a Python worker remembers before it starts anew, what a piece takes besides
#: its bytes and those of its ids (two objects and a place in the table), and the longest piece remembered.
REMEMBER, OBJECTS, LONGEST = 16 << 20, 180, 64
#: Trees that are merged together.
TREES = 4096
#: Characters of texts that are encoded together (a longer text is encoded alone).
CHARS = 1_000_000


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id (fixed size: the vocabulary)."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in rows) + 1)
    for token, r in rows:
        tokens[int(r)] = base64.b64decode(token)
    return tokens


class Merges:
    """Pair ranks as sorted arrays: a pair of ids joins to the id of its bytes."""

    def __init__(self, tokens: list[bytes]):
        import numpy as np

        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens) if t}
        pairs = sorted(
            (self.ids[t[:k]] << 32 | self.ids[t[k:]], i)
            for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids
        )
        self.pair = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.rank = np.array([r for _, r in pairs] or [0], np.int64)
        self.of = dict(pairs)
        self.byte = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)

    def encode_long(self, piece: bytes) -> list[int]:
        """One tree for one piece."""
        n = len(piece)
        none = len(self.tokens) * n
        tok = [int(self.byte[b]) for b in piece]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        size = 1 << max(0, (n - 1).bit_length())
        tree = [none] * (2 * size)
        of = self.of

        def leaf(i):
            j = after[i]
            r = of.get(tok[i] << 32 | tok[j]) if j < n else None
            return none if r is None else r * n + i

        for i in range(n):
            tree[size + i] = leaf(i)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i, value):
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                v = a if a < b else b
                if tree[k] == v:
                    break
                tree[k] = v
                k >>= 1

        while (top := tree[1]) < none:
            rank, i = divmod(top, n)
            j = after[i]
            tok[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        out, i = [], 0
        while i < n:
            out.append(tok[i])
            i = after[i]
        return out

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """One tree a row for pieces of 1 to SHORT bytes; the ids of each as little-endian uint32 bytes."""
        import numpy as np

        out = [b""] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = 2
        while size <= SHORT:
            rows = np.flatnonzero((length <= size) & (length > (size // 2 if size > 2 else 0)))
            for at in range(0, len(rows), TREES):
                self._batch(pieces, rows[at:at + TREES], length, size, out)
            size *= 2
        return out

    def _batch(self, pieces, rows, length, size, out):
        import numpy as np

        n, m = length[rows], len(rows)
        none = np.int64(1) << 40
        raw = np.frombuffer(b"".join(pieces[r].ljust(size, b"\0") for r in rows.tolist()), np.uint8).reshape(m, size)
        tok = np.full((m, size + 1), -1, np.int64)
        tok[:, :size] = np.where(np.arange(size) < n[:, None], self.byte[raw], -1)
        after = np.broadcast_to(np.minimum(np.arange(1, size + 2), size), (m, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size), (m, size + 1)).copy()

        def leaf(r, i):
            a, b = tok[r, i], tok[r, after[r, i]]
            key = a << 32 | b
            k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            return np.where((a >= 0) & (b >= 0) & (self.pair[k] == key), self.rank[k] * size + i, none)

        every = np.arange(m)
        tree = np.full((m, 2 * size), none, np.int64)
        for i in range(size - 1):
            tree[:, size + i] = leaf(every, np.full(m, i))
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(r, i, value):
            k = size + i
            tree[r, k] = value
            k = k >> 1
            while k[0]:
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                k = k >> 1

        while len(r := np.flatnonzero(tree[:, 1] < none)):
            rank, i = np.divmod(tree[r, 1], size)
            j = after[r, i]
            k = after[r, j]
            tok[r, i], tok[r, j], after[r, i] = rank, -1, k
            before[r, k] = i
            put(r, j, none)
            put(r, i, leaf(r, i))
            p = before[r, i]
            has = p >= 0
            if has.any():
                put(r[has], p[has], leaf(r[has], p[has]))
        live = tok[:, :size] >= 0
        flat, ends = tok[:, :size][live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        begin = 0
        for r, end in zip(rows.tolist(), ends):
            out[r] = flat[begin:end]
            begin = end

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        import numpy as np

        out, short, at = [b""] * len(pieces), [], []
        for k, piece in enumerate(pieces):
            known = self.ids.get(piece)
            if known is not None:
                out[k] = known.to_bytes(4, "little")
            elif len(piece) > SHORT:
                out[k] = np.array(self.encode_long(piece), "<u4").tobytes()
            elif piece:
                short.append(piece)
                at.append(k)
        for k, ids in zip(at, self.encode_short(short)):
            out[k] = ids
        return out


class Codec:
    """Splits a text by the pattern and remembers the ids of short pieces, within a bound of bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.merges, self.split = Merges(tokens), regex.compile(pattern).findall
        self.seen, self.held = {}, 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes."""
        split = [self.split(text) for text in texts]
        if self.held > REMEMBER:
            self.seen, self.held = {}, 0
        new = list(set().union(*split).difference(self.seen))
        coded = dict(zip(new, self.merges.encode_pieces([p.encode() for p in new])))
        short = {p: x for p, x in coded.items() if len(p) <= LONGEST}
        self.seen |= short
        self.held += sum(len(p) + len(x) + OBJECTS for p, x in short.items())
        long = coded if len(short) < len(coded) else {}
        find = self.seen.get
        return [b"".join([find(p) or long[p] for p in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.merges.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(tokens, pattern):
    """One codec a worker process, kept across its tasks."""
    import sys

    held = sys.__dict__.setdefault("_segment_bpe", {})
    key = (len(tokens), tokens[-1], pattern)
    if key not in held:
        held.clear()
        held[key] = Codec(tokens, pattern)
    return held[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array) if ``with_ids``.

    Null text counts as empty and has no tokens. Each match of ``pattern`` is
    encoded on its own, without special tokens; decoding gives the text's bytes
    back if the pattern's matches cover the text and every byte is a token.
    The rank file is read by the driver, and its tokens are broadcast: their
    number is the vocabulary's. Other columns are ignored; ids may be null or repeat.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        codec = _codec(shared.value, pattern)
        for batch in batches:
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = [0, *(np.flatnonzero(np.diff(np.cumsum(chars + 1) // CHARS)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cut, cut[1:]):
                part = batch.slice(at, end - at)
                coded = codec.encode_all([x or "" for x in part.column(1).to_pylist()])
                sha = [hashlib.sha256(x).hexdigest() for x in coded]
                back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in coded]
                cols = [part.column(0), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(sha), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
