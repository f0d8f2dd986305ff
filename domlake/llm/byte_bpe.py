"""Byte-level BPE encoding and decoding with a segment tree over the byte positions of a piece.

A text is cut into pieces as the public pattern says: contractions, runs of letters, of numbers, of other
signs, each with one space before it, and white space. The cut is found with numpy from the class of each
character, which gives what the pattern's alternatives, tried in order, give. Leaves of a piece's segment tree
hold the rank of the pair that starts at that byte, so the root names the leftmost pair of least rank. A merge
updates three leaves, the pair's own, its right half's and its left neighbour's, each in logarithmic time, so a
piece of any length takes n log n steps. Pieces that repeat are encoded once in a worker while they are
remembered; texts are never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import common

#: Bytes of pieces and ids that a worker remembers; beyond them it starts to remember anew.
REMEMBERED = 64 << 20
#: Classes of characters.
OTHER, LETTER, NUMBER, WHITE = range(4)
#: What may follow an apostrophe and is cut off with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Longest pieces whose trees are rows of one matrix.
TOGETHER = 64
_NONE = 1 << 62


def character_classes() -> bytes:
    """The class of each code point by the Unicode tables of the tokenizer library, which the library itself tells
    by what it finds in a text of all code points. Surrogates are in no text."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table.tobytes()


def pieces(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start, in bytes; row i of the texts is buf[offsets[i]:offsets[i + 1]], UTF-8."""
    if not len(buf):
        return np.zeros(0, np.int64)
    first = np.flatnonzero((buf & 0xC0) != 0x80)  # bytes that begin a character
    code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    kind = classes[code]
    n = len(code)
    new_text = np.zeros(n + 1, bool)
    new_text[np.searchsorted(first, offsets)] = True
    start = np.append(True, kind[1:] != kind[:-1]) | new_text[:-1]
    # the last of some white space stands apart when the text goes on; a space joins what follows it
    after = np.append(np.flatnonzero(start)[1:], n)
    begin = np.flatnonzero(start)
    white = kind[begin] == WHITE
    last = after[white] - 1
    goes_on = ~new_text[after[white]]
    last, next_ = last[goes_on], after[white][goes_on]
    start[last] = True
    space = code[last] == 32
    start[next_[space]] = False
    # contractions: an apostrophe that begins a piece and stands alone, before letters that are listed
    mark = np.flatnonzero((code == 39) & start & np.append(start[1:], True))
    for tail in CONTRACTIONS:
        fits = mark[mark + len(tail) < n]
        for i, letter in enumerate(tail, 1):
            fits = fits[(code[fits + i] == ord(letter)) & ~new_text[fits + i]]
        start[fits + 1] = False
        end = fits + len(tail) + 1
        inside = end < n
        cut = end[inside]
        start[cut] = True  # what follows begins a piece, as it would after any other
        if len(tail) > 1:
            start[fits + 2] = False
    return first[start]


class Merger:
    """Encodes pieces by ranks. Short pieces go together, one row of a matrix of trees each; a long one goes alone."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks), default=1)
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        # ranks of pairs of tokens: every cut of a token into two tokens
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t))
                 if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NONE for a pair that makes no token."""
        if not len(self.pairs):
            return np.full(left.shape, _NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], _NONE)

    def encode_all(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces in a row, and how many each has."""
        width = [1 if p in self.ranks else max(4, 1 << (len(p) - 1).bit_length()) for p in some]
        count, parts = np.zeros(len(some), np.int64), []
        for w in sorted(set(width)):
            mine = [i for i, x in enumerate(width) if x == w]
            if w == 1:
                found = np.array([self.ranks[some[i]] for i in mine]), np.ones(len(mine), np.int64)
            elif w <= TOGETHER:
                found = self.encode_rows([some[i] for i in mine], w)
            else:
                lists = [self.encode(some[i]) for i in mine]
                found = np.array([x for one in lists for x in one]), np.array([len(one) for one in lists])
            count[mine] = found[1]
            parts.append((np.repeat(mine, found[1]), found[0]))
        flat = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
        order = np.argsort(np.concatenate([p[0] for p in parts] or [np.zeros(0, np.int64)]), kind="stable")
        return flat[order], count

    def encode_rows(self, some: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for pieces of at most width bytes that are no tokens themselves: row i has the tree of piece i."""
        bits, k = width.bit_length() - 1, len(some)
        n = np.array([len(p) for p in some])
        ids = self.single[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in some), np.uint8).reshape(k, width)]
        at = np.arange(width)
        live = at < n[:, None]
        after, before = np.tile(np.arange(1, width + 2), (k, 1)), np.tile(np.arange(-1, width), (k, 1))
        tree = np.full((k, 2 * width), _NONE)
        rank = self.rank_of(ids[:, :-1], ids[:, 1:])
        rank = np.where(live[:, 1:] & (rank != _NONE), rank << bits | at[:-1], _NONE)
        tree[:, width:-1] = rank
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            root = tree[row, 1]
            left = root & (width - 1)
            right = after[row, left]
            end = after[row, right]
            after[row, left], before[row, end] = end, left
            ids[row, left] = root >> bits
            live[row, right] = False
            self.update(tree, row, width + right, np.full(len(row), _NONE))
            pair = self.rank_of(ids[row, left], ids[row, np.minimum(end, width - 1)])
            self.update(tree, row, width + left, np.where((end < n[row]) & (pair != _NONE), pair << bits | left, _NONE))
            inner = left > 0
            own, prior = row[inner], before[row[inner], left[inner]]
            pair = self.rank_of(ids[own, prior], ids[own, left[inner]])
            self.update(tree, own, width + prior, np.where(pair != _NONE, pair << bits | prior, _NONE))
            row = row[tree[row, 1] != _NONE]
        return ids[live], live.sum(axis=1)

    @staticmethod
    def update(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """A new value for a leaf of each row's tree, and the least values above it."""
        flat = tree.ravel()
        at = row * tree.shape[1] + leaf
        flat[at] = value
        base = row * tree.shape[1]
        node = leaf
        while len(node) and node[0] > 1:
            value = np.minimum(value, flat[base + (node ^ 1)])
            node = node >> 1
            flat[base + node] = value

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        ranks = self.ranks
        if piece in ranks:  # a piece that is a token is that token, even where merges would not reach it
            return [ranks[piece]]
        n = len(piece)
        bits = n.bit_length()
        width = 1 << bits
        low = width - 1
        # a part is known by its first byte: where the next part and the one before it begin
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [_NONE] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = self.pair(piece, i, i + 2, bits)  # the least of these is the least rank, leftmost
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        while tree[1] != _NONE:
            left = tree[1] & low
            right = after[left]
            end = after[right]
            after[left], before[end] = end, left
            changes = [(right, _NONE), (left, self.pair(piece, left, after[end], bits) if end < n else _NONE)]
            if left:
                changes.append((before[left], self.pair(piece, before[left], end, bits)))
            for leaf, value in changes:
                at = width + leaf
                tree[at] = value
                while at > 1:
                    at >>= 1
                    a, b = tree[2 * at], tree[2 * at + 1]
                    value = a if a < b else b
                    if tree[at] == value:
                        break
                    tree[at] = value
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at: after[at]]])
            at = after[at]
        return out

    def pair(self, piece: bytes, start: int, end: int, bits: int) -> int:
        if end - start > self.longest:
            return _NONE
        r = self.ranks.get(piece[start:end])
        return _NONE if r is None else r << bits | start


@dataclass
class Coder:
    """Ranks and character classes, and what a worker remembers of pieces: piece -> number, and the ids of numbers."""

    ranks: dict[bytes, int]
    classes: bytes

    def __post_init__(self):
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"the ranks lack the bytes {missing[:5]}")
        self.merger, self.table = Merger(self.ranks), np.frombuffer(self.classes, np.uint8)
        order = sorted((r, t) for t, r in self.ranks.items())
        self.size = np.zeros(order[-1][0] + 1, np.int64)
        self.size[[r for r, _ in order]] = [len(t) for _, t in order]
        self.blob = np.frombuffer(b"".join(t for _, t in order), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        self.name = list(map(str, range(len(self.size))))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held, self.used = 0, 0
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(1 << 16, np.int32)

    def learn(self, new: list[bytes]) -> None:
        ids, count = self.merger.encode_all(new)
        self.known.update(zip(new, range(len(self.first) - 1, len(self.first) - 1 + len(new)), strict=True))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat[:self.used], np.zeros(self.used + 2 * len(ids), np.int32))
        self.flat[self.used: self.used + len(ids)] = ids
        self.first = np.append(self.first, self.used + np.cumsum(count))
        self.used += len(ids)
        self.held += sum(map(len, new)) + 120 * len(new) + 4 * len(ids)

    def encode(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces data[cuts[i]:cuts[i + 1]] in a row, and where those of each piece begin."""
        if self.held > REMEMBERED:
            self.forget()
        listed = [data[a:z] for a, z in zip(cuts.tolist(), cuts[1:].tolist())]  # noqa: B905
        get = self.known.get
        number = np.array([get(p, -1) for p in listed], np.int64)
        if len(fresh := np.flatnonzero(number < 0)):
            unseen = [listed[i] for i in fresh.tolist()]
            self.learn(list(dict.fromkeys(unseen)))
            number[fresh] = [self.known[p] for p in unseen]
        count = self.first[number + 1] - self.first[number]
        begin = np.append(0, np.cumsum(count))
        return self.flat[np.repeat(self.first[number] - begin[:-1], count) + np.arange(begin[-1])], begin

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, in order."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


_CODERS: dict[str, Coder] = {}


def coder(source: str, ranks: bytes, classes: bytes) -> Coder:
    """A worker's coder for a vocabulary; the one of another vocabulary is forgotten."""
    if source not in _CODERS:
        _CODERS.clear()
        listed = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
        _CODERS[source] = Coder(listed, classes)
    return _CODERS[source]


def encode(docs: DataFrame, ranks: dict[bytes, int], classes: bytes | None = None, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """docs (key, text): key, n_tokens, ids (array of int, left out where ids is False), ids_sha256, decoded (the decoded
    bytes, as binary; left out too), decoded_sha256.

    Ids are those of ranks, special tokens aside; ids_sha256 is of the decimal ids with a space between, and
    decoded comes from the ids alone. A null text is an empty one, without tokens. Rows that repeat and null keys stay;
    other columns are not read, whatever their names. Texts are encoded whole. The leftmost of pairs of
    equal rank is merged first."""
    listed = b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items())
    source = hashlib.sha256(listed).hexdigest()
    classes = character_classes() if classes is None else classes
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((listed, classes))  # a vocabulary and a table of code points: fixed sizes
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if ids else "")

    def run(batches):
        c = coder(source, *sent.value)
        for b in batches:
            for t in common.texts(b.column("text")):
                data = t.buf.tobytes()
                cuts = pieces(t.buf, t.offsets, c.table)
                flat, begin = c.encode(data, np.append(cuts, len(data)))
                rows = begin[np.searchsorted(cuts, t.offsets)].tolist()
                coded, plain, listed_ids, decoded = [], [], [], []
                for a, z in zip(rows, rows[1:]):  # noqa: B905
                    mine = flat[a:z]
                    back = c.decode(mine).tobytes()
                    coded.append(hashlib.sha256(" ".join(map(c.name.__getitem__, mine.tolist())).encode()).hexdigest())
                    plain.append(hashlib.sha256(back).hexdigest())
                    if ids:
                        listed_ids.append(mine)
                        decoded.append(back)
                columns = [b.column(key).slice(t.first, t.rows), pa.array(np.diff(rows), pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns += [pa.array(listed_ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(key, "text").mapInArrow(common.released(run), schema)


def decode(tokens: DataFrame, ranks: dict[bytes, int], classes: bytes | None = None) -> DataFrame:
    """tokens with a column ids (array of int): all columns and decoded (binary), the bytes of the ids; a null list gives
    null. An id that the ranks lack is an error."""
    if "decoded" in tokens.columns:
        raise ValueError("tokens has a column decoded already")
    names = {r: t for t, r in ranks.items()}
    sent = tokens.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        for b in batches:
            known = sent.value
            lists = b.column("ids").to_pylist()
            yield b.append_column("decoded", pa.array([None if x is None else b"".join(known[i] for i in x) for x in lists], pa.binary()))

    return tokens.mapInArrow(run, tokens.withColumn("decoded", F.lit(None).cast("binary")).schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return encode(common.documents(spark, sf_dir), ranks, ids=False)
