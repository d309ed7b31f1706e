"""Tokens of two tokenizers aligned by the places where both end, and how often their ids meet.

Each text is encoded twice; byte offsets where tokens of both end cut it into groups. Cuts are found
by divide and conquer: a common end near the middle, found by bisection, parts an interval in two;
intervals without one inside are the groups.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.storage import staged
from shelfcast.llm.tokens import _LETTERS, ID_TYPE, PieceTokenizer, tokenizer

#: Characters of text, about, that are aligned at a time and whose links share a table.
CHUNK = 1 << 21
#: A longer text goes to the second tokenizer in parts; its tokens never cross the start of a run of
#: spaces.
PART = 1 << 20
#: An id pair as one number.
_SHIFT = 32

_open: dict[str, PieceModel] = {}


@dataclass(frozen=True)
class TokenBytes:
    """The bytes of every token, one behind the other."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> TokenBytes:
        size = np.array([len(t) for t in tokens], dtype="i8")
        return TokenBytes(np.frombuffer(b"".join(tokens), dtype="u1"), np.cumsum(size) - size, size)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` in a row."""
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.start[ids] - (ends - size), size)
        return self.data[shift + np.arange(len(shift))]


class PieceModel:
    """The second tokenizer: pieces with byte fallback, spaces as U+2581, a space put ahead."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = self.model.piece_to_id("▁")
        self.bytes = TokenBytes.of([self._bytes(i) for i in range(self.model.get_piece_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``."""
        ids, begin = [], 0
        while len(text) - begin > PART:
            at = begin + PART
            while at < len(text) and (text[at] != " " or text[at - 1] == " "):
                at += 1
            if at == len(text):
                break
            ids += self._part(text[begin:at])
            begin = at + 1  # the model puts this space ahead of the next part
        return ids + (self._part(text[begin:]) if text else [])

    def _part(self, text: str) -> list[int]:
        return self.model.encode(text) if text else [self.space]


def piece_model(path: str) -> PieceModel:
    """The worker's model of a file."""
    if path not in _open:
        _open[path] = PieceModel(path)
    return _open[path]


def byte_tokens(encoder: PieceTokenizer) -> TokenBytes:
    """The bytes of the first tokenizer's tokens, whose letters stand for bytes."""
    byte = {letter: b for b, letter in _LETTERS.items()}
    tokens = [encoder.tokenizer.id_to_token(i) or "" for i in range(encoder.tokenizer.get_vocab_size())]
    return TokenBytes.of(
        [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]
    )


def cut(ends_a: np.ndarray, ends_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First tokens, of a and of b, of all groups in intervals of a row of texts.

    ``ends_a`` and ``ends_b`` are ascending byte offsets of token ends; text i has the tokens from
    ``a[i]`` to ``a[i + 1]`` and from ``b[i]`` to ``b[i + 1]``, of equal bytes. All intervals of a
    depth are halved at once.
    """
    lo_a, hi_a, lo_b, hi_b = a[:-1], a[1:], b[:-1], b[1:]
    some = hi_a > lo_a
    lo_a, hi_a, lo_b, hi_b = (x[some] for x in (lo_a, hi_a, lo_b, hi_b))
    groups_a, groups_b = [], []
    while len(lo_a):
        # an end inside the interval, as near to the middle as there is one
        middle = (lo_a + hi_a - 1) >> 1
        at, meets = np.full(len(lo_a), -1), np.zeros(len(lo_a), dtype="i8")
        left = np.flatnonzero((hi_a - lo_a > 1) & (hi_b - lo_b > 1))
        step = 0
        while len(left):
            for sign in (1, -1) if step else (1,):
                place = middle[left] + sign * step
                inside = (place >= lo_a[left]) & (place < hi_a[left] - 1)
                tried, place = left[inside], place[inside]
                other = np.searchsorted(ends_b, ends_a[place])
                same = ends_b[other] == ends_a[place]
                at[tried[same]], meets[tried[same]] = place[same], other[same]
                left = left[at[left] < 0]
            step += 1
            # beyond both ends nothing is left to try
            left = left[(middle[left] + step < hi_a[left] - 1) | (middle[left] - step >= lo_a[left])]
        found = at >= 0
        groups_a.append(lo_a[~found])
        groups_b.append(lo_b[~found])
        at, meets = at[found] + 1, meets[found] + 1
        lo_a, hi_a = np.concatenate([lo_a[found], at]), np.concatenate([at, hi_a[found]])
        lo_b, hi_b = np.concatenate([lo_b[found], meets]), np.concatenate([meets, hi_b[found]])
    if not groups_a:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    # both ascend together
    return np.sort(np.concatenate(groups_a)), np.sort(np.concatenate(groups_b))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal texts of the numbers below ``n``, with room for a sign behind, and their lengths."""
    texts = [str(i).encode() for i in range(n)]
    size = np.array([len(t) for t in texts], dtype="i8")
    room = int(size.max()) + 1
    return np.frombuffer(b"".join(t.ljust(room, b"\0") for t in texts), dtype="u1").reshape(n, room), size


def written(
    a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray,
    digits: tuple[np.ndarray, np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """The groups as text, ``a1,a2|b1;a3|b2,b3``, and where each document's begins; every text ends
    with one ``;`` too many."""
    table, size = digits
    n_a, n_b, n_groups = len(a), len(b), len(first_a)
    group_a, group_b = np.zeros(n_a + 1, "i8"), np.zeros(n_b + 1, "i8")
    group_a[first_a], group_b[first_b] = 1, 1
    group_a, group_b = np.cumsum(group_a)[:n_a] - 1, np.cumsum(group_b)[:n_b] - 1
    last_a = np.append(first_a[1:], n_a)
    ids, signs = np.empty(n_a + n_b, "i8"), np.full(n_a + n_b, ord(","), "u1")
    at_a = np.arange(n_a) + first_b[group_a]
    at_b = np.arange(n_b) + last_a[group_b]
    ids[at_a], ids[at_b] = a, b
    if n_groups:
        signs[at_a[last_a - 1]] = ord("|")
        signs[at_b[np.append(first_b[1:], n_b) - 1]] = ord(";")
    rows = table[ids]
    rows[np.arange(len(ids)), size[ids]] = signs
    used = np.arange(table.shape[1])[None, :] <= size[ids][:, None]
    ends = np.concatenate(([0], np.cumsum(size[ids] + 1)))
    return rows[used], ends[docs_a + docs_b]


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte, all lowest bytes first: high bytes, mostly 0, then compress."""
    return np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").ravel()


_CHUNK = (
    "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, sha array<string>, "
    "groups array<binary>, ends array<long>, bag binary, bag_n binary, pairs array<long>, pair_n array<long>"
)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text or "") > CHUNK:
            yield first, at
            first, size = at, 0
        size += len(text or "")
    if texts:
        yield first, len(texts)


def _aligned(vocabulary: str, pieces: str, with_groups: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def tokens(texts: list[str], encoder: PieceTokenizer, model: PieceModel, own: TokenBytes):
        """Ids of both with their borders by text; none for a text that either doesn't give back."""
        data = [b" " + t.encode() if t else b"" for t in texts]
        all_a = [np.frombuffer(x, ID_TYPE).astype("i8") for x in encoder.encode([" " + t if t else "" for t in texts])]
        all_b = [model.encode(t) for t in texts]
        sizes = np.array([len(d) for d in data])
        whole = np.frombuffer(b"".join(data), dtype="u1")
        begin = np.cumsum(sizes) - sizes
        out = []
        right = sizes > 0
        for lists, table in ((all_a, own), (all_b, model.bytes)):
            counts = np.array([len(x) for x in lists], dtype="i8")
            if lists is all_a:
                flat = np.concatenate(lists)
            else:
                flat = np.fromiter(itertools.chain.from_iterable(lists), dtype="i8", count=int(counts.sum()))
            ends = np.concatenate(([0], np.cumsum(table.size[flat])))
            borders = np.concatenate(([0], np.cumsum(counts)))
            right &= np.diff(ends[borders]) == sizes
            out.append((flat, counts))
        for flat, counts in out:
            # bytes of the texts of right length stand side by side in both
            mine = right[np.repeat(np.arange(len(texts)), counts)]
            joined = (own if flat is out[0][0] else model.bytes).joined(flat[mine])
            places = np.flatnonzero(right)
            expected = whole if right.all() else whole[np.repeat(right, sizes)]
            wrong = np.flatnonzero(joined != expected)
            if len(wrong):
                ends = np.cumsum(sizes[places])
                right[places[np.unique(np.searchsorted(ends, wrong, side="right"))]] = False
        kept = []
        for flat, counts in out:
            mine = right[np.repeat(np.arange(len(texts)), counts)]
            kept.append((flat[mine], np.concatenate(([0], np.cumsum(np.where(right, counts, 0))))))
        return kept, begin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, model = tokenizer(vocabulary), piece_model(pieces)
        own = byte_tokens(encoder)
        digits = _digits(max(len(own.size), len(model.bytes.size)))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            every, ids = batch.column("text").to_pylist(), batch.column("id")
            for first, last in _chunks(every):
                n = last - first
                texts = [t if t and "▁" not in t else "" for t in every[first:last]]
                ((a, docs_a), (b, docs_b)), _ = tokens(texts, encoder, model, own)
                ends_a, ends_b = np.cumsum(own.size[a]), np.cumsum(model.bytes.size[b])
                first_a, first_b = cut(ends_a, ends_b, docs_a, docs_b)
                row, starts = written(a, b, first_a, first_b, docs_a, docs_b, digits)
                groups = [row[s:max(e - 1, s)].tobytes() for s, e in itertools.pairwise(starts.tolist())]
                # the link of a group: its last tokens, which end together
                pairs = a[np.append(first_a[1:], len(a)) - 1] << _SHIFT | b[np.append(first_b[1:], len(b)) - 1] if len(a) else a
                table, at = np.unique(pairs, return_inverse=True)
                docs = np.searchsorted(docs_a, first_a, side="right") - 1
                n_groups = np.bincount(docs, minlength=n)
                bags, bag_n = np.unique(docs * max(len(table), 1) + at, return_counts=True)
                bag_docs = bags // max(len(table), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        *[pa.array([x], pa.list_(pa.int64())) for x in (
                            ids.slice(first, n).to_pylist(), np.diff(docs_a), np.diff(docs_b), n_groups
                        )],
                        pa.array([[hashlib.sha256(g).hexdigest() if g else "" for g in groups]], pa.list_(pa.string())),
                        pa.array([groups if with_groups else None], pa.list_(pa.binary())),
                        pa.array([np.cumsum(np.bincount(bag_docs, minlength=n))], pa.list_(pa.int64())),
                        pa.array([_planes(bags % max(len(table), 1))], pa.binary()),
                        pa.array([_planes(bag_n)], pa.binary()),
                        pa.array([table], pa.list_(pa.int64())),
                        pa.array([np.bincount(at, minlength=len(table))], pa.list_(pa.int64())),
                    ],
                    names=["chunk", "ids", "n_a", "n_b", "n_groups", "sha", "groups", "ends", "bag", "bag_n", "pairs", "pair_n"],
                )
                number += 1
        encoder.forget()

    return run


_RESULT = (
    "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
    "groups string"
)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a chunk with the counts of their links."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = batch.slice(row, 1)

            def values(name: str, column: pa.RecordBatch = chunk) -> pa.Array:
                return column.column(name)[0].values

            ids, ends = values("ids"), values("ends").to_numpy()
            order, counts, best = [x.to_numpy() for x in values("found").flatten()] if chunk.column("found")[0].is_valid else [np.zeros(0, "i8")] * 3
            at = np.argsort(order)
            counts, best = counts[at], best[at]
            bag, n = (_from_planes(chunk.column(c)[0].as_py()).astype("i8") for c in ("bag", "bag_n"))
            sums = [np.concatenate(([0], np.cumsum(x)))[ends] for x in ((n * counts[bag], n * best[bag]) if len(bag) else (n, n))]
            count_sum, n_best = (np.diff(x, prepend=0) for x in sums)
            groups = chunk.column("groups")[0]
            yield pa.RecordBatch.from_arrays(
                [
                    ids, values("n_a"), values("n_b"), values("n_groups"), values("n_groups"), pa.array(n_best, pa.int64()),
                    pa.array(count_sum, pa.int64()), values("sha"),
                    groups.values.cast(pa.string()) if groups.is_valid else pa.nulls(len(ids), pa.string()),
                ],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"],
            )


def align(
    docs: DataFrame, vocabulary: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True
) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    A space and the text are encoded by the byte-level ``vocabulary``, the text by the ``pieces``,
    which put the space there themselves. Offsets where tokens of both end are cuts; groups lists the
    ids between them, ``a1,a2|b1;a3|b2,b3`` (null without ``with_groups``). The last tokens of a
    group end together: that is its link. An id pair counts once for each of its links in the corpus;
    count_sum adds that up over the links, n_best are the links whose pair counts most for its id of
    the pieces, ties included.

    One scan encodes and aligns chunks of texts, and writes per chunk its pairs and, by document, a
    bag of places among them. Pairs are counted by chunk before they are shuffled, so a pair that is
    everywhere is one row per chunk. Counts go back to the chunks by two more exchanges, of one row
    per chunk and pair; texts and tokens stay where they are. The highest count of an id is
    broadcast: one row per id of the pieces.

    Null and empty texts, and those that the joined bytes of either tokenizer don't give back (U+2581
    in the text, characters that the pieces' normaliser changes), have zeros and empty groups. Ids of
    rows may repeat or be null; rows are aligned one by one. Other columns are not looked at. An
    empty table gives no row.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chunks = staged(rows.mapInArrow(_aligned(vocabulary, pieces, with_groups), _CHUNK), "align-chunks")
    counted = chunks.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.pair_n").alias("count")
    )
    counted = staged(counted, "align-pairs")
    piece = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    highest = counted.groupBy(piece.alias("piece")).agg(F.max("count").alias("highest"))
    known = counted.join(F.broadcast(highest), piece == F.col("piece")).select(
        "pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")
    )
    places = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    found = places.join(known, "pair").groupBy("chunk").agg(
        F.collect_list(F.struct(F.col("at").cast("long").alias("at"), "count", "best")).alias("found")
    )
    columns = ["chunk", "ids", "n_a", "n_b", "n_groups", "sha", "groups", "ends", "bag", "bag_n"]
    return chunks.select(*columns).join(found, "chunk", "left").mapInArrow(_summed, _RESULT).withColumnRenamed("id", id_col)
