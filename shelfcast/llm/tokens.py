"""Token ids of texts by a public vocabulary, with a cache over the pieces between spaces."""

from __future__ import annotations

import os
import re
from array import array

import pyarrow as pa

#: White space as the vocabulary's own splitting pattern sees it.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces the splitting pattern never crosses: Latin words with at most one space ahead, other runs
#: without white space, white space (its last character may belong to what follows).
_PIECE = re.compile(
    f" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?![\\w'’])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Pieces of a cache generation; the pieces of the one before are still looked up.
CACHE = 200_000
#: Ids are kept as two bytes each: the vocabulary has fewer than 65,536.
ID_TYPE = "<u2"

_open: dict[str, PieceTokenizer] = {}


def _byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in the vocabulary: itself if it can be seen in Latin-1,
    else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_ONE_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


class _Pieces(dict):
    """Ids by piece, as bytes of ``ID_TYPE``; a piece that isn't there is encoded."""

    def __init__(self, tokenizer, older: dict[str, bytes]) -> None:
        super().__init__()
        self.tokenizer, self.model, self.older = tokenizer, tokenizer.model, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if _ONE_WORD.fullmatch(piece):
                # the splitting pattern leaves such a piece whole
                word = piece.encode().decode("latin-1").translate(_LETTERS)
                found = [token.id for token in self.model.tokenize(word)]
            else:
                found = self.tokenizer.encode(piece, add_special_tokens=False).ids
            ids = array("H", found).tobytes()
        self[piece] = ids
        return ids


class PieceTokenizer:
    """Texts to ids. A piece is encoded by the tokenizer once and then taken from a cache of two
    bounded generations; ids are the same with or without it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit two bytes")
        self.known = _Pieces(self.tokenizer, {})

    def forget(self) -> None:
        """Empty the cache: a worker that goes on to other work holds no memory for this one."""
        self.known = _Pieces(self.tokenizer, {})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes of ``ID_TYPE``; null is empty."""
        if len(self.known) > CACHE:
            recent = dict(self.known)
            self.known = _Pieces(self.tokenizer, recent)
        get = self.known.__getitem__
        return [b"".join(map(get, _PIECE.findall(text))) if text else b"" for text in texts]


def tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _open:
        _open[path] = PieceTokenizer(path)
    return _open[path]


def text_slices(column: pa.Array, rows: int = 256) -> list[tuple[int, list[str | None]]]:
    """(first row, texts) of small pieces of a batch."""
    return [(at, column.slice(at, rows).to_pylist()) for at in range(0, len(column), rows)]
