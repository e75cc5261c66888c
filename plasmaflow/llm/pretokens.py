"""Pre-tokens of a SentencePiece BPE model: pieces of text that no merge can cross, so each is encoded once and looked up."""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

SPACE = "▁"
#: A line end, a word with the spaces before it, or spaces at a line's end.
PIECES = re.compile(r"\n| *[^ \n]+| +")


@lru_cache(maxsize=4)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def check(path: str) -> None:
    """Raise unless the model lets text be cut before spaces and around line ends, with a space put before the text."""
    model = processor(path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if re.search(f"[^{SPACE}]{SPACE}|\n", piece):
            raise ValueError(f"piece {piece!r} crosses a pre-token's border")
    if model.encode("a  b ", out_type=str)[0][0] != SPACE or "".join(model.encode("a  b ", out_type=str)) != f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
        raise ValueError("the model's normaliser isn't the identity with a dummy prefix")


def split(text: str) -> list[str]:
    """Pre-tokens in order, the dummy prefix as a leading space; none for the empty text."""
    return PIECES.findall(" " + text) if text else []


def encode(model: sentencepiece.SentencePieceProcessor, piece: str) -> list[int]:
    """The ids of one pre-token as the library gives them inside a text."""
    if piece[0] == " ":
        ids = model.encode(piece[1:])
        return ids if len(piece) > 1 else model.encode("\n")[:1]
    return model.encode("\n" + piece)[2:]
