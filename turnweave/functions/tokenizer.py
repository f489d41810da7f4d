"""The tokenizer boundary: what an operator needs of a sub-word model, and a deterministic model for tests."""

from __future__ import annotations

from typing import Protocol


class Tokenizer(Protocol):
    """Pieces mark a word's beginning with ``▁``; a text's first piece begins with it, whether or not the text has a space there."""

    def encode_pieces(self, text: str) -> list[str]: ...

    def piece_to_id(self, piece: str) -> int: ...

    def decode(self, ids: list[int]) -> str: ...


class CodePoints:
    """One piece per code point; ids lie above the special ones. Two code points 31,996 apart share an id."""

    size, first = 31_996, 4

    def encode_pieces(self, text: str) -> list[str]:
        return ["▁", *("▁" if c == " " else c for c in text)] if text else []

    def piece_to_id(self, piece: str) -> int:
        return ord(piece[0]) % self.size + self.first

    def decode(self, ids: list[int]) -> str:
        return "".join(" " if i == self.piece_to_id("▁") else chr(i - self.first) for i in ids if i >= self.first)


class SentencePiece:
    """A model file of the sentencepiece library; loaded once per worker. Byte pieces are joined to whole characters."""

    def __init__(self, path: str):
        self.path, self._model = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_model": None}

    @property
    def model(self):
        if self._model is None:
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._model

    def encode_pieces(self, text: str) -> list[str]:
        out: list[str] = []
        pending = bytearray()
        for piece in self.model.encode(text, out_type=str):
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                pending.append(int(piece[3:5], 16))
                try:
                    out.append(pending.decode())
                    pending.clear()
                except UnicodeDecodeError:
                    pass
                continue
            if pending:
                out.append(pending.decode(errors="replace"))
                pending.clear()
            out.append(piece)
        if pending:
            out.append(pending.decode(errors="replace"))
        return out

    def piece_to_id(self, piece: str) -> int:
        return self.model.piece_to_id(piece)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)
