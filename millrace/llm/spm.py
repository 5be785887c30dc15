"""SentencePiece pieces: an encoder that works unit by unit, and exact decoding.

The model is byte-pair encoding with an identity normaliser and a dummy leading blank.
A merge can never cross a place whose two neighbouring characters stand side by side in no
piece; no piece has a blank after another character, so a text falls into units at single
blanks, and every unit is encoded once and remembered.  U+2581 is the model's own mark of a blank, so a text that
holds it is encoded like one with blanks there.  Texts with doubled, leading or trailing blanks go to the library whole.
"""

from __future__ import annotations

import numpy as np

BLANK = "▁"
#: Remembered units; beyond it the memory is emptied, which changes no result.
MEMORY = 500_000


class Memory(dict):
    """Results of ``make`` by key; emptied when full."""

    def __init__(self, make, most: int = MEMORY):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = found = self.make(key)
        return found


class Pieces:
    """A loaded model with its vocabulary, adjacent-character pairs and byte table."""

    _loaded: dict[str, "Pieces"] = {}

    @classmethod
    def at(cls, path: str) -> "Pieces":
        """The model at ``path``, loaded once a worker process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.ids, self.score, self.raw = {}, {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append(b"" if special[i] else piece.replace(BLANK, " ").encode())
                if not special[i]:
                    self.ids[piece], self.score[piece] = i, sp.get_score(i)
        self.byte_id = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self.unit_safe = not any(p[0] != BLANK and p[1] == BLANK for p in self.pairs)
        self.memory = Memory(lambda unit: np.array(sp.encode(unit), np.uint16).tobytes())
        self.counts = Memory(lambda unit: len(sp.encode(unit)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as the library gives them."""
        out: list = [None] * len(texts)
        whole, parts = [], {}
        for i, text in enumerate(texts):
            if self.splits(text):
                parts[i] = text.split(" ")
            else:
                whole.append(i)
        for i, ids in zip(whole, self.library.encode([texts[i] for i in whole], num_threads=1)):
            out[i] = np.array(ids, np.uint16)
        for i, units in parts.items():
            out[i] = np.frombuffer(b"".join(map(self.memory.__getitem__, units)), np.uint16)
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Number of ids of every text."""
        return [
            sum(map(self.counts.__getitem__, text.split(" "))) if self.splits(text) else len(self.library.encode(text)) for text in texts
        ]

    def splits(self, text: str) -> bool:
        """Whether the units of a text are what stands between its blanks."""
        return self.unit_safe and "  " not in text and text[:1] != " " and text[-1:] != " " and BLANK not in text and text != ""

    def decode(self, ids) -> str:
        """The text of the ids, without the dummy leading blank."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def stable(self, text: str, at: int) -> bool:
        """Whether no merge can cross place ``at`` of a text with blanks already marked."""
        return text[at - 1 : at + 1] not in self.pairs
