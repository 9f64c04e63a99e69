"""Token ids of whole texts by a fixed byte-level BPE file, as little-endian unsigned 32-bit integers.

``encode`` gives the same ids as ``Tokenizer.encode(text, add_special_tokens=False)``. Byte-level BPE works within
pre-tokens, and a pre-token never reaches from a character that isn't white space over a single following space or
line end. So a text is cut there, and the ids of each piece are looked up in a dictionary that the worker fills from the
tokenizer. Texts in which such a cut isn't certain (runs of white space, special tokens) go to the tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np

#: White space but the space and a line end that opens the piece: there the cut between pieces may not hold.
_ODD = re.compile(r"[^\S\n]|(?<!^)\n")
#: The same in keys, which have line ends in front alone.
_SPACE = re.compile(r"[^\S\n]")
_MAX_PIECES, _MAX_FIRSTS = 1_000_000, 50_000
#: Pieces in one call of the tokenizer.
_CALL = 512

_encoders: dict[str, "IdEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class IdEncoder:
    """Encodes texts; keeps about ``_MAX_PIECES`` pieces, then starts anew, so memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes | None] = {}
        self.firsts: dict[str, bytes] = {}  # pieces that open a text, without the space before
        self.stop = dict(zip(".,", self._whole([".", ","])))
        self.end_of_line = self._whole(["\n"])[0]
        # whether an id stands for bytes that begin with a space: in keys, that is the first id alone
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, text: str) -> list[str] | None:
        """Keys of the pieces: "\\n..." stands for itself, another one for itself after a space; None: not safe."""
        if "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text or text.endswith("\n\n") or any(s in text for s in self.special):
            return None
        parts = text.replace("\n", " \n").split(" ")
        return parts

    def _learn(self, keys: list[str]) -> None:
        plain, known = keys, self.pieces
        if _SPACE.search("".join(keys)):
            odd = {key for key in keys if _ODD.search(key)}
            known.update(dict.fromkeys(odd))
            plain = [key for key in keys if key not in odd]
        for key in ("", "\n"):
            if key in plain:
                known[key] = self._whole([key or " "])[0]
                plain = [x for x in plain if x != key]
        lined = [key for key in plain if key[0] == "\n"]
        spaced = [key for key in plain if key[0] != "\n"] if lined else plain
        for i in range(0, len(lined), _CALL):
            some = lined[i : i + _CALL]
            raw = self._whole(["".join([f"{k[1:]}\n" for k in some]) + "."])[0]
            ends = np.flatnonzero(np.frombuffer(raw, "<u4") == np.frombuffer(self.end_of_line, "<u4")[0]) * 4
            starts = np.concatenate([[0], ends[:-1] + 4])
            for key, a, b in zip(some, starts.tolist(), ends.tolist(), strict=True):
                known[key] = self.end_of_line + raw[a:b]
        for i in range(0, len(spaced), _CALL):
            some = spaced[i : i + _CALL]
            raw = self._whole([" " + " ".join(some)])[0]
            starts = (np.flatnonzero(self.opens[np.frombuffer(raw, "<u4")]) * 4).tolist()
            for key, a, b in zip(some, starts, [*starts[1:], len(raw)], strict=True):
                known[key] = raw[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null and empty texts have none."""
        cut = [self._split(t) if t else [] for t in texts]
        known = self.pieces
        if len(known) > _MAX_PIECES:
            known.clear()
        if len(self.firsts) > _MAX_FIRSTS:
            self.firsts.clear()
        need: set[str] = set()
        for parts in cut:
            if parts:
                need.update(parts[1:])
        need = need.difference(known)
        # letters and one stop or comma after them are pre-tokens of their own
        stops = {p for p in need if p[-1:] in (".", ",") and p[:-1].isalpha()}
        self._learn([p for p in {p[:-1] if p in stops else p for p in need} if p not in known])
        for p in stops:
            known[p] = known[p[:-1]] + self.stop[p[-1]]
        firsts = self.firsts
        new = list({parts[0] for parts in cut if parts and parts[0] not in firsts and not _ODD.search(parts[0])})
        firsts.update(zip(new, self._whole(new)))
        out: list[bytes] = []
        for text, parts in zip(texts, cut):
            if not text:
                out.append(b"")
                continue
            ids = None
            if parts is not None and parts[0] in firsts:
                try:
                    ids = firsts[parts[0]] + b"".join(map(known.__getitem__, parts[1:]))
                except TypeError:  # one of them is None
                    pass
            out.append(self._whole([text])[0] if ids is None else ids)
        return out


def encoder(path: str) -> IdEncoder:
    """The worker's encoder for a tokenizer file; it lives on from task to task."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = IdEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Frees the worker's dictionaries of pieces, for stages that encode nothing."""
    for known in _encoders.values():
        known.pieces.clear()
        known.firsts.clear()
