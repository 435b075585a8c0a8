"""Token ids of whole texts, with a word cache in front of the tokenizers library.

Both vocabularies never join a token across certain places of a text, so a text may be cut there, each
part be encoded on its own, and the ids be put together: the result is the same as for the whole text.
Most parts are words that came before, so most ids come from the cache.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from gridloom.llm.caches import hold

#: Most entries of each cache of a Python worker (about 100 MB); words beyond it are encoded each time.
CACHE = 500_000
#: Texts whose unknown words are encoded together.
TOGETHER = 500

_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: White space that is neither a space, a tab nor a line end.
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Marks that may end a word; a run of them is a piece of its own.
_MARKS = ".,;:!?"
_BESIDE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")


class TokenEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers.

    ``drops_space``: the vocabulary drops white space and ends words at it (cut at ASCII white space);
    otherwise a space belongs to the word behind it (cut before a space between two non-white characters).
    """

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.known: dict[str | bytes, bytes] = {}
        self.heads: dict[str, bytes] = {}
        # Tokens that begin with a space (written as this letter in the vocabulary).
        vocab = self.tokenizer.get_vocab()
        self.starts_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts_word[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.small = drops_space and self._ids("A") == self._ids("a")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word of small ASCII letters, which the vocabulary leaves whole before merging."""
        ids = [token.id for token in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _new(self, parts: list) -> dict:
        """Ids of parts that are not known.

        All are encoded together; but telling them apart by offsets costs more than encoding words of ASCII
        letters, and the marks behind them, one by one.
        """
        if not self.drops_space:
            return dict(zip(parts, self._each(parts), strict=True))
        found, others = {}, []
        for part in parts:
            text = part.decode(errors="replace") if isinstance(part, bytes) else part
            stem = text.rstrip(_MARKS)
            if not (stem.isascii() and stem.isalpha() and (self.small is False or stem.islower())):
                others.append((part, text))
                continue
            key = stem.encode() if isinstance(part, bytes) else stem
            ids = self.known.get(key) or found.get(key) or self._word(stem)
            found[part] = ids + self._head(text[len(stem) :]) if len(stem) < len(text) else ids
        if others:
            found.update(zip([part for part, _ in others], self._each([text for _, text in others]), strict=True))
        return found

    def _each(self, parts: list[str]) -> list[bytes]:
        """Ids of each part: all are encoded as one text and told apart again."""
        if not self.drops_space:
            spaced = [p for p in parts if " " in p]
            if spaced:  # a space inside would look like the start of a part
                alone = {p: self._ids(" " + p) for p in spaced}
                plain = [p for p in parts if p not in alone]
                alone.update(zip(plain, self._each(plain) if plain else [], strict=True))
                return [alone[p] for p in parts]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
            owner = np.cumsum(self.starts_word[ids]) - 1
        else:
            enc = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
            ids = np.array(enc.ids, dtype="<u4")
            starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            owner = np.searchsorted(starts, np.array([a for a, _ in enc.offsets], dtype=np.int64), side="right") - 1
        ends = np.searchsorted(owner, np.arange(len(parts)), side="right")
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _head(self, part: str) -> bytes:
        """Ids of the first part of a text, which follows nothing."""
        got = self.heads.get(part)
        if got is None:
            got = self._ids(part)
            if len(self.heads) < CACHE:
                self.heads[part] = got
        return got

    def _cut(self, text: str | bytes | None) -> tuple[bytes, list]:
        """Ids of the first part, where it needs its own, and the parts that follow a space."""
        if not text:
            return b"", []
        if self.drops_space:
            raw = text if isinstance(text, bytes) else text.encode()
            # The vocabulary is of small letters; in ASCII their order with composition does not matter.
            return b"", (raw.lower() if self.small and raw.isascii() else raw).split()
        if isinstance(text, bytes):
            text = text.decode(errors="replace")
        if any(x in text for x in _BESIDE) or text[0].isspace() or text[-1].isspace() or _RARE.search(text):
            parts = _SAFE.split(text)
            return self._head(parts[0]), [p[1:] for p in parts[1:]]
        parts = text.split(" ")
        return self._head(parts[0]), parts[1:]

    def encode_all(self, texts: list[str] | list[bytes], end: bytes = b"") -> list[bytes]:
        """Ids of each text; the words that no text before held are encoded together."""
        cut = [self._cut(text) for text in texts]
        got = [list(map(self.known.get, parts)) for _, parts in cut]
        holes = [k for k, ids in enumerate(got) if None in ids]
        if holes:
            new = list({p for k in holes for p, ids in zip(cut[k][1], got[k], strict=True) if ids is None})
            found = self._new(new)
            for k in holes:
                got[k] = [found[p] if ids is None else ids for p, ids in zip(cut[k][1], got[k], strict=True)]
            if len(self.known) < CACHE:
                self.known.update(found)
        return [head + b"".join(ids) + end for (head, _), ids in zip(cut, got, strict=True)]

    def encode(self, text: str | bytes | None, end: bytes = b"") -> bytes:
        return self.encode_all([text], end)[0]


_ENCODERS: dict[tuple[str, bool], TokenEncoder] = {}


def encoder(path: str, drops_space: bool) -> TokenEncoder:
    """The encoder of this Python worker."""
    hold(_ENCODERS)
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = TokenEncoder(path, drops_space)
    return _ENCODERS[path, drops_space]
