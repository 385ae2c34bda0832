"""Token ids of whole texts by a public tokenizer file, through a bounded memory of pieces that encode independently."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa

#: Pieces and characters that one worker remembers; beyond either the memory starts anew.
MAX_PIECES, MAX_CHARS = 1_600_000, 48_000_000
#: Texts of one call to ``encode`` hold about this many characters, so arrays stay small.
CHUNK_CHARS = 2_000_000
#: Strings that send a text down the careful way: control marks used as keys, and white space other than single spaces
#: and newlines (kind byte) or that libraries class differently (kind word).
MARKS, RARE_SPACES = "\x00\x01\x02", "\x1c\x1d\x1e\x1f"
ODD_BYTE = [*MARKS, *RARE_SPACES, *"\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "  ", "\n\n", " \n", "\n "]
ODD_WORD = [*MARKS, *RARE_SPACES]
JOINED = 2000


def ends_in_letter(stem: str) -> bool:
    """All letters, and a letter of the Latin, Greek or Cyrillic blocks at the end after composition and lower-casing."""
    return stem.isalpha() and (last := unicodedata.normalize("NFC", stem[-4:]).lower()[-1:]) < "\u0530" and last.isalpha()


class PieceEncoder:
    """Equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` of the file as it stands, so a special token's string
    in a text gives that token's id; such a text goes to the library whole.

    kind ``byte``: the byte-level pattern lets a single space belong only to what follows it, so a text may be cut before
    any space that a non-space follows, and around single newlines. kind ``word``: white space only separates, so a text
    may be cut at it. Each distinct piece is encoded once by the library.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = {"byte": self._cut_byte, "word": self._cut_word}[kind]
        self.odd = ODD_BYTE if kind == "byte" else ODD_WORD
        self.before_space = re.compile(r"(?= \S)")
        if kind == "byte":  # every character of a token's name stands for one byte
            names = self.tokenizer.get_vocab(with_added_tokens=False)
            self.n_bytes = np.zeros(max(names.values()) + 1, np.int64)
            for name, i in names.items():
                self.n_bytes[i] = len(name)
        else:
            (self.mark,) = self.tokenizer.encode("\1", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = self.used = 0
        self.pool = np.empty(1 << 16, np.uint32)
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _cut_byte(self, text: str) -> list[str]:
        """Keys of the pieces: \\1 marks the first, \\2 a literal piece; others follow a space or start with a newline."""
        if any(x in text for x in self.special):
            return ["\2" + text]
        if any(x in text for x in self.odd):
            return ["\2" + x for x in self.before_space.split(text)]
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\1" + pieces[0]
        return pieces

    def _cut_word(self, text: str) -> list[str]:
        return ["\2" + text] if any(x in text for x in (*self.odd, *self.special)) else text.split()

    def _literal(self, key: str) -> str:
        if key[:1] in ("\1", "\2"):
            return key[1:]
        return key if self.cut == self._cut_word or key[:1] == "\n" else " " + key

    def _ids(self, keys: list[str]) -> list[list[int]]:
        """Ids of each key. Plain pieces go to the library joined, and come apart by the bytes of the tokens (kind byte) or
        at a mark between them (kind word): a call for each would cost more than the encoding."""
        found: dict[str, list[int]] = {}
        byte = self.cut == self._cut_byte
        # a text's first piece is encoded behind a newline, whose one id is left out
        plain = [k for k in keys if len(k) > 1 and k[0] != "\2" and not (k[0] == "\1" and k[1] == "\n")] if byte else [k for k in keys if k[:1] not in ("", "\1", "\2")]
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            if byte:
                literal = ["\n" + k[1:] if k[0] == "\1" else self._literal(k) for k in part]
                ids = self.tokenizer.encode_batch_fast(["".join(literal)], add_special_tokens=False)[0].ids
                ends = np.cumsum(self.n_bytes[ids])
                cuts = np.searchsorted(ends, np.cumsum([len(x.encode()) for x in literal])) + 1
            else:
                ids = self.tokenizer.encode_batch_fast([" \1 ".join(part)], add_special_tokens=False)[0].ids
                cuts = np.append(np.flatnonzero(np.array(ids) == self.mark), len(ids))
            start = 0
            for k, end in zip(part, cuts.tolist()):
                found[k] = ids[start + (k[0] == "\1") : end]
                start = end if byte else end + 1
        rest = [k for k in keys if k not in found]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([self._literal(k) for k in rest], add_special_tokens=False)):
            found[k] = x.ids
        return [found[k] for k in keys]

    def _learn(self, keys: list[str]) -> None:
        """A word with one comma or full stop is its stem and that mark, so only stems are encoded; not where normal form
        may end in a combining mark, which would join the stop."""
        tail = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ",."}
        stems = {k: k[:-1] for k in keys if k[-1:] in tail and ends_in_letter(k[:-1])}
        bare = list(set(stems.values()).union(k for k in keys if k not in stems).difference(self.number))
        self._store(bare, self._ids(bare))
        derived = list(stems)
        where = [self.number[stems[k]] for k in derived]
        self._store(derived, [[*self.pool[self.starts[i] : self.starts[i] + self.lengths[i]].tolist(), *tail[k[-1]]] for i, k in zip(where, derived)])

    def _store(self, keys: list[str], ids: list[list[int]]) -> None:
        n, total = len(self.number), sum(map(len, ids))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while n + len(keys) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.lengths[n : n + len(keys)] = lengths
        self.starts[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.used += total
        self.number.update(zip(keys, range(n, n + len(keys))))
        self.chars += sum(map(len, keys))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if len(self.number) > MAX_PIECES or self.chars > MAX_CHARS:
            self._forget()
        pieces: list[str] = []
        counts = np.empty(len(texts) + 1, np.int64)
        counts[0] = 0
        for i, text in enumerate(texts):
            pieces += self.cut(text)
            counts[i + 1] = len(pieces)
        new = list(set(pieces).difference(self.number))
        if new:
            self._learn(new)
        which = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        lengths = self.lengths[which]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        at = np.repeat(self.starts[which] - ends[:-1], lengths)
        at += np.arange(len(at))
        return self.pool[at], np.diff(ends[counts])


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """The worker's encoder for a file: its memory of pieces lasts over tasks."""
    if (path, kind) not in _encoders:
        _encoders.clear()
        _encoders[path, kind] = PieceEncoder(path, kind)
    return _encoders[path, kind]


def forget_encoders() -> None:
    """Frees the worker's memory of pieces: workers live on between stages, and what follows may need the room."""
    _encoders.clear()


def text_chunks(batch: pa.RecordBatch, column: str = "text"):
    """(row numbers as a slice, texts) of a batch, nulls as empty texts, about CHUNK_CHARS characters at a time."""
    texts, chunk, size, start = batch.column(batch.schema.get_field_index(column)), [], 0, 0
    for i in range(batch.num_rows):
        chunk.append(texts[i].as_py() or "")
        size += len(chunk[-1])
        if size >= CHUNK_CHARS:
            yield slice(start, i + 1), chunk
            chunk, size, start = [], 0, i + 1
    if chunk:
        yield slice(start, batch.num_rows), chunk
