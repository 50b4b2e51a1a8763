"""Encoding of many texts by a public tokenizer file, each distinct piece once.

For the lower-casing word BPE the ids of a text are those of its pieces in order: letter runs, single
digits and runs of other signs, none of which crosses white space. Pieces of ASCII and of the Latin
letters U+00C0-U+017F are cut with numpy and each distinct one is encoded once for each block; any
white-space separated chunk with another character, an apostrophe, a control character or `<|` goes
whole through the unchanged tokenizer. Added tokens in a text keep the library's default meaning.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from tessera.llm.bytewords import ASCII_LOWER, SPACES, Run, ranges, runs, span_hashes

#: Distinct pieces whose ids a worker keeps.
CACHE_PIECES = 1_000_000
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _classes() -> np.ndarray:
    c = np.full(256, _ODD, np.uint8)
    c[0x21:0x7F] = _SIGN
    c[0x30:0x3A] = _DIGIT
    c[0x41:0x5B] = c[0x61:0x7B] = _LETTER
    c[~SPACES] = _SPACE
    c[0x27] = _ODD
    return c


CLASSES = _classes()


#: How a file cuts texts whose pieces can be cut here. Texts go whole through any other file's tokenizer.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _known(form: dict) -> bool:
    """Whether a tokenizer file cuts texts into the pieces that this module knows."""
    added = all(t["content"].startswith("<|") for t in form.get("added_tokens") or [])
    return added and (form.get("normalizer"), form.get("pre_tokenizer"), form["model"].get("end_of_word_suffix")) == (NORMALIZER, PRE_TOKENIZER, "</w>")


class PieceEncoder:
    """Ids of texts under a file of the tokenizers library: by pieces for lower-casing word BPE, else of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.by_pieces = _known(json.loads(self.whole.to_str()))
        self.piece = Tokenizer.from_file(path)
        self.piece.normalizer = normalizers.Lowercase()
        self.piece.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, i in self.whole.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.len, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str], odd: np.ndarray) -> None:
        """Adds sorted new keys with their texts; odd ones take the unchanged tokenizer."""
        lengths = np.zeros(len(keys), np.int64)
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(keys)
        plain = np.flatnonzero(~odd)
        for lo in range(0, len(plain), 20_000):
            some = plain[lo : lo + 20_000]
            ids = np.array(self.piece.encode_batch_fast([" ".join(texts[i] for i in some)], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(some):  # not one word end for each piece: take them one by one
                odd[some] = True
                continue
            for i, x in zip(some, np.split(ids, stop[:-1]), strict=True):
                parts[i] = x
        rest = np.flatnonzero(odd)
        for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            parts[i] = np.array(e.ids, np.uint32)
        lengths[:] = [len(x) for x in parts]
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._forget()
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(lengths) - lengths])[order]
        self.len = np.concatenate([self.len, lengths])[order]
        self.ids = np.concatenate([self.ids, *parts])
        self.keys = all_keys[order]

    def _pieces(self, run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and oddness of pieces, and each document's first piece."""
        data, off = run.data, run.offsets
        cls = CLASSES[data]
        high = data >= 0x80
        if high.any():
            second = np.zeros(len(data), bool)
            lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
            low = data[lead + 1]
            lead = lead[~((data[lead] == 0xC3) & ((low == 0x97) | (low == 0xB7)) | (data[lead] == 0xC4) & (low == 0xB0))]  # two signs; dotted I lower-cases to two characters
            second[lead + 1] = True
            cls[lead] = cls[lead + 1] = _LETTER
        starts, ends, first = run.words()
        bar = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))  # <|
        cls[bar] = _ODD
        bad = np.zeros(len(data) + 1, np.int64)
        np.cumsum(cls == _ODD, out=bad[1:])
        odd = bad[ends] > bad[starts]
        begin = np.ones(len(data), bool)
        begin[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)
        begin &= cls != _SPACE
        begin[starts] = True
        if odd.any():
            begin[ranges(starts[odd], (ends - starts)[odd])] = False
            begin[starts[odd]] = True
        s = np.flatnonzero(begin)
        chunk = np.searchsorted(starts, s, "right") - 1
        e = np.minimum(np.append(s[1:], len(data)), ends[chunk]) if len(s) else s
        return s, e, odd[chunk] if len(s) else np.zeros(0, bool), np.searchsorted(s, off)

    def encode_run(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the run's documents one after another (uint32), and where each document's begin (n + 1)."""
        if not len(run.data):
            return np.zeros(0, np.uint32), np.zeros(run.n + 1, np.int64)
        if not self.by_pieces:
            blob = run.data.tobytes()
            ids = [np.array(self.whole.encode(blob[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for a, b in zip(run.offsets[:-1].tolist(), run.offsets[1:].tolist(), strict=True)]
            return np.concatenate(ids), np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
        s, e, odd, first = self._pieces(run)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(run.n + 1, np.int64)
        h = span_hashes(ASCII_LOWER[run.data], s, e)
        h ^= odd.astype(np.uint64)  # odd chunks keep keys of their own
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        new = ~self._has(keys)
        if len(self.keys) + new.sum() > CACHE_PIECES:
            self._forget()
            new[:] = True
        if new.any():
            at = where[new]
            blob = run.data.tobytes()
            self._learn(keys[new], [blob[a:b].decode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)], odd[at].copy())
        slot = np.searchsorted(self.keys, keys)[back]
        lengths = self.len[slot]
        total = np.zeros(len(s) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        return self.ids[ranges(self.at[slot], lengths)], total[first]

    def _has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def encode(self, column: pa.Array):
        """(row, ids) for every row of a string column; null texts have no ids."""
        for run in runs(column):
            ids, first = self.encode_run(run)
            for k in range(run.n):
                yield run.first + k, ids[first[k] : first[k + 1]]


_made: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a file, made once."""
    if path not in _made:
        _made[path] = PieceEncoder(path)
    return _made[path]
