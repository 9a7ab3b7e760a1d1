"""Whole texts to token ids with the tokenizers library, by pieces that are kept.

The vocabularies whose pre-tokenizer drops white space never join what white space parts, so a text's ids are those of
its pieces between blanks, tabs and line feeds, one after the other.  The same holds for a full stop or comma between
a Latin letter and a blank; and lower-casing A-Z first changes nothing, as these vocabularies lower-case themselves.
Pieces are cut and told apart by Arrow's kernels, each distinct piece is encoded once, and its ids are kept up to a
bound.  Pieces of Latin letters alone go to the library's model directly, where probes show that its normalizer and
pre-tokenizer leave them whole.  The test suite holds all this against the library on whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Fixed value: the id that ends a document.
END = 2
#: Pieces that a worker keeps in each of two generations, and the longest of them.
_KEPT, _LONG = 400_000, 48
_STOP = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ÿ])([.,])(?= )")
_OTHER_STOP = "(^|[^A-Za-zÀ-ÖØ-öø-ÿ])[.,] "
#: A special token of the vocabulary; it parts pieces that are encoded in one call.
_BETWEEN = "<|endoftext|>"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_PROBES = ("a", "word", "naïve", "Übermaß", "ÀÉîõÿ", "unbelievably")
#: Bytes of text that are cut at once, but for a longer single text.
_GROUP = 8 << 20


def cut(texts: pa.Array) -> pa.Array:
    """The pieces of each text, as lists; some are empty."""
    special = pc.match_substring(texts, "<|")  # a special token in capitals is none
    texts = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
    for blank in "\n\t":
        texts = pc.replace_substring(texts, blank, " ")
    plain = texts
    for stop in ".,":
        texts = pc.replace_substring(texts, stop + " ", f" {stop} ")
    other = np.flatnonzero(pc.match_substring_regex(plain, _OTHER_STOP).to_numpy(zero_copy_only=False))
    if len(other):
        mask = np.zeros(len(texts), bool)
        mask[other] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([_STOP.sub(r" \1", plain[i].as_py()) for i in other], texts.type))
    return pc.split_pattern(texts, " ")


class Encoder:
    """Ids of whole texts; path is a tokenizers file, or the name of one of the installed public ones."""

    def __init__(self, path: str = VOCABULARY):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.library = Tokenizer.from_file(path)
        self.between = self.library.token_to_id(_BETWEEN)
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.coded = {ord(c): bytewise.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.direct = all(self._model(p) == self._whole(p) for p in _PROBES)

    def _model(self, letters: str) -> bytes:
        return np.array([t.id for t in self.library.model.tokenize(letters.lower().translate(self.coded))], "<u4").tobytes()

    def _whole(self, piece: str) -> bytes:
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece from the library, as bytes of unsigned 32-bit integers."""
        out = {}
        if self.direct:
            tokenize, coded = self.library.model.tokenize, self.coded
            letters = [p for p in pieces if _LETTERS(p)]
            found = [[t.id for t in tokenize(p.lower().translate(coded))] for p in letters]
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) * 4).tolist()
            raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            out = {p: raw[s:t] for p, s, t in zip(letters, [0, *ends], ends)}
        plain = [p for p in pieces if p not in out and "<|" not in p]
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for group, e in zip(groups, self.library.encode_batch_fast([_BETWEEN.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.between) * 4).tolist()
            for p, s, t in zip(group, [0, *(x + 4 for x in ends)], [*ends, len(raw)]):
                out[p] = raw[s:t]
        for p in pieces:
            if p not in out:
                out[p] = self._whole(p)
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces.  A full generation becomes the old one; what is met in it again moves on, so that
        common pieces stay."""
        found = list(map(self.known.get, pieces))
        fresh, new = {}, []
        for i, ids in enumerate(found):
            if ids is None:
                p = pieces[i]
                if p in self.old:
                    fresh[p] = self.old[p]
                else:
                    new.append(p)
        if new:
            fresh |= self._encode(new)
        if fresh:
            found = [fresh[p] if ids is None else ids for p, ids in zip(pieces, found)]
            short = {p: ids for p, ids in fresh.items() if len(p) <= _LONG}
            if len(self.known) + len(short) > _KEPT:
                self.old, self.known = self.known, {"": b""}
            if len(short) <= _KEPT:
                self.known |= short
        return found

    def _parts(self, texts: pa.Array):
        """Runs of texts as (ids of the distinct pieces, their counts, pieces by number, ends of the texts in them)."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // _GROUP
        for at in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
            if len(at):
                lists = cut(texts[int(at[0]) : int(at[-1]) + 1])
                coded = lists.flatten().dictionary_encode()
                ids = self._ids(coded.dictionary.to_pylist())
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                yield ids, counts, coded.indices.to_numpy(), np.cumsum(lists.value_lengths().to_numpy())

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column without nulls, without special tokens."""
        for ids, counts, pieces, ends in self._parts(texts):
            flat = np.frombuffer(b"".join(ids), "<u4")
            many = counts[pieces]
            after = np.concatenate(([0], np.cumsum(many)))
            every = flat[np.repeat((np.cumsum(counts) - counts)[pieces] - after[:-1], many) + np.arange(after[-1])]
            s = 0
            for t in after[ends].tolist():
                yield every[s:t]
                s = t

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        out = [np.zeros(0, np.int64)]
        for _, counts, pieces, ends in self._parts(texts):
            out.append(np.diff(np.concatenate(([0], np.cumsum(counts[pieces])))[np.concatenate(([0], ends))]))
        return np.concatenate(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder of each vocabulary a worker process."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]
