"""Token ids of whole texts by the tokenizers library, with caches of what it gave for pieces of text.

The byte-level pre-tokenizer splits a text at white space, letters, digits and other characters; a token never crosses
such a split, so what it gives for a piece between splits is what it gives for that piece in the text. Texts go in
slices: Arrow cuts them at spaces and numbers the different pieces, each of which is encoded once (nearly all come from
a cache), and numpy gathers the ids of all texts of the slice. Texts with strings of special tokens go to the tokenizer
whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordhash import slices

#: What a worker keeps: words in Arrow arrays (some 30 bytes each), and pieces of words in a dict (some 200 bytes each),
#: 50 MB in all; later new ones are encoded each time they come.
CACHED_WORDS, CACHED_PIECES = 800_000, 120_000
#: Bytes of text that are encoded at a time; a longer text is a slice of its own.
SLICE = 4_000_000

#: White space of the splitting rule, as the inside of a character class.
_WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + f"{chr(0x2000)}-{chr(0x200A)}"
#: The splits of the byte-level pre-tokenizer, for texts in which \w and \d mean letters and digits: those below U+0250.
_SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_WHITE}]|_)+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_FOREIGN = re.compile(f"[{chr(0x250)}-{chr(0x10FFFF)}\xb2\xb3\xb9\xbc-\xbe]")
_RARE_WHITE = "[\x0b-\r\x1c-\x1f" + _WHITE.replace("\t-\r ", "") + "]"
#: Where a space is no split: white space on both sides of it, or none after it; and white space of rare kinds.
_ODD = f"  | \n| \t| $|{_RARE_WHITE}"
_ODD_HERE, _ODD_ARROW = re.compile(_ODD.replace("$", r"\Z")), _ODD.replace("$", r"\z")


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as U+0100 and on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(0x100 + n) for n, b in enumerate(others)}


_BYTES = _byte_characters()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to packed native unsigned 32-bit ids, as encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        #: Words after a space, their ids one after another, and len + 1 offsets into the ids.
        self.words, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.fine: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of what lies between two splits: the model alone, on the characters that stand for the bytes."""
        return array("I", [x.id for x in self.model.tokenize(text.encode().decode("latin-1").translate(_BYTES))]).tobytes()

    def by_splits(self, text: str) -> bytes:
        if _FOREIGN.search(text):
            return self.whole(text)
        fine, out = self.fine, []
        for x in _SPLIT.findall(text):
            ids = fine.get(x)
            if ids is None:
                ids = self.piece(x)
                if len(fine) < CACHED_PIECES:
                    fine[x] = ids
            out.append(ids)
        return b"".join(out)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, each after a space, and len + 1 offsets into them."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        parts = [self.by_splits(" " + x) for x in new.to_pylist()]
        more = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ids, ends = np.r_[self.ids, more], np.r_[self.ends, self.ends[-1] + np.cumsum(sizes)]
        where = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        where[where < 0] = len(self.words) + np.arange(len(parts))
        room = CACHED_WORDS - len(self.words)
        if room > 0 and len(new):
            self.words = pa.concat_arrays([self.words, new.slice(0, room).cast(pa.string())])
            self.ends = ends[: len(self.words) + 1]
            self.ids = ids[: self.ends[-1]]
        return _gather(ids, ends[where], ends[where + 1])

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self.whole(text)
        if _ODD_HERE.search(text):
            return self.by_splits(text)
        first, *rest = text.split(" ")
        return self.by_splits(first) + b"".join(self.by_splits(" " + x) for x in rest)

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of all texts (null: empty), end_id after each, and len + 1 offsets of the texts in them."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD_ARROW)
        for x in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False)
        # an odd text is one piece, and an end follows each text
        even = texts if not odd.any() else pc.if_else(pa.array(odd), pa.scalar("", texts.type), texts)
        cut = pc.split_pattern(even, " ")
        where = cut.offsets.to_numpy().astype(np.int64)
        where -= where[0]
        known = cut.flatten().dictionary_encode()
        codes, heads = known.indices.to_numpy().astype(np.int64), where[:-1]
        own = iter([self.encode(x) for x in texts.filter(pa.array(odd)).to_pylist()])
        first = known.dictionary.take(pa.array(codes[heads])).to_pylist()
        starts = [next(own) if is_odd else self.by_splits(x) for x, is_odd in zip(first, odd, strict=True)]
        starts.append(array("i", [end_id]).tobytes())
        ids, ends = self.lookup(known.dictionary)
        codes[heads] = len(ends) - 1 + np.arange(len(heads))
        codes = np.insert(codes, where[1:], len(ends) - 1 + len(heads))
        ids = np.r_[ids, np.frombuffer(b"".join(starts), np.int32)]
        ends = np.r_[ends, ends[-1] + np.cumsum([len(x) // 4 for x in starts])]
        out, ends = _gather(ids, ends[codes], ends[codes + 1])
        return out, np.r_[0, ends[where[1:] + np.arange(1, len(where))]]


def _gather(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids from each begin to its end, one after another, and len + 1 offsets into them."""
    out = np.r_[0, np.cumsum(ends - begins)]
    return ids[np.repeat(begins - out[:-1], ends - begins) + np.arange(out[-1])], out


def encoded(texts: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) of slices of the texts, see Encoder.encode_all."""
    one = encoder(path)
    for a, b in slices(texts, SLICE):
        yield a, b, *one.encode_all(texts.slice(a, b - a), end_id)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    return Encoder(path)
