"""Token ids of whole texts with public tokenizers, encoded chunk by chunk through a bounded memo.

A text is cut where its tokenizer cuts anyway (white space for the word vocabulary, the published pre-token
pattern for the byte vocabulary), so each distinct chunk is encoded once by the tokenizers library and looked up
afterwards. A text that holds a special token's string is encoded in one piece instead.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

#: Chunks that a worker keeps; beyond that, new ones are encoded again when they recur.
MEMO_CHUNKS = 400_000
#: Characters of text whose chunks are encoded together.
GROUP_CHARS = 2_000_000

_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
#: Texts of these characters fall apart as PARTS says whatever their tokenizer's other rules; lower case is simple.
SIMPLE = re.compile(f"[{_LETTERS}0-9{_MARKS} \t\n\r]*")
# The word vocabulary's published pattern, for the characters of simple texts.
_PARTS = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_MARKS}]+"
PARTS, PART = re.compile(_PARTS), re.compile(f"(?:{_PARTS})")
# The byte vocabulary's published pattern, for the same characters.
BYTE_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
# The alphabet of byte vocabularies, in which bytes that print stand for themselves.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)}.difference(_PRINTED)))}
#: The characters of simple texts in that alphabet.
SPELLED = {k: "".join(map(_ALPHABET.get, chr(k).encode())) for k in range(1, 256)}
#: What no simple text holds.
BREAK = "\0"
#: The kinds of the bytes of simple texts: space 1, other white space 2, mark 3, letter or digit 4, apostrophe 8.
KINDS = np.full(256, 4, np.uint8)
KINDS[list(b" \t\n\r")] = 1, 2, 2, 2
KINDS[[k for k in range(33, 127) if not chr(k).isalnum()]] = 3
KINDS[ord("'")] = 8


class WholeTexts:
    """Encodes whole texts; a chunk's ids are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str | bytes, bytes] = {}
        self.special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)").search

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_new(self, chunks: list[str]) -> dict[str, bytes]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = (4 * np.cumsum([len(i) for i in ids], dtype=np.int64)).tolist()
        return {c: data[a:b] for c, a, b in zip(chunks, [0, *ends], ends, strict=False)}

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn; null counts as empty. Chunks new to the memo are encoded together."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self.encode_group(group)
                group, size = [], 0
        yield from self.encode_group(group)

    def encode_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        collects = gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            cuts = [None if self.special(text) else self.cut(text) for text in texts]
            found = looked_up(self.memo, set(chain.from_iterable(c for c in cuts if c)), self.encode_new)
        finally:
            if collects:
                gc.enable()
        for text, chunks in zip(texts, cuts, strict=True):
            if chunks is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            else:
                yield np.frombuffer(b"".join(map(found.__getitem__, chunks)), "<u4")


def looked_up(memo: dict[str, bytes], chunks: set[str], encode_new) -> dict[str, bytes]:
    """A mapping that has all ``chunks``; the memo takes up new ones while it has room (frequent ones come early)."""
    new = chunks.difference(memo)
    found = encode_new(list(new))
    if len(memo) >= MEMO_CHUNKS:
        found.update((c, memo[c]) for c in chunks - new)
        return found
    memo.update(found)
    return memo


class ByteTexts(WholeTexts):
    """For the vocabulary that keeps all bytes.

    A space before anything but white space begins a chunk, and so does a mark other than an apostrophe after a letter
    or a digit, and the other way about. The simple texts of a group are cut there all at once, and each distinct unit
    between cuts is looked up, and its chunks encoded, once; other texts go chunk by chunk.
    """

    def __init__(self, path: str):
        super().__init__(path)
        import public_tokenizers
        import regex
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.any_text = regex.compile(public_tokenizers.PATTERN).findall
        # The same model for chunks that are spelled in its alphabet already; tokens have a character for each byte.
        self.by_chunk = type(self.tokenizer).from_file(path)
        self.by_chunk.pre_tokenizer = CharDelimiterSplit(BREAK)
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))

    def cut(self, text: str) -> list[str]:
        return BYTE_PARTS.findall(text) if SIMPLE.fullmatch(text) else self.any_text(text)

    def encode_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        simple = [bool(SIMPLE.fullmatch(text)) and not self.special(text) for text in texts]
        code = [text.encode() for text, is_simple in zip(texts, simple, strict=True) if is_simple]
        of_simple = iter(self.encode_simple(code) if code else ())
        others = super().encode_group([text for text, is_simple in zip(texts, simple, strict=True) if not is_simple])
        for is_simple in simple:
            yield next(of_simple if is_simple else others)

    def encode_simple(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        joined = b"".join(texts)
        ends = np.cumsum([0, *map(len, texts)])
        kinds = KINDS[np.frombuffer(joined, np.uint8)]
        before, after = np.append(np.uint8(0), kinds[:-1]), np.append(kinds[1:], np.uint8(0))
        after[ends[ends > 0] - 1] = 0
        cut = (kinds == 1) & (after > 2) | (kinds + before == 7)
        cut[ends[ends < len(joined)]] = True
        offsets = np.append(np.flatnonzero(cut), len(joined))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        index, bounds, data = coded.indices.to_numpy(), *coded.dictionary.buffers()[1:]
        bounds, data = np.frombuffer(bounds, np.int64)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        units = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        found = list(map(self.memo.get, units))
        new = [k for k, ids in enumerate(found) if ids is None]
        room = max(0, MEMO_CHUNKS - len(self.memo))
        for k, ids in zip(new, self.encode_units([units[k] for k in new]), strict=True):
            found[k] = ids
        self.memo.update((units[k], found[k]) for k in new[:room])
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        # The ids of each unit in turn, from where they lie.
        own = sizes[index]
        to = np.append(0, np.cumsum(own))
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[index] - to[:-1], own) + np.arange(to[-1])]
        bounds = to[np.searchsorted(offsets, ends)].tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield out[a:b]

    def encode_units(self, units: list[bytes]) -> Iterator[bytes]:
        """Encode the chunks of many units as one text in the model's alphabet, and split the ids by bytes."""
        for at in range(0, len(units), 1000):
            cuts = [BYTE_PARTS.findall(u.decode()) for u in units[at : at + 1000]]
            text = BREAK.join(chain.from_iterable(cuts)).translate(SPELLED)
            ids = np.array(self.by_chunk.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            # Where chunks end, in bytes and in ids: each ends with a token.
            breaks, ends = np.cumsum([0, *map(len, text.split(BREAK))]), np.append(0, np.cumsum(self.sizes[ids]))
            last = np.searchsorted(ends, breaks)
            if not np.array_equal(ends[np.minimum(last, len(ids))], breaks):
                raise ValueError("the tokenizer's tokens do not have a character for each byte")
            data, start = ids.tobytes(), 0
            for end in (4 * last[np.cumsum(list(map(len, cuts)))]).tolist():
                yield data[start:end]
                start = end


class WordTexts(WholeTexts):
    """For the vocabulary that drops white space and marks word ends."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def cut(self, text: str) -> list[str]:
        return PARTS.findall(text.lower()) if SIMPLE.fullmatch(text) else text.replace("\n", " ").split(" ")

    def encode_new(self, chunks: list[str]) -> dict[str, bytes]:
        parts = [c for c in chunks if PART.fullmatch(c)]
        found = self.encode_parts(parts)
        if len(found) < len(chunks):
            found.update(super().encode_new([c for c in chunks if c not in found]))
        return found

    def encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Encode many words as one text and split the ids at the word ends."""
        found = {}
        for at in range(0, len(parts), 1000):
            group = parts[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(group):
                found |= super().encode_new(group)
                continue
            data, start = ids.tobytes(), 0
            for part, end in zip(group, ends.tolist(), strict=True):
                found[part] = data[start:end]
                start = end
        return found


@lru_cache(maxsize=4)
def whole_texts(path: str, kind: str) -> WholeTexts:
    """``kind`` is "word" or "byte" and says where the vocabulary lets a text be cut."""
    return (WordTexts if kind == "word" else ByteTexts)(path)
