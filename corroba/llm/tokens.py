"""Token ids of whole texts by the public tokenizers, with a bounded memory of chunks.

The pre-tokenizers of both vocabularies cut a text at single white space
characters, and merges never cross such a cut. A text is therefore split at
spaces and line feeds that stand between two characters that are not white
space. The chunks of a few MB of text at a time get numbers by a hash table
(Arrow's dictionary encoding); each distinct chunk is looked up once, unknown
ones are encoded by the ``tokenizers`` library itself and remembered, and the
ids of the texts are gathered from those of the chunks by numpy. So the library
runs once a distinct chunk and Python once a distinct chunk of a batch. The ids
equal those of ``Tokenizer.encode(text, add_special_tokens=False)`` on the whole
text (tests/llm/test_operators.py compares them).

The tokenizer is set up as the description of the public files says, with
``encode_special_tokens = True``: strings of special tokens inside a text are
ordinary text. ``special=True`` leaves the library's default, under which they
become the special ids. A null text is empty. A text of any length is encoded
whole; working memory beyond its ids is bounded by ``GATHER`` chunks and the
chunk numbers.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corroba.llm.common import text_batches

#: Chunks that one Python worker remembers for a vocabulary; beyond that the memory starts anew.
CACHE_CHUNKS = 1_000_000
#: Longer chunks are encoded and not remembered.
CACHE_CHARS = 48
#: Characters of the texts that are encoded together, and chunks whose ids are gathered at once.
BATCH_CHARS, GATHER = 8 << 20, 1 << 19

#: A comma or full stop that ends a chunk after a letter or digit below U+0100: both pre-tokenizers cut between the two.
_MARK = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([,.])( |$)"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: First character of the keys of chunks without a space before them; other keys stand for a space and the key.
_BARE = "\r"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, looked up where the code runs."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class Encoder:
    """Ids of texts for one vocabulary.

    ``drops_space``: white space yields no ids, so chunks don't carry it and
    stand for themselves as keys.
    """

    def __init__(self, path: str, drops_space: bool, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(path))
        self.tokenizer.encode_special_tokens = not special
        self.drops_space, self.special = drops_space, special
        self.known: dict[str, bytes] = {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        """Words with single spaces and line feeds between them, no other white space."""
        return "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text and text[0] not in " \n" and text[-1] not in " \n" and text.replace("\n", "").isprintable()

    def _keys(self, text: str) -> list[str]:
        return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else _BARE + c for c in _CUT.split(text) if c]

    def _spaced(self, text: str) -> str:
        """The text without line feeds. All letters are lowered by the tokenizer, so that a text without characters that could compose with others may be lowered here."""
        text = text.replace("\n", " ")
        if self.special and "<" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The number of every key of the texts, the distinct keys, and how many keys each text has."""
        parts, sizes = [], []
        plain: list[str] = []

        def flush() -> None:
            if plain:
                marked = r"\1 \2\3" if self.drops_space else rf"\1 {_BARE}\2\3"
                split = pc.split_pattern(pc.replace_substring_regex(pa.array(plain, pa.large_string()), _MARK, marked), " ")
                parts.append(split.flatten())
                sizes.append(np.diff(split.offsets.to_numpy()))
                plain.clear()

        for text in texts:
            if self.drops_space:
                plain.append(self._spaced(text))
            elif not text or self._plain(text):
                plain.append(_BARE + text.replace("\n", f" {_BARE}\n {_BARE}"))
            else:
                flush()
                keys = self._keys(text)
                parts.append(pa.array(keys, pa.large_string()))
                sizes.append(np.array([len(keys)]))
        flush()
        coded = pc.dictionary_encode(pa.concat_arrays(parts))
        return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.concatenate(sizes)

    def look_up(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct keys."""
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known = self.known
        got = list(map(known.get, keys))
        new = [i for i, ids in enumerate(got) if ids is None]
        names = [keys[i] for i in new]
        for i, name, ids in zip(new, names, self.ids(names if self.drops_space else [k[1:] if k[:1] == _BARE else " " + k for k in names]), strict=True):
            got[i] = ids
            if len(name) <= CACHE_CHARS:
                known[name] = ids
        return got

    def _encode(self, texts: list[str]) -> list[bytes]:
        numbers, keys, counts = self._numbers(texts)
        found = self.look_up(keys)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        pool, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        long = sizes[numbers]
        stops = np.cumsum(long)
        ids = np.empty(int(stops[-1]) if len(stops) else 0, "<u4")
        for a in range(0, len(numbers), GATHER):
            n = long[a : a + GATHER]
            base = int(stops[a] - long[a])
            shift = first[numbers[a : a + GATHER]] - (stops[a : a + GATHER] - n - base)
            place = np.repeat(shift, n)
            place += np.arange(len(place))
            ids[base : base + len(place)] = pool[place]
        cuts = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in text_batches(texts, BATCH_CHARS):
            out += self._encode([t or "" for t in texts[a:b]])
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One encoder a worker process, so that later tasks find its chunks."""
    key = (path, drops_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drops_space)
    return _ENCODERS[key]
