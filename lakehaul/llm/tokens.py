"""Token ids of whole texts, by the ``tokenizers`` library, with a cache of words.

Both tokenizers used here work on parts of a text independently, so each distinct part is
encoded once.

* The byte tokenizer divides a text at a single space between two characters that are
  no white space, and gives the space to what follows.  Texts with white space next to
  white space are encoded whole.
* The word tokenizer drops all white space, ignores case and takes letters, digits and
  runs of other characters one by one.  Its parts lie between ASCII white space, other
  white space stays inside a part; ASCII signs that end a part behind a letter or
  digit are a part of their own.

Arrow splits the texts and numbers their distinct parts, and the ids are put together by number.

The cache is bounded: half full, it becomes the older half, of which only chunks that come
again are kept.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakehaul.llm.shared import held_by_worker

#: Chunks kept by one Python worker.
CACHE_CHUNKS = 600_000
#: First chunks of texts kept by it.
CACHE_FIRSTS = 50_000
#: Chunks encoded in one string.
JOINED = 2048

#: White space next to white space, for Arrow's regular expressions.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\p{Z}]{2}"
#: Signs that are a part of their own, for Arrow's regular expressions.
#: Not "]" and ">", which may end a special token.
_STOPS, _APART = r"([\pL\pN])([!-/:-=?@\[\\^-`{-~]+)(\s|$)", r"\1 \2\3"


class Encoder:
    """Ids of texts.  ``joined_by_space``: ids of a chunk begin with one that holds its
    leading space, and no other id of it holds a space; so many chunks are encoded as
    one string and told apart by those ids."""

    def __init__(self, path: str, joined_by_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.by_space = joined_by_space
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        if joined_by_space:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
            # Chunks are distinct, so the library's own cache only costs.
            self.tokenizer.model._resize_cache(0)
            self.space = self.whole(" ")
            # Letters a to z stand for their bytes and are no place to divide at, so words of
            # them need no division but at the spaces between.
            self.letters = Tokenizer.from_file(path)
            self.letters.pre_tokenizer = WhitespaceSplit()
            self.letters.model._resize_cache(0)
        else:
            (self.mark,) = self._encode(["\x01"])[0]
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return np.array(self._encode([text])[0], dtype="<u4").tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        if self.by_space:
            plain, others = [], []
            for c in chunks:
                (plain if c.isascii() and c.isalpha() else others).append(c)
            return self._learn_by(plain, self._by_letters) | self._learn_by(others, self._by_opening)
        letters = [c for c in chunks if c.isalpha()]
        others = [c for c in chunks if not c.isalpha()]
        return self._learn_by(letters, self._by_closing) | self._learn_by(others, self._by_mark)

    def _by_opening(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(self._encode([" " + " ".join(part)])[0], dtype="<u4")
        begins = np.flatnonzero(self.opens[ids])
        return ids, begins, np.append(begins[1:], len(ids))

    def _by_letters(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = "Ġ" + " Ġ".join(part)
        ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        begins = np.flatnonzero(self.opens[ids])
        return ids, begins, np.append(begins[1:], len(ids))

    def _by_closing(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of letters: each ends with an id that ends a word."""
        ids = np.array(self._encode([" ".join(part)])[0], dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        return ids, np.append(0, ends[:-1]), ends

    def _by_mark(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(self._encode([" \x01 ".join(part) + " \x01"])[0], dtype="<u4")
        ends = np.flatnonzero(ids == self.mark)
        return ids, np.append(0, ends[:-1] + 1), ends

    def _learn_by(self, chunks: list[str], how: Callable) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        prefix = " " if self.by_space else ""
        for at in range(0, len(chunks), JOINED):
            part = chunks[at : at + JOINED]
            ids, begins, ends = how(part)
            if len(begins) != len(part):  # some chunk is not as expected: one by one
                out.update((c, self.whole(prefix + c)) for c in part)
                continue
            data = ids.tobytes()
            for chunk, a, b in zip(part, (begins * 4).tolist(), (ends * 4).tolist(), strict=True):
                out[chunk] = data[a:b]
        return out

    def _recall(self, wanted: list[str]) -> dict[str, bytes]:
        """The cache, with the ids of all these chunks in it."""
        missing = [c for c in wanted if c not in self.cache]
        if len(self.cache) + len(missing) > CACHE_CHUNKS // 2:
            self.older, self.cache, missing = self.cache, {}, wanted
        again = {c: self.older[c] for c in missing if c in self.older}
        self.cache.update(again)
        self.cache.update(self._learn([c for c in missing if c not in again]))
        return self.cache

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        how = self.encode_spaced if self.by_space else self.encode_words
        ids, lengths = how(pa.array(texts, pa.large_string()))
        data, ends = ids.tobytes(), np.cumsum(lengths) * 4
        return [data[b - 4 * n : b] for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]

    def encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without nulls, end to end, and their number per text."""
        parts = pc.ascii_split_whitespace(
            pc.replace_substring_regex(pc.ascii_lower(texts), _STOPS, _APART)
        )
        numbered = parts.flatten().dictionary_encode()
        chunks = numbered.dictionary.to_pylist()
        known = self._recall([c for c in chunks if c])
        found = [known[c] if c else b"" for c in chunks]
        ids, ends = _joined(found, numbered.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        return ids, np.diff(ends[bounds])

    def encode_spaced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same by the byte tokenizer: chunks lie between single spaces, and all but the
        first of a text have one before them."""
        odd = pc.match_substring_regex(texts, _SPACES).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts.filter(pa.array(~odd)) if odd.any() else texts, " ")
        counts = pc.list_value_length(parts).to_numpy()
        flat = pc.list_flatten(parts)
        leads = np.cumsum(counts) - counts
        others, firsts = flat.dictionary_encode(), flat.take(pa.array(leads)).dictionary_encode()
        words = others.dictionary.to_pylist()
        known = self._recall([c for c in words if c])
        found = [known[c] if c else self.space for c in words] + self._first(firsts.dictionary.to_pylist())
        number = others.indices.to_numpy().astype(np.int64)
        number[leads] = firsts.indices.to_numpy() + len(words)
        ids, ends = _joined(found, number)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        lengths = np.zeros(len(texts), dtype=np.int64)
        lengths[~odd] = np.diff(ends[bounds])
        if not odd.any():
            return ids, lengths
        whole = [np.frombuffer(self.whole(t), "<u4") for t in texts.filter(pa.array(odd)).to_pylist()]
        lengths[odd] = [len(x) for x in whole]
        out = np.empty(int(lengths.sum()), dtype="<u4")
        of_odd = np.repeat(odd, lengths)
        out[~of_odd], out[of_odd] = ids, np.concatenate(whole)
        return out, lengths

    def _first(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without a space before them."""
        missing = [c for c in chunks if c not in self.firsts]
        if len(self.firsts) + len(missing) > CACHE_FIRSTS:
            self.firsts, missing = {}, chunks
        for chunk, ids in zip(missing, self._encode(missing), strict=True):
            self.firsts[chunk] = np.array(ids, dtype="<u4").tobytes()
        return [self.firsts[c] for c in chunks]


def _joined(found: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks end to end, each given by its number, and where each one ends."""
    ids = np.frombuffer(b"".join(found), dtype="<u4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    each = sizes[number]
    ends = np.concatenate([[0], np.cumsum(each)])
    places = np.repeat((np.cumsum(sizes) - sizes)[number] - ends[:-1], each)
    places += np.arange(len(places))
    return ids[places], ends


def encoder(path: str, joined_by_space: bool) -> Encoder:
    """One per worker process: its cache serves all tasks that the worker runs, until it runs
    another operator that holds something."""
    held = held_by_worker("encoders")
    found = held.get((path, joined_by_space))
    if found is None:
        found = held[path, joined_by_space] = Encoder(path, joined_by_space)
    return found
