"""Token ids of whole texts by the tokenizers library, each distinct word encoded once in a worker."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import word_codes

#: Parts of words that a worker keeps the ids of; code points of the longest.
KEPT_PARTS, LONGEST = 900_000, 40
#: Text bytes of which the distinct words are found at a time.
TEXT_BYTES = 12_000_000
#: Latin-1 letters, then marks that no contraction and no special token begins with.
PLAIN = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<marks>[.,!?;:#%&*$|]*)$"
#: The characters that byte-level vocabularies write the bytes 0 to 255 as.
BYTE_CHARS = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE_CHARS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in BYTE_CHARS)}


class WordEncoder:
    """Ids of texts as tokenizer.encode(text, add_special_tokens=False) gives them.

    The tokenizer must deal with stretches between ASCII white space one by one: it drops white space, and neither its normalizer nor its special tokens reach over it. With `plain`, it also
    lower-cases, splits runs of letters from runs of marks and has a byte-level BPE model: then Latin-1 letters (which composition leaves alone and which lower-case one by one) with marks behind
    them go to the model straight, each part once.
    """

    def __init__(self, path: str, plain: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), plain
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {"": b""}

    def _ids(self, part: str) -> bytes:
        """Of lower-cased letters, or of marks."""
        chars = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_CHARS)
        return np.array([t.id for t in self.model.tokenize(chars)], np.uint32).tobytes()

    def _runs(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.parts.get, parts))
        if len(self.parts) > KEPT_PARTS:
            self.parts = {"": b""}
        for i, x in enumerate(found):
            if x is None:
                part = parts[i]
                x = found[i] = self._ids(part)
                if len(part) <= LONGEST:
                    self.parts[part] = x
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, first id of each text and an end); null: no ids."""
        starts, codes, words = word_codes(texts)
        cut = pc.extract_regex(words, PLAIN) if self.plain else pa.nulls(len(words), pa.struct([("letters", pa.string()), ("marks", pa.string())]))
        letters, marks = (pc.dictionary_encode(x) for x in (pc.utf8_lower(cut.field("letters")), cut.field("marks")))
        other = cut.is_null().to_numpy(zero_copy_only=False)
        rest = [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes() for w in words.filter(pa.array(other)).to_pylist()]
        runs = [b"", *self._runs(letters.dictionary.to_pylist()), *self._runs(marks.dictionary.to_pylist()), *rest]
        # A word is two runs: its letters and its marks, or itself and nothing
        n = len(letters.dictionary)
        pair = np.zeros((len(words), 2), np.int64)
        pair[:, 0] = np.where(other, n + len(marks.dictionary) + np.cumsum(other), pc.fill_null(letters.indices, 0).to_numpy(zero_copy_only=False) + 1)
        pair[:, 1] = np.where(other, 0, pc.fill_null(marks.indices, 0).to_numpy(zero_copy_only=False) + 1 + n)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids, ends = gathered(np.frombuffer(b"".join(runs), np.uint32), at[:-1], sizes, pair[codes].ravel())
        return ids, ends[2 * starts]


def gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat[at[c] : at[c] + sizes[c]] for each c in codes, laid end to end; where each begins, and an end)."""
    n = sizes[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    where = np.repeat(at[codes] - ends[:-1], n)
    where += np.arange(ends[-1])
    return flat[where], ends


@functools.lru_cache(maxsize=2)
def encoder(path: str, plain: bool = True) -> WordEncoder:
    """One encoder a worker; tasks that follow each other in it find its words."""
    return WordEncoder(path, plain)


def closed(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and ends with end_id after each text."""
    n = len(ends) - 1
    out = np.empty(len(ids) + n, np.uint32)
    to = ends + np.arange(n + 1)
    mark = np.zeros(len(out), bool)
    mark[to[1:] - 1] = True
    out[mark] = end_id
    out[~mark] = ids
    return out, to
