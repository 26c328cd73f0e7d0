"""Exact subword ids of whole texts, fast: each distinct word of a batch is encoded once.

White space ends a token in the tokenizers used here, so a text's ids are its words' ids in a row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: File of the tokenizer package that the operators use unless told otherwise.
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Characters of text that are split at a time.
CHUNK_CHARS = 4 << 20
#: Word parts a worker remembers between batches; it starts anew beyond, which only costs time.
REMEMBERED = 300_000

#: Lower-case words of these letters are one piece for the tokenizer, and composed already.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Marks that the tokenizer cuts off a word of plain letters, and keeps together.
_TAIL = ".,;:!?|*#%&$()[]\"-"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of words by a ``tokenizers`` file whose pre-tokenizer splits at white space.

    ``model.tokenize`` does the work for plain words, the whole tokenizer for all others.
    """

    _shared: dict[str, WordEncoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        # Byte-level letters of the characters that plain words are made of.
        plain = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
        self.letters = {ord(c): self._byte_letters(c) for c in plain}
        self.words_apart = self._plain_words_are_pieces()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The worker's encoder for this file."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _byte_letters(self, char: str) -> str:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(char) if self.tokenizer.pre_tokenizer else [(char, None)]
        return "".join(piece for piece, _ in pieces)

    def _plain_words_are_pieces(self) -> bool:
        """Whether model.tokenize agrees with the tokenizer on sample words, so that it may be used."""
        samples = ["the", "tion", "élève", "straße", "über", "weiß", "zzqj", "aïoli", "niño"]
        return all(self._model_ids(w) == self._whole_ids(w) for w in samples) and all(
            self._model_ids(w) + self._whole_ids(t) == self._whole_ids(w + t) for w in samples for t in (".", "!!", "***", "|")
        )

    def _whole_ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _model_ids(self, word: str) -> list[int]:
        return [token.id for token in self.model.tokenize(word.translate(self.letters))]

    def _bytes(self, part: str, ids) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = np.array(ids(part), "<u4").tobytes()
        return found

    def word_bytes(self, word: str) -> bytes:
        stem = word.rstrip(_TAIL) if self.words_apart else ""
        if not stem or not _PLAIN.fullmatch(stem):
            return self._bytes(word, self._whole_ids)
        found = self._bytes(stem, self._model_ids)
        return found + self._bytes(word[len(stem) :], self._whole_ids) if len(stem) < len(word) else found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and where each text's begin, with the end (int64)."""
        words, starts = split_words(texts)
        return self.encode_words(words.dictionary_encode(), starts)

    def encode_words(self, coded: pa.DictionaryArray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words already split, as a dictionary."""
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        each = [self.word_bytes(word) for word in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ends = np.zeros(len(each) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) // 4, out=ends[1:])
        pool = np.frombuffer(b"".join(each), "<u4")
        ids = pa.LargeListArray.from_arrays(ends, pool).take(coded.indices)
        offsets = ids.offsets.to_numpy()
        return ids.values.to_numpy(), offsets[starts]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and where each text's begin, with the end.

    Words are separated by the ASCII white space \\x20 and \\x09-\\x0D. Null counts as empty.
    """
    # Arrow's lower-casing needs an array that starts at its buffers' beginning; take() makes one.
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    filled = pc.greater(pc.binary_length(words), 0)
    # White space at the ends of a text gives empty words.
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return words.filter(filled), before[offsets - offsets[0]]


def chunks(texts: pa.Array, n_chars: int = CHUNK_CHARS):
    """Slices ``(first, texts)`` of about so many characters; a longer text is one slice."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and held + size > n_chars:
            yield first, texts.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, texts.slice(first)
