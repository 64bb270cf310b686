"""Token ids of whole texts, by the tokenizers library, with each distinct word encoded once.

The vocabulary's normaliser and splitter never join characters across white space, so the ids of a text are the
ids of its white-space separated words, one after another. Words repeat far more often than they differ: a batch is
cut into words (ASCII letters in lower case, as the normaliser makes them) and dictionary-encoded by Arrow, new words are encoded by the library, and all others are gathered
from a pool with NumPy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = "\x00"
TAIL = r"([a-z])([.,!?;:*$%&#]+)(\s|$)"
_loaded: dict[str, "WordTokenizer"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """``most_words`` bounds the memory of the pool only; when it is full it starts anew and no result changes."""

    def __init__(self, path: str, most_words: int = 600_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.most_words = most_words
        sep = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        if len(sep) != 1:
            raise ValueError("the vocabulary has no single token for the separator")
        self.separator = sep[0]
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; the words travel in long texts, cut again at the separator's id."""
        out: list[np.ndarray] = []
        plain = [w for w in words if SEPARATOR not in w]
        group = 2000
        joined = [f" {SEPARATOR} ".join(plain[i : i + group]) + f" {SEPARATOR}" for i in range(0, len(plain), group)]
        for got in self.library.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(got.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.separator)
            begin = 0
            for end in cuts.tolist():
                out.append(ids[begin:end])
                begin = end + 1
        if len(out) != len(plain):
            raise AssertionError("the words of a joined text can't be told apart")
        if len(plain) < len(words):
            rest = iter(out)
            out = [np.array(self.library.encode(w, add_special_tokens=False).ids, np.uint32) if SEPARATOR in w else next(rest) for w in words]
        return out

    def _learn(self, words: list[str]) -> None:
        new = self._encode(words)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.concatenate(new) if new else np.zeros(0, np.uint32)
        at, to = len(self.index), len(self.index) + len(words)
        while to > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.starts[at:to] = self.filled + np.cumsum(lengths) - lengths
        self.lengths[at:to] = lengths
        self.filled += len(flat)
        self.index.update(zip(words, range(at, to), strict=True))

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        get = self.index.get
        known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        return known, np.flatnonzero(known < 0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text). Null texts have no ids."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's name keeps its case
            texts = pc.ascii_lower(texts)
        # letters and the marks after them are split apart by the vocabulary as well; so there are fewer words to learn
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, TAIL, r"\1 \2\3"))
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode()
        bounds = bounds - bounds[0]
        words = coded.dictionary.to_pylist()
        known, miss = self._look_up(words)
        if len(self.index) + len(miss) > self.most_words and len(self.index) > 1:
            self._reset()
            known, miss = self._look_up(words)
        if len(miss):
            first = len(self.index)
            self._learn([words[i] for i in miss.tolist()])
            known[miss] = np.arange(first, first + len(miss))
        at = known[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)
        return self.pool[place], np.concatenate([[0], ends])[bounds] if len(ends) else np.zeros(len(bounds), np.int64)


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Slices of a batch that hold about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
