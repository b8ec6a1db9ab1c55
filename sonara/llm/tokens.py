"""Token ids of whole texts by a vocabulary file of the tokenizers library.

A text is cut at ASCII white space, where that vocabulary's pre-tokenizer cuts too, so a text's ids are its words' ids
laid end to end.  Each distinct word of a batch goes to the tokenizer once and is then looked up; the table of known
words lives in the Python worker, is emptied at a fixed size and goes when other stages follow.  A file with another front
end may tell white space or case apart, so its texts go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
import time

import numpy as np

from . import kernels as K

#: Words known to a worker at most, at about 30 bytes each.
MAX_WORDS = 800_000
#: Bytes of text encoded at once: more words of a chunk are alike the larger it is.
TOKEN_CHUNK_BYTES = 1 << 19
#: New words before they are sorted in among the known ones.
RECENT_WORDS = 50_000

#: A tokenizer that no batch has used for so long is dropped.
IDLE_SECONDS = 15.0

# The front end under which a text's ids are its words' ids.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
END_OF_WORD = "</w>"

_TRIM = np.zeros(256, bool)
_TRIM[list(b".,")] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_words(tokenizer) -> bool:
    """Whether a text's ids are its words' ids laid end to end: the front end is the one above, words end in an id of their
    own, and nothing is drawn at random, cut off or filled up."""
    state = lambda part: json.loads(part.__getstate__()) if part is not None else None
    model = tokenizer.model
    plain = getattr(model, "end_of_word_suffix", None) == END_OF_WORD and not model.dropout and tokenizer.truncation is None and tokenizer.padding is None
    return plain and state(tokenizer.normalizer) == WORD_NORMALIZER and state(tokenizer.pre_tokenizer) == WORD_PRE_TOKENIZER


class WordTokenizer:
    """Encodes chunks of texts: word by word where ``cuts_at_words`` says so, else whole."""

    _known: dict[str, WordTokenizer] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The one of this Python worker."""
        if path not in cls._known:
            cls._known[path] = cls(path)
            K.WHEN_BATCH_DONE[:] = [cls._drop_idle]
        cls._known[path].used_at = time.monotonic()
        return cls._known[path]

    @classmethod
    def _drop_idle(cls) -> None:
        """Let go of tokenizers that no batch has used for a while: the worker has gone on to other stages."""
        now = time.monotonic()
        for path in [p for p, t in cls._known.items() if now - t.used_at > IDLE_SECONDS]:
            del cls._known[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_at_words(self.tokenizer)
        if not self.by_words:
            return
        special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.special = re.compile("|".join(re.escape(t.lower()) for t in special).encode()) if special else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(END_OF_WORD)]] = True
        self.mark = {m: self._ids([m])[0] for m in (".", ",")}
        self._clear()

    def _clear(self) -> None:
        """Known words: sorted hashes with their rows, and a few recent ones that are merged in later."""
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent: dict[int, int] = {}
        self.size = self.used = 0
        self.pool = np.zeros(1 << 18, np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32)
        self.start = np.zeros(1 << 14, np.int32)
        self.count = np.zeros(1 << 14, np.int32)

    def _merge(self) -> None:
        hashes = np.concatenate([self.hashes, np.fromiter(self.recent.keys(), np.uint64, len(self.recent))])
        rows = np.concatenate([self.rows, np.fromiter(self.recent.values(), np.int32, len(self.recent))])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.rows, self.recent = hashes[order], rows[order], {}

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.rows[at[known]]
        if self.recent:
            left = np.flatnonzero(out < 0)
            out[left] = [self.recent.get(h, -1) for h in hashes[left].tolist()]
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Tokenize new words.  Words of one pre-token go in together and are told apart by their end-of-word ids."""
        texts = [w.decode() for w in words]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        found: list = [None] * len(texts)
        for lo in range(0, len(plain), 256):
            group = plain[lo : lo + 256]
            ids = self._ids([" ".join(texts[k] for k in group)])[0]
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(group):
                for k, x in zip(group, np.split(ids, cuts[:-1])):
                    found[k] = x
        rest = [k for k in range(len(texts)) if found[k] is None]
        for k, x in zip(rest, self._ids([texts[k] for k in rest]) if rest else ()):
            found[k] = x
        counts = np.array([len(x) for x in found], np.int64)
        n, total = self.size, int(counts.sum())
        if len(self.start) < n + len(found):
            more = np.zeros(n // 4 + len(found), np.int32)
            self.start, self.count = np.concatenate([self.start[:n], more]), np.concatenate([self.count[:n], more])
        if len(self.pool) < self.used + total:
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 4 + total, self.pool.dtype)])
        self.count[n : n + len(found)] = counts
        self.start[n : n + len(found)] = self.used + np.cumsum(counts) - counts
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(found)
        self.used += total
        self.size += len(found)
        self.recent.update(zip(hashes.tolist(), range(n, n + len(found))))
        if len(self.recent) > RECENT_WORDS:
            self._merge()

    def encode(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk end to end, and the n + 1 offsets of its documents in them.

        Texts that hold the string of a special token, in whatever case, go to the tokenizer whole: it finds such strings
        before it folds case or cuts words.
        """
        self.used_at = time.monotonic()
        if not self.by_words:
            body, cuts = chunk.data.tobytes(), chunk.offsets.tolist()
            found = self._ids([body[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])])
            return np.concatenate(found), np.r_[0, np.cumsum([len(x) for x in found])]
        data = K._LOWER[chunk.data]
        hits = np.array([m.start() for m in self.special.finditer(data)] if self.special else [], np.int64)
        whole = np.unique(np.searchsorted(chunk.offsets, hits, side="right") - 1)
        if not len(whole):
            return self._by_words(K.Chunk(chunk.first, data, chunk.offsets))
        parts, at = [], 0
        for d in [*whole.tolist(), len(chunk.offsets) - 1]:
            lo, hi = chunk.offsets[at], chunk.offsets[d]
            parts.append(self._by_words(K.Chunk(chunk.first, data[lo:hi], chunk.offsets[at : d + 1] - lo)))
            if d < len(chunk.offsets) - 1:
                (ids,) = self._ids([chunk.data[hi : chunk.offsets[d + 1]].tobytes().decode()])
                parts.append((ids, np.array([0, len(ids)])))
            at = d + 1
        counts = np.concatenate([np.diff(offsets) for _, offsets in parts])
        return np.concatenate([ids for ids, _ in parts]), np.r_[0, np.cumsum(counts)]

    def _by_words(self, chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of folded texts without strings of special tokens."""
        data = chunk.data
        w = K.words(chunk)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(chunk.offsets), np.int64)
        last = w.end - 1
        trim = _TRIM[data[last]] & (w.end - w.start > 1)
        trim[trim] = _LETTER[data[last[trim] - 1]]
        end = w.end - trim
        distinct, at, codes = np.unique(K.span_hash(data, w.start, end), return_index=True, return_inverse=True)
        if self.size > MAX_WORDS:
            self._clear()
        rows = self._find(distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            body = data.tobytes()
            self._learn(distinct[new], [body[w.start[k] : end[k]] for k in at[new]])
            rows[new] = np.arange(self.size - len(new), self.size)
        rows = rows[codes]
        counts = self.count[rows].astype(np.int64)
        ends = np.cumsum(counts + trim)
        ids = np.empty(int(ends[-1]), np.uint32)
        begin = ends - trim - counts
        ids[K.ragged(begin, counts)] = self.pool[K.ragged(self.start[rows].astype(np.int64), counts)]
        mark = np.where(data[last[trim]] == ord("."), self.mark["."][0], self.mark[","][0])
        ids[ends[trim] - 1] = mark
        return ids, np.r_[0, ends][w.bounds]
