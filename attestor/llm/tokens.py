"""Whole-text encoding with a public tokenizer file, with a memo for repeated words.

Both kinds of vocabulary used here cut every text at a space that follows a character which is not
white space, so a text is the sequence of its chunks between spaces and the ids of a chunk do not
depend on its neighbours; nor do those of ASCII punctuation after letters.  Arrow cuts and numbers the
chunks of a batch, and numpy puts their ids in place.  Distinct chunks that the memo lacks are encoded together, as pretokenized words; words of Latin letters go to the file's BPE model
directly, as nothing is left to normalize or to cut in them.  Texts for which this does not hold
(special-token strings; in byte-level files white space before a space) are encoded whole.
"""

from __future__ import annotations

import gc
import os
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from attestor.functions.shipping import kept

#: Chunks that one Python worker remembers, and the longest of them in characters.
MEMO_CHUNKS, MEMO_CHARS = 900_000, 48
#: Chunks that are encoded together; bytes of text that a caller had best pass at once.
TOGETHER, BATCH_BYTES = 1024, 10 << 20
#: Letters before this one need no normalization but lower case.
LATIN_END = "\u0130"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)`` gives the ids of every text as an array of little-endian unsigned 16 bit."""

    def __init__(self, path: str, most_chunks: int = MEMO_CHUNKS):
        self.most_chunks = most_chunks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.byte_level = str(self.tokenizer.pre_tokenizer).startswith("ByteLevel")
        self.lead = " " if self.byte_level else ""
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tails: dict[str, bytes] = {}
        self.bare, self.letters = Tokenizer(self.tokenizer.model), byte_letters()
        self.border = np.zeros(1 << 16, bool)  # ids that begin a word with its space, or that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.startswith(self.letters[32]) if self.byte_level else token.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def apart(self, chunk: str) -> bool:
        """Whether a text with this chunk may be cut at spaces."""
        if self.byte_level and (not chunk or chunk[-1].isspace()):
            return False
        return not ("<" in chunk and any(m in chunk for m in self.marks))

    def learn(self, chunks: list[str], lead: str) -> dict[str, bytes]:
        """Ids of each chunk by itself."""
        found: dict[str, bytes] = {}
        for first in range(0, len(chunks), TOGETHER):
            some = chunks[first : first + TOGETHER]
            coded = self.tokenizer.encode([lead + c for c in some], is_pretokenized=True, add_special_tokens=False)
            words = np.array(coded.word_ids, np.int64)
            cuts = (2 * np.searchsorted(words, np.arange(len(some) + 1))).tolist()
            buffer = np.array(coded.ids, "<u2").tobytes()
            found.update(zip(some, map(buffer.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
        return found

    def learn_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of Latin letters (with a space before, in byte-level files)."""
        found: dict[str, bytes] = {}
        for first in range(0, len(words), TOGETHER):
            some = words[first : first + TOGETHER]
            found.update(zip(some, self.letters_only(some), strict=True))
        return found

    def letters_only(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters (with a space before, in byte-level files)."""
        text = "\n".join([self.lead + w for w in words] if self.lead else words)
        text = text if self.byte_level else text.lower()
        mapped = text.encode().decode("latin-1").translate(self.letters).split(self.letters[10])
        (coded,) = self.bare.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, "<u2")
        at = np.flatnonzero(self.border[ids])
        cuts = [*(2 * at).tolist(), 2 * len(ids)] if self.byte_level else [0, *(2 * at + 2).tolist()]
        buffer = ids.tobytes()
        return list(map(buffer.__getitem__, map(slice, cuts, cuts[1:])))

    def fill(self, wanted: list[str]) -> tuple[dict[str, bytes], set[str]]:
        """Ids of chunks that the memo lacks, the punctuation after a word encoded by itself; and chunks that forbid cutting."""
        memo, tails = self.memo, self.tails
        words, ended, others, odd = [], [], [], set()
        for c in wanted:
            base = c if c.isalpha() else c.rstrip(punctuation)
            if not base.isalpha() or len(c) > MEMO_CHARS or not base.isascii() and max(base) >= LATIN_END:
                (others.append if self.apart(c) else odd.add)(c)
            elif base is c:
                words.append(c)
            else:
                ended.append((c, base))
        found = self.learn_words(words)
        found.update(self.learn_words(list({base for _, base in ended if base not in found and base not in memo})))
        for c, base in ended:
            tail = c[len(base) :]
            if tail not in tails:
                if len(tails) > 10_000:
                    tails.clear()
                tails[tail] = self.whole(tail)
            found[c] = (found.get(base) or memo[base]) + tails[tail]
        found.update(self.learn(others, self.lead))
        if len(memo) > self.most_chunks:
            memo.clear()
        memo.update(found)
        for c in [c for c in others if len(c) > MEMO_CHARS]:
            del memo[c]
        return found, odd

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array without nulls."""
        if not len(texts):
            return []
        gc.disable()  # very many strings and no cycles are made here
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.dictionary_encode()
        place, names = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()
        coded = list(map(self.memo.get, names))
        gaps = [i for i, ids in enumerate(coded) if ids is None]
        found, odd = self.fill([names[i] for i in gaps])
        for i in gaps:
            coded[i] = found.get(names[i], b"")
        apart = np.ones(len(texts), bool)
        firsts = bounds[:-1]
        if odd:
            bad = np.isin(place, [i for i in gaps if names[i] in odd])
            if self.byte_level:
                bad[firsts] = False
            apart[np.searchsorted(bounds, np.flatnonzero(bad), side="right") - 1] = False
        if self.byte_level:  # the first chunk has no space before it
            heads = [names[i] for i in place[firsts].tolist()]
            first = self.learn(list({h for h in heads if h and self.apart(h)}), "") | {"": b""}
            number = {h: len(coded) + i for i, h in enumerate(first)}
            coded += first.values()
            place[firsts] = [number.get(h, 0) for h in heads]
            apart &= [h in first for h in heads]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        starts, length = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.cumsum(length)
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64
        ids = np.frombuffer(b"".join(coded), "<u2")[np.arange(ends[-1], dtype=kind) + np.repeat((starts[place] - ends + length).astype(kind), length)]
        cuts = np.concatenate(([0], ends))[bounds].tolist()
        return [ids[a:b] if cut else np.frombuffer(self.whole(text.as_py()), "<u2") for a, b, cut, text in zip(cuts[:-1], cuts[1:], apart.tolist(), texts, strict=True)]


@kept
def encoder(path: str, most_chunks: int = MEMO_CHUNKS) -> Encoder:
    """One encoder a Python worker, for as long as its tasks are of one function."""
    return Encoder(path, most_chunks)
