"""Token ids of whole texts by the tokenizers library, with each distinct chunk of a text encoded once.

The library first cuts a text at the added tokens of its vocabulary (such as an end-of-text mark) wherever their strings
occur, and encodes what lies between on its own; so do `segments`. Both vocabularies then split a segment into pre-tokens that
never cross certain spaces, so the ids of a segment are the ids of its chunks put together:

* word ends (`joined=False`): white space is dropped, so any space or line feed is a border;
* byte level (`joined=True`): a pre-token takes a single space before its word along, so a border lies before a space.
  A space between two white-space characters (or at the end after one) is part of a longer run;
  in segments with such runs only a space after another character is a border.

Encoding a distinct chunk once per worker saves most of the time: BPE ran at 1.2 MB a second on whole texts.
The memory of chunks is bounded and only saves work. Chunks that are met for the first time go to the library a few hundred at once, as one text, without
the places that it can give for each token, which cost it a third of its time. The numbers of bytes that the tokens stand for then tell the chunks apart.
This is for chunks of Latin letters, digits and signs alone, whose bytes no normalizer changes in number; a text whose tokens don't end where its chunks do,
and all other chunks, go the longer way.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: Chunks remembered by one worker.
MEMO = 1_000_000
#: Chunks put together as one text.
TOGETHER = 300
#: Chunks without white space, of characters that lower case and composition keep at as many bytes.
PLAIN = re.compile(r"[!-~\u00A1-\u012F\u0131-\u017F]+")
#: Characters of text encoded together.
SLICE_CHARS = 1_000_000
RUN = re.compile(r" (?=\s|\Z)(?<=\s )")  # starts with the space, which regular expressions find fastest
BORDER = re.compile(r"(?<=\S)(?= )")


class ChunkEncoder:
    def __init__(self, path: str, joined: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized or re.search(r"\s", t.content) for t in added):
            raise ValueError("an added token of this vocabulary reaches beyond its own characters")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.joined, self.limit = joined, memo
        self.memo: dict = {}
        end, names = getattr(self.tokenizer.model, "end_of_word_suffix", None) or "", self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(names.values(), default=0) + 1, np.int64)  # of a token, whose characters stand for a byte each
        for name, i in names.items():
            self.n_bytes[i] = len(name.removesuffix(end))

    def chunks(self, text: str) -> list:
        """Keys of the memory: a chunk after a space as str, other chunks as 1-tuples."""
        if self.added is None or not self.added.search(text):
            return self.segment(text)
        return [c for part in self.added.split(text) for c in ([(part,)] if self.added.fullmatch(part) else self.segment(part))]

    def segment(self, text: str) -> list:
        """The chunks of a text without added tokens."""
        if not self.joined:
            return text.replace("\n", " ").split(" ")
        if RUN.search(text):
            return [(c,) for c in BORDER.split(text)]
        parts = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    def learn(self, keys: list) -> None:
        plain, others = [], []
        for k in keys:
            (plain if isinstance(k, str) and PLAIN.fullmatch(k) else others).append(k)
        for i in range(0, len(plain), TOGETHER):
            others += self.learn_plain(plain[i : i + TOGETHER])
        texts = [k[0] if isinstance(k, tuple) else " " + k if self.joined else k for k in others]
        for i in range(0, len(others), 1000):
            some = texts[i : i + 1000]  # as words of one input, which costs half of as many inputs
            got = self.tokenizer.encode_batch([some], is_pretokenized=True, add_special_tokens=False)[0]
            cuts = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            ids = array("I", got.ids).tobytes()
            self.memo.update((k, ids[4 * a : 4 * b]) for k, a, b in zip(others[i : i + 1000], cuts, cuts[1:], strict=False))

    def learn_plain(self, keys: list[str]) -> list[str]:
        """Learns chunks without white space as one text; gives them back where the bytes of its tokens don't tell them apart."""
        got = self.tokenizer.encode_batch_fast([" " + " ".join(keys) if self.joined else " ".join(keys)], add_special_tokens=False)[0]
        ids = np.array(got.ids, np.uint32)
        ends = np.cumsum(self.n_bytes[ids])
        wanted = np.cumsum([len(k.encode()) for k in keys]) + (np.arange(1, len(keys) + 1) if self.joined else 0)
        cuts = np.searchsorted(ends, wanted, side="right")
        if not len(ends) or ends[-1] != wanted[-1] or not cuts.all() or (ends[cuts - 1] != wanted).any():
            return keys
        data, cuts = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
        self.memo.update((k, data[a:b]) for k, a, b in zip(keys, [0, *cuts], cuts, strict=False))
        return []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [self.chunks(t) for t in texts]
        wanted = set().union(*parts)
        if len(self.memo) + len(wanted) > self.limit:  # what came first is mostly what comes often
            self.memo = dict(islice(self.memo.items(), self.limit // 2))
        self.learn(list(wanted.difference(self.memo)))
        get = self.memo.__getitem__
        return [b"".join(map(get, p)) for p in parts]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, joined: bool) -> ChunkEncoder:
    """One encoder for all tasks of a worker."""
    if (path, joined) not in _encoders:
        _encoders[path, joined] = ChunkEncoder(path, joined)
    return _encoders[path, joined]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with about `chars` characters each, and their texts (null: empty)."""
    for batch in batches:
        start, held, texts = 0, 0, []
        for i, value in enumerate(batch.column(text)):
            texts.append(value.as_py() or "")
            held += len(texts[-1])
            if held >= chars or len(texts) >= 2000:
                yield batch.slice(start, i + 1 - start), texts
                start, held, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start), texts
