import hashlib
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm.bpe import ByteBPE, PerfectHash, bpe_decode, bpe_digests, bpe_encode, load_ranks
from sluice.llm.packing import SHARES, cut_lengths, match_runs, pack_documents, pack_runs, place
from sluice.llm.token_files import BLOCK, Reader, Writer, pack, token_file_round_trip
from sluice.llm.tokens import ChunkEncoder

WORD, BYTE, MULTI = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "a  b", "a \n b\n \nc ", "It's ÉTÉ über\n\nNaïve", "x\t y  z w", "tail \n ", "\n lead", "<|endoftext|> <|startoftext|>x", "日本語 text１２", "a\x1c b \x1f", "ab" * 3000, None, "Of the thing. The thing of\nthe Thing!", "ΣΑΣ ΑΣ. İstanbul", "a\r\n  b   c", "é ́x"]


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_chunks_encode_as_whole_texts():
    for path, joined in ((WORD, False), (BYTE, True)):
        mine, whole = ChunkEncoder(path, joined, memo=20), plain(path)
        for text in TEXTS:
            assert np.frombuffer(mine.encode([text or ""])[0], "<u4").tolist() == whole(text or ""), (path, text)


def test_plain_chunks_are_learned_as_one_text():
    words = ["It's", "ÉTÉ,", "über", "naïve", "</w>", "x</w>y", "'s", "ŸŉĿ", "don't!?", "A1b2", "(a)", "''s", "ab" * 300]
    odd = ["", "\n", "a\n", "日本", "İ", "é\u0301", ("a",), ("<|endoftext|>",), "µ"]
    for path, joined in ((WORD, False), (BYTE, True)):
        mine, whole = ChunkEncoder(path, joined), plain(path)
        assert mine.learn_plain(words) == [] and list(mine.memo) == words  # without the words of each token
        mine.learn(odd)
        for k in [*words, *odd]:
            text = k[0] if isinstance(k, tuple) else " " + k if joined else k
            assert np.frombuffer(mine.memo[k], "<u4").tolist() == whole(text), (path, k)
        mine.n_bytes = mine.n_bytes + 1  # tokens that don't end where the chunks do
        assert mine.learn_plain(["again", "and"]) == ["again", "and"] and "again" not in mine.memo


ADDED = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"]
SPACES = st.lists(st.sampled_from([*" \n\t\r  \x1c\x85abZé1.,'ś", *ADDED]), max_size=30).map("".join)
BYTE_ENCODER, BYTE_PLAIN = ChunkEncoder(BYTE, True), plain(BYTE)
WORD_ENCODER, WORD_PLAIN = ChunkEncoder(WORD, False), plain(WORD)
RANKS = load_ranks(MULTI)
BPE = ByteBPE(RANKS, P.PATTERN, PerfectHash.build(RANKS))
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=600, deadline=None)
@given(SPACES)
def test_any_white_space(text):
    assert np.frombuffer(BYTE_ENCODER.encode([text])[0], "<u4").tolist() == BYTE_PLAIN(text)
    assert np.frombuffer(WORD_ENCODER.encode([text])[0], "<u4").tolist() == WORD_PLAIN(text)
    ids = BPE.encode(text)
    assert ids == TIK.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_matches_tiktoken_on_any_text(text):
    ids = BPE.encode(text)
    assert ids == TIK.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


def test_added_tokens_in_a_text_are_the_librarys():
    word, byte = (np.frombuffer(e.encode(["a <|endoftext|> b"])[0], "<u4").tolist() for e in (WORD_ENCODER, BYTE_ENCODER))
    assert word == [320, 49407, 321] and byte == [64, 220, 50256, 275]


def test_perfect_hash_is_minimal():
    h = PerfectHash.build(RANKS)
    assert sorted(map(h, RANKS)) == list(range(len(RANKS)))


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3 - 5, t, "en") for i, t in enumerate(texts)] + [(None, "no key", None), (1, "again", "x"), (1, "again", "x")], "doc_id long, text string, ids string")


def test_bpe_round_trip(spark):
    docs = frame(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = sorted(((k is None, k), len(ids := TIK.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows)
    got = sorted(((r[0] is None, r[0]), r[1], r[2], r[3]) for r in bpe_digests(docs, vocabulary=MULTI, pattern=P.PATTERN).collect())
    assert got == want
    decoded = bpe_decode(bpe_encode(docs, vocabulary=MULTI, pattern=P.PATTERN), vocabulary=MULTI).collect()
    assert sorted(bytes(r.text) for r in decoded) == sorted(t.encode() for _, t in rows)
    assert bpe_digests(docs.limit(0), vocabulary=MULTI, pattern=P.PATTERN).collect() == []


class Memory:
    def __init__(self):
        self.data, self.at = b"", 0

    def write(self, data):
        self.data += data

    def seek(self, at):
        self.at = at

    def size(self):
        return len(self.data)

    def read(self, n):
        self.at += n
        return self.data[self.at - n : self.at]


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 49408, 5000), np.zeros(300), np.where(rng.random(4000) < 0.01, 2**32 - 1, rng.integers(7, 9, 4000)), np.arange(700), np.zeros(0)):
        ids = ids.astype("<u4")
        sink = Memory()
        writer = Writer(sink)
        cuts = [0, *sorted(rng.integers(0, len(ids) + 1, 9).tolist()), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            writer.add(i, ids[a:b].tobytes())
        writer.close()
        reader = Reader(sink)
        assert reader.n == len(ids) and reader.docs["n"].tolist() == np.diff(cuts).tolist()
        got = list(reader.segments())
        assert np.array_equal(np.concatenate(got) if got else ids[:0], ids)
        for a, b in zip(cuts, cuts[1:]):
            assert np.array_equal(reader.ids(a, b), ids[a:b])
    packed, index = pack(np.tile(np.r_[np.zeros(BLOCK - 1, "<u4"), np.array([2**31], "<u4")], 2))
    assert index["width"].tolist() == [0, 0] and index["exceptions"].tolist() == [1, 1] and [len(p) for p in packed] == [6, 6]


def test_token_files(spark):
    docs, whole = frame(spark, [*TEXTS, "word " * 200_000]), plain(WORD)
    got = token_file_round_trip(docs, vocabulary=WORD, joined=False, end_id=1).collect()
    rows = {}
    for r in docs.collect():
        rows.setdefault(r.doc_id, []).append(np.array([*whole(r.text or ""), 1], "<u4"))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = next(ids for ids in rows[r.doc_id] if (len(ids), zlib.crc32(ids.tobytes())) == (r.n_tokens, r.ids_crc32))
        rows[r.doc_id] = [x for x in rows[r.doc_id] if x is not ids]
        assert r.start == start
        start += len(ids)
    assert not any(rows.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    assert token_file_round_trip(docs.limit(0), vocabulary=WORD, joined=False, end_id=1).collect() == []


def check_packing(pieces, capacity):
    by = {}
    for sequence, offset, length in pieces:
        by.setdefault(sequence, []).append((offset, length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    """One piece at a time; the number of sequences."""
    gaps = []
    for v in sorted(lengths, reverse=True):
        at = bisect_left(gaps, v)
        insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - v)
    return len(gaps)


def test_rounds_pack_like_best_fit(spark):
    rng = random.Random(3)
    for capacity, lengths in (
        (64, [rng.randint(1, 40) for _ in range(3000)]),
        (10, [10] * 5),
    ):
        counts = Counter(lengths)
        plan = pack_runs(spark.createDataFrame(sorted(counts.items()), "length long, n long"), capacity)
        plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
        n = np.array(sorted(lengths))
        rank = np.concatenate([np.arange(counts[v]) for v in sorted(counts)])
        used = check_packing(list(zip(*(a.tolist() for a in (*place(plan, capacity, n, rank), n)))), capacity)
        assert used <= 1.005 * best_fit_decreasing(lengths, capacity) + 1
    assert len(pack_runs(spark.createDataFrame([], "length long, n long"), 9)) == 0


def test_ranges_match_by_themselves(spark):
    """No range places more than its own sizes, most ranges place pieces at once, and the sequences are as many as one by one."""
    rng = random.Random(4)
    for lengths in ([rng.randint(1, 2048) for _ in range(20_000)], [min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(20_000)]):
        steps = match_runs(spark.createDataFrame(sorted(Counter(lengths).items()), "length long, n long"), 2048)
        placed, by_step, used = Counter(), [], set()
        for step in steps:
            plan = step.where("kind = 'plan'").collect()
            by_step.append({r["at"] for r in plan})
            for r in plan:
                placed[r["at"]] += r["n"]
                assert r["at"] == sum(r["length"] * share <= 2048 for share in SHARES)
                used.update(range(r["first"], r["first"] - (-r["n"] // r["fit"])))
        assert sum(placed.values()) == len(lengths) and max(placed.values()) < 0.6 * len(lengths) and len(placed) == 7
        assert max(map(len, by_step)) >= 4 and len(steps) < 40
        assert len(used) <= 1.005 * best_fit_decreasing(lengths, 2048)


def test_pack_documents(spark):
    rng = random.Random(1)
    docs, whole = frame(spark, [*TEXTS, *(" ".join(rng.choices(["of", "the", "thing", "blé"], k=rng.randint(1, 5000))) for _ in range(60))]), plain(BYTE)
    got = pack_documents(docs, vocabulary=BYTE).collect()
    want = []
    for r in docs.collect():
        ids, start = np.array([*whole(r.text or ""), 0], "<u4"), 0
        for i, n in enumerate(cut_lengths(len(ids), 2048)):
            want.append((r.doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    used = check_packing([(r.sequence_id, r.offset, r.length) for r in got], 2048)
    assert used <= best_fit_decreasing([w[3] for w in want], 2048) + 1
    assert pack_documents(docs.limit(0), vocabulary=BYTE).collect() == []
