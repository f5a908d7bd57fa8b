import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom.llm import byte_bpe, packing, piece_counts

from .conftest import rows_of

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(JSON)
PIECE_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_round_trip_of_odd_documents(odd):
    got = Counter(tuple(r) for r in byte_bpe.round_trip(odd, JSON).collect())
    want = Counter()
    for i, t in rows_of(odd):
        ids = ids_of(t)
        want[i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_token_counts_of_odd_documents(odd):
    got = Counter(tuple(r) for r in piece_counts.token_counts(odd, PIECES).collect())
    want = Counter()
    for i, t in rows_of(odd):
        n = len(PIECE_LIBRARY.encode(t or "", num_threads=1))
        want[i, len((t or "").encode()), n, n > 4096] += 1
    assert got == want


def test_empty_tables(no_documents):
    assert byte_bpe.round_trip(no_documents, JSON).count() == 0
    assert piece_counts.token_counts(no_documents, PIECES).count() == 0
    assert packing.pack(no_documents, RANKS).count() == 0


def test_encode_and_decode_tables(odd):
    texts = {r["text"] for r in byte_bpe.decode(byte_bpe.encode(odd, JSON), JSON).collect()}
    assert texts == {t or "" for _, t in rows_of(odd)}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abthe  \n'sé日😀1<|endofxt>▁"), max_size=80))
def test_any_text(text):
    assert byte_bpe.coder(JSON).encode(text) == ids_of(text)
    assert byte_bpe.coder(JSON).decode(ids_of(text)) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)
    assert piece_counts.counter(PIECES).counts([text]) == [len(PIECE_LIBRARY.encode(text, num_threads=1))]


def test_transducer_holds_a_bounded_number_of_bytes():
    r, m = random.Random(3), byte_bpe.coder(JSON).merges
    for letters in ("etaoinshr", "ab", "a"):
        word = "".join(r.choice(letters) for _ in range(6000))
        t, out, held = byte_bpe.Transducer(m), [], 0
        for k in range(0, len(word), 7):
            out += t.push(word[k : k + 7].encode())
            held = max(held, len(t.held))
        assert out + list(t.flush()) == ids_of(word)
        assert held <= t.window


def test_decoding_of_ids_that_are_no_text():
    r, c = random.Random(4), byte_bpe.coder(JSON)
    for _ in range(200):
        ids = [r.randrange(50257) for _ in range(r.randrange(1, 9))] + [r.randrange(94, 256)]
        assert c.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_pieces_of_odd_documents(odd):
    got = [r.asDict() for r in packing.pack(odd, RANKS).collect()]
    seen = Counter()
    for i, t in rows_of(odd):
        ids = [*ids_of(t), 0]
        short = (len(ids) - 1) % 2048 + 1
        begin = 0
        for k, end in enumerate(range(short, len(ids) + 1, 2048)):
            seen[i, k, begin, end - begin, zlib.crc32(np.array(ids[begin:end], "<u4").tobytes())] += 1
            begin = end
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == seen
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 2048
    # small documents fill what large ones leave
    assert len(places) <= 1.1 * sum(r["length"] for r in got) / 2048 + 1


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    counts = {n: r.randrange(1, 12) for n in r.sample(range(1, 101), r.randrange(1, 60))}
    base, places = packing.best_fit(dict(counts), 100)
    gaps = {}
    for rank, n, first, offset in places.tolist():
        length = next(k for k in counts if base[k] <= rank < base[k] + counts[k])
        for k in range(n):
            assert offset == 100 - gaps.get(first + k, 100)
            gaps[first + k] = 100 - offset - length
            assert gaps[first + k] >= 0
    assert places[:, 1].sum() == sum(counts.values())
    plain = []  # one document after another
    for length in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((g for g in plain if g >= length), default=None)
        if fit is None:
            plain.append(100 - length)
        else:
            plain[plain.index(fit)] -= length
    assert sorted(plain) == sorted(gaps.values())
