"""Packing and token ids against the tokenizer and brute-force rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarterline.llm.packing import pack, pack_documents, plan
from quarterline.llm.queries import tokenizer_path
from quarterline.llm.tokens import documents_ids


def fill(counts, capacity):
    """Bins of (place, length) that the plan describes; checks that every rank is placed once."""
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, past, number, per_bin, place in plan(counts, capacity):
        ranks[length] += range(first, past)
        for k in range(past - first):
            bins[number + k // per_bin].append((place + k % per_bin * length, length))
    assert all(sorted(ranks[length]) == list(range(count)) for length, count in counts.items())
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    counts = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    bins = fill(counts, capacity)
    for content in bins.values():
        at = 0
        for place, length in sorted(content):
            assert place == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in content) <= 2
    total = sum(length * count for length, count in counts.items())
    large = [length for length in counts for _ in range(counts[length]) if 3 * length > capacity]
    # first bins of the large, and hardly any room lost besides
    assert len(bins) <= max(len(large), 1.25 * total / capacity + 2)


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    signs = "abcXYZ'stremdl0123456789 \t\n\x0b\x0c\r\x1c\x85 éÉßſİıŒœ×÷µªº٣你好ΣσςǅÅé<|endoftext|>#$%&*.,!?-_​😀ŉ"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(4000)]
    texts += [None, "", "it's you'RE we'll ('s '' don't <|endoftext|>x", "long " * 30000]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for text, ids in zip(texts, documents_ids(texts, tokenizer_path())):
        assert list(ids) == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_round_trip_of_documents(documents, small):
    from tokenizers import Tokenizer

    rows = small + [(10 ** 6, None), (10 ** 6 + 1, ""), (10 ** 6 + 2, "word " * 9000)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = pack_documents(documents(rows), tokenizer_path(), with_ids=True).collect()
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        pieces[r["doc_id"]][r["piece"]] = (r["start"], r["ids"])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = pieces[doc_id]
        assert [x for k in sorted(own) for x in own[k][1]] == ids
        assert all(own[k][0] == 2048 * k for k in own) and all(len(own[k][1]) == 2048 for k in range(len(own) - 1))
    for content in sequences.values():
        at = 0
        for place, length in sorted(content):
            assert place == at
            at += length
        assert at <= 2048


def test_repeated_rows_and_empty_table(spark, documents):
    pieces = spark.createDataFrame([(1, 0, 700)] * 7 + [(None, 0, 2048)], "doc_id long, piece int, length long")
    places = [(r["sequence_id"], r["offset"]) for r in pack(pieces).collect()]
    assert len(set(places)) == 8 and len({s for s, _ in places}) == 5
    assert pack_documents(documents([]), tokenizer_path()).collect() == []
