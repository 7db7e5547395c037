"""Fingerprints against a plain computation of bands, parts and neighbours."""

import hashlib
import re

import xxhash

from quarterline.llm import fingerprints as f


def term(word):
    return xxhash.xxh64_intdigest(word.encode(), seed=42)


def terms(text):
    return {term(w) for w in re.split(r"[^\w]+|_", (text or "").lower()) if w}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def parts(text, table):
    own = [h for h in terms(text) if table[h & (f.BUCKETS - 1)]]
    found, shift = [], 20
    for level in range(f.LEVELS):
        for number in range(f.SUBSETS):
            inside = sorted(signed(h) for h in own if h >> shift & 15 == number)
            seed = 42
            for h in inside:
                seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), seed=seed)
            found.append(f"{seed:016x}"[-6:] if inside else "")
        own = [h for h in own if h >> (shift + 4) & 7 == 0]
        shift += 7
    return found


def likeness(a, b):
    if a == b:
        return 1.0
    filled = same = 0
    for level in range(f.LEVELS):
        pairs = list(zip(a, b))[level * f.SUBSETS: (level + 1) * f.SUBSETS]
        some = [p for p in pairs if p != ("", "")]
        if level == f.LEVELS - 1 or len(some) < f.SUBSETS:
            filled += len(some)
            same += sum(x == y for x, y in some)
    return same / filled if filled else 0.0


def check(df, rows):
    table = f.lexicon(df)
    total = len(rows)
    frequency = {}
    for _, text in rows:
        for h in terms(text):
            frequency[h] = frequency.get(h, 0) + 1
    wanted = bytearray(f.BUCKETS)
    for h, n in frequency.items():
        if max(2, f.LOW * total) <= n <= f.HIGH * total:
            wanted[h & (f.BUCKETS - 1)] = 1
    assert table == bytes(wanted)
    got = {r["doc_id"]: r for r in f.fingerprints(df, table).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        row, own = got[doc_id], parts(text, table)
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == "".join(p.ljust(6, "-") for p in own)
        assert abs(row["near_edited"] - likeness(own, parts(edited, table))) < 1e-12
        assert abs(row["near_next"] - likeness(own, parts(following, table))) < 1e-12


def test_given_documents(documents, small):
    check(documents(small), small)


def test_edge_texts_and_sparse_ids(documents):
    rows = [(10 ** 15, None), (-5, ""), (7, "é"), (8, "word " * 20000), (9, "a b c d e f"), (10 ** 12, "a b c x y"), (3, "a b"), (4, "ü" * 7)]
    check(documents(rows), rows)


def test_one_row_repeated_rows_and_none(documents):
    one = f.fingerprints(documents([(1, "abc def")])).collect()
    assert [r["near_next"] for r in one] == [1.0]
    same = f.fingerprints(documents([(1, "abc def")] * 3 + [(None, "x")])).collect()
    assert len(same) == 4
    assert f.fingerprints(documents([])).collect() == []


def test_texts_without_lexicon_terms_are_alike_only_if_their_terms_are(documents):
    rows = [(6, "rare words here"), (5, "none of those there"), (4, "There of those, none"), (3, ""), (2, None), (1, "!")]
    df = documents(rows)
    got = {r["doc_id"]: r for r in f.fingerprints(df, bytes(f.BUCKETS), own_terms=True).collect()}
    marks = [got[i]["fingerprint"] for i in (6, 5, 4, 3, 2, 1)]
    assert marks[1] == marks[2] and marks[3] == marks[4] == marks[5] and len(set(marks)) == 3
    assert [got[i]["near_next"] == 1.0 for i in (6, 5, 4, 3, 2, 1)] == [False, True, False, True, True, False]
    table = f.lexicon(df)
    assert [r["fingerprint"] for r in f.fingerprints(df, table, own_terms=True).orderBy("doc_id").collect()] != [
        r["fingerprint"] for r in f.fingerprints(df, table).orderBy("doc_id").collect()]
