"""Pieces against the tokenizer, sequences against their limit and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codesift.llm import bin_slack as bs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def encoded(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def pieces_of(ids, limit):
    first = (len(ids) - 1) % limit + 1
    cuts = [0, *range(first, len(ids) + 1, limit)]
    return [(a, ids[a:b]) for a, b in zip(cuts, cuts[1:])]


def check_sequences(rows, limit):
    """Gapless, within the limit; returns their number."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(held)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bs.op13_minimum_bin_slack(spark, SF).collect()
    want = {(d, i): (a, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            for d, t in texts.items() for i, (a, ids) in enumerate(pieces_of(encoded(t), 2048))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    total = sum(n for _, n, _ in want.values())
    assert check_sequences(rows, 2048) <= -(-total // 2048) + 1


def test_fullest_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(400):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        capacity = rng.randrange(0, 60)
        chosen = bs.fullest(counts, capacity)
        assert all(0 < n <= counts[k] for k, n in chosen)
        items = [k for k, n in counts.items() for _ in range(n)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in chosen) == max(s for s in sums if s <= capacity)


def test_patterns_are_those_of_one_bin_at_a_time():
    rng = random.Random(6)
    for _ in range(60):
        counts = {rng.randrange(1, 65): rng.randrange(1, 200) for _ in range(rng.randrange(1, 12))}
        found = bs.patterns(counts, 64)
        placed, left = Counter(), Counter(counts)
        for times, items in found:
            for k, n in items:
                placed[k] += n * times
            for _ in range(times):
                # The fullest combination beside the longest piece, each time anew.
                longest = max(k for k, n in left.items() if n)
                left[longest] -= 1
                best = sum(k * n for k, n in bs.fullest({k: n for k, n in left.items() if n}, 64 - longest))
                assert sum(k * n for k, n in items) == longest + best
                left[longest] += 1
                left -= Counter(dict(items))
        assert placed == Counter(counts) and len(found) <= 64


def test_both_ways_to_encode_agree(spark):
    vocabulary = open(PATH).read()
    fast, slow = bs.Encoder(vocabulary), bs.Encoder(vocabulary)
    assert fast.fast is not None
    slow.fast, slow.tokenizer = None, Tokenizer.from_file(PATH)
    slow.tokenizer.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    texts += ["<|endoftext|>a", "\u200b \ufeff\x00", "I'm we'LL 's", "١٢٣ ½ Ⅷ ²", "a\r\n\r\n b  \n", "日本語 テキスト", "👩‍👩‍👧 é e\u0301"]
    for t in texts:
        assert fast(t) == slow(t), t[:80]
    # A vocabulary of another kind goes to the library itself.
    other = open(public_tokenizers.path("word_bpe_49k.json")).read()
    assert bs.Encoder(other).fast is None
    t = Tokenizer.from_str(other)
    t.encode_special_tokens = True
    assert list(np.frombuffer(bs.Encoder(other)("Some Words, here"), "<u4")) == t.encode("Some Words, here", add_special_tokens=False).ids


def test_slices_join_to_the_whole():
    rng = random.Random(7)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", ".", "'s", "1", "ä", "　", "!?", "<|endoftext|>"]
    vocabulary = open(PATH).read()
    encode = bs.Encoder(vocabulary)
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200)))
        assert list(np.frombuffer(encode(text), "<u4")) == encoded(text)[:-1]
        parts = list(bs.slices(text, 10))
        assert "".join(parts) == text
        assert [x for p in parts for x in encoded(p)[:-1]] == encoded(text)[:-1]


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (None, "a b"), (4, "word " * 30_000), (5, "same text"), (5, "same text"), (6, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, 0, 1, 2) for i, t in texts], "doc_id long, text string, length int, _k int, ids int")
    pieces = bs.token_pieces(docs, PATH, 64)
    assert pieces.count() == sum(len(pieces_of(encoded(t), 64)) for _, t in texts)
    rows = bs.placed(pieces, 64)
    kept = rows.collect()
    check_sequences(kept, 64)
    assert all(len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= 64 for r in kept)
    assert [r["piece"] for r in kept if r["doc_id"] == 1] == [0]
    # Sequences hold the ids of their pieces, and documents come back whole.
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in bs.sequences(rows).collect()}
    for r in kept:
        assert joined[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    back = b"".join(bytes(r["ids"]) for r in sorted((r for r in kept if r["doc_id"] == 4), key=lambda r: r["piece"]))
    assert list(np.frombuffer(back, "<u4")) == encoded("word " * 30_000)
    assert bs.placed(bs.token_pieces(docs.where("false"), PATH, 64), 64).count() == 0


def test_one_row_many_times(spark):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one hot row of the table").alias("text"))
    rows = bs.placed(bs.token_pieces(docs, PATH, 2048))
    n = rows.agg(F.count("*").alias("n"), F.countDistinct("sequence_id").alias("s"), F.countDistinct("sequence_id", "offset").alias("d"), F.first("length").alias("length")).first()
    assert n["n"] == n["d"] == 100_000 and n["s"] == -(-100_000 // (2048 // n["length"]))
