"""Base spans against the plain regexes; labelers, EM and odd rows."""

import random
import re
import time

import numpy as np
from conftest import SF

from codesift.llm import personal_data as pd_

PLAIN = [
    (0, re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    (1, re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    (2, re.compile(r"[0-9]([\x20-]?[0-9])+")),
    (3, re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def brute(text):
    out = []
    for kind, pattern in PLAIN:
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pd_.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append(pd_.Span(m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_of_random_texts():
    rng = random.Random(11)
    pieces = ["a", "b.c", "@", ".", "-", "+", "1", "12", "255", "256", "001", " ", "(", ")", "é", "4111111111111111", "x@y.z", "%", "+1 (555) 010-9999", "10.0.0.1"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert pd_.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    start = time.perf_counter()
    for text in ["1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "1." * 150_000, "+" * 200_000, "+1" + " " * 200_000, "1 " * 150_000]:
        pd_.candidates(text, pd_.base_spans(text))
    assert time.perf_counter() - start < 20


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pd_.op10_weak_supervision_pii(spark, SF).collect()
    assert len(rows) == len(docs)
    import hashlib

    for r in rows:
        base = brute(docs[r["doc_id"]])
        text = ",".join(f"{pd_.KINDS[s.kind]}:{s.start}:{s.end}" for s in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pd_.BASE_KINDS] == [sum(s.kind == i for s in base) for i in range(4)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_estimation_finds_a_bad_labeler():
    """One labeler votes at random, four are right nine times in ten."""
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(4000):
        truth = 1 if rng.random() < 0.4 else -1
        said = tuple([truth if rng.random() < 0.9 else -truth for _ in range(4)] + [int(rng.choice([-1, 1]))])
        counts[said] = counts.get(said, 0) + 1
    model = pd_.estimate([(0, list(v), n) for v, n in counts.items()])
    right = model.given[1, :, 2]
    assert all(abs(x - 0.9) < 0.05 for x in right[:4]) and abs(right[4] - 0.5) < 0.06
    assert abs(model.prior[0] - 0.4) < 0.05


def test_added_spans(spark):
    rows = [(k, f'word token = "{random.Random(k).getrandbits(160):040x}" ends. Dr. Maria Lopez called 555-123-{1000 + k}. Mail me: jo [at] mail [dot] com') for k in range(40)]
    rows += [(100 + k, f"see version {k}.1 of page {k}") for k in range(20)]
    got = {r["doc_id"]: r["spans"] for r in pd_.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows[:40]:
        at = text.index('"') + 1
        assert f"secret:{at}:{at + 40}" in got[k].split(",")
        assert "mail:" in got[k]
    assert all(got[k] == "" for k, _ in rows[40:])


def test_long_and_overlapping_candidates():
    token = "".join(random.Random(2).choices("abcdefghijklmnop0123456789", k=700))
    assert pd_.Span(6, pd_.KINDS.index("secret"), 706) in pd_.candidates(f"token {token} ends", [])
    # A malformed IBAN and the secret that starts where it does are both scored.
    text = "key DE00AAAABBBBCCCCDDDD ends"
    assert {pd_.KINDS[s.kind] for s in pd_.candidates(text, [])} == {"iban", "secret"}
    assert pd_.without_overlaps([pd_.Span(4, 4, 24), pd_.Span(4, 7, 24), pd_.Span(30, 7, 50)]) == [pd_.Span(4, 4, 24), pd_.Span(30, 7, 50)]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a@b.cd", "x"), (2, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((str(r["doc_id"]), r["n_email"], r["spans"]) for r in pd_.personal_spans(docs).collect())
    assert got == [("1", 0, ""), ("1", 0, ""), ("2", 0, ""), ("None", 1, "email:0:6")]
    assert pd_.personal_spans(docs.where("false")).count() == 0
