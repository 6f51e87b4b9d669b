"""Personal data by weak supervision.

Four base kinds are found by exact rules.  Beyond them, candidates of further
kinds (secrets, IBANs, social security numbers, national telephone numbers,
spelt-out mail addresses, names after a title) and of the base kinds get votes
of five labelers: shape (regex), checksum, gazetteer, context words and
variety of characters.  A vote is 1, -1 or 0 for none.  Expectation-maximisation
over the counts of all vote patterns of the corpus estimates how reliable each
labeler is and how likely each pattern is to be personal data.  With these
probabilities as soft labels a span classifier is trained on a bounded sample
of candidates (``SAMPLE``), on their kind, shape and neighbouring words.
Candidates it scores at 0.5 or more are added; base spans always stay.

Positions are code points, ends exclusive.  Defined cases: a null text is an
empty text without spans; repeated rows are read each; very long runs of
digits or letters are read in linear time; a table without candidates adds
nothing; further columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from codesift.llm.common import table
from codesift.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 20_000
BITS = 14
ROUNDS = 200
SEED = 17

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "mail", "name", "secret", "ssn", "tel")
KINDS = BASE_KINDS + MORE_KINDS


class Span(NamedTuple):
    start: int
    kind: int
    end: int


# --- base kinds -------------------------------------------------------------------

_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits begins: what follows the run is
# the same from any place in it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _local_part(text: str, end: int, at: int) -> int:
    """Length of the local part before the sign at ``at``, read backwards in
    growing pieces and not beyond ``end``."""
    size = 64
    while True:
        piece = text[max(end, at - size):at][::-1]
        length = _LOCAL_BACK.match(piece).end()
        if length < len(piece) or at - size <= end:
            return length
        size *= 4


def emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at - _local_part(text, end, at)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(Span(start, 0, domain.end()))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, in order of start and kind."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(Span(m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(Span(m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append(Span(m.start(), 3, m.end()))
    return sorted(out)


# --- candidates of further kinds -----------------------------------------------------

_MORE = [
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+=*+(?![A-Za-z0-9_+/=-])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("tel", re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")),
]
_MAIL = re.compile(
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}"
    r"(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]{1,63}){1,4}")
_TITLES = ("Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Mme ", "Señor ", "Señora ")
_NAME = re.compile(r"(?<!\w)(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Mme|Señora|Señor)\x20((?:[A-ZÀ-Þ][a-zß-ÿ]{2,20})(?:\x20[A-ZÀ-Þ][a-zß-ÿ]{2,20}){0,2})")

# Given names of the name gazetteer.
_GIVEN = frozenset("""anna anne barbara carlos carmen charles david elena elizabeth emma francois hans heinrich helga ines
james jean jennifer john jose josé juan jürgen karl klaus laura linda lucia luis maria marie mark martin mary michael
miguel monika nicole patricia paul peter petra philippe pierre richard robert sabine sara sophie stefan susan thomas
ursula ute william wolfgang""".split())
# Top-level domains of the mail gazetteer.
_DOMAINS = frozenset("at be biz ca ch com de edu es eu fr gov info io it net nl org uk us".split())
# Words before a span that speak for personal data, and against.
_FOR = frozenset("""account api apikey auth bank bearer call card cell contact credential credit cell e-mail email fax iban
key kennwort konto login mail mobile name passwd passwort password phone pin pwd secret señor ssn social tel telefon
telefono teléfono telephone téléphone token visa correo courriel clave contraseña""".split())
_AGAINST = frozenset("chapter commit edition isbn issn item order page price section seite table version vol volume".split())
_WORD = re.compile(r"\w+")


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans, and spans of further kinds beside them, which may overlap."""
    out = list(base)
    found: list[tuple[str, int, int]] = []
    if _DIGIT.search(text):
        for kind, pattern in _MORE:
            for m in pattern.finditer(text):
                if kind != "secret" or any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                    found.append((kind, m.start(), m.end()))
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        found += [("mail", m.start(), m.end()) for m in _MAIL.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [("name", m.start(1), m.end(1)) for m in _NAME.finditer(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    taken = sorted((s.start, s.end) for s in base)
    at = 0
    for kind, start, end in found:
        # Both lists are in order, so each base span is passed once.
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or end <= taken[at][0]:
            out.append(Span(start, KINDS.index(kind), end))
    return sorted(out)


def without_overlaps(spans: list[Span]) -> list[Span]:
    """Of overlapping spans the one that starts first."""
    out: list[Span] = []
    for s in sorted(spans):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


# --- labelers -----------------------------------------------------------------------


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(text[max(0, start - 48):start])[-4:]]


def _shape(kind: str, s: str) -> int:
    if kind == "secret":
        return 1 if len(s) >= 32 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else 0
    if kind == "name":
        return 1 if " " in s else 0
    if kind == "card":
        return 1 if re.fullmatch(r"[0-9]{14,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", s) else -1
    return 1


def _checksum(kind: str, s: str) -> int:
    if kind == "card":
        return 1 if luhn(_digits(s)) else -1
    if kind == "iban":
        return 1 if _iban_ok(s) else -1
    if kind == "ip":
        return 1 if all(p == "0" or p[0] != "0" for p in s.split(".")) else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    return 0


def _gazetteer(kind: str, s: str) -> int:
    if kind in ("email", "mail"):
        return 1 if re.split(r"[^A-Za-z]+", s.lower().rstrip(")] "))[-1] in _DOMAINS else 0
    if kind == "name":
        return 1 if s.split()[0].lower() in _GIVEN else 0
    if kind == "card":
        return 1 if s[0] in "3456" else -1
    if kind == "secret":
        return 1 if s.startswith(("sk_", "ghp_", "AKIA", "xox", "eyJ")) else 0
    return 0


def _context(before: list[str]) -> int:
    return 1 if any(w in _FOR for w in before) else -1 if any(w in _AGAINST for w in before) else 0


def _variety(kind: str, s: str) -> int:
    if kind == "secret":
        return 1 if _entropy(s) >= 3.0 else -1
    return -1 if len(set(_digits(s))) == 1 else 0 if kind in ("name", "mail", "email") else 1


LABELERS = 5


def votes(text: str, span: Span) -> list[int]:
    kind, s = KINDS[span.kind], text[span.start:span.end]
    return [_shape(kind, s), _checksum(kind, s), _gazetteer(kind, s), _context(_before(text, span.start)), _variety(kind, s)]


def _feature(name: str) -> int:
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1


def features(text: str, span: Span) -> list[int]:
    kind, s = KINDS[span.kind], text[span.start:span.end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s[:64]))))
    after = [w.lower() for w in _WORD.findall(text[span.end:span.end + 32])[:2]]
    names = [f"kind {kind}", f"length {kind} {min(len(s), 64) // 4}", f"shape {kind} {shape[:24]}",
             f"entropy {kind} {int(2 * _entropy(s))}"]
    names += [f"before {w}" for w in _before(text, span.start)] + [f"after {w}" for w in after]
    return sorted({_feature(n) for n in names})


# --- estimation -----------------------------------------------------------------------


class Reliability(NamedTuple):
    prior: np.ndarray   # by kind
    given: np.ndarray   # [class, labeler, vote + 1]

    def posterior(self, kind: int, pattern: list[int]) -> float:
        logs = np.log([1 - self.prior[kind], self.prior[kind]])
        for k, v in enumerate(pattern):
            if v:
                logs = logs + np.log(self.given[:, k, v + 1])
        logs -= logs.max()
        p = np.exp(logs)
        return float(p[1] / p.sum())


def estimate(counts: list[tuple[int, list[int], int]], rounds: int = ROUNDS) -> Reliability:
    """EM over (kind, votes, count).  The start takes each labeler as right
    four times in five; a vote of 0 says nothing."""
    given = np.empty((2, LABELERS, 3))
    given[0, :], given[1, :] = (0.8, 1.0, 0.2), (0.2, 1.0, 0.8)
    prior = np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        model = Reliability(prior, given)
        mass = np.full((2, LABELERS, 3), 1.0)
        mass[0, :, 0] = mass[1, :, 2] = 4.0
        by_kind = np.full((len(KINDS), 2), 1.0)
        for kind, pattern, n in counts:
            p = model.posterior(kind, pattern)
            by_kind[kind] += (n * (1 - p), n * p)
            for k, v in enumerate(pattern):
                mass[0, k, v + 1] += n * (1 - p)
                mass[1, k, v + 1] += n * p
        said = mass[:, :, 0] + mass[:, :, 2]
        new = np.ones_like(given)
        new[:, :, 0], new[:, :, 2] = mass[:, :, 0] / said, mass[:, :, 2] / said
        moved = np.abs(new - given).max()
        given, prior = new, np.clip(by_kind[:, 1] / by_kind.sum(axis=1), 0.02, 0.98)
        if moved < 1e-7:
            break
    return Reliability(prior, given)


def fit(rows: list[tuple[list[int], float]], epochs: int = 20, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Logistic weights from features and soft labels."""
    w, g2, b = np.zeros(1 << BITS), np.full(1 << BITS, 1.0), 0.0
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, p = rows[k]
            z = max(-30.0, min(30.0, b + float(w[i].sum())))
            g = 1 / (1 + math.exp(-z)) - p
            step = g + 1e-4 * w[i]
            g2[i] += step * step
            w[i] -= rate * step / np.sqrt(g2[i])
            b -= 0.01 * g
    return w, b


# --- operator ---------------------------------------------------------------------------

_CANDIDATE = "array<struct<kind:int,start:bigint,end:bigint,votes:array<int>,features:array<int>,base:boolean>>"
_ARROW_CANDIDATE = pa.list_(pa.struct([
    ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.list_(pa.int32())),
    ("features", pa.list_(pa.int32())), ("base", pa.bool_())]))
_FLUSH = 4096


def found_spans(docs: DataFrame) -> DataFrame:
    """Candidates of each whole text with votes and features."""
    schema = pa.schema([("doc_id", pa.int64()), ("found", _ARROW_CANDIDATE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, held = [], [], 0
            for doc_id, value in zip(batch.column("doc_id"), batch.column("text")):
                text = value.as_py() or ""
                base = base_spans(text)
                known = set(base)
                ids.append(doc_id.as_py())
                out.append([
                    {"kind": s.kind, "start": s.start, "end": s.end, "votes": votes(text, s), "features": features(text, s),
                     "base": s in known} for s in candidates(text, base)])
                held += 1 + len(out[-1])
                if held > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, _ARROW_CANDIDATE)], schema=schema)
                    ids, out, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, _ARROW_CANDIDATE)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, f"doc_id bigint, found {_CANDIDATE}")


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def personal_spans(docs: DataFrame, sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """One row per document with the counts and spans."""
    met = durable(found_spans(docs))
    each = met.select("doc_id", F.explode("found").alias("c"))
    # At most three votes for each of five labelers and ten kinds.
    patterns = each.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()
    counts = sorted((r["kind"], list(r["votes"]), r["n"]) for r in patterns)
    model = estimate(counts)
    total = sum(c[2] for c in counts)
    share = min(1.0, sample / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "c.start", "c.kind"), F.lit(1 << 30))
    picked = each.select(draw.alias("draw"), "doc_id", "c.start", "c.kind", "c.votes", "c.features").where(F.col("draw") < F.lit(int(share * (1 << 30))))
    # Repeats of a row draw alike: each candidate counts once, and no more than
    # the sample comes to the driver.
    chosen = picked.distinct().orderBy(*picked.columns).limit(sample).collect()
    chosen.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["start"], r["kind"]))
    weights, bias = fit([(list(r["features"]), model.posterior(r["kind"], list(r["votes"]))) for r in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist()):
                base = [Span(c["start"], c["kind"], c["end"]) for c in found if c["base"]]
                more = [Span(c["start"], c["kind"], c["end"]) for c in found
                        if not c["base"] and 1 / (1 + math.exp(-max(-30.0, bias + float(weights[c["features"]].sum())))) >= cut]
                kinds = Counter(s.kind for s in base)
                out.append({
                    "doc_id": doc_id, **{f"n_{k}": kinds[i] for i, k in enumerate(BASE_KINDS)},
                    "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(sorted(base + without_overlaps(more)))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE_KINDS], ("base_sha256", pa.string()), ("spans", pa.string())]))

    fields = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return met.mapInArrow(run, f"doc_id bigint, {fields}, base_sha256 string, spans string")


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents"))
