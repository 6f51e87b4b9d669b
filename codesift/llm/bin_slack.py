"""Best-fit packing of token pieces by minimum bin slack.

Each sequence takes the longest piece that is left and, beside it, the fullest
combination of the others: a bitset of the sums that the available lengths can
make, one shift and OR per length, gives the largest sum that fits, and walking
back through the bitsets gives its lengths.  These are removed and the next
sequence is filled.  While a combination is still available it stays the
fullest one (taking lengths away makes no new sums), so it is applied as often
as the counts allow at once.  Each application uses up one length; there are at
most ``limit`` patterns, whatever the number of documents, and the driver holds
nothing but the histogram of at most ``limit`` lengths.

Texts are tokenised once in an Arrow map that numbers the pieces of each length
as it goes; the pieces are cut durably, one small row per task and length gives
each task its first number of that length, and a binary search in the layout
(length, number) gives sequence and offset.  A length that a third of all
pieces share is numbered by as many tasks as hold it.

Defined cases: a null or empty text is the single id 0; a text over the limit
is cut into full pieces, the first may be shorter; pieces of equal length are
alike, and which of them goes where depends on the order of the input; repeated
rows are packed each; an empty table gives no rows; further columns do not
matter.  A very long text is tokenised in slices of about ``SLICE`` characters
that end where the tokenizer splits anyway; its ids need four bytes a token.
"""

from __future__ import annotations

import json
import os
import re
import sys
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codesift.llm.common import columns_of, table, text_or_empty
from codesift.session import durable

# The helpers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 2048
END_ID = 0
SLICE = 1 << 20
# Bytes of ids of one Arrow batch.
_BATCH_BYTES = 8 << 20

# Fixed value: how byte-level BPE vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A single space between two other characters begins a pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, _task int, _k bigint"


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A long text in slices whose token ids join to those of the whole."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, where these are the ranks of the merges."""
    # Byte-level vocabularies write printable bytes as themselves and the others
    # as the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    pair = lambda m: "".join(m.split(" ") if isinstance(m, str) else m)
    vocab = model["vocab"]
    ids = [vocab.get(pair(m)) for m in model["merges"]]
    if ids != list(range(256, 256 + len(ids))) or sorted(vocab[c] for c in byte_of) != list(range(256)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(ids)}


class Encoder:
    """Token ids of texts, as the library ``tokenizers`` gives them with this
    vocabulary and without special tokens, as little-endian bytes.

    A byte-level BPE whose ids are the ranks of its merges is run by the several
    times faster ``tiktoken``, which gives the same ids; any other vocabulary by
    ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str) -> None:
        described = json.loads(vocabulary)
        split, model = described.get("pre_tokenizer") or {}, described["model"]
        self.fast = None
        if not described.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) \
                and model["type"] == "BPE" and not model.get("ignore_merges") and (ranks := _ranks(model)):
            import tiktoken

            self.fast = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(vocabulary)
            # The strings of special tokens in a text are ordinary text.
            self.tokenizer.encode_special_tokens = True

    def __call__(self, text: str) -> bytes:
        if self.fast is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(np.array(self.fast.encode_ordinary(part), "<u4").tobytes() for part in slices(text))


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of at most ``limit`` tokens of ``docs(doc_id, text)``, cut
    durably, with their ids; ``tokenizer`` is the path of a vocabulary file
    on the driver."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())  # a file of fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, taken = Encoder(vocabulary.value), TaskContext.get().partitionId(), Counter()
        names = ("doc_id", "piece", "start", "length", "ids", "_task", "_k")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for doc_id, text in columns_of(batch, "doc_id", "text"):
                ids = encode(text) + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                tops = range((n - 1) % limit + 1, n + 1, limit)
                for piece, top in enumerate(tops):
                    start = max(0, top - limit) if piece else 0
                    rows.append((doc_id, piece, start, top - start, ids[4 * start:4 * top], task, taken[top - start]))
                    taken[top - start] += 1
                    held += 4 * (top - start)
                    if held >= _BATCH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return durable(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(cut, _PIECES))


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """``(length, number)`` of the fullest combination within ``capacity``.

    Bit s of ``sums`` says that some of the lengths so far add up to s.  Longer
    lengths come first, so short ones are kept for later gaps.
    """
    mask, sums, layers = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        layers.append((length, sums))
        left, step = min(counts[length], capacity // length), 1
        while left:
            take = min(step, left)
            sums |= (sums << (take * length)) & mask
            left, step = left - take, step * 2
        if sums >> capacity & 1:
            break
    rest, chosen = sums.bit_length() - 1, []
    for length, before in reversed(layers):
        number = 0
        while not before >> rest & 1:
            rest, number = rest - length, number + 1
        if number:
            chosen.append((length, number))
    return chosen


def patterns(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(times, [(length, number), ...])`` until all pieces are placed."""
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = Counter(dict(fullest({k: n for k, n in left.items() if n}, limit - longest)))
        left[longest] += 1
        rest[longest] += 1
        times = min(left[k] // n for k, n in rest.items())
        out.append((times, sorted(rest.items(), reverse=True)))
        for k, n in rest.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def layout(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows ``key, number, sequence, offset`` by key, which is the length in the
    upper bits and the first piece of that length the row is about in the lower
    ones; ``number`` pieces of it lie in each sequence from ``sequence`` on."""
    used, sequence, rows = Counter(), 0, []
    for times, items in found:
        offset = 0
        for length, number in items:
            rows.append(((length << _SLOT_BITS) + used[length], number, sequence, offset))
            used[length] += number * times
            offset += length * number
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4).T


_SLOT_BITS = 48


def placed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` as ``token_pieces`` gives them, with ``sequence_id`` and
    ``offset`` instead of their numbers."""
    counts = durable(pieces.groupBy("_task", "length").agg((F.max("_k") + 1).alias("_n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    keys, numbers, sequences, offsets = layout(patterns(histogram, limit))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, slot: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy() << _SLOT_BITS) + slot.to_numpy()
        at = np.searchsorted(keys, key, "right") - 1
        inside = key - keys[at]
        return pd.DataFrame({
            "sequence_id": sequences[at] + inside // numbers[at],
            "offset": offsets[at] + inside % numbers[at] * length.to_numpy()})

    rows = pieces.join(starts, ["_task", "length"]).withColumn("_place", place("length", F.col("_first") + F.col("_k")))
    kept = [c for c in pieces.columns if c not in ("_task", "_k")]
    return rows.select(*kept, "_place.sequence_id", "_place.offset")


def sequences(placed_pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` with the ids of its pieces one after another; a
    sequence holds at most ``limit`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return placed_pieces.groupBy("sequence_id").agg(joined.alias("ids"))


def op13_minimum_bin_slack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer)
    # Only the checksum of the ids goes through the join.
    lean = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "_task", "_k")
    return placed(lean)
