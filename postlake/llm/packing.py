"""Pack token pieces of documents into as few sequences as possible.

Lengths are at most the capacity, so an instance of any size is a histogram of lengths, and the whole packing is decided
on that histogram: first Martello-Toth dominance fixes small sets that are at least as good as any other set in their
sequence, then the rest is placed best-fit, longest first. The plan is a list of patterns (which lengths share a sequence,
how many such sequences); its size is bounded by the capacity, not by the corpus. Pieces then look up their place by their
rank among the pieces of their length; ranks come from counts by (length, hash bucket), so a length that a third of all
pieces share is spread over all buckets.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_width, spread

CAPACITY = 2048
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END = 0
#: The fast reader of the same vocabulary is used for texts in these characters only, where both readers' character classes are the same tables.
_COMMON = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")


def token_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Whole texts to ids of the byte-level vocabulary, strings of added tokens read as those tokens."""

    def __init__(self, tokenizer: str, ranks: str | None):
        self.tokenizer, self.fast = tokenizer, None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        with open(tokenizer, encoding="utf-8") as f:
            self.added = tuple(t["content"] for t in json.load(f)["added_tokens"])

    @cached_property
    def slow(self):
        """Loaded where a text needs it: both readers' tables at once would be a good part of a worker's memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer)

    def _plain(self, text: str) -> bool:
        """Whether the fast reader gives the same ids: common characters only, and no added token's string."""
        return self.fast is not None and not _COMMON.search(text) and not any(a in text for a in self.added)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self._plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that takes the rest."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


_encoders: dict[tuple, Encoder] = {}


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document's ids and the closing id 0."""
    tokenizer, ranks = tokenizer or token_path(TOKENIZER), ranks or token_path(RANKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (tokenizer, ranks)
        if key not in _encoders:
            _encoders[key] = Encoder(*key)
        encoder, end = _encoders[key], np.array([END], "<u4")
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.concatenate([encoder.ids(text or ""), end])
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(own).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fix_dominating(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction: (patterns fixed, counts left).

    Taking the longest piece left, j, the sets that can share its sequence are looked at. A set dominates if each
    other feasible set can be split among its members, each part no longer than its member. So, with room c - j:
    - no piece fits: {j};
    - the longest piece i that fits fills the room exactly, or no two pieces fit together: {j, i};
    - two fit but never three, and i is no shorter than any two that fit: {j, i}.
    Where nothing dominates, the next longest is tried; the counts of equal lengths go in bulk.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(pattern: tuple[int, ...], n: int) -> None:
        fixed.append((pattern, n))
        for s in pattern:
            left[s] -= n
        for s in set(pattern):
            if not left[s]:
                del left[s], sizes[bisect.bisect_left(sizes, s)]

    for j in sorted(left, reverse=True):
        while j in left:
            room = capacity - j
            small = sizes[: bisect.bisect_right(sizes, room)]
            if j in small and left[j] == 1:
                small.remove(j)
            if not small:
                fix((j,), left[j])
                continue
            longest, shortest = small[-1], small[0]
            n = left[j] // 2 if longest == j else min(left[j], left[longest])
            again = left[shortest] - (shortest == j) > 1
            pair_fits = shortest + (shortest if again else small[1] if len(small) > 1 else capacity) <= room
            if longest == room or not pair_fits:
                fix((j, longest), n)
            elif 3 * shortest > room and longest >= _best_pair(small, left, room):
                fix((j, longest), n)
            else:
                break
    return fixed, left


def _best_pair(small: list[int], left: dict[int, int], room: int) -> int:
    """The longest total of two pieces that fits into room (0: none)."""
    best, a, b = 0, 0, len(small) - 1
    while a <= b:
        t = small[a] + small[b]
        if t > room:
            b -= 1
            continue
        if a < b or left[small[a]] > 1:
            best = max(best, t)
        a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences are filled together."""
    open_by_room: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = Counter()
            bisect.insort(rooms, room)
        open_by_room[room][pattern] += n

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                per = capacity // size  # new sequences, as many of this length as fit
                if n >= per:
                    put(capacity - per * size, (size,) * per, n // per)
                if n % per:
                    put(capacity - n % per * size, (size,) * (n % per), 1)
                n = 0
                continue
            room = rooms[k]
            own = open_by_room[room]
            pattern = next(iter(own))
            take = min(n, own[pattern])
            own[pattern] -= take
            if not own[pattern]:
                del own[pattern]
            if not own:
                del open_by_room[room], rooms[k]
            put(room - size, (*pattern, size), take)
            n -= take
    return [(p, n) for room in rooms for p, n in sorted(open_by_room[room].items())]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, sequences) that hold every piece of the histogram exactly once."""
    fixed, rest = fix_dominating(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted intervals of (length, rank): key of each interval's first rank, its first sequence and its offset."""
    at: Counter = Counter()
    rows, first = [], 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            rows.append(((size << 44) + at[size], first, offset))
            at[size] += n
            offset += size
        first += n
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every document row.

    Null and empty texts are the closing id alone. Repeated rows (and ids) are packed as often as they occur; pieces that
    tie in everything are interchangeable. Null ids stay null. An empty table gives no rows. Other columns are not read.
    Sequences hold no gap: offsets run from 0.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, capacity, tokenizer, ranks, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    first, sequence, offset = _slots(plan(counts, capacity))
    sent = spark.sparkContext.broadcast((first, sequence, offset))

    buckets = max(1, min(4096, 4 * shuffle_width(spark)))
    dealt = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, sequence, offset = sent.value
        for pdf in batches:
            key = (pdf["length"].to_numpy(np.int64) << 44) + pdf["rank"].to_numpy(np.int64)
            k = np.searchsorted(first, key, side="right") - 1
            out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]]
            yield out.assign(sequence_id=sequence[k] + key - first[k], offset=offset[k])

    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("local", local).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, out)
