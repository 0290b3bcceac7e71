"""Best-fit packing of token sequences by the linear grouping scheme.

Documents are tokenised, closed with id 0 and, if longer than a sequence, cut so that only the first piece is short.
Lengths are whole numbers up to the sequence length, so a histogram of at most that many rows holds all that a packing
plan needs; it alone goes to the driver, and the plan's size depends on the sequence length, not on the corpus:

1. lengths above ``small`` of a sequence are sorted down, dealt into groups of equal cardinality, and rounded up to
   their group's largest;
2. over those few sizes, the number of sequences of each configuration is optimised (column generation, with a
   knapsack for the next configuration) and rounded down;
3. actual documents take the slots of their group in order of length, which leaves gaps;
4. small documents, and the large ones that rounding left over, go longest first to the tightest gap that holds them,
   or to new sequences.

The plan maps (length, rank among that length) to a sequence. Ranks are two-level running counts.

Nulls: a null text is an empty one, which is the id 0 alone; a null id is kept. Repeated rows are packed once each. An
empty table gives an empty result. Extra columns are ignored. Very long texts are tokenised whole.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import warnings
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import materialise, prefix_sum, rows_per_bucket


def _plain_byte_pairs(path: str) -> bool:
    """Whether a tokenizer file is plain byte-level BPE: no normaliser, the byte-level split as it comes, no dropout, no
    affixes, and pairs merged in the order of their ids. Only such a file can be run by ranks."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    single = {w: i for w, i in model["vocab"].items() if len(w) == 1}
    every = len(single) + len(made) == len(model["vocab"].keys() - added)
    return None not in made and every and len(single) == 256 and made == sorted(made) and max(single.values()) < min(made, default=1 << 30)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    """The tokenizer of a file; the same vocabulary as byte-pair ranks, or None if its file asks for more than these; a
    pattern of its special tokens."""
    import tiktoken
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    special = {t.content for t in exact.get_added_tokens_decoder().values()}
    if not _plain_byte_pairs(path):
        return exact, None, re.compile(r"(?!)")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(letters[c] for c in w): i for w, i in exact.get_vocab().items() if w not in special}
    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    quick = tiktoken.Encoding(path, pat_str=split, mergeable_ranks=ranks, special_tokens={})
    return exact, quick, re.compile("|".join(map(re.escape, special)) or r"(?!)")


def token_bytes(texts: list[str], path: str | None = None) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    A plain byte-level file, which ``_plain_byte_pairs`` makes sure of, is run by the faster of the two libraries that
    read it; a text that spells out a special token, or on which the faster one gives up (it bounds backtracking, which a
    run of a million blanks exceeds), and every text of any other file goes to the ``tokenizers`` library itself. Tests
    hold the two against each other.
    """
    exact, quick, special = _tokenizer(path)
    out = []
    for text in texts:
        text = text or ""
        ids = None
        if quick is not None and not special.search(text):
            try:
                ids = quick.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        if ids is None:
            ids = np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        out.append(ids.astype("<u4", copy=False).tobytes())
    return out


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def cut(batches):
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"]
            row, piece, start, length, crc = [], [], [], [], []
            for i, tokens in enumerate(token_bytes(texts, path)):
                tokens += b"\0\0\0\0"
                n = len(tokens) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[4 * a : 4 * b]))
            yield pa.record_batch(
                [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def configurations(sizes: list[int], demand: list[int], capacity: int, max_rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(counts by size, number of sequences): few-size cutting by column generation, numbers rounded down.

    Every round improves a valid plan, so ending after ``max_rounds`` costs sequences, never pieces; a warning tells.
    """
    k, size = len(sizes), np.array(sizes)
    basis = np.diag(capacity // size).astype(float)
    x = np.array(demand) / np.diag(basis)
    room = np.arange(capacity + 1)[:, None] - size[None, :]
    fits, at = room >= 0, np.maximum(room, 0)
    for _ in range(max_rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        # the best worth of up to m pieces in each room, one more piece at a time
        worth, choices = np.zeros(capacity + 1), []
        for _ in range(capacity // int(size.min())):
            gain = np.where(fits, worth[at] + price, 0.0)
            best = gain.argmax(axis=1)
            more = gain[np.arange(capacity + 1), best]
            choices.append(np.where(more > worth + 1e-12, best, -1))
            worth = np.maximum(worth, more)
        if worth[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for choice in reversed(choices):
            if choice[c] >= 0:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        step = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    else:
        warnings.warn(f"configurations: still improving after {max_rounds} rounds", stacklevel=2)
    return [(basis[:, j].round().astype(int), int(x[j] + 1e-6)) for j in range(k) if x[j] + 1e-6 >= 1]


class _Gaps:
    """Open sequences by the room left in them, as ranges (first, count)."""

    def __init__(self):
        self.by_room: dict[int, list[list[int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.by_room:
                bisect.insort(self.rooms, room)
                self.by_room[room] = []
            self.by_room[room].append([first, count])

    def take(self, length: int, most: int) -> tuple[int, int, int] | None:
        """(room, first, count) of some of the tightest sequences with room for ``length``."""
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        ranges = self.by_room[room]
        first, count = ranges[-1]
        n = min(count, most)
        if n == count:
            ranges.pop()
            if not ranges:
                del self.by_room[room], self.rooms[at]
        else:
            ranges[-1] = [first + n, count - n]
        return room, first, n


def plan_packing(histogram: dict[int, int], capacity: int = 2048, small: float = 1 / 3, groups: int = 256) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces in each sequence): ranks of a length go to sequences
    in order. ``histogram`` counts the pieces of each length."""
    rows, sequences, gaps = [], histogram.get(capacity, 0), _Gaps()
    if sequences:
        rows.append((capacity, 0, sequences, 0, 1))
    large = [length for length in sorted(histogram, reverse=True) if small * capacity < length < capacity]
    base = np.cumsum([0, *[histogram[length] for length in large]])
    total = int(base[-1])
    edges = np.append(np.unique((np.arange(min(groups, total)) * total) // max(1, min(groups, total))), total).astype(np.int64)

    def length_at(rank):
        return large[int(np.searchsorted(base, rank, side="right")) - 1]

    left: list[tuple[int, int, int]] = []  # (length, first rank, end rank) of what no configuration takes

    def spread(a, b, first, stride):
        """Large pieces a to b, by their places in the order of length, to sequences from ``first`` on; ``first`` None: left over."""
        while a < b:
            i = int(np.searchsorted(base, a, side="right")) - 1
            end = min(b, int(base[i + 1]))
            if first is None:
                left.append((large[i], int(a - base[i]), int(end - base[i])))
            else:
                # a sequence takes ``stride`` pieces, and a length may begin in the midst of one
                lead = min((-(a - spread.origin)) % stride, end - a)
                at = first + (a - spread.origin) // stride
                if lead:
                    rows.append((large[i], int(a - base[i]), int(a - base[i] + lead), int(at), stride))
                    at += 1
                if end > a + lead:
                    rows.append((large[i], int(a - base[i] + lead), int(end - base[i]), int(at), stride))
            a = end

    if total:
        merged: dict[int, list[int]] = {}  # groups that round up to the same length are one
        for a, b in zip(edges, edges[1:]):
            span = merged.setdefault(length_at(a), [int(a), int(b)])
            span[1] = int(b)
        sizes = list(merged)
        used = {s: merged[s][0] for s in sizes}
        for counts, number in configurations(sizes, [merged[s][1] - merged[s][0] for s in sizes], capacity):
            parts, cuts = [], {0, number}
            for s, c in zip(sizes, counts):
                if c:
                    start = used[s]
                    spread.origin = start
                    spread(start, start + int(c) * number, sequences, int(c))
                    used[s] = start + int(c) * number
                    parts.append((start, int(c)))
                    inside = base[(base > start) & (base < used[s])]
                    for m in ((inside - start) // int(c)).tolist():
                        cuts |= {m, m + 1}
            cuts = sorted(m for m in cuts if m <= number)
            for m, end in zip(cuts, cuts[1:]):
                room = capacity - sum(length_at(start + m * c + i) for start, c in parts for i in range(c))
                gaps.put(room, sequences + m, end - m)
            sequences += number
        for s in sizes:
            spread(used[s], merged[s][1], None, 1)
    left += [(length, 0, histogram[length]) for length in histogram if length <= small * capacity]
    for length, rank, end in sorted(left, reverse=True):
        while rank < end:
            found = gaps.take(length, end - rank)
            if found:
                room, first, n = found
                rows.append((length, rank, rank + n, first, 1))
                gaps.put(room - length, first, n)
            else:
                most = capacity // length
                n, each = ((end - rank) // most, most) if end - rank >= most else (1, end - rank)
                rows.append((length, rank, rank + n * each, sequences, each))
                gaps.put(capacity - each * length, sequences, n)
                sequences, n = sequences + n, n * each
            rank += n
    return rows


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, small: float = 1 / 3, groups: int = 256, least_per_bucket: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = materialise(pieces(docs, capacity, path), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    plan = sorted(plan_packing(histogram, capacity, small, groups))
    columns = np.array(plan, dtype=np.int64).reshape(-1, 5).T
    wide = 1 << 44  # more than the ranks of any length
    start = columns[0] * wide + columns[1]

    def place(batches):
        for batch in batches:
            key = batch["length"].to_numpy() * wide + batch["rank"].to_numpy()
            at = np.searchsorted(start, key, side="right") - 1
            sequence = columns[3][at] + (key - start[at]) // columns[4][at]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.record_batch([*[batch[c] for c in kept], pa.array(sequence)], names=[*kept, "sequence_id"])

    rows = sum(histogram.values())
    buckets = rows // rows_per_bucket(rows, least_per_bucket) + 1
    ranked = cut.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))).withColumn("__one", F.lit(1))
    ranked = prefix_sum(ranked, ["length"], "__bucket", ["doc_id", "piece", "ids_crc32"], "__one", "rank")
    ranked = ranked.select(*cut.columns, F.col("rank").cast("long").alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long")
    inside = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32")
    before = F.sum("length").over(inside.rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
