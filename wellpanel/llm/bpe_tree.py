"""Byte-level BPE of whole texts as a tree reduction, and back.

The encoding of a text is a monoid: ``join(encode(a), encode(b)) == encode(a + b)``.  A text is encoded in
halves; two neighbours are joined by encoding a window around their border anew, and the window grows until
what lies outside is proved to stand.  The proof is one of two:

* between matches of the splitting pattern (``Tree.join``): a match is settled by the characters up to three
  after its start and one after its run, so in the left part every boundary before the last four matches
  stands; in the right part all matches stand from the first boundary that both scans share;
* between tokens of one match (``Merger.join``): a sequence is the BPE encoding of its bytes exactly when
  every two neighbouring tokens are the encoding of their joint bytes.

Texts longer than ``SPREAD`` characters are cut into parts that Spark spreads over tasks before they meet in
the fold.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.storage import table
from wellpanel.llm.words import row_groups, text_bytes

#: Characters of a leaf of the tree, bytes of a leaf within one match, characters of a part of a spread text.
LEAF, MATCH_LEAF, SPREAD = 1 << 14, 64, 1 << 20
#: Encoded matches a task remembers.
REMEMBERED = 200_000
#: Trailing matches of a scan that may change with what follows.
OPEN_MATCHES = 4
NO_RANK, GONE = 1 << 60, 1 << 29
_EDGE = 64

#: The characters with the Unicode property White_Space.
WHITE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def splitter(pattern: str) -> regex.Pattern:
    """The splitting pattern with white space as the Unicode property defines it."""
    plain = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
    return regex.compile(plain)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merger:
    """BPE within one match."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.settled: dict[tuple[int, int], bool] = {}
        pairs = {
            ranks[token[:k]] << 32 | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], 1 << 62)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NO_RANK)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= MATCH_LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 1
        while left and right:
            a, b = left[:-width], right[width:]
            window = b"".join(self.bytes_of[t] for t in left[-width:] + right[:width])
            between = self.merge(window)
            if (not a or self.stands(a[-1], between[0])) and (not b or self.stands(between[-1], b[0])):
                return a + between + b
            width *= 2
        return left + right

    def stands(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their joint bytes."""
        found = self.settled.get((a, b))
        if found is None:
            if len(self.settled) >= REMEMBERED:
                self.settled.clear()
            found = self.settled[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_RANK)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed encodings of many short pieces, those of one length merged side by side."""
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            found = self._merge_table(self.of_byte[np.frombuffer(b"".join(pieces[k] for k in own), np.uint8).reshape(-1, size)])
            for k, ids in zip(own.tolist(), found):
                out[k] = ids
        return out

    def _merge_table(self, tokens: np.ndarray) -> list[bytes]:
        """Merge every row: its pair of lowest rank, leftmost first, until no pair has a rank."""
        n, size = tokens.shape
        # two closing columns without a rank, so that shifting needs no special case
        tokens = np.concatenate((tokens, np.full((n, 2), GONE)), axis=1)
        ranks = self._pair_ranks(tokens[:, :-1], tokens[:, 1:])
        live, place = np.arange(n), np.arange(size + 2)
        while len(live):
            at = ranks[live].argmin(axis=1)
            least = ranks[live, at]
            live, at, least = live[least < NO_RANK], at[least < NO_RANK], least[least < NO_RANK]
            if not len(live):
                break
            shift = np.minimum(place + (place > at[:, None]), size + 1)
            row = np.take_along_axis(tokens[live], shift, axis=1)
            step = np.take_along_axis(ranks[live], np.minimum(shift[:, :-1], size), axis=1)
            k = np.arange(len(live))
            row[k, at] = least
            step[k, at] = self._pair_ranks(least, row[k, at + 1])
            left = np.flatnonzero(at > 0)
            step[left, at[left] - 1] = self._pair_ranks(row[left, at[left] - 1], least[left])
            tokens[live], ranks[live] = row, step
        counts = (tokens != GONE).sum(axis=1)
        packed = tokens.astype("<u4")
        return [row[:c].tobytes() for row, c in zip(packed, counts.tolist())]

    def merge(self, piece: bytes) -> list[int]:
        """Join the neighbouring parts of lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < 1 << 60:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]


class Remembered(dict):
    """The packed ids of matches, computed on first sight; forgetting costs time, never results."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, match: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.merger.encode(match.encode("utf-8", "replace")), "<u4").tobytes()
        if len(match) <= MATCH_LEAF:
            self[match] = ids
        return ids

    def learn(self, matches: set[str]) -> None:
        """Encode the unknown ones of ``matches`` together."""
        fresh = [m for m in matches if m not in self and len(m) <= MATCH_LEAF // 4]
        if len(self) + len(fresh) > REMEMBERED:
            self.clear()
            fresh = [m for m in matches if len(m) <= MATCH_LEAF // 4]
        pieces = [m.encode("utf-8", "replace") for m in fresh]
        ranks = self.merger.ranks
        whole = [ranks.get(p) for p in pieces]
        rest = [k for k, rank in enumerate(whole) if rank is None]
        self.update((m, rank.to_bytes(4, "little")) for m, rank in zip(fresh, whole) if rank is not None)
        self.update(zip([fresh[k] for k in rest], self.merger.merge_all([pieces[k] for k in rest])))


class Piece:
    """An encoded text: packed ids, and match boundaries (characters, bytes of ids) at both edges."""

    __slots__ = ("text", "ids", "head", "tail")

    def __init__(self, text: str, ids: bytes, head: list[tuple[int, int]], tail: list[tuple[int, int]]):
        self.text, self.ids, self.head, self.tail = text, ids, head, tail


class Tree:
    """Encoder and decoder of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = splitter(pattern)
        self.known = Remembered(Merger(ranks))
        tokens = [self.known.merger.bytes_of.get(rank, b"") for rank in range(max(ranks.values(), default=0) + 1)]
        self.alphabet = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts, whose short matches are learned together."""
        split = [self.split.findall(text) if len(text) <= LEAF else None for text in texts]
        self.known.learn({m for matches in split if matches for m in matches})
        return [self.ids(text) if matches is None else b"".join(map(self.known.__getitem__, matches)) for text, matches in zip(texts, split)]

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= LEAF:
            return b"".join(map(self.known.__getitem__, self.split.findall(text)))
        return self.piece(text).ids

    def piece(self, text: str) -> Piece:
        if len(text) <= LEAF:
            return self._scan(text)
        half = len(text) // 2
        return self.join(self.piece(text[:half]), self.piece(text[half:]))

    def _scan(self, text: str) -> Piece:
        matches = self.split.findall(text)
        self.known.learn(set(matches))
        ids = list(map(self.known.__getitem__, matches))
        chars = np.concatenate(([0], np.cumsum([len(m) for m in matches], dtype=np.int64)))
        tokens = np.concatenate(([0], np.cumsum([len(i) for i in ids], dtype=np.int64)))
        bounds = list(zip(chars.tolist(), tokens.tolist()))
        return Piece(text, b"".join(ids), bounds[:_EDGE], bounds[-_EDGE:])

    def join(self, left: Piece, right: Piece) -> Piece:
        if not left.text or not right.text:
            return right if not left.text else left
        # a boundary of the left part that stands whatever follows; the text's start always does
        at, kept = left.tail[-1 - OPEN_MATCHES] if len(left.tail) > OPEN_MATCHES else (0, 0)
        open_text = left.text[at:]
        landing = dict(right.head)
        width = min(64, len(right.text))
        while True:
            matches = self.split.findall(open_text + right.text[:width])
            whole = width == len(right.text)
            done, meets = 0, None
            settled = len(matches) if whole else max(0, len(matches) - OPEN_MATCHES)
            for k in range(settled):
                done += len(matches[k])
                if done - len(open_text) in landing:
                    meets = k + 1
                    break
            if meets is not None or whole:
                break
            width = min(2 * width, len(right.text))
        between = list(map(self.known.__getitem__, matches[:meets]))
        border = done - len(open_text) if meets is not None else len(right.text)
        skipped = landing[border] if meets is not None else len(right.ids)
        middle = b"".join(between)
        ids = left.ids[:kept] + middle + right.ids[skipped:]
        chars, tokens, inner = at, kept, []
        for match, got in zip(matches, between):
            chars, tokens = chars + len(match), tokens + len(got)
            inner.append((chars, tokens))
        shift_c, shift_t = len(left.text), kept + len(middle) - skipped
        after = [(c + shift_c, t + shift_t) for c, t in right.tail if c > border]
        ahead = [(c + shift_c, t + shift_t) for c, t in right.head if c > border]
        before_head = [x for x in left.head if x[0] <= at]
        before_tail = [x for x in left.tail if x[0] <= at]
        # edge lists must be gapless: beyond a side's own edge they simply end
        head = before_head if before_head[-1][0] < at else (before_head + inner + ahead)[:_EDGE]
        tail = after[-_EDGE:] if after and right.tail[0][0] > border else (before_tail + inner + after)[-_EDGE:]
        return Piece(left.text + right.text, ids, head, tail)

    def decode(self, ids: bytes) -> bytes:
        if len(ids) <= 4 * LEAF:
            own = np.frombuffer(ids, "<u4")
            lengths = self.lengths[own]
            ends = np.cumsum(lengths)
            place = np.repeat(self.starts[own] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
            return self.alphabet[place].tobytes()
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


_TREES: dict[str, Tree] = {}


def tree_of(name: str, ranks: dict[bytes, int], pattern: str) -> Tree:
    """One encoder for all tasks of a worker process, so that it remembers matches between them."""
    if name not in _TREES:
        _TREES.clear()
        _TREES[name] = Tree(ranks, pattern)
    return _TREES[name]


def _digests(tree: Tree, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(tree.decode(ids)).hexdigest()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, spread: int = SPREAD) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row of ``docs``.

    The vocabulary is read once, on the driver, from ``ranks_path`` and broadcast (its size is that file's).

    Defined cases: null and empty texts have no tokens and the digests of nothing; repeated rows are encoded each;
    a null id keeps its row; texts of any length are encoded whole; malformed UTF-8 counts as U+FFFD; an empty
    table gives an empty result.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    name = f"{ranks_path} {pattern}"

    def tree() -> Tree:
        return tree_of(name, shared.value, pattern)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            found = []
            for first, last in row_groups(offsets):
                texts = [data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in range(first, last)]
                found += [_digests(t, ids) for ids in t.many(texts)]
            n, a, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tree()
        for batch in batches:
            pieces = [t.piece(x) for x in batch["part"]]
            yield batch[["row", "doc_id", "at"]].assign(
                text=[p.text for p in pieces],
                ids=[p.ids for p in pieces],
                head=[np.array(p.head, "<i8").tobytes() for p in pieces],
                tail=[np.array(p.tail, "<i8").tobytes() for p in pieces],
            )

    def edge(packed: bytes) -> list[tuple[int, int]]:
        return [tuple(x) for x in np.frombuffer(packed, "<i8").reshape(-1, 2).tolist()]

    def fold(parts: pd.DataFrame) -> pd.DataFrame:
        t = tree()
        level = [Piece(x.text, x.ids, edge(x.head), edge(x.tail)) for x in parts.sort_values("at").itertuples()]
        while len(level) > 1:
            level = [reduce(t.join, level[k : k + 2]) for k in range(0, len(level), 2)]
        return pd.DataFrame([(parts["doc_id"].iloc[0], *_digests(t, level[0].ids))], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > spread
    whole = texts.filter(~is_long).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(short, RESULT)
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(spread))
    cut = (
        texts.filter(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "text", F.explode(starts).alias("at"))
        .select("row", "doc_id", "at", F.substring(F.col("text"), F.col("at"), F.lit(spread)).alias("part"))
        .repartition("row", "at")
        .mapInPandas(part, "row long, doc_id long, at int, text string, ids binary, head binary, tail binary")
    )
    return whole.unionByName(cut.groupBy("row").applyInPandas(fold, RESULT))


def public_encoding() -> tuple[str, str]:
    """Path and pattern of the registered vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *public_encoding())
