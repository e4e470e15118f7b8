"""SentencePiece encoding and decoding with N-best segmentation.

A forward Viterbi pass over the piece lattice gives every node the score of its best prefix; backward A-star from the
end uses these scores as exact heuristics, so hypotheses leave the queue in order of their full scores, and as each of
them has a completion with just that score, the queue never needs more than n. The model at hand is a BPE model, whose
scores are merge ranks and no log-probabilities; sums of ranks would prefer many short pieces. So a piece of rank r
counts as log of 1 / (r + RANK_OFFSET), Zipf's law, up to the normalising constant. No piece spans
a boundary between segments (a run of meta spaces with what follows it, or a character that no longer piece contains),
so a text's lattice is a chain of segments: forward scores are computed for many segments at once, and A-star enters
only those segments whose second-best segmentation can matter for the N best of the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Added to ranks before the logarithm. With 100, segments agree with the model's own merges most often.
RANK_OFFSET = 100.0
#: An unknown character scores this much below the least piece.
UNKNOWN_PENALTY = 10.0
META = "▁"
#: Segments, and characters of them, that a worker remembers.
CACHE_SEGMENTS, CACHE_CHARS = 400_000, 16_000_000
#: Segments whose n best segmentations a worker remembers.
OTHERS_KNOWN = 50_000
#: Cells of a block's lattice, its longest segments, and the fewest segments of a length that are worth a block.
BLOCK_CELLS, BLOCK_CHARS, BLOCK_LEAST = 2_000_000, 40, 64
#: Bytes of text that a worker takes at once; their segments are learned together.
BATCH_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary of a model file as tables for lattices."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: dict[int, bytes] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.text[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.score[piece] = i, float(sp.get_score(i))
                self.text[i] = piece.encode("utf-8")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        # Scores of a BPE model are ranks, negated. Multiples of 2^-16 add up without rounding, so ties are ties in any order.
        size = math.log(math.log1p(len(self.id) / RANK_OFFSET))
        self.score = {k: round((-math.log(RANK_OFFSET - v) - size) * 65536) / 65536 for k, v in self.score.items()}
        self.longest = max(map(len, self.id))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        inside = {c for p in self.id if len(p) > 1 for c in p}
        if any(META in p.lstrip(META) for p in self.id):
            raise ValueError("a piece spans words")
        joined = re.escape("".join(sorted(inside - {META})))
        self.segment = re.compile(f"{META}+[{joined}]*|[{joined}]+|[^{META}{joined}]", re.DOTALL)
        self._others: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self._tables()

    # Hashes of pieces, for lookups of many substrings at once: a prefix code is mixed with each next character.
    def _tables(self) -> None:
        names = list(self.id)
        codes = np.array([self._hash(n) for n in names], dtype=np.uint64)
        order = np.argsort(codes)
        self._codes = codes[order]
        if (self._codes[1:] == self._codes[:-1]).any():
            raise ValueError("hashes of pieces meet")
        self._scores = np.array([self.score[n] for n in names])[order]
        self._ids = np.array([self.id[names[i]] for i in order], dtype="<u4")
        bits = 22
        self._shift = np.uint64(64 - bits)
        slots = (self._codes * _MIX) >> self._shift
        self._slot = np.full(1 << bits, -1, dtype=np.int32)
        self._next = np.full(len(names), -1, dtype=np.int32)  # pieces that share a slot form a chain
        for n, s in enumerate(slots):
            self._next[n] = self._slot[s]
            self._slot[s] = n

    @staticmethod
    def _hash(text: str) -> int:
        out = 0
        for c in text:
            out = ((out ^ ord(c)) * 0x100000001B3 + 0x9E3779B9) & 0xFFFFFFFFFFFFFFFF
            out ^= out >> 29
        return out

    def _find(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot[(codes * _MIX) >> self._shift]
        while True:
            wrong = (at >= 0) & (self._codes[at] != codes)
            if not wrong.any():
                return at
            at[wrong] = self._next[at[wrong]]

    def segments(self, text: str) -> list[str]:
        """The chain of segments of a text, with the leading meta space and spaces as meta spaces."""
        return self.segment.findall(META + text.replace(" ", META))

    def forward(self, segments: list[str]) -> list[tuple[bytes, int, float, float, bytes]]:
        """For each segment: ids of its best segmentation as bytes, their number, its score, the loss of the second best,
        and the bytes that the ids decode to.

        Segments are taken by length, each length as a matrix of characters. Of equal scores the longer last piece wins.
        """
        out: list = [None] * len(segments)
        by_length: dict[int, list[int]] = {}
        for n, s in enumerate(segments):
            by_length.setdefault(len(s), []).append(n)
        for length, members in by_length.items():
            if length > BLOCK_CHARS or len(members) < BLOCK_LEAST:
                for n in members:
                    out[n] = self._forward_one(segments[n])
                continue
            step = max(1, BLOCK_CELLS // ((length + 1) * (min(self.longest, length) + 1)))
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for n, found in zip(part, self._forward_block([segments[n] for n in part], length)):
                    out[n] = found
        return out

    def _forward_block(self, words: list[str], length: int) -> Iterator[tuple[bytes, int, float, float, bytes]]:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length).astype(np.uint64)
        n = len(words)
        reach = min(self.longest, length)
        edge = np.full((length + 1, reach + 1, n), -np.inf)  # by end and size: the piece's score
        piece = np.full((length + 1, reach + 1, n), -1, dtype=np.int32)
        with np.errstate(over="ignore"):
            for start in range(length):
                code = np.zeros(n, dtype=np.uint64)
                for size in range(1, min(reach, length - start) + 1):
                    code = (code ^ chars[:, start + size - 1]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B9)
                    code ^= code >> np.uint64(29)
                    at = self._find(code)
                    piece[start + size, size] = at
                    edge[start + size, size] = np.where(at >= 0, self._scores[at], -np.inf)
        none = piece[1:, 1] < 0
        edge[1:, 1][none] = self.unknown
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, n), dtype=np.int64)
        for end in range(1, length + 1):
            for size in range(1, min(reach, end) + 1):
                total = best[end - size] + edge[end, size]
                better = total >= best[end]
                best[end] = np.where(better, total, best[end])
                back[end] = np.where(better, size, back[end])
        # The second best leaves the best path, seen from the end, at one node by another edge; its prefix is best there.
        loss = np.full(n, np.inf)
        at, live = np.full(n, length), np.arange(n)
        ids, column = np.zeros((n, length), dtype="<u4"), np.full(n, length)
        odd = np.zeros(n, dtype=bool)
        while len(live):
            end = at[live]
            size = back[end, live]
            for other in range(1, reach + 1):
                fits = (other <= end) & (other != size)
                if fits.any():
                    start = np.where(fits, end - other, 0)
                    total = np.where(fits, best[start, live] + edge[end, np.where(fits, other, 0), live], -np.inf)
                    loss[live] = np.minimum(loss[live], best[end, live] - total)
            chosen = piece[end, size, live]
            column[live] -= 1
            ids[live, column[live]] = self._ids[chosen]
            odd[live] |= chosen < 0
            at[live] = end - size
            live = live[at[live] > 0]
        data, width, text = ids.tobytes(), 4 * length, self.text.__getitem__
        columns = (column.tolist(), odd.tolist(), ids.tolist(), best[length].tolist(), loss.tolist())
        for r, (word, first, other, row, score, lost) in enumerate(zip(words, *columns)):
            if not other:
                plain = b"".join(map(text, row[first:]))
                if plain == word.encode("utf-8", "surrogatepass"):  # else two strings of one hash
                    yield data[r * width + 4 * first : (r + 1) * width], length - first, score, lost, plain
                    continue
            yield self._forward_one(word)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))

    def _edges(self, word: str, end: int) -> Iterator[tuple[int, float]]:
        """(start, score) of the pieces that end there."""
        for size in range(1, min(self.longest, end) + 1):
            score = self.score.get(word[end - size : end])
            if score is not None:
                yield end - size, score
            elif size == 1:
                yield end - 1, self.unknown

    def heuristics(self, word: str) -> tuple[list[float], list[int]]:
        best, back = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, at = -np.inf, end - 1
            for start, score in self._edges(word, end):
                if best[start] + score >= top:
                    top, at = best[start] + score, start
            best.append(top)
            back.append(at)
        return best, back

    def _forward_one(self, word: str) -> tuple[bytes, int, float, float, bytes]:
        best, back = self.heuristics(word)
        end, cuts, loss = len(word), [len(word)], np.inf
        while end:
            for start, score in self._edges(word, end):
                if start != back[end]:
                    loss = min(loss, best[end] - best[start] - score)
            end = back[end]
            cuts.append(end)
        ids = self.ids_of(word, cuts[::-1])
        return np.array(ids, dtype="<u4").tobytes(), len(ids), float(best[-1]), float(loss), self.bytes_of(ids)

    def ids_of(self, word: str, cuts) -> list[int]:
        out = []
        for a, b in zip(cuts, cuts[1:]):
            found = self.id.get(word[a:b])
            out += [found] if found is not None else [self.bytes[x] for x in word[a:b].encode("utf-8", "surrogatepass")]
        return out

    def nbest(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """Up to n best segmentations (score, cuts) by backward A-star; of equal scores, the longer last piece first.

        A hypothesis is its loss, the node it has reached, a number that settles ties, the score behind it, and the
        hypothesis it came from.
        """
        best, _ = self.heuristics(word)
        queue, found, made = [(-best[-1], len(word), 0, 0.0, None)], [], 0
        while queue and len(found) < n:
            hypothesis = queue.pop(0)
            loss, end, _, behind, _ = hypothesis
            if end == 0:
                cuts = []
                while hypothesis is not None:
                    cuts.append(hypothesis[1])
                    hypothesis = hypothesis[4]
                found.append((-loss, cuts))
                continue
            wanted = n - len(found)
            for start, score in self._edges(word, end):
                total = -(best[start] + score + behind)
                if len(queue) < wanted or total < queue[-1][0]:
                    made += 1
                    insort(queue, (total, start, made, score + behind, hypothesis))
                    del queue[wanted:]  # those before it have completions of their own
        return found

    def nbest_text(self, segments: list[str], loss: np.ndarray, top: float, n: int) -> list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]]:
        """Up to n best (score, ((segment, its ids), ...) where they differ from the best) of a chain, from the losses
        that forward() gave for its segments.

        A segmentation among the n best departs from the best one only in segments whose own loss is among the n - 1
        least, as each of those alone would do better; these segments are searched by A-star and combined.
        """
        near = np.argsort(loss, kind="stable")[: n - 1] if len(loss) <= 4 * n else self._least(loss, n - 1)
        combined = [(0.0, ())]
        for i in near.tolist():
            if loss[i] == np.inf:
                continue
            options = self.others(segments[i], n)
            combined = sorted(((gone + more, (*way, (i, ids)) if ids else way) for gone, way in combined for more, ids in options), key=lambda x: x[0])[:n]
        return [(top - gone, way) for gone, way in combined]

    def others(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the n best segmentations; the best has no ids, as forward() gave them. Common ones are remembered."""
        known = self._others.get((segment, n))
        if known is None:
            found = self.nbest(segment, n)
            known = [(found[0][0] - score, tuple(self.ids_of(segment, cuts)) if k else ()) for k, (score, cuts) in enumerate(found)]
            if len(segment) <= BLOCK_CHARS:
                if len(self._others) >= OTHERS_KNOWN:
                    self._others.clear()
                self._others[segment, n] = known
        return known

    @staticmethod
    def _least(loss: np.ndarray, n: int) -> np.ndarray:
        """Places of the n least losses, ties by place."""
        bound = np.partition(loss, n - 1)[n - 1] if n else -np.inf
        below, at = np.nonzero(loss < bound)[0], np.nonzero(loss == bound)[0]
        return np.concatenate([below, at])[:n]

    def decode(self, ids) -> str:
        """The text of ids: bytes joined, meta spaces as spaces, without the leading space."""
        return self.plain(self.bytes_of(ids))

    @staticmethod
    def plain(data: bytes) -> str:
        text = data.decode("utf-8", "surrogatepass").replace(META, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


class Cache:
    """What forward() gave, by segment: a number for each segment, and columns by number.

    When it is full, it keeps what the batch at hand uses, which are the common segments.
    """

    def __init__(self) -> None:
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.plain: list[bytes] = []
        self.columns = np.zeros((3, 1024))  # ids, score, loss
        self.chars = 0

    def _keep(self, wanted: set[str]) -> None:
        old = (self.number, self.ids, self.plain, self.columns)
        kept = [s for s in wanted if s in old[0]]
        at = [old[0][s] for s in kept]
        self._empty()
        self.number = {s: n for n, s in enumerate(kept)}
        self.ids, self.plain = [old[1][n] for n in at], [old[2][n] for n in at]
        self.columns = old[3][:, at]
        self.chars = sum(map(len, kept))

    def learn(self, p: Pieces, wanted: set[str]) -> None:
        fresh = [s for s in wanted if s not in self.number]
        if len(self.number) + len(fresh) > CACHE_SEGMENTS or self.chars > CACHE_CHARS:
            self._keep(wanted)
        start = len(self.number)
        if start + len(fresh) > self.columns.shape[1]:
            self.columns = np.concatenate([self.columns, np.zeros((3, start + len(fresh)))], axis=1)
        if fresh:
            ids, count, score, loss, plain = zip(*p.forward(fresh))
            self.number.update(zip(fresh, range(start, start + len(fresh))))
            self.ids += ids
            self.plain += plain
            self.columns[:, start : start + len(fresh)] = count, score, loss
            self.chars += sum(map(len, fresh))


_CACHES: dict[str, Cache] = {}


def encode_texts(p: Pieces, cache: Cache, texts: list[str], n_best: int) -> list[tuple]:
    """For each text: ids of the n best segmentations as bytes, number of the best's ids, scores of the n best, whether
    decoding gives the text back."""
    chains = [p.segments(t) for t in texts]
    cache.learn(p, set().union(*chains))
    bounds = np.cumsum([0, *map(len, chains)]).tolist()
    numbers = list(map(cache.number.__getitem__, chain.from_iterable(chains)))
    count, score, loss = cache.columns[:, numbers]
    out = []
    for text, segments, a, b in zip(texts, chains, bounds, bounds[1:]):
        own = numbers[a:b]
        best = b"".join(map(cache.ids.__getitem__, own))
        ends = np.cumsum(count[a:b]).astype(np.int64) * 4
        scores, ids = [], []
        for s, way in p.nbest_text(segments, loss[a:b], float(score[a:b].sum()), n_best):
            scores.append(s)
            ids.append(_changed(best, ends, way))
        out.append((ids, int(count[a:b].sum()), scores, p.plain(b"".join(map(cache.plain.__getitem__, own))) == text))
    return out


def _changed(best: bytes, ends: np.ndarray, way) -> bytes:
    """best with the ids of some segments replaced; ends: where each segment's ids end."""
    if not way:
        return best
    parts, at = [], 0
    for i, ids in sorted(way):
        parts += [best[at : int(ends[i - 1]) if i else 0], np.array(ids, dtype="<u4").tobytes()]
        at = int(ends[i])
    return b"".join([*parts, best[at:]])


def encode(docs: DataFrame, model: str = MODEL, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, best_score, n_best_scores, n_best_sha256, round_trip[, ids, n_best_ids]), one row for each input row.

    The n best segmentations come best first; ids_sha256 and n_pieces are the best one's, n_best_sha256 all of theirs,
    of the ids as little-endian 32-bit numbers; with_ids gives the ids themselves. Null texts are encoded like empty
    ones: the leading meta space alone, which has one segmentation. Repeated rows are encoded alike; equal scores are
    ordered by longer last pieces; extra columns are ignored; an empty table gives an empty table. Texts that hold the
    meta space itself decode to spaces there, and round_trip is false for them. Long texts are encoded whole, and a long
    run without spaces takes memory in proportion to its length.
    """
    bounded_batches(docs.sparkSession, size=BATCH_BYTES)
    kind = "n_pieces long, ids_sha256 string, best_score double, n_best_scores array<double>, n_best_sha256 array<string>, round_trip boolean"
    names = ["n_pieces", "ids_sha256", "best_score", "n_best_scores", "n_best_sha256", "round_trip"]
    if with_ids:
        kind, names = kind + ", ids array<int>, n_best_ids array<array<int>>", [*names, "ids", "n_best_ids"]

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p, cache = pieces(model), _CACHES.setdefault(model, Cache())
        for texts in parts:
            out = []
            for ids, count, scores, same in encode_texts(p, cache, texts.tolist(), n_best):
                digests = [hashlib.sha256(x).hexdigest() for x in ids]
                row = (count, digests[0], scores[0], scores, digests, same)
                if with_ids:
                    numbers = [np.frombuffer(x, dtype="<u4").astype("int32") for x in ids]
                    row = (*row, numbers[0], numbers)
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), run(text_of(docs, text_col)).alias("e")).select("doc_id", "e.*")


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the text of the ids."""
    bounded_batches(encoded.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = pieces(model)
        for ids in parts:
            yield ids.map(lambda x: None if x is None else p.decode(x))

    return encoded.withColumn("decoded", run(encoded[ids_col]))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
