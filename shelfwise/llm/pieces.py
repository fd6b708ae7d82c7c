"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

The lattice of a text has an edge for every vocabulary piece that matches at a place, and a
byte-fallback edge for a character that is no piece. Forward filtering sums the weight of
all paths to every place; backward sampling draws the last edge in proportion to its share,
then the one before it. So a segmentation comes up in proportion to its probability.

No piece has a blank after another character, so the lattice splits before blanks. The chunks
of a batch are filtered side by side, longest first: place p of all chunks is one slice of an
array, and so is every step of the draws. Random numbers are a hash of seed, row key, chunk and
step: a row gets the same ids on every run, in any partition and after any retry.

Chunks of more than LONG characters (scripts without blanks, encoded data) are filtered one by
one: the pieces of SLICE places at a time are found by one pass per piece length, sums are
carried from slice to slice, and the draws find each slice's pieces again on their way back.
So they take time in proportion to their length, and a few numbers a character.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_BASE, _ODD = 0x100000001B3, 0xFF51AFD7ED558CCD
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a chunk that is filtered beside others at most, and places of a longer one at a time.
LONG, SLICE = 256, 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PieceLattice:
    """Weights: exp(alpha x log p). Unigram files carry log p as scores; a BPE file's scores
    are ranks, which stand for log p by Zipf's law (a piece of rank r has weight 1 / (r + 2))."""

    _made: dict[tuple, PieceLattice] = {}

    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes_ids, self.weights, texts = [0] * 256, {}, []
        ranked = min(model.get_score(i) for i in range(self.size) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)) < -200
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_ids[int(piece[3:-1], 16)] = i
                texts.append(bytes((int(piece[3:-1], 16),)))
                continue
            texts.append(b"" if model.is_control(i) else piece.replace(SPACE, " ").encode())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = -np.log(2.0 - model.get_score(i)) if ranked else model.get_score(i)
                self.weights[piece.replace(SPACE, " ")] = (float(np.exp(alpha * score)), i)
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.weights):
            raise ValueError("pieces may not hold a blank after another character, or a newline")
        self.fallback = min(w for w, _ in self.weights.values()) * float(np.exp(-10.0 * alpha))
        self.longest = max(map(len, self.weights))
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        keys = {p: self._hash(np.array([*map(ord, p)], dtype=np.uint64)) for p in self.weights}
        by = sorted(keys, key=keys.get)
        self.keys = np.array([keys[p] for p in by], dtype=np.uint64)
        if len(np.unique(self.keys)) < len(by):
            raise ValueError("two pieces share a hash")
        self.key_weights = np.array([self.weights[p][0] for p in by])
        self.key_ids = np.array([self.weights[p][1] for p in by], dtype=np.int32)
        self.key_lengths = np.array([len(p) for p in by])
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.keys >> np.uint64(42)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> int:
        h = 0
        for c in codes.tolist():
            h = (h * _BASE + c + 1) * _ODD & 0xFFFFFFFFFFFFFFFF
        return h

    @classmethod
    def of(cls, path: str, alpha: float = 1.0) -> PieceLattice:
        if (path, alpha) not in cls._made:
            cls._made[path, alpha] = cls(path, alpha)
        return cls._made[path, alpha]

    def _filter(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For chunks sorted by falling length: where each place's nodes begin (node = begin[p] +
        chunk), and per node the cumulative shares and ids of the edges that end there, by length.

        Hashes find the pieces: 64 bits, no two pieces alike, the length checked as well.
        """
        lengths = np.array([len(c) for c in chunks])
        longest, most = int(lengths[0]), self.longest
        flat = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        at_least = np.searchsorted(-lengths, -np.arange(longest + 1), side="right")  # chunks with a place p
        begin = np.concatenate(([0], np.cumsum(at_least)))
        letters = [flat[first[: at_least[i + 1]] + i] for i in range(longest)]
        weights = np.zeros((most, begin[-1]), dtype=np.float32)
        ids = np.zeros((most, begin[-1]), dtype=np.int32)
        base, odd = np.uint64(_BASE), np.uint64(_ODD)
        for i in range(longest):
            h = np.zeros(at_least[i + 1], dtype=np.uint64)
            for k in range(1, min(most, longest - i) + 1):
                n = at_least[i + k]
                h = (h[:n] * base + letters[i + k - 1][:n] + np.uint64(1)) * odd
                hit = np.flatnonzero(self.maybe[h >> np.uint64(42)])
                place = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
                good = (self.keys[place] == h[hit]) & (self.key_lengths[place] == k)
                hit, place = begin[i + k] + hit[good], place[good]
                weights[k - 1, hit] = self.key_weights[place]
                ids[k - 1, hit] = self.key_ids[place]
            here = slice(begin[i + 1], begin[i + 1] + at_least[i + 1])
            other = weights[0, here] == 0
            weights[0, here][other] = self.fallback
            ids[0, here][other] = self.size + letters[i][other].astype(np.int32)
        total = np.ones(begin[-1])
        for p in range(1, longest + 1):
            n = at_least[p]
            here = slice(begin[p], begin[p] + n)
            paths, sums = np.zeros(n), []
            for k in range(1, min(most, p) + 1):
                paths = paths + weights[k - 1, here] * total[begin[p - k] : begin[p - k] + n]
                sums.append(paths)
            total[here] = paths
            for k, run in enumerate(sums):
                weights[k, here] = run / paths
            weights[len(sums) - 1 :, here] = 1.0
            if p % most == 0:  # only ratios matter: lift what later places still use
                for j in range(p - most + 1, p + 1):
                    total[begin[j] : begin[j] + n] /= paths
        return begin, np.ascontiguousarray(weights.T), np.ascontiguousarray(ids.T)

    def _pieces_at(self, codes: np.ndarray, low: int, high: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """The edges that end at the places low + 1 to high: where each place's begin, and their lengths, weights and ids.

        Edges of a place come by rising length; a character that is no piece has its fallback.
        """
        first = max(0, low - self.longest + 1)
        part = codes[first:high].astype(np.uint64)
        base, odd = np.uint64(_BASE), np.uint64(_ODD)
        h, found = np.zeros(len(part), dtype=np.uint64), []
        for k in range(1, min(self.longest, len(part)) + 1):
            n = len(part) - k + 1
            h = (h[:n] * base + part[k - 1 :] + np.uint64(1)) * odd
            hit = np.flatnonzero(self.maybe[h >> np.uint64(42)])
            place = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
            good = (self.keys[place] == h[hit]) & (self.key_lengths[place] == k) & (first + hit + k > low)
            hit, place = hit[good], place[good]
            found.append((first + hit + k, np.full(len(hit), k), self.key_weights[place], self.key_ids[place]))
            if k == 1:
                other = np.setdiff1d(np.arange(low + 1, high + 1), found[0][0], assume_unique=True)
                found.append((other, np.ones(len(other), dtype=np.int64), np.full(len(other), self.fallback), self.size + codes[other - 1].astype(np.int32)))
        ends, lengths, weights, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lengths, ends))
        begin = np.searchsorted(ends[order], np.arange(low + 1, high + 2))
        return begin.tolist(), lengths[order].tolist(), weights[order].tolist(), ids[order].tolist()

    def _sample_long(self, chunk: str, state: int) -> np.ndarray:
        """A sampled id sequence of one chunk, whatever its length."""
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        n, most = len(codes), self.longest
        logs = np.zeros(n + 1)  # of all paths' weight to a place
        sums, shift = [1.0], 0.0  # of the last places, times exp(-shift)
        for low in range(0, n, SLICE):
            high = min(n, low + SLICE)
            begin, lengths, weights, _ = self._pieces_at(codes, low, high)
            sums, kept = sums[-most:], []
            for e, s in zip(begin[1:], begin[:-1], strict=True):
                total = 0.0
                for j in range(s, e):
                    total += weights[j] * sums[-lengths[j]]
                if total < 1e-150:  # only ratios matter: lift what later places still use
                    sums = [x * 1e150 for x in sums[-most:]]
                    total *= 1e150
                    shift -= 150 * math.log(10)
                sums.append(total)
                kept.append(math.log(total) + shift)
            logs[low + 1 : high + 1] = kept
        out, at, turn, chances = [], n, 0, []
        for low in range((n - 1) // SLICE * SLICE, -1, -SLICE):
            begin, lengths, weights, ids = self._pieces_at(codes, low, min(n, low + SLICE))
            near = logs[max(0, low - most) : low + SLICE + 1].tolist()
            zero = max(0, low - most)
            while at > low:
                if turn == len(chances):
                    turns = np.arange(turn + 1, turn + 4097).astype(np.uint64) * _GOLDEN
                    chances += ((_mixed(np.uint64(state) + turns) >> np.uint64(11)) * (1.0 / (1 << 53))).tolist()
                left, whole = chances[turn], near[at - zero]
                turn += 1
                for j in range(begin[at - low - 1], begin[at - low]):
                    left -= weights[j] * math.exp(near[at - lengths[j] - zero] - whole)
                    if left < 0:
                        break
                out.append(ids[j])
                at -= lengths[j]
        return np.array(out[::-1], dtype=np.int32)

    def sample(self, texts: list[str], keys: list[str], seed: int) -> list[np.ndarray]:
        """A sampled id sequence for each text."""
        found = [_CHUNKS.findall(t) for t in texts]
        sizes = [len(x) for x in found]
        if not sum(sizes):
            return [np.empty(0, dtype=np.int32) for _ in texts]
        chunks = sorted({c for x in found for c in x if len(c) <= LONG}, key=len, reverse=True)
        number = {c: i for i, c in enumerate(chunks)}
        word = np.array([number.get(c, -1) for x in found for c in x], dtype=np.int64)
        docs = np.repeat(np.arange(len(texts)), sizes)
        base = np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "replace"), seed) for k in keys], dtype=np.uint64)
        inner = np.arange(len(word)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), sizes)
        state = _mixed(base[docs] + (inner.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        if chunks:
            begin, shares, ids = self._filter(chunks)
            active = np.argsort(word, kind="stable")
            active = active[np.searchsorted(word[active], 0) :]
            at = np.array([len(c) for c in chunks])[word[active]]
            while len(active):
                turn = np.uint64((len(drawn) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                u = ((_mixed(state[active] + turn) >> np.uint64(40)) * (1.0 / (1 << 24))).astype(np.float32)
                node = begin[at] + word[active]
                edge = (shares[node] <= u[:, None]).sum(axis=1)
                drawn.append((active, ids[node, edge]))
                at = at - edge - 1
                keep = at > 0
                active, at = active[keep], at[keep]
        taken = np.zeros(len(word), dtype=np.int64)
        for who, _ in drawn:
            taken[who] += 1
        whole = {}
        for i in np.flatnonzero(word < 0).tolist():
            whole[i] = self._sample_long(found[docs[i]][inner[i]], int(state[i]))
            taken[i] = len(whole[i])
        ends = np.cumsum(taken)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        for i, (who, got) in enumerate(drawn):
            out[ends[who] - 1 - i] = got
        for i, got in whole.items():
            out[ends[i] - len(got) : ends[i]] = got
        stops = np.cumsum(np.bincount(docs, weights=taken, minlength=len(texts)).astype(np.int64))
        return [self._with_bytes(x) for x in np.split(out, stops[:-1])]

    def _with_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Fallback characters become their UTF-8 bytes' ids."""
        if not len(ids) or ids.max() < self.size:
            return ids
        out = []
        for i in ids.tolist():
            out += [i] if i < self.size else [self.bytes_ids[b] for b in chr(i - self.size).encode("utf-8", "replace")]
        return np.array(out, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The exact bytes that were encoded."""
        ids = np.asarray(ids, dtype=np.int64)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        shift = np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[shift + np.arange(len(shift))].tobytes()


_CHUNKS = re.compile(r" *[^ \n]+|\n| +")


def sample_encode(docs: DataFrame, model: str, seed: int = 0, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, text, ids array<int>): one sampled segmentation of every whole text.

    ``decoded`` adds the columns of ``decode_ids``, made from the ids in the same pass. A null
    text has null ids, an empty one none. A null id samples as the key '' does; rows with one id
    and text get one result, and rows that share an id with other texts their own. Other columns
    aren't read, whatever their names; an empty table stays empty. A long text takes memory for
    itself, and time in proportion to its length, with blanks or without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice.of(model, alpha)
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            at = 0
            while at < len(sizes):
                end, room = at, 1 << 18
                while end < len(sizes) and (end == at or room > 0):
                    room -= sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                texts, keys = part.column(1).to_pylist(), ["" if k is None else str(k) for k in part.column(0).to_pylist()]
                found = lattice.sample([t or "" for t in texts], keys, seed)
                ids = pa.array([None if t is None else x for t, x in zip(texts, found, strict=True)], pa.list_(pa.int32()))
                more = _decoded(lattice, ids) if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids, *more], names=["doc_id", "text", "ids", "decoded", "ids_crc32"][: 3 + len(more)])
                at = end

    import pyarrow.compute  # noqa: F401

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string, ids array<int>" + ", decoded string, ids_crc32 long" * decoded)


def _decoded(lattice: PieceLattice, column: pa.Array) -> list[pa.Array]:
    """The texts of id lists and the checksums of their ids as little-endian 32-bit numbers."""
    texts, crcs = [], []
    for x in column:
        ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else None
        texts.append(None if ids is None else lattice.decode(ids).decode("utf-8", "replace"))
        crcs.append(None if ids is None else zlib.crc32(ids.astype("<u4")))
    return [pa.array(texts, pa.string()), pa.array(crcs, pa.int64())]


def decode_ids(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` plus decoded (string) and ids_crc32; null ids give null in both. Columns of these names are replaced."""
    kept = encoded.drop("decoded", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice.of(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_decoded(lattice, batch.column(batch.schema.names.index(ids_col)))], names=[*batch.schema.names, "decoded", "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, decoded string, ids_crc32 long")


def op1_sampled_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfwise.llm.common import table

    both = sample_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), seed=17, decoded=True)
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids_crc32", F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"), F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull()).alias("lossless"))
