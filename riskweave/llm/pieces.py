"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A BPE model of the sentencepiece library gives pieces and scores; the merging
itself is done here. The agenda holds every pair of neighbours that forms a
piece, best score first, leftmost first. A candidate that comes up is skipped with
probability ``dropout``; it returns only when a neighbour's merge makes it a new
candidate. Every occurrence of a word has a draw of its own, keyed by (seed, doc_id,
text, copy, place), that says which steps are skipped: gaps between them are
geometric, so each step is skipped on its own. A run with the same seed gives
the same ids, and there is no bound on the segmentations of a word. With dropout 0
the ids are those of the library.

No piece of such a model has a space mark after another character, so merges
never cross the start of a word with the spaces before it, and a word is worked
out once per task memory for each set of skipped steps that is drawn. Characters outside the vocabulary, and a literal space
mark, become byte pieces, so decoding returns every text exactly.

Defined cases: a null or empty text has no pieces and decodes to the empty text;
a null doc_id counts as 0 for the draws; rows equal in doc_id, text and copy number
(a whole-number column the caller names with ``copy``; without it all count 0) get
equal ids; extra columns are ignored, whatever their names and types.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import mix, slices, text_bytes, whole_text
from riskweave.llm.memo import Memo, Numbered

DROPOUT, SEED = 0.1, 17
_MARK = "▁"
_LONG = 96
#: Words up to this length are kept in memory: n symbols take at most 3 (n - 1) steps, which fit a mask of 64 bits.
_KEPT = 21
_GAPS = 4096
_NEVER = (1 << 31) - 1
_M64 = (1 << 64) - 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Segmenter:
    """Merges of one model."""

    def __init__(self, path: str, dropout: float, seed: int):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = range(model.get_piece_size())
        plain = [i for i in pieces if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        names = {i: model.id_to_piece(i) for i in plain}
        self.id = {names[i]: i for i in plain}
        self.rank = {names[i]: place[model.get_score(i)] for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # A gap is at least k if 53 random bits are below 2**53 (1 - dropout)**k; the longest is "at least _GAPS".
        chances = (int((1 - dropout) ** k * (1 << 53)) for k in range(1, _GAPS + 1))
        self.gaps = np.array(sorted(c for c in chances if c), dtype=np.uint64)
        self.drops = dropout > 0
        self.seed = seed * 0xD6E8FEB86659FD93
        texts = [b""] * model.get_piece_size()
        for i in plain:
            texts[i] = names[i].replace(_MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            texts[i] = bytes([b])
        self.text_length = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length
        self.text_flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        # The same vocabulary as arrays: piece of every code point, and of every pair of pieces that is a piece.
        # Characters without a piece are negative, below the -1 that fills rows, and never merge.
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)
        for name, i in self.id.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.mark = self.id.get(_MARK, -2 - ord(_MARK))
        self.of_char[ord(" ")], self.of_char[ord(_MARK)] = self.mark, -2 - ord(_MARK)
        pairs = {}
        for name, i in self.id.items():
            for cut in range(1, len(name)):
                a, b = self.id.get(name[:cut]), self.id.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.pair_id = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int32)
        self.pair_rank = np.array([self.rank[names[i]] for i in self.pair_id.tolist()], dtype=np.int32)

    def _gap(self, draws: np.ndarray, level: int) -> np.ndarray:
        """Steps between the skipped ones before and at ``level``."""
        u = mix(mix(draws + np.uint64(self.seed & _M64)) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & _M64)) >> np.uint64(11)
        return len(self.gaps) - np.searchsorted(self.gaps, u, side="right")

    def _places(self, draw: int) -> Iterator[int]:
        """Skipped steps, in order."""
        one, at = np.array([draw & _M64], np.uint64), 0
        for level in count():
            gap = int(self._gap(one, level)[0])
            if gap < _GAPS:
                yield at + gap
                at += 1
            at += gap

    def split(self, word: str, draw: int) -> list[str]:
        """Pieces of one word as text, space marks for its leading spaces."""
        symbols = [c if c != _MARK else "" for c in word]
        symbols = [_MARK] + [_MARK if c == " " else c for c in symbols]
        return (self._long if len(symbols) > _LONG else self._short)(symbols, draw)

    def _short(self, symbols: list[str], draw: int) -> list[str]:
        rank, step = self.rank, -1
        skipped = self._places(draw) if self.drops else iter(())
        skip = next(skipped, None)
        ranks = [rank.get(a + b, _NEVER) if a and b else _NEVER for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            step += 1
            if step == skip:
                ranks[i], skip = _NEVER, next(skipped)
                continue
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(symbols[i] + symbols[i + 1], _NEVER) if symbols[i + 1] else _NEVER
            if i:
                ranks[i - 1] = rank.get(symbols[i - 1] + symbols[i], _NEVER) if symbols[i - 1] else _NEVER
        return symbols

    def _long(self, symbols: list[str], draw: int) -> list[str]:
        """The same with a heap and linked neighbours, for words of any length."""
        step, skipped = -1, self._places(draw) if self.drops else iter(())
        skip = next(skipped, None)
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbols[i] and symbols[j]:
                r = self.rank.get(symbols[i] + symbols[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, symbols[i] + symbols[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and symbols[i] + symbols[j] == joined):
                continue
            step += 1
            if step == skip:
                skip = next(skipped)
                continue
            symbols[i], alive[j] = joined, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def ids(self, word: str, draw: int) -> list[int]:
        out: list[int] = []
        for piece in self.split(word, draw):
            i = self.id.get(piece)
            if i is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in (piece or _MARK).encode()]
        return out


    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of pieces, _NEVER where they form none."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        known = (self.pair[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.pair_rank[at], _NEVER), self.pair_id[at]

    def _together(self, ids: np.ndarray, count: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_short`` for many words at a time: rows of piece ids, filled with -1; (rows, pieces per row, steps per row)."""
        done, sizes, steps = np.full(ids.shape, -1, np.int32), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        row, columns = np.arange(len(ids)), np.arange(ids.shape[1])
        step = -1
        rank = self._ranks(ids, np.hstack([ids[:, 1:], np.full((len(ids), 1), -1, np.int32)]))[0]
        while len(row):
            best = rank.min(1)
            live = best != _NEVER
            if not live.all():
                done[row[~live]], sizes[row[~live]] = ids[~live], count[~live]
                steps[row[~live]] = step + 1
                ids, count, row, rank, best = (x[live] for x in (ids, count, row, rank, best))
                if not len(row):
                    break
            step += 1
            every, at = np.arange(len(row)), rank.argmin(1)
            skip = skips[row, step]
            rank[every[skip], at[skip]] = _NEVER
            merged, place = every[~skip], at[~skip]
            if not len(merged):
                continue
            joined = self._ranks(ids[merged, place], ids[merged, place + 1])[1]
            moved = columns[None, :] + ((columns[None, :] > at[:, None]) & ~skip[:, None])
            last = moved == ids.shape[1]
            moved = np.minimum(moved, ids.shape[1] - 1)
            ids, rank = (np.take_along_axis(y, moved, 1) for y in (ids, rank))
            ids[last], rank[last] = -1, _NEVER
            ids[merged, place] = joined
            count[merged] -= 1
            after = np.where(place + 1 < ids.shape[1], ids[merged, np.minimum(place + 1, ids.shape[1] - 1)], -1)
            rank[merged, place] = self._ranks(joined, after)[0]
            inner = place > 0
            rank[merged[inner], place[inner] - 1] = self._ranks(ids[merged[inner], place[inner] - 1], joined[inner])[0]
        return done, sizes, steps

    def _drawn(self, draws: np.ndarray, steps: int) -> np.ndarray:
        """Skipped steps of every draw as a table of truth values."""
        out, row, place = np.zeros((len(draws), steps), dtype=bool), np.arange(len(draws)), self._gap(draws, 0)
        for level in count(1):
            row, place = row[place < steps], place[place < steps]
            if not len(row):
                return out
            out[row, place] = True
            place = place + 1 + self._gap(draws[row], level)

    def many(self, words: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, ids per word)."""
        draws = draws.astype(np.uint64)
        return self._many(words, lambda own, steps: self._drawn(draws[own], steps), draws)[:2]

    def masked(self, words: list[str], masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words end to end, ids per word, steps per word) of words up to _KEPT, with the steps of ``masks`` skipped."""
        return self._many(words, lambda own, steps: (masks[own][:, None] >> np.arange(steps, dtype=np.uint64)[None, :] & np.uint64(1)).astype(bool), None)

    def _many(self, words: list[str], skips, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        odd = sizes >= _LONG
        parts: list[np.ndarray] = []
        lengths, where, steps = (np.zeros(len(words), np.int64) for _ in range(3))
        used = 0
        plain = np.flatnonzero(~odd)
        plain = plain[np.argsort(sizes[plain], kind="stable")]
        for lo in range(0, len(plain), 8192):
            own = plain[lo : lo + 8192]
            width = int(sizes[own].max()) + 1
            column = np.arange(width)
            inside = column[None, :] <= sizes[own][:, None]
            at = np.where(inside, begins[own][:, None] + column[None, :] - 1, 0)
            ids = np.where(inside, points[np.clip(at, 0, max(len(points) - 1, 0))] if len(points) else 0, -1).astype(np.int32)
            ids[:, 0] = self.mark
            rows, counts, steps[own] = self._together(ids, sizes[own] + 1, skips(own, 3 * width))
            parts.append(rows[rows != -1])
            lengths[own], where[own] = counts, used + np.cumsum(counts) - counts
            used += int(counts.sum())
        for i in np.flatnonzero(odd).tolist():
            ids = self.ids(words[i], int(draws[i]))
            parts.append(np.array(ids, dtype=np.int32))
            lengths[i], where[i], used = len(ids), used, used + len(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        stops = np.cumsum(lengths)
        take = np.repeat(where - stops + lengths, lengths) + np.arange(used)
        return *self._spelled(flat[take], lengths), steps

    def _spelled(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of characters without a piece."""
        unknown = np.flatnonzero(flat < 0)
        if not len(unknown):
            return flat, lengths
        spelled = [[self.bytes[b] for b in chr(-2 - c).encode()] for c in flat[unknown].tolist()]
        width = np.ones(len(flat), np.int64)
        width[unknown] = [len(x) for x in spelled]
        out = np.repeat(flat, width)
        first = (np.cumsum(width) - width)[unknown]
        at = np.repeat(first, width[unknown]) + np.concatenate([np.arange(len(x)) for x in spelled])
        out[at] = [b for x in spelled for b in x]
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(lengths)])]
        return out, np.diff(ends)


class Drawn:
    """Ids of words under a draw for every occurrence, worked out once for each (word, set of skipped steps).

    These are the nodes of a tree per word: a node knows how many steps its run
    takes, and a further skip before the run's end leads to a child. At ``limit`` bytes the memory starts
    afresh, and a task empties it when it ends, so an idle worker holds none; longer words are not kept.
    """

    #: Bytes of a word in the table of words: its text, its number and its places in a list and a dictionary.
    WORD_BYTES = 160

    def __init__(self, segmenter: Segmenter, limit: int = 256 << 20):
        self.segmenter, self.limit = segmenter, limit
        self.reset()

    def held(self) -> int:
        """Bytes of all that is remembered, about."""
        arrays = (self.root, self.word, self.mask, self.start, self.length, self.steps, self.first, self.child, self.flat)
        return sum(a.nbytes for a in arrays) + self.WORD_BYTES * len(self.numbers)

    def reset(self) -> None:
        self.numbers, self.words = Numbered(), []
        self.root = np.full(1 << 12, -1, np.int32)
        self.word, self.mask = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.uint64)
        self.start, self.length, self.steps, self.first = (np.zeros(1 << 12, t) for t in (np.int64, np.int16, np.int16, np.int64))
        self.child, self.flat = np.full(1 << 14, -1, np.int32), np.zeros(1 << 14, np.int32)
        self.filled = self.used = self.places = 0

    def _learn(self, words: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Nodes of new (word, skipped steps)."""
        flat, lengths, steps = self.segmenter.masked([self.words[w] for w in words.tolist()], masks)
        begin, end = self.filled, self.filled + len(words)
        columns = {
            "word": words, "mask": masks, "length": lengths, "steps": steps,
            "start": self.used + np.cumsum(lengths) - lengths, "first": self.places + np.cumsum(steps) - steps,
        }
        for name, values in columns.items():
            setattr(self, name, Memo.room(getattr(self, name), end))
            getattr(self, name)[begin:end] = values
        self.flat = Memo.room(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.filled, self.used, self.places = end, self.used + len(flat), self.places + int(steps.sum())
        self.child = Memo.room(self.child, self.places, -1)
        return np.arange(begin, end, dtype=np.int32)

    def ids(self, words: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, ids per word)."""
        if self.held() > self.limit:
            self.reset()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.words) < len(self.numbers):
            fresh = np.arange(len(self.words), len(self.numbers))
            self.words.extend(list(self.numbers)[len(self.words) :])
            self.root = Memo.room(self.root, len(self.numbers), -1)
            fresh = fresh[np.fromiter((len(self.words[i]) <= _KEPT for i in fresh.tolist()), bool, len(fresh))]
            self.root[fresh] = self._learn(fresh, np.zeros(len(fresh), np.uint64))
        node = self.root[numbers]
        lengths, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = kept = np.flatnonzero(node >= 0)
        place = self.segmenter._gap(draws[live], 0)
        for level in count(1):
            before_end = place < self.steps[node[live]]
            live, place = live[before_end], place[before_end]
            if not len(live):
                break
            slots = self.first[node[live]] + place
            if (unknown := self.child[slots] < 0).any():
                new, one = np.unique(slots[unknown], return_index=True)
                parent, skip = node[live[unknown][one]], place[unknown][one].astype(np.uint64)
                nodes = self._learn(self.word[parent], self.mask[parent] | np.uint64(1) << skip)
                self.child[new] = nodes
            node[live] = self.child[slots]
            place = place + 1 + self.segmenter._gap(draws[live], level)
        lengths[kept], start[kept] = self.length[node[kept]], self.start[node[kept]]
        if len(kept) < len(words):
            other = np.flatnonzero(node < 0)
            flat, own = self.segmenter.many([words[i] for i in other.tolist()], draws[other])
            self.flat = Memo.room(self.flat, self.used + len(flat))
            self.flat[self.used : self.used + len(flat)] = flat  # room only until the next words are learned
            lengths[other], start[other] = own, self.used + np.cumsum(own) - own
        ends = np.cumsum(lengths)
        at = np.repeat(start - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.flat[at], lengths


@lru_cache(maxsize=2)
def _worker(path: str, dropout: float, seed: int) -> tuple[Segmenter, Drawn]:
    segmenter = Segmenter(path, dropout, seed)
    return segmenter, Drawn(segmenter)


_SPACED = re.compile(r" *[^ ]+| +")


def words_of(text: str) -> list[str]:
    """Words with the spaces before them, less the first (each word starts with one space mark)."""
    if not text:
        return []
    words = text.split(" ")
    return [w[1:] for w in _SPACED.findall(" " + text)] if "" in words else words


def _encode(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _worker(path, dropout, seed)
        try:
            yield from encoded(batches, memo)
        finally:
            memo.reset()
            pa.default_memory_pool().release_unused()

    def encoded(batches: Iterator[pa.RecordBatch], memo: Drawn) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words: list[str] = []
            counts, sums = [], []
            for text in batch.column("text").to_pylist():
                own = words_of(text or "")
                counts.append(len(own))
                sums.append(zlib.crc32((text or "").encode()))
                words += own
            counts = np.array(counts, dtype=np.int64)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            keys, copies = (batch.column(c).fill_null(0).to_numpy().astype(np.int64).view(np.uint64) for c in ("doc_id", "copy"))
            keys = mix(mix(mix(keys) + np.array(sums, np.uint64)) + copies)
            occurrence = np.arange(len(words), dtype=np.int64) - np.repeat(bounds[:-1], counts)
            ids, per_word = memo.ids(words, mix(np.repeat(keys, counts) + occurrence.view(np.uint64)))
            offsets = np.concatenate([[0], np.cumsum(per_word)])[bounds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "text", "ids"],
            )

    return run


def _decoded(segmenter: Segmenter, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets) of lists of ids; the first byte of each, a space, is dropped."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lengths = segmenter.text_length[ids]
    ends = np.cumsum(lengths)
    at = np.repeat(segmenter.text_start[ids] - ends + lengths, lengths)
    at += np.arange(len(at))
    data = segmenter.text_flat[at]
    bounds = np.concatenate([[0], ends])[offsets]
    keep = np.ones(len(data), dtype=bool)
    filled = np.diff(offsets) > 0
    keep[bounds[:-1][filled]] = False
    return data[keep], bounds - np.concatenate([[0], np.cumsum(filled)])


def _slim(docs: DataFrame, copy: str | None) -> DataFrame:
    number = F.lit(0).cast("bigint") if copy is None else F.col(copy).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text(docs).alias("text"), number.alias("copy"))


def encode(
    docs: DataFrame, model: str | None = None, dropout: float = DROPOUT, seed: int = SEED, copy: str | None = None
) -> DataFrame:
    """(doc_id, text, ids) of all rows; ``copy`` names the column that numbers the copies of a document."""
    run = _encode(model or default_model(), dropout, seed)
    return _slim(docs, copy).mapInArrow(run, "doc_id bigint, text string, ids array<int>")


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, _ = _worker(path, 0.0, 0)
        for batch in batches:
            data, offsets = _decoded(segmenter, batch.column("ids"))
            text = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digest(docs: DataFrame, copy: str | None = None) -> DataFrame:
    """Ids of all rows and what decoding them again gives: equal to the text or not."""
    path, dropout, seed = default_model(), DROPOUT, SEED
    encode_batches = _encode(path, dropout, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, _ = _worker(path, dropout, seed)
        for batch in encode_batches(batches):
            lists = batch.column("ids")
            data, ends = _decoded(segmenter, lists)
            original, starts = text_bytes(batch.column("text"))
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            if np.array_equal(ends, starts) and np.array_equal(data, original):
                same = np.ones(batch.num_rows, dtype=bool)
            else:
                pairs = zip(zip(ends[:-1], ends[1:], strict=True), zip(starts[:-1], starts[1:], strict=True), strict=True)
                same = np.array([np.array_equal(data[a:b], original[c:d]) for (a, b), (c, d) in pairs])
            sums = [zlib.crc32(np.ascontiguousarray(flat[a:b], dtype="<u4")) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64()), pa.array(same), lists],
                names=["doc_id", "n_tokens", "ids_crc32", "lossless", "ids"],
            )

    return _slim(docs, copy).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, lossless boolean, ids array<int>")
