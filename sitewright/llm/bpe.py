"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for all new words of a batch in one automaton pass. A sequence of tokens is what
exact merging gives if and only if each token encodes to itself and each adjacent pair encodes to itself; so every
adjacent pair is tested, all at once, by undoing merges on both sides of its seam. Only words with a failing pair are
merged exactly.

The words are those of the tokenizer file's byte-level splitting. Before each space that a character other than white
space follows, the text falls into independent pieces; pieces are remembered with their ids and with the bytes that
these ids decode to. The file's special tokens are recognised in the text, as its library does. A file that asks for
another kind of splitting, normalising or merging is refused.

Defined results: a null text is the empty text with no tokens; ids may be null or repeat; texts of any length are
read whole; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import pickle
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, released, trimmed

WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WHITE_SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | set(map(chr, range(0x2000, 0x200B)))
REMEMBERED = 120_000  # pieces in each half of what a worker keeps
SHORT_WORD, NO_MERGE = 64, 1 << 60
SHIFT = 20
RUN_CHARS = 4 << 20


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def load_file(path: str) -> dict:
    """What the executors need of a tokenizer file: a fixed amount, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    splitting, model = data.get("pre_tokenizer") or {}, data["model"]
    plain = splitting.get("type") == "ByteLevel" and not splitting.get("add_prefix_space") and splitting.get("use_regex", True) and not data.get("normalizer")
    if not plain or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
        raise ValueError(f"{path}: only byte-level BPE without normalising, prefix space or shortcuts past merging is supported")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    return {"vocab": data["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in data["added_tokens"]}}


class Memory:
    """Pieces with their ids and with the bytes that these decode to. When as many as wanted are held they become the
    older half, from which those that are met again come back; what was older before is forgotten."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def age(self, most: int) -> None:
        if len(self.ids) > most:
            self.older, self.ids, self.raw = (self.ids, self.raw), {}, {}

    def unknown(self, pieces: set[str]) -> list[str]:
        """Those of the pieces that must be encoded."""
        new = pieces.difference(self.ids)
        ids, raw = self.older
        again = new.intersection(ids)
        for p in again:
            self.ids[p], self.raw[p] = ids[p], raw[p]
        return sorted(new.difference(again))


class Codec:
    def __init__(self, file: dict) -> None:
        letters = byte_letters()
        self.to_letters = {i: c for i, c in enumerate(letters)}
        to_byte = {c: i for i, c in enumerate(letters)}
        self.vocab: dict[str, int] = file["vocab"]
        self.special: dict[str, int] = file["special"]
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        for s, i in self.vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in s)
        self.letters_of_id = np.zeros(size, np.int64)
        for s, i in self.vocab.items():
            self.letters_of_id[i] = len(s)
        # rank of a pair's merge, and what it makes; a token's own rank is -1 for single bytes
        self.rank_of: dict[int, int] = {}
        self.rank_of_parts: dict[tuple[str, str], int] = {}
        self.made: list[int] = []
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1, np.int64)
        for rank, (a, b) in enumerate(file["merges"]):
            i = self.vocab[a + b]
            self.made.append(i)
            self.rank_of_parts.setdefault((a, b), rank)
            self.rank_of.setdefault(self.vocab[a] << SHIFT | self.vocab[b], rank)
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = rank, self.vocab[a], self.vocab[b]
        pairs = sorted(self.rank_of.items())
        self.pair_keys, self.pair_ranks = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.matcher = ahocorasick.Automaton()
        for s, i in self.vocab.items():
            self.matcher.add_word(s, i)
        self.matcher.make_automaton()
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.heads, self.pieces = Memory(), Memory()
        self.good_pairs = np.zeros(0, np.int64)
        self.bad_pairs = np.zeros(0, np.int64)
        self.own = np.zeros(size, bool)
        for s, i in self.vocab.items():
            self.own[i] = len(s) == 1 or self.exact(s) == [i]

    def forget(self) -> None:
        """Lets go of all remembered pieces: a worker that waits for other work should hold no more than the vocabulary."""
        self.heads, self.pieces = Memory(), Memory()
        self.good_pairs = self.bad_pairs = np.zeros(0, np.int64)
        trimmed()

    # exact merging

    def exact(self, word: str) -> list[int]:
        """Merges by rank, leftmost first. Short words keep the ranks of their pairs in a list; longer ones a heap of pairs
        over a linked list, so that they take n log n."""
        if len(word) > SHORT_WORD:
            return self._exact_long([self.vocab[c] for c in word])
        get, parts = self.rank_of_parts.get, list(word)
        ranks = list(map(get, zip(parts, parts[1:]), repeat(NO_MERGE)))
        while ranks and (rank := min(ranks)) < NO_MERGE:
            i = ranks.index(rank)
            whole = parts[i] + parts[i + 1]
            parts[i : i + 2] = [whole]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], whole), NO_MERGE)
            if i < len(ranks):
                ranks[i] = get((whole, parts[i + 1]), NO_MERGE)
        return [self.vocab[x] for x in parts]

    def _exact_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := self.rank_of.get(ids[i] << SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i] = self.made[rank]
            ids[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (rank := self.rank_of.get(ids[x] << SHIFT | ids[y])) is not None:
                    heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    # verification

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of two tokens' bytes gives these two tokens: undo the later merge of both sides and
        look whether a merge across the seam would have come before it."""
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            keys = x << SHIFT | y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.iinfo(np.int64).max)
            broken = rank < limit[live]
            ok[live[broken]] = False
            live, x, y = live[~broken], x[~broken], y[~broken]
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry  # of equal ranks the left token was made first, so the right one is undone
            done = (rx < 0) & (ry < 0)
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~done]
        return ok

    def pairs_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, inverse = np.unique(a << SHIFT | b, return_inverse=True)
        new = keys[~(np.isin(keys, self.good_pairs, assume_unique=True) | np.isin(keys, self.bad_pairs, assume_unique=True))]
        if len(new):
            ok = self.compatible(new >> SHIFT, new & ((1 << SHIFT) - 1))
            if len(self.good_pairs) + len(self.bad_pairs) > 2_000_000:
                self.good_pairs = self.bad_pairs = np.zeros(0, np.int64)
                return self.compatible(keys >> SHIFT, keys & ((1 << SHIFT) - 1))[inverse]
            self.good_pairs, self.bad_pairs = np.union1d(self.good_pairs, new[ok]), np.union1d(self.bad_pairs, new[~ok])
        return np.isin(keys, self.good_pairs, assume_unique=True)[inverse]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        words: list[str] = []
        first = [0]
        for piece in pieces:
            words += [w.encode().decode("latin-1").translate(self.to_letters) for w in self.words.findall(piece)]
            first.append(len(words))
        text = " ".join(words)
        found = list(self.matcher.iter_long(text))
        ends, ids = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        word = np.searchsorted(starts, ends, "right") - 1
        held = np.bincount(word, self.letters_of_id[ids], len(words)).astype(np.int64) == sizes
        held &= np.bincount(word, ~self.own[ids], len(words)) == 0
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        holds = self.pairs_hold(ids[inner], ids[inner + 1]) if len(inner) else np.zeros(0, bool)
        held[word[inner[~holds]]] = False
        bounds = np.searchsorted(word, np.arange(len(words) + 1))
        packed = ids.astype("<u4").tobytes()
        mended = {w: np.array(self.exact(words[w]), "<u4").tobytes() for w in np.flatnonzero(~held).tolist()}
        self.proposed, self.failed = len(words), len(mended)
        bounds, out = (bounds * 4).tolist(), []
        bad = np.concatenate([[0], np.cumsum(~held)]).tolist()
        for p in range(len(pieces)):
            a, b = first[p], first[p + 1]
            if bad[a] == bad[b]:
                out.append(packed[bounds[a] : bounds[b]])
            else:
                out.append(b"".join(mended[w] if w in mended else packed[bounds[w] : bounds[w + 1]] for w in range(a, b)))
        return out

    def split(self, text: str) -> list[str]:
        """Pieces whose encodings joined are the text's: the text is cut before each space that a character other than
        white space follows. The first piece is as it stands; the others are without that space."""
        parts = text.split(" ")
        if not any(self.needs_mending(p) for p in set(parts).difference(self.pieces.ids)):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if self.needs_mending(p):
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    @staticmethod
    def needs_mending(part: str) -> bool:
        return not part or part[0] in WHITE_SPACE

    def remember(self, known: Memory, pieces: list[str], before: str) -> None:
        """Keeps the ids of new pieces, and the bytes that these ids decode to."""
        if not pieces:
            return
        found = self.encode_pieces([before + p for p in pieces])
        ids = np.frombuffer(b"".join(found), "<u4")
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.cumsum([0] + [len(x) // 4 for x in found])].tolist()
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        known.ids.update(zip(pieces, found, strict=True))
        known.raw.update((p, data[a:b]) for p, a, b in zip(pieces, ends[:-1], ends[1:], strict=True))

    def both_ways(self, texts: list[str], remembered: int = REMEMBERED) -> list[tuple[bytes, bytes]]:
        """Of each text its ids, and the bytes that they decode to."""
        self.pieces.age(remembered)
        self.heads.age(remembered // 8)  # of few texts the first piece comes back
        sections: list[list[list[str] | int]] = []
        heads: set[str] = set()
        rest: set[str] = set()
        for text in texts:
            parts: list[list[str] | int] = []
            for part in self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]:
                if part in self.special:
                    parts.append(self.special[part])
                elif part:
                    cut = self.split(part)
                    heads.add(cut[0])
                    rest.update(cut[1:])
                    parts.append(cut)
            sections.append(parts)
        self.remember(self.heads, self.heads.unknown(heads), "")
        self.remember(self.pieces, self.pieces.unknown(rest), " ")
        out = []
        for parts in sections:
            ids: list[bytes] = []
            raw: list[bytes] = []
            for part in parts:
                if isinstance(part, int):
                    ids.append(part.to_bytes(4, "little"))
                    raw.append(self.bytes_of[part])
                else:
                    ids += [self.heads.ids[part[0]], *map(self.pieces.ids.__getitem__, part[1:])]
                    raw += [self.heads.raw[part[0]], *map(self.pieces.raw.__getitem__, part[1:])]
            out.append((b"".join(ids), b"".join(raw)))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [ids for ids, _ in self.both_ways(texts)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _codec(shared) -> Codec:
    """One codec for each worker process and tokenizer; it outlives tasks."""
    kept = sys.modules.setdefault("_corpus_codecs", types.ModuleType("_corpus_codecs"))
    found = vars(kept).get(shared.value["name"])
    if found is None:
        found = vars(kept)[shared.value["name"]] = Codec(pickle.loads(zlib.decompress(shared.value["file"])))
    return found


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast({"name": path, "file": zlib.compress(pickle.dumps(load_file(path)))})  # a vocabulary: fixed size, packed as workers keep it


def _slices(texts: pa.Array, most: int) -> Iterator[list[str]]:
    """The texts in runs of about `most` characters, read from Arrow as they are needed."""
    run, size = [], 0
    for i in range(0, len(texts), 64):
        for text in texts.slice(i, 64).to_pylist():
            run.append(text or "")
            size += len(run[-1])
            if size >= most:
                yield run
                run, size = [], 0
    if run:
        yield run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers)."""
    shared = _shared(docs, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in released(batches):
            ids = [x for run in _slices(batch.column("text"), RUN_CHARS) for x in codec.encode_batch(run)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from encode_documents() rows."""
    shared = _shared(encoded, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch, (ids,) in arrow_rows(batches, "ids"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or b"") for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", run_chars: int = RUN_CHARS, remembered: int = REMEMBERED, keep_codec: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass over the texts, about run_chars characters at a time:
    longer runs, and more remembered pieces, take less time and more memory, and give the same rows. Without keep_codec each task builds its own codec, and
    workers that wait for other work hold nothing of it."""
    shared = _shared(docs, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in released(batches):
            n, a, b = [], [], []
            for run in _slices(batch.column("text"), run_chars):
                for ids, raw in codec.both_ways(run, remembered):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep_codec:
            vars(sys.modules["_corpus_codecs"]).pop(shared.value["name"], None)
            codec.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
