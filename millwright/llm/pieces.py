"""Operator 11: SentencePiece encoding and decoding with merge-type vocabularies.

A normalised text is a row of symbols (characters, or whole user-defined pieces).  All adjacent pairs
whose join is a piece stand on an agenda by score, the leftmost first among equals; the best pair is
joined, its new neighbours join the agenda, and pairs whose symbols have changed meanwhile are passed
over.  Joined pieces that the vocabulary marks as unused fall back into their parts, symbols without
a piece into bytes.

Two characters that stand next to each other in no piece are never joined: there a text falls into
units (before space marks, and between ASCII characters of that kind) that are encoded one by one, and
each distinct unit of a batch once.  Every distinct unit is checked against the sentencepiece library
before its ids are used, one call for each Arrow slice, behind a character that no piece holds.  A
vocabulary with pieces across space marks, without bytes to fall back to or with a normaliser of its own
has whole texts as units and whole texts checked.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm import textops as X

MARK = "▁"  # fixed value: the space mark of the file format
_LOADED: dict[str, Vocabulary] = {}


class Vocabulary:
    """A model file of merge type: pieces with scores, encoded by agenda, decoded by table.

    ``known`` remembers where in ``pool`` the ids of a unit are; it starts anew when ``room`` units are there,
    which costs time but never changes a result.
    """

    def __init__(self, path: str, room: int = 200_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto.FromString(self.library.serialized_model_proto())
        kind = pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("not a merge-type vocabulary")
        spec = model.normalizer_spec
        self.ids, self.score, self.unused, frozen = {}, {}, set(), []
        self.bytes_of, self.byte_id, self.control = [], {}, set()
        self.unknown = 0
        for k, p in enumerate(model.pieces):
            self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            if p.type == kind.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.bytes_of[k] = k, bytes([value])
            elif p.type == kind.CONTROL:
                self.control.add(k)
                self.bytes_of[k] = b""
            elif p.type == kind.UNKNOWN:
                self.unknown = k
                self.bytes_of[k] = model.trainer_spec.unk_surface.encode()
            else:
                self.ids[p.piece] = k
                self.score[p.piece] = -p.score
                if p.type == kind.UNUSED:
                    self.unused.add(p.piece)
                if p.type == kind.USER_DEFINED:
                    frozen.append(p.piece)
        self.frozen = set(frozen)
        self.symbols = re.compile("|".join(map(re.escape, sorted(frozen, key=len, reverse=True))) + "|.", re.DOTALL).findall if frozen else list
        self.fallback = model.trainer_spec.byte_fallback
        self.plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.strip = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.strip_all = spec.remove_extra_whitespaces
        across = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.by_unit = self.plain and not across and self.fallback
        self.room, self.known, self.pool, self.at = room, {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.no_blank = self.control | set(self.byte_id.values()) | {self.unknown}
        self.of_byte = np.array([self.byte_id.get(k, self.unknown) for k in range(256)], np.int32)
        #: [a, b]: no piece holds these ASCII characters next to each other
        apart = np.zeros((256, 256), bool)
        apart[:128, :128] = True
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if a < "\x80" and b < "\x80":
                    apart[ord(a), ord(b)] = False
        self.apart = apart.ravel()
        chars = set(chain.from_iterable(self.ids))
        self.guard = next(chr(c) for c in chain(range(0xE000, 0xF900), range(0xF0000, 0xFFFFE)) if chr(c) not in chars)
        self._tables()

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text by the agenda."""
        symbols: list = self.symbols(text)
        n, score, frozen = len(symbols), self.score, self.frozen
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        parts: dict[str, tuple[str, str]] = {}

        def pair(a: int, b: int) -> tuple | None:
            if frozen and (symbols[a] in frozen or symbols[b] in frozen):
                return None
            joined = symbols[a] + symbols[b]
            s = score.get(joined)
            if s is None:
                return None
            if joined in self.unused:
                parts[joined] = symbols[a], symbols[b]
            return s, a, b, len(joined)

        agenda = [p for k in range(n - 1) if (p := pair(k, k + 1))]
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = None
            after = right[a] = right[b]
            if after < n:
                left[after] = a
                if p := pair(a, after):
                    heapq.heappush(agenda, p)
            if left[a] >= 0 and (p := pair(left[a], a)):
                heapq.heappush(agenda, p)
        out: list[int] = []
        stack = [s for s in reversed(symbols) if s is not None]
        while stack:
            s = stack.pop()
            if s in self.unused and s in parts:
                stack += parts[s][::-1]
            elif s in self.ids:
                out.append(self.ids[s])
            elif self.fallback:
                out += [self.byte_id[c] for c in s.encode()]
            elif not out or out[-1] != self.unknown:  # neighbours without a piece are one unknown
                out.append(self.unknown)
        return out

    def _tables(self) -> None:
        """Numbers for symbols, and what joining two of them gives: a hash table of pairs of numbers."""
        number = dict(self.ids)
        for c in sorted(set(chain.from_iterable(self.ids)) - self.ids.keys()):
            number[c] = -len(number) - 2  # a character that only longer pieces have
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        joins = [(number[p[:k]], number[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, join = np.array(joins, np.int64).reshape(-1, 3).T
        self.rank = np.full(len(self.bytes_of), np.inf)
        for p, i in self.ids.items():
            self.rank[i] = self.score[p]
        self.slots = 1 << max(4, int(4 * len(joins)).bit_length())
        self.pair_key, self.pair_join = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int32)
        key = self._key(left, right)
        at, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):  # of those that want one free slot the first takes it, the others go one on
            self.probes += 1
            free = todo[self.pair_key[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.pair_key[at[won]], self.pair_join[at[won]] = key[won], join[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & (self.slots - 1)

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.int64) + (1 << 30)) << 31) + right.astype(np.int64) + (1 << 30)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (X.mix64(key.view(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, or -1."""
        key = self._key(left, right)
        at, out = self._slot(key), np.full(len(key), -1, np.int32)
        todo = np.flatnonzero((left != -1) & (right != -1))
        for _ in range(self.probes):
            found = self.pair_key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.pair_join[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (self.slots - 1)
        return out

    def merge_many(self, units: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of units of ``size`` characters at most: their agendas are the rows of one matrix, and each
        round takes the best pair of every row, the leftmost of equals.  (Ids end to end, ids of each unit.)"""
        n = len(units)
        length = np.fromiter(map(len, units), np.int64, n)
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(n), length)
        col = np.arange(len(chars)) - np.repeat(np.cumsum(length) - length, length)
        symbol = np.full((n, size), -1, np.int32)
        symbol[row, col] = self.of_char[chars]
        alive = np.arange(size) < length[:, None]
        after = np.where(alive, np.arange(1, size + 1), size)
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        join = np.full((n, size), -1, np.int32)
        inside = col + 1 < length[row]
        r, c = row[inside], col[inside]
        join[r, c] = self.joined(symbol[r, c], symbol[r, c + 1])
        agenda = np.where(join >= 0, self.rank[join], np.inf)
        rows = np.arange(n)
        while len(rows):
            a = agenda[rows].argmin(1)
            more = agenda[rows, a] < np.inf
            rows, a = rows[more], a[more]
            b = after[rows, a]
            symbol[rows, a] = join[rows, a]
            alive[rows, b] = False
            agenda[rows, b] = np.inf
            c = after[rows, a] = after[rows, b]
            for left, right, ok in ((a, c, c < length[rows]), (before[rows, a], a, before[rows, a] >= 0)):
                k, x, y = rows[ok], left[ok], right[ok]
                before[k, y] = x
                j = self.joined(symbol[k, x], symbol[k, y])
                join[k, x], agenda[k, x] = j, np.where(j >= 0, self.rank[j], np.inf)
                agenda[rows[~ok], left[~ok]] = np.inf
        many, whole = alive.sum(1), symbol[alive]
        lost = np.flatnonzero(whole < 0)
        if not len(lost):
            return whole, many
        code = np.zeros((n, size), np.uint32)
        code[row, col] = chars
        text = code[alive][lost]
        wide = 1 + (text > 0x7F) + (text > 0x7FF) + (text > 0xFFFF).astype(np.int64)
        width = np.ones(len(whole), np.int64)
        width[lost] = wide
        out = np.repeat(whole, width)
        end = np.cumsum(width)
        place = np.repeat((end - width)[lost] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
        out[place] = self.of_byte[np.frombuffer(text.tobytes().decode("utf-32-le").encode(), np.uint8)]
        last = np.append(0, end)[np.append(0, np.cumsum(many))]
        return out, np.diff(last)

    def encode_units(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the distinct units in another order, their ids end to end, ids of each), checked against the library."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        short = () if self.frozen or self.unused else ((0, 8), (8, 12), (12, 20), (20, 32))
        names, ids, sizes = [], [], []
        for least, most in short:
            some = [units[k] for k in np.flatnonzero((size > least) & (size <= most))]
            flat, many = self.merge_many(some, most)
            names += some
            ids.append(flat)
            sizes.append(many)
        rest = [units[k] for k in np.flatnonzero(size > 32)] if short else units
        own = [self.merge(u) for u in rest]
        names += rest
        flat = np.concatenate([*ids, np.fromiter(chain.from_iterable(own), np.int32)])
        many = np.concatenate([*sizes, np.fromiter(map(len, own), np.int64)])
        theirs = self.library.encode([self.guard + u.replace(MARK, " ") for u in names], num_threads=1)
        front = 1 + len(self.guard.encode())  # ids of the first space mark and of the guard
        sizes = np.fromiter(map(len, theirs), np.int64)
        got = np.fromiter(chain.from_iterable(theirs), np.int32)
        inner = np.arange(len(got)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= front
        if not (np.array_equal(many + front, sizes) and np.array_equal(flat, got[inner])):
            raise ValueError(f"the library encodes a unit otherwise, one of {names[:20]}")
        return names, flat, many

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [self.merge(self.normalize(t)) for t in texts]
        for t, a, b in zip(texts, own, self.library.encode(texts, num_threads=1)):
            if a != b:
                raise ValueError(f"the library encodes {t[:80]!r} otherwise")
        return np.fromiter(chain.from_iterable(own), np.int32), np.cumsum([0, *map(len, own)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts in them)."""
        if not self.by_unit:
            return self._texts(texts)
        whole = [self.normalize(t).encode() for t in texts]
        bound = np.cumsum([0, *map(len, whole)])
        body = np.frombuffer(b"".join(whole), np.uint8)
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lead, mid, last = np.frombuffer(MARK.encode(), np.uint8)
        mark = np.zeros(len(body) + 3, bool)
        mark[3:-2] = (body[:-2] == lead) & (body[1:-1] == mid) & (body[2:] == last)
        first = mark[3:] & ~mark[:-3]
        first[1:] |= self.apart[body[:-1].astype(np.uint16) << 8 | body[1:]]
        first[bound[:-1][np.diff(bound) > 0]] = True
        start = np.append(np.flatnonzero(first), len(body))
        units = pa.StringArray.from_buffers(len(start) - 1, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(body)).dictionary_encode()
        distinct, place = units.dictionary.to_pylist(), units.indices.to_numpy()
        if len(self.known) > self.room:
            self.known, self.pool, self.at = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        at = np.fromiter((self.known.get(u, -1) for u in distinct), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            names, ids, many = self.encode_units([distinct[k] for k in new])
            self.known.update(zip(names, range(len(self.at) - 1, len(self.at) - 1 + len(new))))
            at[new] = np.fromiter((self.known[distinct[k]] for k in new), np.int64, len(new))
            self.pool = np.concatenate((self.pool, ids))
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(many)))
        at = at[place]
        size = self.at[at + 1] - self.at[at]
        end = np.cumsum(size)
        out = self.pool[np.arange(end[-1], dtype=np.int32) + np.repeat((self.at[at] - end + size).astype(np.int32), size)]
        return out, np.concatenate(([0], end))[np.searchsorted(start, bound)]

    def decode(self, ids: list[int]) -> str:
        """Pieces end to end, space marks as blanks, bytes that are no UTF-8 as U+FFFD each; the blank that
        normalising puts in front goes."""
        table, k = self.bytes_of, 0
        while k < len(ids) and ids[k] in self.control:
            k += 1
        text = b"".join(map(table.__getitem__, ids))
        if self.strip and k < len(ids) and ids[k] not in self.no_blank and text[:1] == b" ":
            text = text.lstrip(b" ") if self.strip_all else text[1:]
        try:
            return text.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = batch.column("text")
            _, off = X.flat(texts)
            for lo, hi in X.slices(off, 1 << 21):
                ids, at = vocab.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "text"), column], names=[*(c for c in batch.schema.names if c != "text"), "ids"])

    return run


def _decode(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            ids, names = batch.column("ids").fill_null(pa.scalar([], pa.list_(pa.int32()))) if batch.column("ids").null_count else batch.column("ids"), batch.schema.names
            off = ids.offsets.to_numpy().astype(np.int64)
            for lo, hi in X.slices(off, 1 << 20):
                flat = ids.values.slice(off[lo], off[hi] - off[lo]).to_numpy().tolist()
                at = (off[lo : hi + 1] - off[lo]).tolist()
                rows = [flat[a:b] for a, b in zip(at, at[1:])]
                own = list(map(vocab.decode, rows))
                if check and own != vocab.library.decode(rows, num_threads=1):
                    raise ValueError("the library decodes otherwise")
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(own, pa.string())], names=[*names, "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, without begin and end ids.

    ``path`` is a file that every worker has, as the installed vocabularies are.  A null or empty text has
    no ids; of very long texts only the distinct units are held besides the text and its ids.  Rows that
    repeat come out as often as they came in, a null id stays null, an empty table gives an empty one and
    further columns, whatever their names, are left out.  A unit that the library encodes otherwise ends
    the job with an error.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, check: bool = True) -> DataFrame:
    """Adds ``decoded``, the text of each row's ``ids``; no ids and null give an empty text.

    With ``check`` every text is compared with the library's ``decode``, a slice of rows at a time."""
    rows = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(path, check), "doc_id long, ids array<int>, decoded string")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``decode``'s rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
