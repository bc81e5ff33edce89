"""SentencePiece encoding and decoding by a merge-type prefix table.

A byte-pair encoding has one last token for each prefix of a text. Left to right, the table
stores it: an automaton over the vocabulary gives the tokens that end here, longest first,
and the one is right whose neighbour, the last token of the prefix before it, is compatible
with it. From the end the ids are then recovered backwards.

Two tokens are compatible if merging their characters yields just these two: the right spine
of the first token's merge tree and the left spine of the second grow, the earlier merge first,
and no merge across the boundary may come before both. Tests are memoised.

A text is cut where no piece can span: before a run of space marks that follows another character,
at line feeds, which no piece holds, and between ASCII characters that stand beside each other in no piece. Parts are told apart by 64-bit hashes, encoded once and kept in a bounded memo of arrays.

Defined results: null and empty texts have no ids and decode to the empty text; ids outside the
vocabulary raise; repeated rows are encoded each; the text is read whole, in linear time.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, mix, raw_texts, slices, span_hashes, trimmed

#: Entries of each memo; it is emptied when full, which changes speed and never results.
MEMO, PAIRS = 600_000, 200_000
#: Bytes of text that are looked up in the memo at once.
MEMO_BYTES = 1 << 19
SPACE = "▁"
NEVER = 1 << 60


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte fallback and its prefix-table encoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes | None] = [None] * n
        self.raw: set[int] = set()
        self.byte_id: dict[int, int] = {}
        self.unknown = model.unk_id()
        self.id_of: dict[str, int] = {}
        score: dict[str, float] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
                self.byte_id[self.bytes_of[i][0]] = i
                self.raw.add(i)
            elif model.is_control(i):
                self.bytes_of[i] = b""
            elif model.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            else:
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                self.id_of[piece], score[piece] = i, model.get_score(i)
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: rank[s] for p, s in score.items()}
        self.spines: dict[str, tuple[list[str], list[str]]] = {}
        self.fits: dict[int, bool] = {-1: True}
        self.base = 1 << 17
        self.names = {i: p for p, i in self.id_of.items()}
        self.sizes = {i: len(p) for p, i in self.id_of.items()}
        self.single = {p: i for p, i in self.id_of.items() if len(p) == 1}
        self.memo = Memo(MEMO, np.int32)
        self.byte_size = np.fromiter((len(x or b"") for x in self.bytes_of), np.int64, n)
        #: Whether a text that begins with the token loses one leading space in decoding.
        self.opens_plainly = np.fromiter(((x or b"")[:1] == b" " and i not in self.raw and i != self.unknown for i, x in enumerate(self.bytes_of)), bool, n)
        #: ASCII characters (the mark as a space) that no piece holds one behind the other
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for p in self.id_of:
            for x, y in zip(p, p[1:], strict=False):
                x, y = x.replace(SPACE, " "), y.replace(SPACE, " ")
                if x < "\x80" and y < "\x80":
                    self.apart[ord(x), ord(y)] = False
        self.char_id = np.empty(0, np.int64)
        self._grow(0x3000)
        self.size_of = np.ones(n, np.int64)
        for i, size in self.sizes.items():
            self.size_of[i] = size
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in self.id_of:
            if len(p) > 1 and self.merged(p) == [p]:
                self.auto.add_word(p, self.id_of[p])
        self.auto.make_automaton()

    def merged(self, piece: str) -> list[str]:
        """The plain merge loop, used to lay out the merge tree of single pieces only."""
        parts = list(piece)
        left, right = {x: [x] for x in parts}, {x: [x] for x in parts}
        while len(parts) > 1:
            r, i = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if r == NEVER:
                break
            a, b = parts[i], parts[i + 1]
            left[a + b], right[a + b] = [*left[a], a + b], [*right[b], a + b]
            parts[i : i + 2] = [a + b]
        if len(parts) == 1:
            self.spines[piece] = left[piece], right[piece]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``; characters outside the vocabulary stand as ``base`` + code point."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
            self.fits[-1] = True
        known = self.fits[a << 24 | b] = self._compatible(self._name(a), self._name(b))
        return known

    def _name(self, i: int) -> str:
        return self.names[i] if i < self.base else chr(i - self.base)

    def _compatible(self, a: str, b: str) -> bool:
        right = self.spines[a][1] if len(a) > 1 else [a]
        left = self.spines[b][0] if len(b) > 1 else [b]
        i = j = 0
        while True:
            across = self.rank.get(right[i] + left[j], NEVER)
            up_a = self.rank[right[i + 1]] if i + 1 < len(right) else NEVER
            up_b = self.rank[left[j + 1]] if j + 1 < len(left) else NEVER
            if across < up_a and across <= up_b and across != NEVER:
                return False
            if up_a == up_b == NEVER:
                return True
            if up_a <= up_b:
                i += 1
            else:
                j += 1

    def tokens(self, part: str) -> list[int]:
        """Tokens of a part by the prefix table; the automaton names those that end at a place longest first."""
        fits, base, n = self.fits, self.base, len(part)
        last = [self.single.get(c, 0) or base + ord(c) for c in part]
        done = 0  # prefixes shorter than this have their last token
        for end, i in self.auto.iter(part):
            if end < done:
                continue
            done, before = end, end - self.sizes[i]
            if before >= 0:
                pair = last[before] << 24 | i
                ok = fits[pair] if pair in fits else self.fit(last[before], i)
                if not ok:
                    continue
            last[end] = i
            done = end + 1
        out, at, sizes = [], n - 1, self.sizes
        while at >= 0:
            i = last[at]
            out.append(i)
            at -= sizes[i] if i < base else 1
        out.reverse()
        return out

    def _ids(self, part: str) -> bytes:
        ids = self.tokens(part)
        if max(ids) >= self.base:
            ids = [x for i in ids for x in ([i] if i < self.base else (self.byte_id.get(b, self.unknown) for b in chr(i - self.base).encode()))]
        return array("i", ids).tobytes()

    def tables(self, parts: list[str]) -> list[bytes]:
        """Ids of many parts, as int32 bytes: the prefix tables of all parts are filled position by position together.

        ``parts`` hold no line feed; each must be non-empty.
        """
        joined = "\n".join(parts)
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(sizes + 1) - sizes - 1
        self._grow(int(chars.max()))
        last = self.char_id[chars]
        found = np.fromiter((end << 20 | value for end, value in self.auto.iter(joined)), np.int64)
        end, tok = found >> 20, found & 0xFFFFF
        size = self.size_of[tok]
        place = end - np.repeat(start, sizes + 1)[end] if end.size else end
        head = size > place  # the token is the whole prefix: nothing stands before it
        order = np.argsort(place, kind="stable")[::-1]  # the longest of a place comes last and so stays
        end, tok, size, place, head = end[order], tok[order], size[order], place[order], head[order]
        top = int(place[0]) if place.size else -1
        cuts = np.searchsorted(-place, -np.arange(top + 2), side="right")  # rows with place >= p end at cuts[p]
        fits, fit = self.fits, self.fit
        for p in range(1, top + 1):
            i, j = cuts[p + 1], cuts[p]
            if i == j:
                continue
            e, t = end[i:j], tok[i:j]
            pairs = np.where(head[i:j], -1, last[e - size[i:j]] << 24 | t).tolist()
            ok = [fits[k] if k in fits else fit(k >> 24, k & 0xFFFFFF) for k in pairs]
            good = np.array(ok, bool)
            last[e[good]] = t[good]
        at, path = start + sizes - 1, np.zeros(chars.size, bool)
        while at.size:
            path[at] = True
            step = last[at]
            at = at - np.where(step < self.base, self.size_of[np.minimum(step, self.size_of.size - 1)], 1)
            at = at[(at >= 0) & (chars[np.maximum(at, 0)] != 10)]
        ends = np.cumsum(path)
        lo, hi = (ends[start] - path[start]).tolist(), ends[start + sizes - 1].tolist()
        ids = last[path]
        raw = ids.astype(np.int32).tobytes()
        out = [raw[4 * i : 4 * j] for i, j in zip(lo, hi, strict=True)]
        if (ids >= self.base).any():
            for k in np.unique(np.searchsorted(np.array(hi), np.flatnonzero(ids >= self.base), side="right")).tolist():
                out[k] = self._ids(parts[k])
        return out

    def _grow(self, code: int) -> None:
        if code >= self.char_id.size:
            self.char_id = np.arange(self.base, self.base + 2 * code, dtype=np.int64)
            for c, i in self.single.items():
                if ord(c) < self.char_id.size:
                    self.char_id[ord(c)] = i

    def encode_raw(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts behind one another, and how many each has; ``at``: where each begins and the last ends."""
        if not raw:
            return np.empty(0, np.int32), np.zeros(at.size - 1, np.int64)
        b = np.frombuffer(raw, np.uint8)
        p1, line = np.append(np.uint8(10), b[:-1]), b == 10
        cut = line | (p1 == 10) | self.apart[p1, b]
        runs = np.flatnonzero((b == 32) & (p1 != 32))  # a run of spaces, but not behind a mark that is in the text
        mark = (runs > 2) & (b[runs - 1] == 0x81) & (b[runs - 2] == 0x96) & (b[runs - 3] == 0xE2)
        cut[runs[~mark]] = True
        first = at[:-1][np.diff(at) > 0]
        cut[first] = True
        start = np.flatnonzero(cut)
        ends = np.append(start[1:], len(raw))
        begins = np.searchsorted(start, first)

        def make(which: np.ndarray) -> list[bytes]:
            heads = set(begins.tolist())
            parts = [(SPACE if k in heads else "") + raw[a:b].decode("utf-8", "replace").replace(" ", SPACE) for k, a, b in zip(which.tolist(), start[which].tolist(), ends[which].tolist(), strict=True)]
            plain = [k for k, p in enumerate(parts) if p[-1] != "\n"]
            out = [b"".join(self._ids(c) for c in p) if p[-1] == "\n" else b"" for p in parts]
            for k, ids in zip(plain, self.tables([parts[k] for k in plain]) if plain else [], strict=True):
                out[k] = ids
            return out

        hashes = span_hashes(raw, start, ends - start)
        hashes[begins] = mix(hashes[begins] + np.uint64(1))  # a text's first part has one mark more
        ids, size = self.memo.look(hashes, make)
        edge = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(edge[np.searchsorted(start, at)])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        ids, sizes = self.encode_raw(b"".join(raw), np.cumsum([0, *map(len, raw)]))
        return np.split(ids, np.cumsum(sizes)[:-1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids that lie behind one another."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        edge = np.concatenate([[0], np.cumsum(self.byte_size[ids])])
        ends = np.cumsum(sizes)
        plain = (sizes > 0) & self.opens_plainly[ids[np.minimum(ends - sizes, max(0, ids.size - 1))]] if ids.size else np.zeros(sizes.size, bool)
        out = []
        for k, (i, j, a, z) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), edge[ends - sizes].tolist(), edge[ends].tolist(), strict=True)):
            try:
                out.append(raw[a + 1 : z].decode() if plain[k] else self.decode(ids[i:j].tolist()))
            except UnicodeDecodeError:
                out.append(self.decode(ids[i:j].tolist()))
        return out

    def decode(self, ids) -> str:
        """Text of ids: pieces with marks as spaces, byte pieces as UTF-8 (each byte that fits none as U+FFFD), less the leading mark."""
        table = self.bytes_of
        ids = [int(i) for i in ids]
        if any(i < 0 for i in ids):
            raise IndexError("piece id is out of range")
        raw = b"".join([table[i] for i in ids])
        try:
            out = raw.decode("utf-8")
        except UnicodeDecodeError:
            out, run = "", b""
            for i in [*ids, None]:
                if i in self.raw:
                    run += table[i]
                    continue
                out, run = out + _lenient(run), b""
                out += table[i].decode() if i is not None else ""
        first = next((i for i in ids if table[i]), None)
        return out[1:] if first is not None and first not in self.raw and out[:1] == " " and table[first][:1] == b" " and first != self.unknown else out


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        at += n
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (what the ids decode to) of every text. ``model`` is a path that executors can read."""
    path = model or default_model()
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches):
        p = pieces(path)
        for b in batches:
            raw, at = raw_texts(b.column(1))
            for i, j in slices(at, MEMO_BYTES):
                ids, sizes = p.encode_raw(bytes(raw[int(at[i]) : int(at[j])]), at[i : j + 1] - at[i])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, pa.array(p.decode_all(ids, sizes), pa.string())], ["doc_id", "ids", "decoded"])

    return df.mapInArrow(trimmed(work), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


