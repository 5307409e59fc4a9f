"""SentencePiece encoding and decoding with a table of each prefix's unique last token.

A byte-pair model with merge priorities gives every prefix of a text exactly one encoding, so a table of the last token
of each prefix determines all ids. A trie walked from every position finds the tokens that match there; a match is the
last token of its prefix when it is compatible with the last token of the prefix before it. Two tokens are compatible
when merging them side by side never joins symbols over the boundary. Ids are then read off backwards from the end.

Spaces and line ends bound pieces in such models (checked when the model is read), so the stretches between them are
encoded once a worker and remembered. All steps run over numpy arrays of many stretches at once. A stretch that is long
goes through them as many overlapping windows at once: the table behind a point depends on the last tokens just before it
alone, so a window is right from where it agrees with the one before. Windows that don't agree are tried from other
beginnings, and what is still left is done one after the other.

Results: null and empty texts have no ids and decode to the empty text. Repeated rows are encoded alike. Bytes of
characters that the model lacks become byte tokens. Texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices, small_batches

SPACE = "▁"
#: A stretch longer than WINDOW characters is cut into windows of so many, each with RUN_UP characters of the one before.
WINDOW, RUN_UP = 512, 64
NEVER = np.int64(1 << 40)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTable:
    """The tables of one model. remember bounds the stretches that a worker keeps."""

    def __init__(self, model_file: str, remember: int = 50_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in plain):
            raise ValueError("pieces that hold a space after another character are not supported")
        scores = sorted({model.get_score(i) for i in plain}, reverse=True)
        order = {s: k for k, s in enumerate(scores)}
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self._symbols = {self.pieces[i]: i for i in plain}
        chars = {c for i in plain for c in self.pieces[i]}
        for c in sorted(chars):  # characters that only occur inside pieces
            self._symbols.setdefault(c, len(self._symbols) + n)
        self.cuts = "\n" not in chars
        self._unknown = n
        rank = {self._symbols[self.pieces[i]]: order[model.get_score(i)] for i in plain}
        merges = {}
        for i in plain:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self._symbols.get(p[:k]), self._symbols.get(p[k:])
                if a is not None and b is not None:
                    merges[a, b] = i
        self._spines(plain, merges, rank, n)
        keys = sorted((a << 24 | b, rank[t]) for (a, b), t in merges.items())
        self._pair = np.array([k for k, _ in keys], np.int64)
        self._pair_rank = np.array([r for _, r in keys], np.int64)
        self._trie(self._own)
        self._memo_key = np.full(1 << 20, -1, np.int64)
        self._memo = np.zeros(1 << 20, bool)
        self.remember = remember
        ordinary = set(plain)
        self._text = [self.pieces[i].replace(SPACE, " ").encode() if i in ordinary else b"" for i in range(n)]
        for b, i in enumerate(self.byte_id):
            if self.byte_id.any():
                self._text[i] = bytes([b])
        self._text[model.unk_id()] = b" \xe2\x81\x87 "
        self._text_len = np.array([len(t) for t in self._text], np.int64)
        self._text_at = np.concatenate([[0], np.cumsum(self._text_len)])
        self._text_bytes = np.frombuffer(b"".join(self._text), np.uint8)
        self._lead = np.array([p.startswith(SPACE) for p in self.pieces])
        self._stretch = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if self.cuts else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._flat, self._count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _spines(self, plain: list[int], merges: dict, rank: dict, n: int) -> None:
        """For each token merged on its own: the symbols at its two edges in turn, and up to which priority each stays. Tokens that merging never yields are left out."""
        left, right, self._own = {}, {}, []
        for i in plain:
            parts, l, r, worst = [self._symbols[c] for c in self.pieces[i]], [], [], -1
            first, last = parts[0], parts[-1]
            while len(parts) > 1:
                found = [(rank[t], k, t) for k in range(len(parts) - 1) if (t := merges.get((parts[k], parts[k + 1]))) is not None]
                if not found:
                    break
                p, k, t = min(found)
                worst = max(worst, p)
                if k == 0:
                    l.append((worst, t))
                if k == len(parts) - 2:
                    r.append((worst, t))
                parts[k : k + 2] = [t]
            if len(parts) == 1:
                self._own.append(i)
                left[i], right[i] = (first, l), (last, r)
        size, depth = n + 1 + len(self._symbols), 1 + max(max(len(x[1]) for x in (*left.values(), *right.values())), 1)

        def table(spine: dict) -> tuple[np.ndarray, np.ndarray]:
            symbol, until = np.zeros((size, depth), np.int64), np.full((size, depth), NEVER)
            symbol[:, 0] = np.arange(size)
            for i, (edge, steps) in spine.items():
                symbol[i, : len(steps) + 1] = [edge, *(t for _, t in steps)]
                until[i, : len(steps)] = [w for w, _ in steps]
            return symbol, until

        self._left, self._right = table(left), table(right)

    def _trie(self, own: list[int]) -> None:
        nodes, token = {}, [-1]
        for i in own:
            at = 0
            for c in self.pieces[i]:
                key = at << 21 | ord(c)
                if key not in nodes:
                    nodes[key] = len(token)
                    token.append(-1)
                at = nodes[key]
            token[at] = i
        keys = np.array(sorted(nodes), np.int64)
        self._edge, self._node = keys, np.array([nodes[int(k)] for k in keys], np.int64)
        self._token = np.array(token, np.int64)
        self._longest = max(len(self.pieces[i]) for i in own)
        self._length = np.ones(self._unknown + 1, np.int64)
        self._length[own] = [len(self.pieces[i]) for i in own]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 24 | b
        k = np.minimum(np.searchsorted(self._pair, key), len(self._pair) - 1)
        return np.where(self._pair[k] == key, self._pair_rank[k], NEVER)

    def _pairs_hold(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether no merge joins p and t. Both edges advance in order of priority; of equal priorities the left one is first."""
        good, live = np.ones(len(p), bool), np.arange(len(p))
        i, j = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        while len(live):
            pl, tl, il, jl = p[live], t[live], i[live], j[live]
            a, b = self._right[1][pl, il], self._left[1][tl, jl]
            c = self._rank_of(self._right[0][pl, il], self._left[0][tl, jl])
            joined = (c < a) & (c <= b) & (c < NEVER)
            good[live[joined]] = False
            on = ~joined & ~((a == NEVER) & (b == NEVER))
            first = a <= b
            i[live] += first & on
            j[live] += ~first & on
            live = live[on]
        return good

    def compatible(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        key = p << 24 | t
        with np.errstate(over="ignore"):
            slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        new = self._memo_key[slot] != key
        out = self._memo[slot]
        if new.any():
            some, back = np.unique(key[new], return_inverse=True)
            held = self._pairs_hold(some >> 24, some & 0xFFFFFF)
            out[new] = held[back]
            self._memo_key[slot[new]], self._memo[slot[new]] = key[new], held[back]
        return out

    def _long(self, chars: np.ndarray) -> np.ndarray:
        """The last token of each prefix of one long stretch, chars."""
        n, reach = len(chars), self._longest
        out = np.full(n + 1, -1, np.int64)
        first = min(n, WINDOW)
        out[: first + 1] = self._last_tokens(chars[None, :first], np.array([first]))[0]
        at = np.arange(WINDOW, n, WINDOW)  # a window stands for the prefixes that end after its beginning

        def tried(begins: np.ndarray, early: np.ndarray) -> np.ndarray:
            """Rows of last tokens from begins - reach on, each computed afresh from begins - RUN_UP - early."""
            size = np.minimum(begins + WINDOW, n) - begins + RUN_UP + early
            order = np.argsort(-size, kind="stable")
            wide = np.zeros((len(begins), int(size.max())), np.int64)
            on = np.arange(wide.shape[1]) < size[order][:, None]
            wide[on] = chars[((begins - RUN_UP - early)[order][:, None] + np.arange(wide.shape[1]))[on]]
            last = np.empty((len(begins), wide.shape[1] + 1), np.int64)
            last[order] = self._last_tokens(wide, size[order])
            return np.take_along_axis(last, np.minimum((RUN_UP + early - reach)[:, None] + np.arange(reach + WINDOW + 1), last.shape[1] - 1), 1)

        rows, done, liked = (tried(at, np.zeros(len(at), np.int64)) if len(at) else []), {}, set()

        def other(k: int, early: np.ndarray, known: np.ndarray) -> np.ndarray | None:
            """The row of window k that agrees with what is known, among those with other beginnings; computed for 32 windows at once."""
            early = early[early <= at[k] - RUN_UP]
            if not len(early):
                return None
            if (k, len(early)) not in done:
                done.clear()
                some = np.arange(k, min(k + 32, len(at)))
                found = tried(np.repeat(at[some], len(early)), np.tile(early, len(some))).reshape(len(some), len(early), -1)
                done.update({(w, len(early)): x for w, x in zip(some.tolist(), found, strict=True)})
            fit = np.flatnonzero((done[k, len(early)][:, 1 : reach + 1] == known).all(1))
            if not len(fit):
                return None
            liked.add(int(early[fit[0]]))
            return done[k, len(early)][fit[0]]

        for k, begin in enumerate(at.tolist()):
            end = min(begin + WINDOW, n)
            known = out[begin - reach + 1 : begin + 1]
            row = rows[k]
            if not (row[1 : reach + 1] == known).all():
                row = other(k, np.array(sorted(liked), np.int64), known) if 0 < len(liked) < 8 else None  # beginnings that have fitted before
                row = other(k, np.arange(1, RUN_UP), known) if row is None else row
                row = self._on(chars[begin - reach : end], out[begin - reach : begin + 1]) if row is None else row
            out[begin + 1 : end + 1] = row[reach + 1 : reach + 1 + end - begin]
        return out

    def _on(self, chars: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The last tokens of all prefixes of chars, of which those known come first."""
        last = np.full((1, len(chars) + 1), -1, np.int64)
        last[0, : len(known)] = known
        return self._last_tokens(chars[None], np.array([len(chars)]), last, len(known) - 1)[0]

    def _last_tokens(self, chars: np.ndarray, lengths: np.ndarray, last: np.ndarray | None = None, known: int = 0) -> np.ndarray:
        """chars: a row for each stretch, longest first. last[k, e]: the last token of the first e characters of row k; those up to `known` are given."""
        rows, width = chars.shape
        last = np.full((rows, width + 1), -1, np.int64) if last is None else last
        for s in range(max(0, known - self._longest), width):
            live = np.arange(np.searchsorted(-lengths, -s, side="left"))
            node = np.zeros(len(live), np.int64)
            for k in range(min(self._longest, width - s)):
                if k:
                    on = lengths[live] > s + k
                    live, node = live[on], node[on]
                if not len(live):
                    break
                key = node << 21 | chars[live, s + k]
                at = np.minimum(np.searchsorted(self._edge, key), len(self._edge) - 1)
                hit = self._edge[at] == key
                token = np.where(hit, self._token[self._node[at]], -1)
                if k == 0:
                    token = np.where(token < 0, self._unknown, token)  # a character that the model lacks stands alone
                fits = np.flatnonzero(token >= 0) if s + k + 1 > known else np.zeros(0, np.int64)
                if s and len(fits):
                    fits = fits[self.compatible(last[live[fits], s], token[fits])]
                last[live[fits], s + k + 1] = token[fits]
                live, node = live[hit], self._node[at][hit]
        return last

    def _ids(self, last: np.ndarray, lengths: np.ndarray, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Read the ids off backwards, one token of every stretch at a time. (all ids in order, ids of each stretch)"""
        at, live, found = lengths.copy(), np.arange(len(lengths)), []
        while len(live):
            token = last[live, at[live]]
            found.append((live, token, at[live] - 1))
            at[live] -= self._length[token]
            live = live[at[live] > 0]
        row, token, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, row))
        row, token, end = row[order], token[order], end[order]
        lacking = np.flatnonzero(token == self._unknown)
        if len(lacking):
            raw = [stretches[r][e].encode() for r, e in zip(row[lacking].tolist(), end[lacking].tolist(), strict=True)]
            many = np.ones(len(token), np.int64)
            many[lacking] = [len(x) for x in raw]
            row, first = np.repeat(row, many), np.cumsum(many) - many
            token = np.repeat(token, many)
            token[token == self._unknown] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return token, np.bincount(row, minlength=len(lengths))

    def _learn(self, stretches: list[str]) -> None:
        """Encode stretches that are not known yet; those of like length go together."""
        stretches.sort(key=len, reverse=True)
        at, flat, counts = 0, [self._flat], [self._count]
        while at < len(stretches):
            width = len(stretches[at])
            end = at
            while end < len(stretches) and (len(stretches[end]) * 2 > width or width <= 24) and (end - at) * width < 250_000 and not (end > at and width > 2 * WINDOW):
                end += 1
            some = stretches[at:end]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            chars = np.zeros((len(some), width), np.int64)
            chars[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
            last = self._long(chars[0])[None] if width > 2 * WINDOW else self._last_tokens(chars, lengths)
            ids, count = self._ids(last, lengths, some)
            self._known.update(zip(some, range(len(self._known), len(self._known) + len(some)), strict=True))
            flat.append(ids.astype(np.int32))
            counts.append(count)
            at = end
        self._flat, self._count = np.concatenate(flat), np.concatenate(counts)
        self._start = np.concatenate([[0], np.cumsum(self._count)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the offsets of each text's ids."""
        parts = [self._stretch.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        every = list(chain.from_iterable(parts))
        if not every:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if len(self._known) > self.remember:
            self._forget()
        rows = np.fromiter(map(self._known.get, every, repeat(-1)), np.int64, len(every))
        new = np.flatnonzero(rows < 0).tolist()
        if new:
            self._learn(list({every[k] for k in new}))
            rows[new] = [self._known[every[k]] for k in new]
        counts = self._count[rows]
        ends = np.cumsum(counts)
        ids = self._flat[np.repeat(self._start[rows] - (ends - counts), counts) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])
        return ids, upto[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids; the space that encoding put in front goes."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return [""] * (len(offsets) - 1)
        size = self._text_len[ids]
        ends = np.cumsum(size)
        raw = self._text_bytes[np.repeat(self._text_at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()
        upto = np.concatenate([[0], ends])[offsets]
        out = []
        for k in range(len(offsets) - 1):
            a = upto[k] + bool(offsets[k] < offsets[k + 1] and self._lead[ids[offsets[k]]])
            out.append(self._utf8(raw[a : upto[k + 1]]))
        return out

    @staticmethod
    def _utf8(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:  # ids that no text has: each stray byte is a replacement character
            out, at = [], 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            return "".join(out)


_TABLES: dict[str, PrefixTable] = {}


def prefix_table(model_file: str) -> PrefixTable:
    """One table a worker and model."""
    if model_file not in _TABLES:
        _TABLES[model_file] = PrefixTable(model_file)
    return _TABLES[model_file]


def encode_decode(docs: DataFrame, text: str = "text", model_file: str | None = None, rows_at_once: int = 400) -> DataFrame:
    """All columns but text, and ids (array of int) and decoded (the text that the ids stand for). Adds no shuffle."""
    small_batches(docs.sparkSession)
    model_file = model_file or default_model()
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for b in (part.slice(at, rows_at_once) for whole in batches for part in slices(whole, len(keep)) for at in range(0, part.num_rows, rows_at_once)):
            ids, offsets = table.encode(b.column(len(keep)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), lists, pa.array(table.decode(ids, offsets), pa.string())], names=[*keep, "ids", "decoded"])
        released()

    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def with_digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of ids and decoded."""
    return encoded.select(
        *(c for c in encoded.columns if c not in ("ids", "decoded")),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
