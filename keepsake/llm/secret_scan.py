"""Secrets: three patterns, and the tokens that a linear-chain conditional random field tags as secret.

Base spans are `assign`, `access` and `hex`, each kind found from the left without overlaps; matches that are too short are
dropped. Offsets are code points.

The field tags tokens as outside, begin or inside of a secret. Tokens are runs of ASCII letters, digits, `+/_-` and bytes
over 127, and every other character but blanks. A token's features are its shape (length, kinds of characters, changes
between them, vowels), its word and its first letters; those of the two tokens before and the one after count as well, and so
do three of the file: length, share of digits, share of punctuation. It is trained here, by the likelihood of tag sequences
(forward-backward in numpy), on windows of WINDOW tokens: at most `positives` around base spans, whose values are tagged, and
at most `negatives` of texts without any, both the first by hash. Labels, ids, languages and sources are not read.

Every token of every whole text is decoded by Viterbi. Where a token's score for outside exceeds the others by more than all
transitions could make up, the best sequence is outside there for sure, so sequences are decoded between such tokens. Tagged
spans that overlap no base span are added, as kind `crf`.

Results: null and empty texts have no spans. Equal texts get equal spans; repeated rows stay. Without base spans in the table
there is nothing to learn and nothing is added. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, slices, small_batches, span_hashes, stored, text_bytes

KINDS = ("assign", "access", "hex")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api")).replace("[Aa][Pp][Ii]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
PATTERNS = {
    "assign": rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
}
_FIND = {k: re.compile(p) for k, p in PATTERNS.items()}
#: What a text has that has a match.
_MAY = {"assign": rf"""(?:{_NAMES})["']?\x20*[:=]""", "access": "AKIA", "hex": "[0-9a-f]{24}"}
_LEAST = {"assign": 6, "access": 20, "hex": 24}

WINDOW, BEFORE = 24, 2
O, B, I = 0, 1, 2  # noqa: E741
#: Sizes of the features of a token: length, kinds, changes, only hex by length, marks, vowels, word, beginning.
SIZES = (16, 24, 8, 32, 8, 8, 4096, 1024)
FILE_SIZES = (12, 6, 6)
_AT = np.concatenate([[0], np.cumsum(SIZES)]).astype(np.int64)
_FILE_AT = np.concatenate([[0], np.cumsum(FILE_SIZES)]).astype(np.int64)
#: Tokens whose features count for a token: itself, the one before, the one before that, the one after.
OFFSETS = (0, -1, -2, 1)

_BYTES = np.arange(256)
_IS = {
    "blank": (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "mark": np.isin(_BYTES, list(b"+/_-")),
    "wide": _BYTES >= 128,
    "hex": ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 102)),
    "vowel": np.isin(_BYTES, list(b"aeiouyAEIOUY")),
}
_RUN = _IS["digit"] | _IS["upper"] | _IS["lower"] | _IS["mark"] | _IS["wide"]
_CLASS = (_IS["digit"] * 1 + _IS["upper"] * 2 + _IS["lower"] * 3 + _IS["mark"] * 4 + _IS["wide"] * 5).astype(np.int8)


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of all tokens of the texts raw[at[k]:at[k + 1]]."""
    run, blank = _RUN[raw], _IS["blank"][raw]
    begins = ~blank
    ends = ~blank
    begins[1:] &= ~(run[1:] & run[:-1])
    ends[:-1] &= ~(run[1:] & run[:-1])
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = ~blank[edges]
    ends[edges - 1] = ~blank[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(at, starts, side="right") - 1


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:])
    return total[ends] - total[starts]


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of feature numbers for each token."""
    n = ends - starts
    count = {k: _sums(_IS[k][raw], starts, ends) for k in ("digit", "upper", "lower", "mark", "wide", "hex", "vowel")}
    kind = _CLASS[raw]
    turn = np.zeros(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turns = _sums(turn, np.minimum(starts + 1, ends), ends)
    long = np.minimum(15, np.where(n <= 8, n, 8 + (n - 8) // 5))
    letters = (count["upper"] > 0) * 1 + (count["lower"] > 0) * 2
    alone = (n == 1) & ~_RUN[raw[starts]] if len(n) else n == 1
    lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    word = span_hashes(lower, starts, ends)
    head = span_hashes(lower, starts, np.minimum(ends, starts + 3))
    out = np.empty((len(n), len(SIZES)), np.int32)
    share = np.minimum(4, (5 * count["digit"]) // np.maximum(n, 1))
    values = (
        long,
        np.where(alone, 23, share * 4 + letters),
        np.minimum(7, turns),
        np.where((count["hex"] == n) & (count["digit"] > 0), 16 + long, long),
        np.minimum(3, count["mark"]) + 4 * (count["wide"] > 0),
        np.where(count["lower"] + count["upper"] > 3, np.minimum(6, 8 * count["vowel"] // np.maximum(count["lower"] + count["upper"], 1)), 7),
        (word % np.uint64(SIZES[6])).astype(np.int64),
        (head % np.uint64(SIZES[7])).astype(np.int64),
    )
    for k, v in enumerate(values):
        out[:, k] = v + _AT[k]
    return out


def file_features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    size = np.diff(at)
    digit, mark = _sums(_IS["digit"][raw], at[:-1], at[1:]), _sums(~(_RUN | _IS["blank"])[raw], at[:-1], at[1:])
    some = np.maximum(size, 1)
    values = (np.minimum(11, np.log2(some).astype(int) // 2), np.minimum(5, 40 * digit // some), np.minimum(5, 40 * mark // some))
    return np.stack([v + _FILE_AT[k] for k, v in enumerate(values)], 1).astype(np.int32)


def base_spans(text: str, kinds=KINDS) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the secret itself) of the patterns' matches, by start, then kind as listed."""
    out = []
    for k, kind in enumerate(KINDS):
        if kind in kinds:
            for m in _FIND[kind].finditer(text):
                a, z = m.span(1) if kind == "assign" else m.span()
                if z - a >= _LEAST[kind]:
                    out.append((m.start(), k, m.end(), a, z))
    return [(s, e, KINDS[k], a, z) for s, k, e, a, z in sorted(out)]


def _bases(texts) -> list[list]:
    """base_spans of each text of an Arrow array; only texts that may have a kind are searched for it."""
    import pyarrow.compute as pc

    may = {kind: pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(zero_copy_only=False) for kind, p in _MAY.items()}
    out: list[list] = [[] for _ in range(len(texts))]
    for k in np.flatnonzero(np.logical_or.reduce(list(may.values()))):
        out[k] = base_spans(texts[int(k)].as_py(), [kind for kind in KINDS if may[kind][k]])
    return out


class Field:
    """Weights of the tokens' features for each offset and tag, of the file's features for each tag, and of transitions."""

    def __init__(self, token: np.ndarray, file: np.ndarray, move: np.ndarray):
        self.token, self.file, self.move = token, file, move
        # what begin or inside may gain over outside by transitions, whatever stands beside
        ends = [None, O, B, I]
        go = lambda a, b: 0.0 if a is None or b is None else move[a, b]
        self.most = max(go(a, y) + go(y, b) - go(a, O) - go(O, b) for a in ends for b in ends for y in (B, I))

    def scores(self, own: np.ndarray, doc: np.ndarray, file: np.ndarray) -> np.ndarray:
        """(tokens, 3) from the features of tokens in order, the document of each, and the features of documents."""
        parts = np.zeros((len(own), len(OFFSETS) * 3), np.float32)
        for k in range(own.shape[1]):
            parts += self.token[own[:, k]]
        out = self.file[file].sum(1)[doc] + parts[:, :3]
        for k, offset in enumerate(OFFSETS[1:], 1):
            part = parts[:, 3 * k : 3 * k + 3]
            if offset < 0:
                same = doc[-offset:] == doc[:offset]
                out[-offset:] += np.where(same[:, None], part[:offset], 0)
            else:
                same = doc[offset:] == doc[:-offset]
                out[:-offset] += np.where(same[:, None], part[offset:], 0)
        return out

    def tags(self, scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best tag sequence of each document."""
        out = np.zeros(len(doc), np.int8)
        open_ = np.flatnonzero(scores[:, O] - scores[:, 1:].max(1) <= self.most + 1e-6)
        if not len(open_):
            return out
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) != 1) | (doc[open_[1:]] != doc[open_[:-1]])
        first = open_[np.flatnonzero(new)]
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        begins = first == np.searchsorted(doc, doc[first])
        best = scores[first] + np.where(begins[:, None], 0, self.move[O])
        backs, alive = [], [len(first)]
        for t in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
            step = best[:n, :, None] + self.move
            backs.append(step.argmax(1).astype(np.int8))
            best[:n] = step.max(1) + scores[first[:n] + t]
            alive.append(n)
        # a run that ends before its document is followed by outside
        after = first + size
        ends = (after == len(doc)) | (doc[np.minimum(after, len(doc) - 1)] != doc[first])
        last = (best + np.where(ends[:, None], 0, self.move[:, O])).argmax(1)
        out[after - 1] = last
        for t in range(int(size[0]) - 1, 0, -1):
            n = alive[t]
            here = out[first[:n] + t]
            out[first[:n] + t - 1] = backs[t - 1][np.arange(n), here]
        return out


def nothing() -> Field:
    file = np.zeros((_FILE_AT[-1], 3))
    file[:, O] = 30.0
    return Field(np.zeros((_AT[-1], 3 * len(OFFSETS)), np.float32), file, np.zeros((3, 3)))


def fitted(own: np.ndarray, tags: np.ndarray, size: np.ndarray, file: np.ndarray, steps: int = 120, rate: float = 0.15, penalty: float = 1e-3) -> Field:
    """The field of greatest likelihood less `penalty` times its squares, by Adam. own: (windows, WINDOW, features), tags: (windows, WINDOW), size: tokens of each window, file: (windows, features)."""
    n, width = tags.shape
    inside = np.arange(width) < size[:, None]
    flat = own.reshape(n * width, -1)
    doc = np.repeat(np.arange(n), width)
    weights = [np.zeros((_AT[-1], 3 * len(OFFSETS))), np.zeros((_FILE_AT[-1], 3)), np.zeros((3, 3))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    hot = np.eye(3)[tags] * inside[:, :, None]
    pairs = inside[:, 1:, None, None] * hot[:, :-1, :, None] * hot[:, 1:, None, :]
    pad = (~inside).ravel()

    def log_sum(x, axis):
        top = x.max(axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

    for k in range(1, steps + 1):
        field = Field(weights[0].astype(np.float32), weights[1], weights[2])
        e = field.scores(flat, doc, file).reshape(n, width, 3)
        move = weights[2]
        a, z = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, width):
            a[:, t] = np.where(inside[:, t, None], log_sum(a[:, t - 1, :, None] + move, 1) + e[:, t], a[:, t - 1])
        for t in range(width - 2, -1, -1):
            z[:, t] = np.where(inside[:, t + 1, None], log_sum(move + (e[:, t + 1] + z[:, t + 1])[:, None, :], 2), 0)
        total = log_sum(a[:, -1], 1)
        rest = (hot - np.exp(a + z - total[:, None, None]) * inside[:, :, None]).reshape(n * width, 3)
        both = np.exp(a[:, :-1, :, None] + move + (e[:, 1:] + z[:, 1:])[:, :, None, :] - total[:, None, None, None]) * inside[:, 1:, None, None]
        wide = np.zeros((n * width, 3 * len(OFFSETS)))
        wide[:, :3] = rest
        for j, offset in enumerate(OFFSETS[1:], 1):
            moved = np.zeros_like(rest)
            if offset < 0:
                moved[:offset] = np.where((doc[-offset:] == doc[:offset])[:, None], rest[-offset:], 0)
            else:
                moved[offset:] = np.where((doc[offset:] == doc[:-offset])[:, None], rest[:-offset], 0)
            wide[:, 3 * j : 3 * j + 3] = moved
        wide[pad] = 0
        up = [np.zeros_like(w) for w in weights]
        for c in range(wide.shape[1]):
            for f in range(flat.shape[1]):
                up[0][:, c] += np.bincount(flat[:, f], wide[:, c], len(weights[0]))
        by_doc = rest.reshape(n, width, 3).sum(1)
        for f in range(file.shape[1]):
            for c in range(3):
                up[1][:, c] += np.bincount(file[:, f], by_doc[:, c], len(weights[1]))
        up[2] = (pairs - both).sum((0, 1))
        for j, w in enumerate(weights):
            g = up[j] / n - penalty * w
            first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
            w += rate * (first[j] / (1 - 0.9**k)) / (np.sqrt(second[j] / (1 - 0.999**k)) + 1e-8)
    return Field(weights[0].astype(np.float32), weights[1], weights[2])


def _code_points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def _parsed(texts) -> tuple:
    """(starts, ends, document, features, file features, starts and ends in code points of their text)."""
    raw, at = text_bytes(texts)
    starts, ends, doc = tokens(raw, at)
    points = _code_points(raw)
    return starts, ends, doc, features(raw, starts, ends), file_features(raw, at), points[starts] - points[at[doc]], points[ends] - points[at[doc]]


def windows(docs: DataFrame, share: float, text: str = "text") -> DataFrame:
    """(h, positive, own, tags, n, file): windows around all base spans, and one of each text without any that its hash chooses at `share`."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 0):
                keep, texts, chosen = [], part.column(0), part.column(1).to_numpy()
                for k, spans in enumerate(_bases(texts)):
                    if spans or chosen[k] < share:
                        keep.append((k, spans))
                if not keep:
                    continue
                picked = texts.take(pa.array([k for k, _ in keep]))
                _, _, doc, own, file, s, e = _parsed(picked)
                out = []
                for k, (row, spans) in enumerate(keep):
                    a, z = np.searchsorted(doc, [k, k + 1])
                    if z == a:
                        continue
                    tags = np.zeros(z - a, np.int8)
                    for span in spans:
                        inside = np.flatnonzero((s[a:z] < span[4]) & (e[a:z] > span[3]))
                        if len(inside) and not tags[inside].any():
                            tags[inside], tags[inside[0]] = I, B
                    middle = np.flatnonzero(tags == B) if spans else [int(chosen[row] / share * (z - a))]
                    for m in middle:
                        low = max(0, min(int(m) - WINDOW // 2, z - a - WINDOW))
                        high = min(z - a, low + WINDOW)
                        body = own[a + low : a + high].tobytes()
                        out.append((int.from_bytes(hashlib.blake2b(body, digest_size=7).digest(), "big"), bool(spans), body, tags[low:high].tobytes(), high - low, file[k].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))], ["h", "positive", "own", "tags", "n", "file"])
        released()

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    unit = F.shiftrightunsigned(F.xxhash64(body), 11) / F.lit(float(1 << 53))
    return docs.select(body.alias("t"), unit.alias("u")).mapInArrow(run, "h long, positive boolean, own binary, tags binary, n int, file binary")


def train(docs: DataFrame, text: str = "text", positives: int = 1500, negatives: int = 3000) -> Field:
    """The field, fitted on at most so many windows, equal ones once."""
    share = min(1.0, 2 * negatives / max(1, docs.count()))
    every = stored(windows(docs, share, text), "windows").dropDuplicates(["h"])
    rows = [r for kind, most in ((True, positives), (False, negatives)) for r in every.filter(F.col("positive") == kind).orderBy("h").limit(most).collect()]
    if not any(r.positive for r in rows):
        return nothing()
    own = np.zeros((len(rows), WINDOW, len(SIZES)), np.int32)
    tags = np.zeros((len(rows), WINDOW), np.int64)
    for k, r in enumerate(rows):
        own[k, : r.n] = np.frombuffer(r.own, np.int32).reshape(r.n, -1)
        tags[k, : r.n] = np.frombuffer(r.tags, np.int8)
    return fitted(own, tags, np.array([r.n for r in rows]), np.stack([np.frombuffer(r.file, np.int32) for r in rows]))


def tagged(texts, field: Field) -> list[list[tuple[int, int]]]:
    """(start, end) of the spans that the field finds in each text of an Arrow array, in code points."""
    out: list[list] = [[] for _ in range(len(texts))]
    starts, _, doc, own, file, s, e = _parsed(texts)
    if not len(starts):
        return out
    tags = field.tags(field.scores(own, doc, file), doc)
    on = tags != O
    follows = np.zeros(len(tags), bool)
    follows[1:] = (tags[1:] == I) & on[:-1] & (doc[1:] == doc[:-1])
    ends = on.copy()
    ends[:-1] &= ~follows[1:]
    for k, a, z in zip(doc[on & ~follows], s[on & ~follows], e[ends]):
        out[k].append((int(a), int(z)))
    return out


def spans(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): for each row the list of (kind, start, end) by start, base kinds before `crf`."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, 1):
                out = []
                for base, more in zip(_bases(part.column(1)), tagged(part.column(1), field)):
                    added = [(a, z) for a, z in more if not any(x[0] < z and a < x[1] for x in base)] if base else more
                    both = sorted([(x[0], KINDS.index(x[2]), x[1]) for x in base] + [(a, len(KINDS), z) for a, z in added])
                    out.append([{"kind": (*KINDS, "crf")[k], "start": a, "end": z} for a, k, z in both])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, item)], ["doc_id", "spans"])
        released()

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def report(table: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans, one row for each row of spans()."""
    listed = lambda some: F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return table.select("doc_id", *map(number, KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number("crf"))
