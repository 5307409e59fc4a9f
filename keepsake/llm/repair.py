"""Repair of conversations at least cost: rows are kept, given another role or deleted, and missing ones put in.

Rows come by turn, nulls first, then by role and by the SHA-256 of the text. A row's first fault counts: blank, duplicate (a
row before has its role and text), truncated. What a conversation costs depends on its sequence of roles and faults alone,
so conversations with equal sequences share all work:

* Rows are range-partitioned by conversation, turn, role and digest and cut into chunks of at most CHUNK rows; a conversation
  of any length is spread over tasks. A chunk's sequence is a string of nine symbols.
* Re-Pair over the distinct sequences: in rounds, pairs that occur most become rules, up to RULES of them. Each round counts
  pairs where the sequences are; the driver gets PAIRS rows.
* A rule has a transfer matrix over the states of `(s?(ua)+)?`: for each state before and after, the least cost and the
  audit of its edits, the ASCII-least of the cheapest. Products in this semiring of (cost, audit) are exact, as two audits of
  equal cost over the same rows are never prefixes of one another. Audits are ropes, shared between rules; they carry a hash
  of 61 bits by which equal parts are skipped when two are compared.
* Sequences are evaluated from the symbols that the grammar leaves. Chunks of a conversation that goes over several are
  folded in order by their matrices, which gives each chunk its own part of the audit.

Results: rows with a null conversation are one conversation; null turns come first and count for no gap. A conversation
without rows has zeros, an empty audit and the digest of the empty string. An empty table gives none. Repeated rows are
duplicates. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, released, stored

CHUNK, CHUNK_BYTES = 4096, 1 << 20
RULES, PAIRS = 256, 32
#: Tables of at most so many rows and characters are broadcast.
BROADCAST_ROWS, BROADCAST_CHARACTERS = 50_000, 1 << 24
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {2: "user", 3: "assistant"}
#: Roles by initial, small where the text is whole and large where it is truncated; "-" must go.
SYMBOLS = "suaoSUAO-"
START, STATES, ENDS = 0, 4, (0, 3)
_PRIME = (1 << 61) - 1


class Rope:
    """Two ropes or strings one after the other."""

    __slots__ = ("hash", "left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right = left, right
        self.size = length(left) + length(right)
        self.hash = (hashed(left) * pow(256, length(right), _PRIME) + hashed(right)) % _PRIME


def length(rope) -> int:
    return len(rope) if isinstance(rope, str) else rope.size


def hashed(rope) -> int:
    return int.from_bytes(rope.encode(), "big") % _PRIME if isinstance(rope, str) else rope.hash


def joined(left, right):
    if not length(left) or not length(right):
        return left if length(left) else right
    return left + right if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= 16 else Rope(left, right)


def leaves(rope):
    """The strings of a rope from the left, in pieces."""
    stack = [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack += (x.right, x.left)


def spelled(rope) -> str:
    return rope if isinstance(rope, str) else "".join(leaves(rope))


def before(a, b) -> bool:
    """Whether rope a comes before rope b."""
    one, other = [a], [b]
    while one and other:
        x, y = one.pop(), other.pop()
        if x is y or (length(x) == length(y) and hashed(x) == hashed(y)):
            continue
        if isinstance(x, str) and isinstance(y, str):
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            one += [x[n:]] if len(x) > n else []
            other += [y[n:]] if len(y) > n else []
        else:  # open the longer one, the other waits
            if isinstance(y, str) or (not isinstance(x, str) and x.size >= y.size):
                one += (x.right, x.left)
                other.append(y)
            else:
                other += (y.right, y.left)
                one.append(x)
    return bool(other) and not one


def better(a, b):
    """The cheaper of two (cost, rope), then the one that comes first; None costs more than all."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def product(x: list, y: list) -> list:
    """Matrix product with `better` for the sum; x may be a list of rows of any number."""
    out = []
    for row in x:
        line = [None] * STATES
        for k, a in enumerate(row):
            if a is not None:
                for j, b in enumerate(y[k]):
                    if b is not None and (line[j] is None or a[0] + b[0] <= line[j][0]):
                        line[j] = better(line[j], (a[0] + b[0], joined(a[1], b[1])))
        out.append(line)
    return out


def inserts() -> list:
    """From state to state by rows put in alone."""
    n = INSERT
    return [[(0, ""), None, (n, "I"), (2 * n, "II")], [None, (0, ""), (n, "I"), (2 * n, "II")], [None, None, (0, ""), (n, "I")], [None, None, (n, "I"), (0, "")]]


def terminal(symbol: str) -> list:
    """Rows put in, then one row."""
    row = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        row[i][i] = (DELETE, "D")
    if symbol != "-":
        late, own = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        moves = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
        for role in "ua":
            for i, j in moves[role]:
                row[i][j] = better(row[i][j], (REROLE + late, "R"))
        for i, j in moves.get(own, ()):
            row[i][j] = better(row[i][j], (KEEP + late, "K"))
    return product(inserts(), row)


@functools.lru_cache(maxsize=2)
def matrices(rules: tuple) -> list:
    """The matrix of each symbol and, from the bottom up, of each rule."""
    out = [terminal(s) for s in SYMBOLS]
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


def replaced(flat: np.ndarray, rules, first: int) -> np.ndarray:
    """flat with each rule's pair, from the left, replaced by its number; the rules count from `first`."""
    for k, (a, b) in enumerate(rules):
        at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
        if a == b and len(at):  # of a run of one symbol every other place
            head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            at = at[place % 2 == 0]
        if len(at):
            flat = flat.copy()
            flat[at] = first + k
            flat = np.delete(flat, at + 1)
    return flat


def grammar(sequences: DataFrame, most: int = RULES) -> tuple[tuple, DataFrame]:
    """(rules, sequences with the numbers that they leave them with). sequences: (symbols string), distinct."""

    def begin(batches):
        import pyarrow as pa

        for b in batches:
            codes = [np.array([SYMBOLS.index(c) for c in s], np.int32).tobytes() for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary())], ["symbols", "codes"])

    table, rules = stored(sequences.select("symbols").mapInArrow(begin, "symbols string, codes binary"), "grammar"), []
    while len(rules) < most:

        def pairs(batches):
            import pyarrow as pa

            for b in batches:
                flat = np.concatenate([x for s in b.column(1).to_pylist() for x in (np.frombuffer(s, np.int32), [-1])] or [np.zeros(0, np.int32)]).astype(np.int64)
                key = flat[:-1] * (1 << 20) + flat[1:]
                key, n = np.unique(key[(flat[:-1] >= 0) & (flat[1:] >= 0)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

        best = table.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(min(PAIRS, most - len(rules))).collect()
        if not best:
            break
        fresh = [(r.pair >> 20, r.pair & ((1 << 20) - 1)) for r in best]
        first = len(SYMBOLS) + len(rules)

        def rewrite(batches, fresh=fresh, first=first):
            import pyarrow as pa

            for b in batches:
                each = [np.frombuffer(s, np.int32) for s in b.column(1).to_pylist()]
                flat = replaced(np.concatenate([x for s in each for x in (s, [-1])] or [np.zeros(0, np.int32)]).astype(np.int32), fresh, first)
                codes = [x.tobytes() for x in np.split(flat, np.flatnonzero(flat < 0) + 1)[: len(each)]]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c[:-4] for c in codes], pa.binary())], ["symbols", "codes"])

        old, table = table, stored(table.mapInArrow(rewrite, "symbols string, codes binary"), "grammar")
        discard(old)
        rules += fresh
    return tuple(rules), table


def evaluated(rules: tuple, table: DataFrame, whole: bool) -> DataFrame:
    """(symbols, costs, audits): for whole conversations the cheapest repair, for parts the whole matrix by rows (cost -1: no way)."""

    def run(batches):
        import pyarrow as pa

        known, rest = matrices(rules), inserts()
        for b in batches:
            costs, audits = [], []
            for s in b.column(1).to_pylist():
                rows = [[(0, ""), None, None, None]] if whole else [[(0, "") if i == j else None for j in range(STATES)] for i in range(STATES)]
                for code in np.frombuffer(s, np.int32):
                    rows = product(rows, known[code])
                if whole:
                    last = product(rows, rest)[0]
                    rows = [[functools.reduce(better, (last[e] for e in ENDS))]]
                flat = [x for row in rows for x in row]
                costs.append([-1 if x is None else x[0] for x in flat])
                audits.append(["" if x is None else spelled(x[1]) for x in flat])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["symbols", "costs", "audits"])

    return table.mapInArrow(run, "symbols string, costs array<long>, audits array<string>")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): the rows that the contract's damage leaves, by the CRC-32 of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def _faults(rows: DataFrame) -> DataFrame:
    """rows with digest and symbol. A row like another of an earlier turn is found by their least turn; rows alike in turn too are told apart where they stand side by side."""
    rows = rows.select("conv", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    order = F.struct(F.col("turn").isNotNull().alias("n"), "turn")
    first = rows.groupBy("conv", "role", "digest").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first <> last")
    first = stored(first.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("_turn")), "first")
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    both = rows.join(first, rows.conv.eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    own = F.substring("role", 1, 1)
    kind = F.when(own.isin("s", "u", "a"), own).otherwise("o")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    again = F.col("_d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_turn"))
    symbol = F.when(blank, "B").when(again, "D").when(cut, F.upper(kind)).otherwise(kind)
    return both.select("conv", "turn", "role", "text", "digest", symbol.alias("symbol"))


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of the rows in order: (conv, task, chunk, part, symbols, roles, texts, counts, ends). part: the conversation may go on in other chunks."""
    n = partitions(rows.sparkSession)
    # no equal rows of one turn are parted, so side by side means in one task
    rows = rows.repartitionByRange(n, "conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, task int, chunk int, part boolean, symbols string, roles array<string>, texts array<string>, n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number, out = TaskContext.get().partitionId(), 0, []
        types = [pa.list_(pa.string())] * 2
        held, size, last, cut, started = [], 0, None, False, False

        def close(part):
            nonlocal number
            symbols = "".join(h[4] for h in held)
            own = [h[1][:1] for h in held]
            turns = [h[0] for h in held if h[0] is not None]
            bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
            distinct = sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns)
            cutoff = sum(c in "SUAO" for c in symbols)
            out.append((last[0], task, number, part, symbols.replace("B", "-").replace("D", "-"), [h[1] for h in held], [h[2] for h in held], len(held), symbols.count("B"), symbols.count("D"), cutoff, bad, distinct, turns[0] if turns else None, turns[-1] if turns else None, own[0], own[-1]))
            number += 1

        def sent(conv):
            columns = list(zip(*out))
            kinds = [conv, pa.int32(), pa.int32(), pa.bool_(), pa.string(), *types, *[pa.int64()] * 8, pa.string(), pa.string()]
            names = ["conv", "task", "chunk", "part", "symbols", "roles", "texts", "n", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        conv_type, twin = None, None
        for b in batches:
            conv_type, weight = b.schema.field(0).type, 0
            for conv, turn, role, text, digest, symbol in zip(*(b.column(k).to_pylist() for k in range(6))):
                if last is None or last[0] != conv:
                    if held:
                        close(part=cut or not started)
                        started = True
                    held, size, last, cut = [], 0, (conv,), False
                elif len(held) >= CHUNK or size > CHUNK_BYTES:
                    close(part=True)
                    held, size, started, cut = [], 0, True, True
                this = (conv, turn, role, digest)
                held.append((turn, role, text, digest, "D" if this == twin and symbol != "B" else symbol))
                twin, size, weight = this, size + len(text), weight + len(text)
                if out and weight > 1 << 21:
                    yield sent(conv_type)
                    weight = 0
            if out:
                yield sent(conv_type)
        if held:
            close(part=True)
            yield sent(conv_type)
        released()

    return rows.mapInArrow(run, schema)


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Fold:
    """The chunks of one conversation in order. Of what came before, the four cheapest ways stay, one a state, sharing their beginnings."""

    def __init__(self):
        self.state = [(0, "", None), None, None, None]  # cost, audit, (state before, own audit, way before)
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.places, self.role, self.first, self.turn = [], None, None, None

    def add(self, c: dict) -> None:
        new: list = [None] * STATES
        for i, x in enumerate(self.state):
            for j in range(STATES):
                if x is not None and c["costs"][STATES * i + j] >= 0:
                    own = c["audits"][STATES * i + j]
                    y = (x[0] + c["costs"][STATES * i + j], joined(x[1], own), (i, own, x[2]))
                    if new[j] is None or y[0] < new[j][0] or (y[0] == new[j][0] and before(y[1], new[j][1])):
                        new[j] = y
        self.state = new
        for k in self.sums:
            self.sums[k] += c[k]
        if self.places:
            self.sums["illegal"] += self.role + c["first_role"] not in ("su", "ua", "au")
        if c["turns"]:
            self.sums["turns"] -= self.turn == c["first_turn"]
            self.first = c["first_turn"] if self.first is None else self.first
            self.turn = c["last_turn"]
        self.places.append((c["task"], c["chunk"]))
        self.role = c["last_role"]

    def columns(self, conv) -> list[list]:
        best = None
        for x, row in zip(self.state, inserts()):
            for j in ENDS:
                if x is not None and row[j] is not None:
                    e = (x[0] + row[j][0], joined(x[1], row[j][1]), row[j][1], x[2])
                    if best is None or e[0] < best[0] or (e[0] == best[0] and before(e[1], best[1])):
                        best = e
        cost, audit, tail, way = best
        pieces = []
        while way is not None:
            pieces.append((way[0], way[1]))
            way = way[2]
        pieces[0] = (pieces[0][0], pieces[0][1] + tail)
        pieces.reverse()
        gaps = 0 if self.turn is None else self.turn - self.first + 1 - self.sums["turns"]
        numbers = [gaps, *(self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, spelled(audit)]
        rest = [None] * (len(pieces) - 1)
        return [[conv] * len(pieces), *([x, *rest] for x in numbers), *map(list, zip(*self.places)), *map(list, zip(*pieces))]


def _folded(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations over several chunks, whose chunks pass through a task in order: (conv, numbers, audit), and (task, chunk, state, audit) of each chunk."""
    kind = parts.schema["conv"].dataType.simpleString()
    rows = parts.repartition("conv").sortWithinPartitions("conv", "task", "chunk")
    rows = rows.select("conv", "task", "chunk", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_role", "last_role", "costs", "audits")

    def run(batches):
        import pyarrow as pa

        names, last, fold = ["conv", *_NUMBERS, "audit", "task", "chunk", "state", "own"], None, None

        def sent(columns, conv):
            kinds = [conv, *[pa.int64()] * len(_NUMBERS), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        conv = None
        for b in batches:
            conv = b.schema.field(0).type
            for k in range(b.num_rows):
                c = {name: b.column(j)[k].as_py() for j, name in enumerate(b.schema.names)}
                if last is None or last[0] != c["conv"]:
                    if last is not None:
                        yield sent(fold.columns(last[0]), conv)
                    last, fold = (c["conv"],), _Fold()
                fold.add(c)
        if last is not None:
            yield sent(fold.columns(last[0]), conv)
        released()

    out = stored(rows.mapInArrow(run, f"conv {kind}, {', '.join(f'{x} long' for x in _NUMBERS)}, audit string, task int, chunk int, state int, own string"), "folded")
    return out.filter("audit is not null").select("conv", *_NUMBERS, "audit"), out.select("task", "chunk", "state", F.col("own").alias("audit"))


def lines(symbols_roles: list[str], texts: list[str], state: int, audit: str) -> list[str]:
    """The repaired rows of a chunk."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = 3 if state == 2 else 2
            out.append(f"{ROLES[state]}:")
            continue
        role, text = symbols_roles[at], texts[at]
        at += 1
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = 3 if state == 2 else 2
            out.append(f"{ROLES[state]}:{text}")
    return out


def _is_small(df: DataFrame, size) -> bool:
    """Whether a written table may be broadcast."""
    rows, characters = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and characters <= BROADCAST_CHARACTERS


def _digests(chunks: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): chunks write their lines where they are; those of a conversation over several are hashed as they pass in order."""
    kind = chunks.schema["conv"].dataType.simpleString()
    small = _is_small(audits, F.length("audit"))
    both = chunks.select("conv", "task", "chunk", "part", "roles", "texts").join(F.broadcast(audits) if small else audits, ["task", "chunk"]).select("conv", "task", "chunk", "part", "roles", "texts", "state", "audit")

    def write(batches):
        import pyarrow as pa

        for b in batches:
            shas, blobs = [], []
            for part, roles, texts, state, audit in zip(*(b.column(k).to_pylist() for k in range(3, 8))):
                blob = "\n".join(lines(roles, texts, state, audit)).encode()
                shas.append(None if part else hashlib.sha256(blob).hexdigest())
                blobs.append(blob if part else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(shas, pa.string()), pa.array(blobs, pa.binary())], ["conv", "task", "chunk", "sha", "blob"])
        released()

    written = stored(both.mapInArrow(write, f"conv {kind}, task int, chunk int, sha string, blob binary"), "written")

    def hash_in_order(batches):
        import pyarrow as pa

        last, state, begun = None, None, False
        for b in batches:
            convs, shas = [], []
            for conv, blob in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if last is None or last[0] != conv:
                    if last is not None:
                        convs.append(last[0])
                        shas.append(state.hexdigest())
                    last, state, begun = (conv,), hashlib.sha256(), False
                if blob:
                    state.update(b"\n" + blob if begun else blob)
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array(convs, b.schema.field(0).type), pa.array(shas, pa.string())], ["conv", "repaired_sha256"])
            kind_ = b.schema.field(0).type
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], kind_), pa.array([state.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    several = written.filter("sha is null").select("conv", "task", "chunk", "blob").repartition("conv").sortWithinPartitions("conv", "task", "chunk")
    return written.filter("sha is not null").select("conv", F.col("sha").alias("repaired_sha256")).unionByName(several.mapInArrow(hash_in_order, f"conv {kind}, repaired_sha256 string"))


def repaired(rows: DataFrame, rules: int = RULES) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation. rows: (conv, turn, role, text) without nulls in role and text."""
    chunks = stored(chunked(_faults(rows)), "chunks")
    found, table = grammar(chunks.select("symbols").distinct(), rules)
    kinds = stored(chunks.select("symbols", "part").distinct(), "kinds")
    of = lambda part: table.join(kinds.filter(F.col("part") == part).select("symbols"), "symbols")
    whole = stored(evaluated(found, of(False), whole=True), "whole")
    parts = stored(evaluated(found, of(True), whole=False), "parts")
    near = lambda df: F.broadcast(df) if _is_small(df, F.size("audits") * F.length("symbols")) else df
    ends = chunks.filter("not part").drop("roles", "texts").join(near(whole), "symbols")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    ends = ends.select("conv", "task", "chunk", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.get("costs", F.lit(0)).alias("cost"), F.get("audits", F.lit(0)).alias("audit"))
    some = chunks.filter("part").drop("roles", "texts").join(near(parts), "symbols")
    far, pieces = _folded(some)
    audits = stored(ends.select("task", "chunk", F.lit(0).alias("state"), "audit").unionByName(pieces), "audits")
    numbers = ends.drop("task", "chunk").unionByName(far)
    digests = _digests(chunks, audits).withColumnRenamed("conv", "_conv")
    return numbers.join(digests, numbers.conv.eqNullSafe(F.col("_conv"))).drop("_conv")


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the undamaged table: what its damaged rows are like and how they are repaired."""
    every = conversations.select("conv_id").distinct()
    found = repaired(damaged(conversations))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    both = every.join(found, every.conv_id.eqNullSafe(found.conv), "left")
    return both.select("conv_id", *map(zero, _NUMBERS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
