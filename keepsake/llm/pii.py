"""Personal data: patterns, and the terms beside them that give a protected entity away.

Base spans are e-mail addresses, IPv4 addresses, card numbers and telephone numbers, each kind found from the left without
overlaps; matches that fail their check (parts over 255, digits, Luhn) are dropped. Offsets are code points.

How strongly a term t, any word, reveals an entity e is the share of e's information that t carries, estimated from
co-occurrence over the distinct texts of the corpus: PMI(t, e) / IC(e) = 1 - ln(c(t) / c(t, e)) / ln(N / c(e)), where
c(t, e) counts texts with t and e, c(t) texts with t, c(e) texts with e and N all, wherever in the text they stand. There is
something to estimate only where e stands in `support` texts or more, so each entity counts at the narrowest of three levels
that does: itself, its part (domain, network, the first digits), its kind. Near copies, texts that agree in the least hash of
their shingles, count as one in c(t, e) and c(e). And a share counts only if it can't be chance: c(t, e) * PMI(t, e) nats must
be more than the logarithm of the number of words tried and SURE on top. Terms that pass are removed from the share `remove`
on, and from the share `generalise` on generalised to the class that their form shows (number, code, name or word): every
occurrence, in all texts that have the entity. What stands inside base spans is no term beside them, though it counts in c(t).
Texts without a protected entity are never changed.

Entities that stand in the same texts count as one, so a text's words meet each set of texts once, however many addresses two
texts share.

All of it is DataFrame functions. Where a text splits at a pattern, the lengths of the parts and of the matches add up to
the offsets. Patterns look for their first character only where a run begins, so long runs cost linear time.

Results: null and empty texts have no spans. Copies of a text count once in the estimates and all get the same spans.
Rows that repeat a doc_id are separate. Extra columns stay out of op10 and stay in the sanitised documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest128, stored, unused

KINDS = ("email", "ip", "card", "phone")
# (?:\G|(?<!x)): a match begins at the start of a run, or where the last match has ended inside one
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "[REMOVED]", "number": "[NUMBER]", "code": "[CODE]", "name": "[NAME]", "word": "[WORD]"}
TERM = r"[\p{L}\p{N}]+"
SPAN = "array<struct<start:int,end:int,value:string>>"
CUT = "array<struct<start:int,end:int,mask:string>>"
#: Items of one running sum.
STEP = 64
#: A table of at most so many spans or terms is broadcast; a larger one is joined by shuffles.
BROADCAST_ROWS = 50_000
#: So many 64-bit hashes, of terms or of texts that repeat, are broadcast (some 16 MB).
BROADCAST_HASHES = 1_000_000
#: Nats of evidence above the logarithm of the number of trials: a word in twenty tables passes by chance.
SURE = 3.0
#: Words of a shingle, and hashes by which near copies are told.
SHINGLE, SKETCHES = 4, 3


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value being made once, however often f uses it: inside a function of array elements it would be made anew for each of them."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(items: Column) -> Column:
    """The items in arrays of STEP."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)).cast("int"), F.lit(STEP)), lambda k: F.slice(items, k + 1, STEP))


def _starts(sizes: Column) -> Column:
    """Where each of many blocks starts, from their sizes; summed within blocks of blocks and over those."""

    def some(block: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    step = lambda acc, o: F.struct((acc["at"] + o["at"]).alias("at"), F.array_append(acc["out"], F.transform(o["out"], lambda n: n + acc["at"])).alias("out"))
    return F.flatten(F.aggregate(F.transform(_blocks(sizes), some), begin, step)["out"])


def _placed(items: Column, kind: str, gap: Callable[[Column], Column], length: Callable[[Column], Column], make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(item, start, end) of all items, laid out one after another: an item starts gap(item) after the end of the one before and has length(item). Sums run within blocks of STEP items and over the blocks, as appending to one long array copies it each time."""

    def inner(block: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + gap(x)
            end = start + length(x)
            return F.struct(end.alias("at"), F.array_append(acc["out"], make(x, start, end)).alias("out"))

        return F.aggregate(block, begin, step, lambda acc: acc["out"])

    def laid_out(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + gap(x) + length(x)))
        return F.flatten(F.zip_with(blocks, _let(sizes, _starts), inner))

    return _let(items, lambda it: _let(_blocks(it), laid_out))


def _matches(text: Column, pattern: str, kind: str, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(match, start, end) of all matches from the left, a match being its text (value) and what stands before it (part)."""

    def placed(values: Column) -> Column:
        parts = F.arrays_zip(F.slice(F.split(text, pattern), F.lit(1), F.size(values)).alias("part"), values.alias("value"))
        return F.when(F.size(values) > 0, _placed(parts, kind, lambda x: F.length(x["part"]), lambda x: F.length(x["value"]), make)).otherwise(F.array().cast(kind))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def located(text: Column, pattern: str) -> Column:
    """All matches from the left, as (start, end, value)."""
    return _matches(text, pattern, SPAN, lambda x, start, end: F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.try_to_number(F.substring(digits, F.length(digits) - i + 1, F.lit(1)), F.lit("9")).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _checked(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(value))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of one kind; texts without the character that it needs are passed over."""
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": text.contains("+")}[kind]
    return F.when(may, F.filter(located(text, PATTERNS[kind]), lambda s: _checked(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def _words(text: Column) -> Column:
    """The distinct words of a text, in small letters."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _class(word: Column) -> Column:
    """What a term is generalised to: the class that its form shows."""
    return F.when(word.rlike(r"^\p{N}+$"), MASKS["number"]).when(word.rlike(r"\p{N}"), MASKS["code"]).when(word.rlike(r"^\p{Lu}"), MASKS["name"]).otherwise(MASKS["word"])


def _occurrences(text: Column, removed: Column, general: Column) -> Column:
    """Where the words of two lists stand in text, as (start, end, mask) from the left."""

    def make(x: Column, start: Column, end: Column) -> Column:
        word = F.lower(x["value"])
        mask = F.when(F.array_contains(removed, word), MASKS["removed"]).when(F.array_contains(general, word), _class(x["value"]))
        return F.struct(start.alias("start"), end.alias("end"), mask.alias("mask"))

    return F.filter(_matches(text, TERM, CUT, make), lambda x: x["mask"].isNotNull())


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, email, ip, card, phone) of each row."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return body.select("doc_id", digest128(F.col("t")).alias("digest"), "t", *(base_spans(F.col("t"), k).alias(k) for k in KINDS))


def _levels(kind: str) -> Column:
    """For each span of a kind the entity at its three levels, the narrowest first."""
    whole = (lambda v: F.lower(v)) if kind in ("email", "ip") else _digits  # noqa: PLW0108
    part = {"email": lambda v: F.substring_index(v, "@", -1), "ip": lambda v: F.substring_index(v, ".", 3), "card": lambda v: F.substring(v, 1, 6), "phone": lambda v: F.substring(v, 1, 5)}[kind]
    name = lambda level, v: F.concat(F.lit(f"{kind}{level}:"), v)
    return F.transform(kind, lambda s: _let(whole(s["value"]), lambda v: F.struct(name("", v).alias("e0"), name("-part", part(v)).alias("e1"), F.lit(f"{kind}s").alias("e2"))))


def _sketches(text: Column) -> Column:
    """The least hash of the text's shingles under several seeds; near copies agree in one of them nearly always, other texts hardly ever."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)

    def least(w: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda k: F.xxhash64(F.slice(w, k, SHINGLE)))
        return _let(shingles, lambda h: F.array(*(F.array_min(F.transform(h, lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(SKETCHES))))

    return _let(words, least)


def evidence_texts(own: DataFrame) -> DataFrame:
    """(digest) of those texts of own (digest, t) that no other of a smaller digest is a near copy of."""
    each = own.select("digest", F.posexplode(_sketches(F.col("t"))).alias("k", "h"))
    first = each.groupBy("k", "h").agg(F.min("digest").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = each.join(first, ["k", "h"]).filter("digest <> first").select("digest").distinct()
    return own.select("digest").join(later, "digest", "left_anti")


def _document_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(t, c_t): in how many distinct texts each of the terms is. Texts that stand once are counted where they are; only those that repeat are shuffled to become one. Hashes let words through that may be terms, the join by the words themselves decides."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(digest128(body).alias("digest"), body.alias("_t")).withColumn("_h", F.xxhash64("digest"))
    copies = stored(texts.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64("digest").alias("_h")).distinct(), "copies")
    words = _words(F.col("_t")).alias("words")
    few = copies.count() <= BROADCAST_HASHES
    once = texts.join(F.broadcast(copies), "_h", "left_anti") if few else texts.filter(F.lit(False))
    several = texts.join(F.broadcast(copies), "_h", "left_semi") if few else texts
    one_of = several.select("digest", F.array_join(words, " ").alias("words")).groupBy("digest").agg(F.max("words").alias("words")).select(F.split("words", " ").alias("words"))
    asked = terms.select(F.xxhash64("t").alias("_w")).distinct()
    asked = F.broadcast(asked) if terms.count() <= BROADCAST_HASHES else asked

    def counted(some: DataFrame) -> DataFrame:
        each = some.select(F.explode("words").alias("t"))
        if terms.count() <= BROADCAST_HASHES:
            return each.join(asked, F.xxhash64("t") == F.col("_w"), "left_semi").groupBy("t").agg(F.count("*").alias("c"))
        return each.groupBy("t").agg(F.count("*").alias("c"))

    both = counted(once.select(words)).unionByName(counted(one_of))
    return both.groupBy("t").agg(F.sum("c").alias("c_t")).join(terms, "t", "left_semi")


def disclosing(docs: DataFrame, rows: DataFrame, corpus: int, text: str = "text", support: int = 2, generalise: float = 0.85, remove: float = 0.95) -> DataFrame | None:
    """(digest, terms) for distinct texts with terms to change; terms: array of (start, end, mask). rows: what found() gives of those documents that have a base span."""
    own = stored(rows.groupBy("digest").agg(F.any_value("t").alias("t")), "own")
    spans_of = rows.select("digest", F.explode(F.concat(*(_levels(k) for k in KINDS))).alias("s")).select("digest", "s.*").distinct()
    spans_of = stored(spans_of, "entities")
    once = stored(evidence_texts(own), "evidence")
    # each entity at the narrowest level that stands in enough texts, near copies once
    narrow = spans_of.join(once, "digest", "left_semi")
    level = lambda k: narrow.select("digest", f"e{k}").distinct().groupBy(f"e{k}").agg(F.count("*").alias(f"c{k}")).filter(F.col(f"c{k}") >= support)
    placed = spans_of.join(level(0), "e0", "left").join(level(1), "e1", "left").join(level(2), "e2", "left")
    each = placed.select("digest", F.when(F.col("c0").isNotNull(), F.col("e0")).when(F.col("c1").isNotNull(), F.col("e1")).when(F.col("c2").isNotNull(), F.col("e2")).alias("e")).filter("e is not null").distinct()
    each = stored(each, "levels")
    # entities of the same texts are one
    alike = each.groupBy("e").agg(F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit("keepsake"), "digest")).alias("y"), F.count("*").alias("m"))
    named = alike.groupBy("x", "y", "m").agg(F.min("e").alias("e"))
    each = each.join(named.select("e"), "e", "left_semi")
    of_e = each.join(once, "digest", "left_semi").groupBy("e").agg(F.count("*").alias("c_e")).filter(F.col("c_e") >= support)
    held = stored(each.join(of_e, "e"), "held")
    ic = F.log(F.lit(float(corpus)) / F.col("c_e"))
    share = lambda c, c_te: F.when(ic > 0, 1 - F.log(F.greatest(c, c_te) / c_te) / ic)
    # A term is at least in the texts that count; of those counts, what can't reach the threshold goes before pairs are made, and again before terms are counted
    counting = own.join(once, "digest", "left_semi")
    least = counting.select(F.explode(_words(F.col("t"))).alias("t")).groupBy("t").agg(F.count("*").alias("c_own")).filter(F.col("c_own") >= support)
    most = held.select(F.max(F.when(ic > 0, F.col("c_e") * F.exp((1 - generalise) * ic)))).first()[0]
    if most is None:
        return None
    least = stored(least.filter(F.col("c_own") <= most + 1), "rare")
    tried = least.count()
    nats = math.log(max(tried, 1)) + SURE
    # c(t, e) * PMI(t, e): how far from chance
    far = lambda c, c_te: c_te * F.log(F.lit(float(corpus)) * c_te / (F.greatest(c, c_te) * F.col("c_e")))
    beside = counting.select("digest", F.explode(_words(F.col("t"))).alias("t"))
    if BROADCAST_ROWS < tried <= BROADCAST_HASHES:  # hashes let the words through that may be in the table
        beside = beside.join(F.broadcast(least.select(F.xxhash64("t").alias("_w")).distinct()), F.xxhash64("t") == F.col("_w"), "left_semi")
    beside = beside.join(F.broadcast(least) if tried <= BROADCAST_ROWS else least, "t")
    held_near = F.broadcast(held) if held.count() <= BROADCAST_ROWS else held
    able = (share("c_own", F.least("c_e", "c_own")) >= generalise - 1e-9) & (far(F.col("c_own"), F.least("c_e", "c_own")) >= nats - 1e-9)
    pairs = beside.join(held_near, "digest").filter(able).groupBy("e", "t", "c_e", "c_own").agg(F.count("*").alias("c_te"))
    pairs = stored(pairs.filter((F.col("c_te") >= support) & (share("c_own", F.col("c_te")) >= generalise) & (far(F.col("c_own"), F.col("c_te")) >= nats)).drop("c_own"), "pairs")
    terms = stored(pairs.select("t").dropDuplicates(), "terms")
    if terms.isEmpty():
        return None
    of_t = _document_counts(docs, text, terms)
    flagged = pairs.join(of_t, "t").withColumn("share", share(F.col("c_t"), F.col("c_te"))).filter((F.col("share") >= generalise) & (far(F.col("c_t"), F.col("c_te")) >= nats))
    flagged = flagged.select("e", "t", (F.col("share") >= remove).alias("out"))
    flagged = stored(flagged, "flagged")
    # an entity's terms come to its texts one by one; each text gathers its own
    marks = held.select("digest", "e").join(flagged, "e").groupBy("digest", "t").agg(F.bool_or("out").alias("out"))
    pick = lambda out: F.collect_list(F.when(F.col("out") == out, F.col("t")))
    marks = marks.groupBy("digest").agg(pick(True).alias("removed"), pick(False).alias("general"))
    at = own.join(marks, "digest").select("digest", _occurrences(F.col("t"), F.col("removed"), F.col("general")).alias("terms"))
    return at.filter(F.size("terms") > 0)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, digest, email, ip, card, phone, terms): base spans by kind, and the terms that the method adds, less those inside a base span."""
    rows = found(docs, doc_id, text)
    some = " or ".join(f"size({k}) > 0" for k in KINDS)
    # texts are kept only where a base span is, with the spans blanked: what stands inside them is masked as it is
    base = stored(rows.withColumn("t", F.when(F.expr(some), _blanked(F.col("t")))), "found")
    corpus = base.select("digest").distinct().count()
    extra = disclosing(docs, base.filter("t is not null"), corpus, text, **options)
    none = F.array().cast(CUT)
    if extra is None:
        return base.drop("t").withColumn("terms", none)
    extra = stored(extra, "terms")
    many = extra.agg(F.sum(F.size("terms"))).first()[0] or 0
    joined = base.drop("t").join(F.broadcast(extra) if many <= BROADCAST_ROWS else extra, "digest", "left")
    clear = lambda w: ~F.exists(F.concat(*KINDS), lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
    return joined.select("doc_id", "digest", *KINDS, F.coalesce(F.filter("terms", clear), none).alias("terms"))


def report(table: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans, one row for each row of spans()."""
    listed = lambda spans, kind: F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
    lists, terms = [listed(k, k) for k in KINDS], listed("terms", "term")
    return table.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*lists), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*lists, terms), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def masked(text: Column, cuts: Column) -> Column:
    """text with each of cuts, (start, end, mask) in order, replaced by its mask; of overlapping cuts the first gives the mask for all. The furthest end so far is kept within blocks of STEP cuts and over the blocks."""

    def inner(block: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), F.array().cast("array<string>").alias("out"))
        last = F.array_max(F.transform(block, lambda c: c["end"]))

        def pieces(part: Column) -> Column:
            def step(acc: Column, c: Column) -> Column:
                piece = F.concat(F.substring(part, acc["at"] - first + 1, c["start"] - acc["at"]), c["mask"])
                return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.when(c["start"] >= acc["at"], F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

            return F.array_join(F.aggregate(block, begin, step, lambda acc: acc["out"]), "")

        # a block's own stretch of the text: finding a place in a text takes as long as the text before it
        return _let(F.substring(text, first + 1, F.greatest(last - first, F.lit(0))), pieces)

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda block: F.array_max(F.transform(block, lambda c: c["end"])))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        before = F.aggregate(ends, begin, lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))
        return _let(before, lambda b: F.concat(F.array_join(F.zip_with(blocks, b["out"], inner), ""), F.substring(text, b["at"] + 1, F.length(text))))

    return F.when(F.size(cuts) > 0, _let(cuts, lambda c: _let(_blocks(c), joined))).otherwise(text)


def _blanked(text: Column) -> Column:
    """text with blanks in place of its base spans, kind by kind, as spans of two kinds may overlap; places stay."""

    def without(t: Column, kind: str) -> Column:
        cuts = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.repeat(F.lit(" "), s["end"] - s["start"]).alias("mask")))
        return _let(t, lambda x: masked(x, cuts))  # made once for the next

    return reduce(without, KINDS, text)


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with every span masked in text. n_chars, where there is one, is counted again. Texts stay where they are; what is joined is the short list of cuts."""
    table = spans(docs, doc_id, text, **options)
    cut = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(MASKS[k]).alias("mask")))
    key, mark, cut_at = (unused(docs, n) for n in ("_id", "_digest", "_cuts"))
    cuts = table.select(F.col("doc_id").alias(key), F.col("digest").alias(mark), F.array_sort(F.concat(*(cut(k) for k in KINDS), "terms")).alias(cut_at)).filter(F.size(cut_at) > 0).dropDuplicates([key, mark])
    cuts = stored(cuts, "cuts")
    many = cuts.agg(F.sum(F.size(cut_at))).first()[0] or 0
    cuts = F.broadcast(cuts) if many <= BROADCAST_ROWS else cuts
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    joined = docs.join(cuts, docs[doc_id].eqNullSafe(cuts[key]) & (digest128(body) == cuts[mark]), "left")
    new = F.when(F.col(cut_at).isNotNull(), masked(F.col(text), F.col(cut_at))).otherwise(F.col(text))
    out = joined.select(*(new.alias(c) if c == text else F.col(c) for c in docs.columns))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
