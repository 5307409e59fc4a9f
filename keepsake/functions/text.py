"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"

# Media placeholders of the exports, and names of accounts without one.
MEDIA = r"(?i)^\s*(<media omitted>|sent an attachment\.?|sent a photo\.?|sent a video\.?|\[?attachment\]?|image omitted|video omitted|sticker omitted)\s*$"
LINK = r"https?://(?:www\.)?([^/\s]+)\S*"
PLACEHOLDER_NAMES = ("instagram user", "deleted user", "facebook user")
PLATFORM_LABELS = {"twitter": "Twitter", "reddit": "Reddit", "discord": "Discord", "instagram": "Instagram", "facebook": "Facebook", "whatsapp": "WhatsApp"}
# Country calling codes.
CALLING_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "49", "52", "55", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93",
    "94", "95", "98", "212", "234", "254", "351", "353", "880", "960", "961", "962", "963", "964", "965", "966", "967", "968", "970", "971", "972", "973", "974", "975", "977",
)
# Words that carry no subject in topic phrases.
STOP = ("and", "the", "of", "with", "about", "for", "to", "in", "on", "a", "an", "chat", "chats", "talk", "talks", "discussion", "discussions", "conversation", "conversations", "casual", "general", "some", "various")


def cleaned(text: Column) -> Column:
    """Trimmed text with media placeholders as [media], links as [link host] and blanks folded; null if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(F.trim(text), LINK, "[link $1]"), r"\s+", " ")
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, None).when(text.rlike(MEDIA), "[media]").otherwise(F.trim(body))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def search_terms(text: Column) -> Column:
    """Lower-cased words of two characters or more."""
    return F.filter(words(F.lower(text)), lambda w: F.length(w) > 1)


def token_estimate(text: Column, per_word: float = 1.4, plus: int = 1) -> Column:
    """int(words * per_word) + plus, words being runs of non-blanks."""
    n = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return (F.floor(n * F.lit(per_word).cast("double")) + plus).cast("int")


def name_key(name: Column) -> Column:
    """Lower case, everything but ASCII letters and digits to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def merge_key(name: Column) -> Column:
    """Name reduced to letters and digits, without a leading @ or u/; null if under four characters."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"^(@|u/)", ""), r"[^\p{L}\p{N}]+", "")
    return F.when(F.length(key) >= 4, key)


def same_text(text: Column) -> Column:
    """What two exports of one message have in common: lower case, no "www.", "group chat" as "group", word characters only; the lower-cased text where nothing is left."""
    low = F.lower(F.coalesce(text, F.lit("")))
    key = F.regexp_replace(F.replace(F.replace(low, F.lit("www."), F.lit("")), F.lit("group chat"), F.lit("group")), r"[^\p{L}\p{N}]+", "")
    return F.when(key != "", key).otherwise(F.trim(low))


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 read right; unchanged where it wasn't."""
    plain = ~text.rlike("[^\\u0000-\\u00ff]")
    raw = F.encode(F.when(plain, text).otherwise(""), "ISO-8859-1")
    return F.when(plain & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(text)


def slug(text: Column) -> Column:
    """NFKC, lower case, blanks to underscores, word characters only."""
    folded = F.lower(F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))
    return F.regexp_replace(F.regexp_replace(F.trim(folded), r"\s+", "_"), r"[^\p{L}\p{N}_]", "")


def unaccented(text: Column) -> Column:
    """Letters without their combining marks."""
    apart = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.regexp_replace(apart, r"\p{M}+", "")


def stable_id(prefix: str, ids: Column) -> Column:
    """prefix and the first 16 hex digits of the SHA-1 of the ids joined by bars."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.array_join(ids, "|").cast("binary")), 1, 16))


def short_name(name: Column, most: int = 40) -> Column:
    """At most `most` characters, cut at the last space, trailing punctuation off, an ellipsis after."""
    head = F.substring(name, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.regexp_replace(cut, r"[\s,.;:\-]+$", ""), F.lit("…")))


def elided(text: Column, most: int) -> Column:
    """Head half, a mark, tail half, where text is longer than most."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n[…]\n"), F.substring(text, -half, half)))


def csv_safe(text: Column, most: int | None = None) -> Column:
    s = F.trim(F.translate(F.coalesce(text, F.lit("")), ',\r"\n', "   ").cast("string"))
    s = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), '[,\r"]', ""), "\n", " "))
    return s if most is None else F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def masked_phone(phone: Column) -> Column:
    code = F.substring(phone, F.lit(1), F.greatest(F.length(phone) - 10, F.lit(0)))
    rest = F.substring(phone, -10, 10)
    return F.when(F.length(phone) < 8, "WhatsApp user").otherwise(F.replace(F.concat(F.lit("+"), code, F.lit(" "), F.substring(rest, 1, 2), F.lit("··· ··"), F.substring(rest, -3, 3)), F.lit("+ "), F.lit("+")))


def formatted_phone(digits: Column) -> Column:
    """+cc and groups of digits, by the longest calling code that fits; empty unless 8 to 15 digits."""
    known = lambda k: F.substring(digits, 1, k).isin(*[c for c in CALLING_CODES if len(c) == k])
    n = F.when(known(3), 3).when(known(2), 2).when(known(1), 1).otherwise(0)
    code, rest = F.substring(digits, F.lit(1), n), F.substring(digits, n + 1, F.length(digits))
    size = F.length(rest)
    cut = lambda *ks: F.concat_ws(" ", *(F.substring(rest, F.lit(a), F.lit(b)) for a, b in ks))
    tail = F.concat_ws(" ", F.when(size > 6, F.substring(rest, F.lit(1), size - 6)), F.substring(rest, size - 5, F.lit(3)), F.substring(rest, size - 2, F.lit(3)))
    shaped = F.when((code == "91") & (size == 10), cut((1, 5), (6, 5))).when((code == "1") & (size == 10), cut((1, 3), (4, 3), (7, 4))).when(size == 8, cut((1, 4), (5, 4))).otherwise(tail)
    return F.when(~digits.rlike("^[0-9]{8,15}$"), "").when(n == 0, F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit("+"), code, F.lit(" "), shaped))


def redacted(text: Column) -> Column:
    """E-mail addresses, order numbers with a digit, and runs of ten digits or more hidden. The three patterns, as what they hide has to be the same everywhere."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+", "[email hidden]")
    s = F.regexp_replace(s, r"(?i)\b(order|invoice|tracking|awb)(\s*(?:no\.?|number|id|#)?\s*[:#]?\s*)(?=[A-Z0-9-]*[0-9])([A-Z0-9][A-Z0-9-]{4,})", "$1$2[hidden]")
    return F.regexp_replace(s, r"(?<![\p{L}\p{N}_/])\+?(?=(?:[\s-]*\d){10})\d[\d\s-]{8,}\d(?![\p{L}\p{N}_/])", "[number hidden]")


def cited_numbers(text: Column) -> Column:
    """Sorted numbers cited as [3], [3, 5] or [3-5]; ranges of more than 30 are left out."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[((?:\d+\s*(?:[-–—]\s*\d+)?\s*,?\s*)+)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(F.trim(g), r"^,|,$", ""), r"\s*,\s*")))
    span = r"^\s*(\d+)\s*[-–—]\s*(\d+)\s*$"

    def numbers(p: Column) -> Column:
        a, b = F.regexp_extract(p, span, 1), F.regexp_extract(p, span, 2)
        a, b = F.when(a != "", a).cast("int"), F.when(b != "", b).cast("int")
        return F.when((b - a > 0) & (b - a <= 30), F.sequence(a, b)).when(p.rlike(r"^\s*\d+\s*$"), F.array(F.when(p.rlike(r"^\s*\d+\s*$"), F.trim(p)).cast("int"))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def stemmed(word: Column) -> Column:
    """The first of ing, ed, es, s, y that ends a word of over four letters goes."""
    return F.when(F.length(word) > 4, F.regexp_replace(word, "(ing|ed|es|s|y)$", "")).otherwise(word)


def topic_key(topic: Column) -> Column:
    """Sorted distinct stems of a phrase's content words; the phrase itself where none is left."""
    low = F.trim(F.regexp_replace(F.lower(topic), r"\s+", " "))
    kept = F.filter(F.regexp_extract_all(low, F.lit(r"\p{L}{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP))
    key = F.array_sort(F.array_distinct(F.transform(kept, stemmed)))
    return F.when(F.size(key) > 0, key).otherwise(F.array(low))


def first_sentence(text: Column, most: int = 180) -> Column:
    """Up to the first sentence end after 20 characters, at most `most` characters with an ellipsis at a word's end."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    found = F.regexp_extract(flat, r"^(.{20,}?[.!?])(\s|$)", 1)
    s = F.when(found != "", found).otherwise(flat)
    head = F.substring(s, 1, most - 1)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"^(.*) ", 1)).otherwise(head)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(cut, F.lit("…")))


def chat_title(title: Column) -> Column:
    """A chat's title, null where it is only an id."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*\[\d+\]", ""))
    bare = (t == "") | t.rlike(r"(?i)^(tweet|ghost|reddit) (thread|post)\b|^dm \d|^\d+$")
    return F.when(~bare, F.regexp_replace(t, "^Direct Messages - ", "DMs with "))


def subreddit(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"r/(\S+)", 1), F.lit(""))


def ics_escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "([,;])", r"\\$1"), "\n", " ")


def is_placeholder(display_name: Column, raw_id: Column) -> Column:
    dn, rid = F.lower(F.coalesce(display_name, F.lit(""))), F.lower(F.coalesce(raw_id, F.lit("")))
    return dn.isin(*PLACEHOLDER_NAMES) | rid.startswith("deleted_user") | dn.startswith("deleted_user")


def thread_group(platform: Column, title: Column, key: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    reddit_dm = t.startswith("dm") | F.coalesce(key, F.lit("")).contains(":reddit.com")
    return (
        F.when(platform.isin("discord", "whatsapp"), F.concat(platform, F.lit("_dm_group")))
        .when(platform.isin("facebook", "instagram"), F.concat(platform, F.when(t.startswith("comment on"), "_comment_thread").otherwise("_dm_group")))
        .when(platform == "reddit", F.when(reddit_dm, "reddit_dm_group").otherwise("reddit_public_thread"))
        .when(platform == "twitter", F.when(t.startswith("dm"), "twitter_dm_group").otherwise("twitter_public_thread"))
        .otherwise(F.concat(platform, F.lit("_public_thread")))
    )


def split_words(line: Column, cap: Column | int, per_word: float = 1.4) -> Column:
    """A line in word-bounded pieces, each closed as soon as its token estimate reaches cap."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    each = F.greatest(F.ceil((cap - 1) / F.lit(per_word)).cast("int"), F.lit(1))
    parts = F.split(line, " ")
    return F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / each).cast("int")), lambda k: F.array_join(F.slice(parts, k * each + 1, each), " "))


def is_dm(platform: Column, title: Column, key: Column) -> Column:
    """Whether a thread is a direct one: those groups of thread_group that aren't public."""
    return thread_group(platform, title, key).endswith("_dm_group")


def shown_name(platform: Column, raw_id: Column, display_name: Column, known: Column) -> Column:
    """The name an account is shown by: of short posts' accounts the handle that is known, else the id; of forums u/ and the name; elsewhere the name, else the id; names of telephone accounts that are only digits are masked."""
    name = F.nullif(F.trim(F.coalesce(display_name, F.lit(""))), F.lit(""))
    plain = F.coalesce(name, raw_id)
    return (
        F.when(platform == "twitter", F.concat(F.lit("@"), F.coalesce(known, plain)))
        .when(platform == "reddit", F.when(plain.startswith("u/"), plain).otherwise(F.concat(F.lit("u/"), plain)))
        .when((platform == "whatsapp") & plain.rlike("^[0-9]+$"), masked_phone(plain))
        .otherwise(plain)
    )


def header(platform: Column, kind: Column, who: Column, dates: Column, title: Column, most: int = 6) -> Column:
    """platform kind · who · dates · title: at most six names and how many more; the title without its number, left out where it is empty or one of the names."""
    names = F.array_join(F.slice(who, 1, most), ", ")
    more = F.when(F.size(who) > most, F.concat(F.lit(" +"), (F.size(who) - most).cast("string"))).otherwise("")
    said = chat_title(title)
    label = F.element_at(F.create_map(*(F.lit(x) for kv in PLATFORM_LABELS.items() for x in kv)), platform)
    return F.concat_ws(" · ", F.concat_ws(" ", label, kind), F.nullif(F.concat(names, more), F.lit("")), dates, F.when(~F.array_contains(who, said), said))


def verified_name(name: Column, texts: Column) -> Column:
    """Whether one of the texts says the name as its writer's ("I'm X", "this is X", "my name is X") or greets by it ("hi X")."""
    pattern = F.concat(F.lit(r"(?i)\b(i'?m|i am|this is|my name is|hi|hey|hello|dear)\s+"), F.regexp_replace(F.trim(name), r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"\b"))
    return F.exists(texts, lambda t: F.regexp_like(t, pattern))


def undated_fact(text: Column) -> Column:
    """A fact's text without "As of <date>," before it, its first letter large."""
    bare = F.regexp_replace(text, r"^As of [^,]{4,20}, ?(?:[0-9]{4}, ?)?", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1_000_000_000))


def transcript_parts(line: Column) -> Column:
    """(at, who, said) of "[ts] who: text"; nulls where a line isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(line, r"^\[([^\]]+)\] ([^:]{1,80}): (?s)(.*)$", k), F.lit(""))
    return F.struct(part(1).alias("at"), part(2).alias("who"), part(3).alias("said"))


def session_title(header_: Column) -> Column:
    """A session's title from its header: the last part that is neither the platform nor a date; else the names."""
    parts = F.split(header_, " · ")
    kept = F.filter(F.slice(parts, 2, 100), lambda p: ~p.rlike("^[0-9]{4}-"))
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(F.element_at(parts, 1))


def initials(name: Column) -> Column:
    """The first letters of the first and the last word, large."""
    w = F.filter(F.split(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} ]", "")), " +"), lambda x: x != "")
    first = F.substring(F.get(w, F.lit(0)), 1, 1)
    last = F.when(F.size(w) > 1, F.substring(F.element_at(w, -1), 1, 1)).otherwise("")
    return F.when(F.size(w) > 0, F.upper(F.concat(first, last))).otherwise("?")


def alias_of(key: Column, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """A made-up name that a key always gets: a word of each list, by its MD5."""
    n = lambda a: F.conv(F.substring(F.md5(key.cast("binary")), a, 6), 16, 10).cast("long")
    pick = lambda words, x: F.element_at(F.array(*map(F.lit, words)), (x % len(words) + 1).cast("int"))
    return F.concat_ws(" ", pick(first, n(1)), pick(second, n(7)))


def old_token_estimate(text: Column) -> Column:
    """int(words * 1.3), and half the characters: the two estimates of older chunks."""
    n = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return F.struct(F.floor(n * F.lit(1.3).cast("double")).cast("int").alias("by_words"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 2).cast("int").alias("by_chars"))


def keyword_bag(*parts: Column) -> Column:
    """Lists of keywords and topics as one string for the index."""
    return F.array_join(F.array_distinct(F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)))), " ")


def with_alias(aliases: Column, name: Column, most: int = 20) -> Column:
    """The list with a name that it lacks at its end; of more than `most` the last stay."""
    added = F.when(F.array_contains(aliases, name), aliases).otherwise(F.array_append(aliases, name))
    return F.slice(added, F.greatest(F.size(added) - most + 1, F.lit(1)), F.lit(most))
