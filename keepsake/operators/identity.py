"""Accounts and people: detection, folding, suggestions and the user-written overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .automaton import occurring


def match_levels(subjects: DataFrame, participants: DataFrame) -> DataFrame:
    """(subject_id, account_id): the one participant a subject's name means. Levels: the same name; the same words; the subject's words all in the name; the same first word. The first level with a match decides, and only if it has a single one. subjects: (subject_id, scope, name), participants: (scope, account_id, name), names already keys."""
    words = F.array_sort(F.array_distinct(F.split("name", " "))).alias("ws")
    s = subjects.select("subject_id", "scope", "name", words, F.element_at(F.split("name", " "), 1).alias("first")).filter("name <> ''")
    p = participants.select("scope", F.struct("account_id").alias("a"), "name", words, F.element_at(F.split("name", " "), 1).alias("first")).filter("name <> ''")
    # a level has a single match if the least account at it is the largest, so accounts meet subjects as one row a key
    spans = lambda *by: p.groupBy(*by).agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    hits = lambda level, rows, found, *on: rows.join(found, [*on]).select("subject_id", F.lit(level).alias("level"), "lo", "hi")
    sets = spans("scope", "ws")
    same = hits(1, s, spans("scope", "name"), "scope", "name").unionByName(hits(2, s, sets, "scope", "ws"))
    rest = s.join(same.select("subject_id").distinct(), "subject_id", "left_anti")
    inside = hits(3, rest, _held(rest.select("scope", "ws").distinct(), sets), "scope", "ws")
    every = same.unionByName(inside).unionByName(hits(4, s, spans("scope", "first"), "scope", "first"))
    best = every.groupBy("subject_id").agg(F.min(F.struct("level", "lo")).alias("l"), F.max(F.struct(-F.col("level"), "hi")).alias("h"))
    return best.filter(F.col("l.lo").eqNullSafe(F.col("h.hi"))).select("subject_id", "l.lo.account_id")


def _held(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(scope, ws, lo, hi): the least and largest account among the sets of words that hold all words asked. They meet under the rarest of the words asked; a single word needs no meeting. asked: (scope, ws), sets: (scope, ws, lo, hi)."""
    each = sets.select("scope", F.col("ws").alias("pw"), "lo", "hi", F.explode("ws").alias("w"))
    often = each.groupBy("scope", "w").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = asked.select("scope", "ws", F.explode("ws").alias("w")).join(often, ["scope", "w"])
    rare = known.groupBy("scope", "ws").agg(F.count("*").alias("found"), F.min(F.struct("n", "w", "lo", "hi")).alias("r")).filter(F.col("found") == F.size("ws"))
    one = rare.filter(F.size("ws") == 1).select("scope", "ws", "r.lo", "r.hi")
    met = rare.filter(F.size("ws") > 1).select("scope", "ws", "r.w").join(each, ["scope", "w"]).filter(F.size(F.array_except("ws", "pw")) == 0)
    return one.unionByName(met.groupBy("scope", "ws").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def owner_accounts(users: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, how): users that the owner's aliases mean, by raw id always, by display name only if one user of the platform has it. aliases: (platform, alias)."""
    a = aliases.select("platform", F.lower("alias").alias("alias")).distinct()
    by_id = users.withColumn("alias", F.lower("raw_id")).join(a, ["platform", "alias"], "left_semi").select("id", F.lit("raw_id").alias("how"))
    named = users.withColumn("alias", F.lower("display_name"))
    single = named.groupBy("platform", "alias").agg(F.count("*").alias("n")).filter("n = 1").select("platform", "alias")
    by_name = named.join(a, ["platform", "alias"], "left_semi").join(single, ["platform", "alias"], "left_semi").select("id", F.lit("name").alias("how"))
    return by_id.unionByName(by_name.join(by_id, "id", "left_anti"))


def folded(group_names: DataFrame, contacts: DataFrame) -> DataFrame:
    """(id, into): group participants folded into the one direct contact of the platform with their name. Both: (id, platform, name)."""
    one = contacts.groupBy("platform", "name").agg(F.count("*").alias("n"), F.min("id").alias("into")).filter("n = 1")
    return group_names.join(one, ["platform", "name"]).filter("id <> into").select("id", "into")


def exploded_placeholders(messages: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, thread_id, n, first_ts, last_ts): a row for every chat in which a user without a name of their own wrote."""
    nameless = users.filter(tx.is_placeholder(F.col("display_name"), F.col("raw_id"))).select(F.col("id").alias("user_id"))
    return messages.join(nameless, "user_id", "left_semi").groupBy("user_id", "thread_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_suggestions(accounts: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(name_key, a, b): pairs of two to six accounts with the same name key that wrote something, but those rejected. rejected: pairs (a, b) in either order."""
    keyed = accounts.filter("messages > 0").withColumn("name_key", tx.merge_key(F.col("name"))).filter("name_key is not null")
    sized = keyed.groupBy("name_key").agg(F.count("*").alias("n")).filter("n between 2 and 6")
    few = keyed.join(sized, "name_key").select("name_key", "account_id")
    pairs = few.alias("x").join(few.alias("y"), "name_key").filter("x.account_id < y.account_id").select("name_key", F.col("x.account_id").alias("a"), F.col("y.account_id").alias("b"))
    if rejected is None:
        return pairs
    no = rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(no, ["a", "b"], "left_anti").select("name_key", "a", "b")


def rekeyed(rows: DataFrame, nodes: str, moved: DataFrame) -> DataFrame:
    """rows with account nodes A_<old> in an array column as A_<new>. moved: (old, new), one row an account that moved."""
    key = rows.withColumn("_r", F.monotonically_increasing_id())
    m = moved.select(F.concat(F.lit("A_"), F.col("old").cast("string")).alias("n"), F.concat(F.lit("A_"), F.col("new").cast("string")).alias("_to"))
    each = key.select("_r", F.posexplode(nodes).alias("_k", "n")).join(m, "n", "left").select("_r", "_k", F.coalesce("_to", "n").alias("n"))
    lists = each.groupBy("_r").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_k", "n"))), lambda s: s["n"])).alias("_nodes"))
    return key.join(lists, "_r", "left").withColumn(nodes, F.coalesce("_nodes", F.col(nodes))).drop("_r", "_nodes")


class People:
    """The user-written overlay of people: (person_id, name) and (platform, raw_id, chat, person_id). Person 1 is the owner. Each change returns new frames; the caller writes them."""

    def __init__(self, people: DataFrame, members: DataFrame):
        self.people, self.members = people, members

    def create(self, name: str, keys: list[tuple]) -> People:
        spark = self.people.sparkSession
        new = (self.people.agg(F.max("person_id")).first()[0] or 0) + 1
        return People(self.people.unionByName(spark.createDataFrame([(new, name)], self.people.schema)), self.members).attach(new, keys)

    def attach(self, person_id: int, keys: list[tuple]) -> People:
        """Accounts move from whatever person they were with."""
        add = self.members.sparkSession.createDataFrame([(*k, person_id) for k in keys], self.members.schema)
        on = ["platform", "raw_id", "chat"]
        return People(self.people, self.members.join(F.broadcast(add), on, "left_anti").unionByName(add))  # as many rows as keys given

    def detach(self, key: tuple) -> People:
        p, r, c = key
        return People(self.people, self.members.filter(~((F.col("platform") == p) & (F.col("raw_id") == r) & F.col("chat").eqNullSafe(F.lit(c)))))

    def rename(self, person_id: int, name: str) -> People:
        return People(self.people.withColumn("name", F.when(F.col("person_id") == person_id, name).otherwise(F.col("name"))), self.members)

    def delete(self, person_id: int) -> People:
        if person_id == 1:
            raise ValueError("the owner can't be deleted")
        return People(self.people.filter(F.col("person_id") != person_id), self.members.filter(F.col("person_id") != person_id))


def candidates(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """People and accounts whose name contains a text: exact names first, people before accounts, then by messages. nodes: (node, kind, name, messages)."""
    q = name.strip().lower()
    low = F.lower("name")
    order = Window.orderBy(F.desc(low == q), F.desc(F.col("kind") == "person"), F.desc("messages"), "node")
    hits = nodes.filter(low.contains(q)).orderBy(F.desc(low == q), F.desc(F.col("kind") == "person"), F.desc("messages"), "node").limit(limit)
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))  # limit rows


def ghost_authors(ghosts: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """(id, author): the author of each missing post by the first source that knows it. sources: (id, author), best first."""
    from functools import reduce

    ranked = [s.select("id", F.struct(F.lit(k).alias("k"), F.col("author")).alias("s")) for k, s in enumerate(sources)]
    best = reduce(DataFrame.unionByName, ranked).filter("s.author is not null").groupBy("id").agg(F.min("s")["author"].alias("author"))
    return ghosts.select("id").join(best, "id", "left").select("id", F.coalesce("author", F.lit("unknown")).alias("author"))


def ancestor_chains(starts: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(start, id, depth, src): from each start up to the first post that no source knows, which is a ghost. sources: name and (id, parent), best first. A frontier is joined a level at a time until it is empty; a chain that comes back to itself ends there."""
    from functools import reduce

    from ..sources.shared import Levels, kept

    ranked = [s.select("id", F.struct(F.lit(k).alias("k"), F.lit(name).alias("src"), "parent").alias("s")) for k, (name, s) in enumerate(sources)]
    known = kept(reduce(DataFrame.unionByName, ranked).groupBy("id").agg(F.min("s").alias("s")).select("id", "s.src", "s.parent"), "known")
    frontier = starts.select("start", F.col("start").alias("id"), F.array("start").alias("_seen"))
    levels, depth = Levels(starts.sparkSession, "chain"), 0
    while True:
        rows = levels.add(depth, frontier.join(known, "id", "left").select("start", "id", "src", "parent", "_seen"))
        if rows.isEmpty():
            return levels.all().select("start", "id", F.col("level").alias("depth"), F.coalesce("src", F.lit("ghost")).alias("src"))
        depth += 1
        on = rows.filter(F.col("src").isNotNull() & F.col("parent").isNotNull() & ~F.array_contains("_seen", F.col("parent")))
        frontier = on.select("start", F.col("parent").alias("id"), F.array_append("_seen", F.col("parent")).alias("_seen"))


def without_rejected(pairs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs (a, b), the smaller first, but those rejected in either order."""
    no = rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(no, ["a", "b"], "left_anti")


def mentioned(texts: DataFrame, names: DataFrame, most: int = 3000, each: int = 12) -> DataFrame:
    """(id, name): which of the `most` largest names stand in a text between word edges, whatever their case, at most `each` a text, the largest first. names: (name, size), of words joined by single spaces. An automaton of the names goes over the texts where they are."""
    top = names.orderBy(F.desc("size"), "name").limit(most)
    # words and what stands between them
    parts = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0))
    hits = occurring(texts.select("id", parts("text").alias("tokens")), top.select(F.col("name").alias("pattern"), parts("name").alias("tokens")))
    sized = hits.join(F.broadcast(top), F.col("pattern") == F.col("name")).select("id", "name", "size")  # at most `most` names
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("size"), "name"))
    return sized.withColumn("k", k).filter(F.col("k") <= each).select("id", "name")


def handles(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, handle, first_seen, n, current): handles that mentions in texts give an account, when first and how often. The current one is the profile's, or where there is none the last mentioned. texts: (id, msg_id, seen, text), profiles: (id, handle)."""
    found = F.regexp_extract_all("text", F.lit(r"(?<![\w.+-])@(\w{2,30})"), F.lit(1))
    m = texts.select("id", "msg_id", "seen", F.explode(found).alias("handle"))
    each = m.groupBy("id", "handle").agg(F.min("seen").alias("first_seen"), F.count("*").alias("n"), F.max(F.struct("seen", "msg_id")).alias("_last"))
    latest = each.groupBy("id").agg(F.max_by("handle", "_last").alias("_latest"))
    own = profiles.groupBy("id").agg(F.max("handle").alias("_own"))
    both = each.join(latest, "id").join(own, "id", "left")
    return both.select("id", "handle", "first_seen", "n", (F.col("handle") == F.coalesce("_own", "_latest")).alias("current"))


def members_inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(brand, a, b): rows a whose set is inside b's, of one brand. Sets are compared once however many rows have them, met under the rarest element; rows are then joined to the pairs of sets. inner: (brand, a, inner), outer: (brand, b, outer), sets as sorted arrays."""
    from .tables import met_under

    small, large = inner.select("brand", "inner").distinct(), outer.select("brand", "outer").distinct()
    each = large.select("brand", "outer", F.explode("outer").alias("w"))
    often = each.groupBy("brand", "w").agg(F.count("*").alias("n"))
    known = small.select("brand", "inner", F.explode("inner").alias("w")).join(often, ["brand", "w"])
    rare = known.groupBy("brand", "inner").agg(F.min(F.struct("n", "w"))["w"].alias("w"), F.count("*").alias("found")).filter(F.col("found") == F.size("inner"))
    sets = rare.join(each, ["brand", "w"]).filter(F.size(F.array_except("inner", "outer")) == 0).select("brand", "inner", "outer")
    asked = inner.join(sets, ["brand", "inner"]).select("brand", "outer", "a")
    met = met_under(asked, outer, ["brand", "outer"])
    return met.select("brand", F.col("l_a").alias("a"), F.col("r_b").alias("b"))
