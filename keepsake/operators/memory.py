"""Facts, commitments and profiles: what stands before and after a model call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, unit
from .similarity import cosine_join


def support(facts: DataFrame, raw: DataFrame, least: float = 0.78) -> DataFrame:
    """(fact_id, support): sessions with a raw fact of the same entity at cosine `least` or more, one at least. facts: (fact_id, entity, vec), raw: (entity, session_id, vec)."""
    near = cosine_join(facts.select("fact_id", "entity", "vec"), raw.select("entity", "session_id", "vec"), least, "entity").select(F.col("l_fact_id").alias("fact_id"), F.col("r_session_id").alias("session_id"))
    n = near.groupBy("fact_id").agg(F.count_distinct("session_id").alias("n"))
    return facts.select("fact_id").join(n, "fact_id", "left").select("fact_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long").alias("support"))


def near_duplicates(rows: DataFrame, against: DataFrame, least: float = 0.9, by: str = "entity") -> DataFrame:
    """rows that have no row of `against` in their group at cosine `least` or more. Both: (id, group, vec)."""
    hit = cosine_join(rows.select(by, "id", "vec"), against.select(by, "vec"), least, by).select(F.col("l_id").alias("id")).distinct()
    return rows.join(hit, "id", "left_anti")


def similar_pairs(rows: DataFrame, least: float = 0.86, by: str = "entity") -> DataFrame:
    """Pairs (a, b), a < b, of one group at cosine `least` or more."""
    rows = rows.select(by, "id", "vec")
    return cosine_join(rows, rows, least, by, extra=lambda pairs: pairs.l_id < pairs.r_id).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def current_items(items: DataFrame, today: Column, week: int = 7, undated: int = 21) -> Column:
    """Due within the last week or later; without a date, said within the last three weeks."""
    return F.when(F.col("due").isNotNull(), F.col("due") >= F.date_sub(today, week)).otherwise(F.col("said_on") >= F.date_sub(today, undated))


def bucket(current: Column, mine: Column, verdict: Column, reopened: Column) -> Column:
    """now, cleared or older; reopening beats the verdict."""
    settled = F.coalesce(verdict != "pending", F.lit(False)) & ~F.coalesce(reopened, F.lit(False))
    return F.when(~(current & mine), "older").when(settled, "cleared").otherwise("now")


def facets(items: DataFrame, owner: str = "all", status: str = "now", q: str = "", area: str = "") -> dict[str, DataFrame]:
    """Counts at the depth at which each is shown: buckets before the text filter, areas before the area filter, totals after all. items: (cid, owner, status, text, area, due)."""
    open_ = ("now", "cleared", "older")
    mine = items if owner == "all" else items.filter(F.col("owner") == owner)
    buckets = mine.filter(F.col("status").isin(*open_)).groupBy("status").agg(F.count("*").alias("n"))
    if status == "open":
        mine = mine.filter(F.col("status").isin(*open_))
    elif status != "all":
        mine = mine.filter(F.col("status") == status)
    if q:
        mine = mine.filter(F.lower("text").contains(q.lower()))
    areas = mine.groupBy("area").agg(F.count("*").alias("n"))
    if area:
        mine = mine.filter(F.col("area") == area)
    totals = mine.agg(F.count("*").alias("total"), F.count_if(F.col("owner") == "me").alias("mine"), F.count_if(F.col("owner") == "them").alias("theirs"), F.count("due").alias("with_due"))
    return {"buckets": buckets, "areas": areas, "totals": totals, "items": mine}


def calendar(items: DataFrame) -> DataFrame:
    """(cid, event): an all-day iCalendar event of each item with a due date, lines ended by CRLF. items: (cid, title, what, due date, said_on)."""
    from ..functions.text import ics_escaped

    day = lambda d: F.date_format(d, "yyyyMMdd")
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("cid"), F.lit("@keepsake")), F.concat(F.lit("DTSTART;VALUE=DATE:"), day(F.col("due"))), F.concat(F.lit("DTEND;VALUE=DATE:"), day(F.date_add("due", 1))),
        F.concat(F.lit("SUMMARY:"), ics_escaped(F.col("title"))), F.concat(F.lit("DESCRIPTION:"), ics_escaped(F.concat(F.col("what"), F.lit(" (said "), F.col("said_on").cast("string"), F.lit(")")))), F.lit("END:VEVENT"),
    )
    return items.filter("due is not null").select("cid", F.concat(lines, F.lit("\r\n")).alias("event"))


def dossier(messages: DataFrame, by: str) -> DataFrame:
    """Totals, own messages, first and last day, chats of each person or account. messages: (by, thread_id, is_me, day)."""
    return messages.groupBy(by).agg(
        F.count("*").alias("messages"), F.sum(F.col("is_me").cast("int")).cast("long").alias("by_you"), F.sum((~F.col("is_me")).cast("int")).cast("long").alias("by_them"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("thread_id").alias("chats"),
    )


def month_spine(counts: DataFrame, by: str) -> DataFrame:
    """counts (by, month yyyy-MM, n) with the months between first and last that have none."""
    first = F.to_date(F.concat(F.min("month"), F.lit("-01")))
    last = F.to_date(F.concat(F.max("month"), F.lit("-01")))
    every = counts.groupBy(by).agg(F.sequence(first, last, F.expr("interval 1 month")).alias("m")).select(by, F.explode("m").alias("m")).select(by, F.date_format("m", "yyyy-MM").alias("month"))
    return every.join(counts, [by, "month"], "left").select(by, "month", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mean_vectors(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, vec): the normalised component-wise mean, summed per component so that partial sums merge before the shuffle."""
    each = rows.select(by, F.posexplode(vector).alias("k", "x")).groupBy(by, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("vec"))
    return lists.select(by, unit(F.col("vec")).alias("vec"))


def distinctive(topics: DataFrame) -> DataFrame:
    """(grp, topic, score): share inside times the log ratio of shares inside and outside, topics twice or more inside. topics: (grp, item, topic)."""
    size = topics.groupBy("grp").agg(F.count_distinct("item").alias("n_in"))
    total = topics.agg(F.count_distinct("item").alias("n_all"))
    inside = topics.groupBy("grp", "topic").agg(F.count_distinct("item").alias("c_in"))
    overall = topics.groupBy("topic").agg(F.count_distinct("item").alias("c_all"))
    rows = inside.join(size, "grp").join(overall, "topic").crossJoin(F.broadcast(total))  # one row
    fin = F.col("c_in") / F.col("n_in")
    fout = F.when(F.col("n_all") > F.col("n_in"), (F.col("c_all") - F.col("c_in")) / (F.col("n_all") - F.col("n_in"))).otherwise(0.0)
    return rows.filter(F.col("c_in") >= F.least(F.lit(2), F.col("n_in"))).select("grp", "topic", (fin * F.log((fin + 0.01) / (fout + 0.01))).alias("score"))


def display_order(items: DataFrame) -> DataFrame:
    """(id, grp, k): due within the week and later in order of days, overdue the latest first, undated the newest first. items: (id, due: days from today)."""
    due = F.col("due")
    grp = F.when(due.between(0, 7), "week").when(due > 7, "later").when(due < 0, "overdue").otherwise("undated")
    order = F.when(F.col("grp").isin("week", "later"), due).otherwise(-due)
    w = Window.partitionBy("grp").orderBy(order.asc_nulls_last(), F.desc("id"))
    return items.withColumn("grp", grp).select("id", "grp", F.row_number().over(w).alias("k"))


def recalled(facts: DataFrame, rejected: DataFrame, entities: list[int], query: Column | None, past: bool = False, k: int = 20) -> DataFrame:
    """The k facts of some entities that a question recalls, with score and rank: by cosine to the question's vector, or without one current facts first. Facts that the user has refused don't come, past ones only when asked for. facts: (fact, entity, vec, status)."""
    rows = facts.filter(F.col("entity").isin(*entities)).join(rejected.select("fact"), "fact", "left_anti")
    rows = rows if past else rows.filter("status = 'current'")
    if query is None:
        rows, order = rows.withColumn("score", F.lit(None).cast("double")), [F.col("status") == "past", F.col("fact")]
    else:
        rows, order = rows.withColumn("score", F.round(cosine(F.col("vec"), query), 6)), [F.desc("score"), F.col("fact")]
    best = rows.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows


def theme_names(topics: DataFrame, most: int = 3, least: int = 2, share: float = 0.02) -> DataFrame:
    """(scope, theme, names): up to `most` topics that set a theme apart, each used once in a scope; the largest theme picks first. Themes with fewer than `least` items, or under `share` of the scope's, get none. topics: (scope, theme, item, topic). Themes of a scope pick in turn, all scopes at once."""
    from ..sources.shared import kept

    items = topics.select("scope", "theme", "item").distinct()
    size = items.groupBy("scope", "theme").agg(F.count("*").alias("n_in"))
    total = items.select("scope", "item").distinct().groupBy("scope").agg(F.count("*").alias("n_all"))
    large = size.join(total, "scope").filter((F.col("n_in") >= least) & (F.col("n_in") >= share * F.col("n_all")))
    turn = large.withColumn("turn", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("n_in"), "theme")))
    inside = topics.groupBy("scope", "theme", "topic").agg(F.count_distinct("item").alias("c_in"))
    overall = topics.groupBy("scope", "topic").agg(F.count_distinct("item").alias("c_all"))
    rows = inside.join(turn, ["scope", "theme"]).join(overall, ["scope", "topic"])
    fin = F.col("c_in") / F.col("n_in")
    fout = F.when(F.col("n_all") > F.col("n_in"), (F.col("c_all") - F.col("c_in")) / (F.col("n_all") - F.col("n_in"))).otherwise(0.0)
    scored = kept(rows.filter(F.col("c_in") >= F.least(F.lit(2), F.col("n_in"))).select("scope", "theme", "turn", "topic", F.round(fin * F.log((fin + 0.01) / (fout + 0.01)), 9).alias("score")).filter("score > 0"), "scored")
    last = scored.agg(F.max("turn")).first()[0] or 0
    taken = None
    for k in range(1, last + 1):
        free = scored.filter(F.col("turn") == k)
        free = free if taken is None else free.join(taken.select("scope", "topic"), ["scope", "topic"], "left_anti")
        place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "topic"))
        picked = free.withColumn("k", place).filter(F.col("k") <= most).select("scope", "theme", "topic", "k")
        taken = kept(picked if taken is None else taken.unionByName(picked), "names")
    if taken is None:
        return turn.select("scope", "theme", F.array().cast("array<string>").alias("names")).limit(0)
    return taken.groupBy("scope", "theme").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "topic"))), lambda s: s["topic"]).alias("names"))


def where_and_when(rows: DataFrame, minutes: int = 330) -> DataFrame:
    """(theme, mostly, span): the place that half of a theme's rows or more are in, and its months. rows: (theme, place, ts)."""
    from ..functions import times

    by = rows.groupBy("theme", "place").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    each = by.groupBy("theme").agg(F.max_by(F.struct("place", "n"), F.struct("n", -F.ascii("place"))).alias("best"), F.sum("n").alias("all"), F.min("a").alias("a"), F.max("b").alias("b"))
    return each.select("theme", F.when(F.col("best.n") >= 0.5 * F.col("all"), F.col("best.place")).alias("mostly"), times.month_span(F.col("a"), F.col("b"), minutes).alias("span"))


def remembered(notes: DataFrame | None, new: DataFrame) -> DataFrame:
    """The notes table (note, text, active) with notes (note, text) put in, in place of those of their number."""
    from .tables import upserted

    add = new.select("note", "text", F.lit(True).alias("active"))
    return add if notes is None else upserted(notes, add, ["note"])


def forgotten(notes: DataFrame, gone: DataFrame) -> DataFrame:
    """The notes table with some notes (note) set inactive; their rows stay."""
    return notes.join(gone.select("note", F.lit(True).alias("_gone")), "note", "left").select("note", "text", (F.col("active") & F.col("_gone").isNull()).alias("active"))


def listed_notes(notes: DataFrame) -> DataFrame:
    return notes.filter("active").select("note", "text")


def with_notes(results: DataFrame, notes: DataFrame) -> DataFrame:
    """(result, notes): the notes about accounts that results name. results: (result, account_ids), notes: (account_id, note)."""
    each = results.select("result", F.explode(F.array_distinct("account_ids")).alias("account_id")).join(notes, "account_id")
    return each.groupBy("result").agg(F.array_sort(F.collect_set("note")).alias("notes"))
