"""What stands before and after calls to a model: batches and prompts made from rows, answers checked and put back.

A model is a callable that is given by the caller and runs in tasks, from lists of texts to answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import unit
from .identity import match_levels
from .similarity import nearest_join
from .tables import ordered

FACT = "array<struct<subject:string,kind:string,category:string,statement:string>>"
KINDS = ("habit", "event", "state", "relation", "plan")
COMMITMENT = "commitments array<struct<what:string,owner:string,due:string>>"


def in_calls(rows: DataFrame, key: str, size: int, *more: str) -> DataFrame:
    """rows with call: numbers of batches of `size` rows in order of the key."""
    return ordered(rows, [key, *more], "_k").withColumn("call", F.floor(F.col("_k") / size).cast("long")).drop("_k")


def prompts(sessions: DataFrame, chat: str) -> DataFrame:
    """(session, prompt): each session's text between those of its neighbours in the chat. sessions: (session, chat, start_ts, body)."""
    w = Window.partitionBy(chat).orderBy("start_ts", "session")
    other = lambda f: F.coalesce(f("body").over(w), F.lit("-"))
    return sessions.select("session", F.concat_ws("\n", F.lit("Before:"), other(F.lag), F.lit("Session:"), F.col("body"), F.lit("After:"), other(F.lead)).alias("prompt"))


def asked(rows: DataFrame, columns: list[str], model: Callable[..., list], name: str, kind: str = "string") -> DataFrame:
    """rows with a model's answers, batch by batch; model takes lists, one a column, and gives a list."""
    schema = rows.withColumn(name, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = model(*(b.column(c).to_pylist() for c in columns))
                of = pa.string() if kind == "string" else pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, of)], names=schema.names)

    return rows.mapInArrow(run, schema)


def embedded(texts: DataFrame, old: DataFrame | None, key: str, text: str, encode: Callable[[list[str]], list[list[float]]], unit_length: bool = True) -> DataFrame:
    """(key, vec): a vector for each text, those in old (key, vec) reused. What is new is dealt by length, so that a batch holds texts of like length."""
    fresh = texts if old is None else texts.join(old.select(key), key, "left_anti")
    dealt = fresh.select(key, text, F.length(text).alias("_n")).repartitionByRange("_n").sortWithinPartitions("_n")
    made = asked(dealt, [text], encode, "vec", "array<double>").select(key, (unit(F.col("vec")) if unit_length else F.col("vec")).alias("vec"))
    return made if old is None else made.unionByName(old.select(key, F.col("vec").cast("array<double>").alias("vec")))


def raw_facts(sessions: DataFrame, session: str, text: str, model: Callable[[list, list], list], per_call: int = 6) -> DataFrame:
    """(session, call, subject, kind, category, statement, fact_id): what a model finds in sessions, `per_call` of them a call. Answers that aren't a list of facts give none; facts without a statement or of an unknown kind are dropped."""
    answers = asked(in_calls(sessions.select(session, text), session, per_call), [session, text], model, "answer")
    f = answers.select(F.col(session).alias("session"), "call", F.explode(F.from_json("answer", FACT)).alias("f")).select("session", "call", "f.*")
    good = f.filter(F.col("kind").isin(*KINDS) & (F.trim(F.coalesce("statement", F.lit(""))) != "") & F.col("subject").isNotNull())
    return good.withColumn("fact_id", tx.stable_id("f_", F.array(F.col("session").cast("string"), "statement")))


def linked(facts: DataFrame, participants: DataFrame, own: tuple[str, ...] = ("i", "me", "myself", "user")) -> DataFrame:
    """(fact, kind, account_id): whom a fact is about: the owner, the one participant that its subject names, or a thing. facts: (fact, scope, subject), participants: (scope, account_id, name)."""
    named = facts.filter(~F.lower("subject").isin(*own))
    found = match_levels(named.select(F.col("fact").alias("subject_id"), "scope", tx.name_key(F.col("subject")).alias("name")), participants.select("scope", "account_id", tx.name_key(F.col("name")).alias("name")))
    both = facts.join(found.withColumnRenamed("subject_id", "fact"), "fact", "left")
    return both.select("fact", F.when(F.lower("subject").isin(*own), "self").when(F.col("account_id").isNotNull(), "account").otherwise("thing").alias("kind"), "account_id")


def consolidated(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """(entity, cluster, n, statement): a single fact as it is; a group as a model has merged it, or where it hasn't, its latest. facts: (entity, cluster, id, statement, said_on), merged: (entity, cluster, merged)."""
    g = facts.groupBy("entity", "cluster").agg(F.count("*").alias("n"), F.max_by("statement", F.struct("said_on", "id")).alias("latest"))
    both = g.join(merged, ["entity", "cluster"], "left")
    return both.select("entity", "cluster", "n", F.when(F.col("n") == 1, F.col("latest")).otherwise(F.coalesce("merged", "latest")).alias("statement"))


def evidence(facts: DataFrame, pieces: DataFrame, k: int = 3) -> DataFrame:
    """(fact, evidence): the k pieces nearest to each fact among those of its entity, the nearest first. Both: (id, entity, vec). Facts and pieces without a cosine have and are none."""
    best = nearest_join(facts.select("id", "entity", "vec"), pieces.select("id", "entity", "vec"), k, "id", "entity")
    return best.groupBy(F.col("l_id").alias("fact")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r_id"))), lambda x: x["r_id"]).alias("evidence"))


def after_verdict(verdict: Column) -> Column:
    """What becomes of a fact: wrong and unverifiable ones are set aside, partly right ones corrected (and embedded anew), the others kept."""
    return F.when(verdict.isin("wrong", "unverifiable"), "quarantined").when(verdict == "partly", "corrected").otherwise("kept")


def corrected(facts: DataFrame, said: DataFrame) -> DataFrame:
    """facts (fact, text) after a rebuild, as the user has left them: refused ones gone, edited ones in the user's words. said: (fact, verdict, correction)."""
    both = facts.join(said, "fact", "left").filter(F.coalesce(F.col("verdict") != "wrong", F.lit(True)))
    return both.select("fact", F.when(F.col("verdict") == "edited", F.coalesce("correction", "text")).otherwise(F.col("text")).alias("text"))


def commitments(summaries: DataFrame, per_call: int = 40) -> DataFrame:
    """(session, what, owner, due, call): the commitments that summaries (session, summary as JSON) name, `per_call` a call. Those without a text are dropped, owners are me or them, a date that isn't one is null."""
    c = summaries.select("session", F.explode(F.from_json("summary", COMMITMENT)["commitments"]).alias("c")).select("session", "c.*").filter("trim(coalesce(what, '')) <> ''")
    c = c.select("session", "what", F.when(F.col("owner") == "me", "me").otherwise("them").alias("owner"), F.col("due").try_cast("date").alias("due"))
    return in_calls(c, "session", per_call, "what")


def checked_names(guesses: DataFrame, messages: DataFrame) -> DataFrame:
    """(account, guess, sure): whether a message of the account's chat says the name guessed. messages: (account, text)."""
    said = guesses.join(messages, "account").groupBy("account").agg(F.bool_or(tx.verified_name(F.col("guess"), F.array("text"))).alias("sure"))
    return guesses.join(said, "account", "left").select("account", "guess", F.coalesce("sure", F.lit(False)).alias("sure"))
