"""The nine interactive queries of the social-network benchmark, as documented for it.

Reads filter, then sort by a total order, then limit. Properties are joined on after the limit where the order allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft.functions.props import prop
from weft.operators import dml
from weft.operators.graph import PropertyGraph
from weft.session import stage

#: Replies followed in one job.
HOPS_AT_ONCE = 6


def _people(g: PropertyGraph, key: str, **names: str) -> DataFrame:
    """Persons' id as ``key`` and the named properties."""
    return g.with_label("Person").select(F.col("vid").alias(key), *(prop(p).alias(n) for n, p in names.items()))


def _messages(g: PropertyGraph, key: str, label: str = "Message") -> DataFrame:
    return g.with_label(label).select(F.col("vid").alias(key), prop("creationDate", "bigint").alias("date"), prop("content").alias("content"))


def _creators(g: PropertyGraph) -> DataFrame:
    return g.edges_of("hasCreator").select(F.col("src").alias("message"), F.col("dst").alias("creator"))


def recent_messages_of_friends(g: PropertyGraph, person: int, before: int, n: int = 20) -> DataFrame:
    """IC2: the newest messages by friends created before a time."""
    friends = g.neighbours(person, "knows", "Person").withColumnRenamed("dst", "creator")
    made = _creators(g).join(friends, "creator", "left_semi").join(_messages(g, "message"), "message").filter(F.col("date") < before)
    top = made.orderBy(F.col("date").desc(), "message").limit(n)
    return top.join(_people(g, "creator", first="firstName", last="lastName"), "creator").select(
        F.col("creator").alias("personId"), F.col("first").alias("personFirstName"), F.col("last").alias("personLastName"), F.col("message").alias("postOrCommentId"), F.col("date").alias("postOrCommentCreationDate")
    )


def recent_replies(g: PropertyGraph, person: int, n: int = 20) -> DataFrame:
    """IC8: the newest comments replying to a person's messages, with their authors."""
    own = _creators(g).filter(F.col("creator") == person).select(F.col("message").alias("dst"))
    replies = g.edges_of("replyOf").join(own, "dst", "left_semi").select(F.col("src").alias("message")).distinct()
    top = replies.join(_messages(g, "message", "Comment"), "message").join(_creators(g), "message").orderBy(F.col("date").desc_nulls_last(), "message", "creator").limit(n)
    return top.join(_people(g, "creator", first="firstName", last="lastName"), "creator").select(
        F.col("creator").alias("personId"), F.col("first").alias("personFirstName"), F.col("last").alias("personLastName"), F.col("date").alias("commentCreationDate"), F.col("message").alias("commentId"), F.col("content").alias("commentContent")
    )


def person_messages(g: PropertyGraph, person: int, n: int = 10) -> DataFrame:
    """IS2: a person's newest messages with the post each thread began with and its author.

    The root is the nearest post, however many replies away, the smaller id where several are as near; without one, as where its
    author is unknown, the columns are null. The walk ends where it meets no message it has not met before.
    """
    top = _creators(g).filter(F.col("creator") == person).select("message").join(_messages(g, "message"), "message").orderBy(F.col("date").desc_nulls_last(), F.col("message").desc()).limit(n).select("message", "date")
    posts = g.with_label("Post").select(F.col("vid").alias("at"))
    reply = g.edges_of("replyOf").select(F.col("src").alias("at"), F.col("dst").alias("next"))
    walked = here = stage(top.select("message", F.col("message").alias("at"), F.lit(0).alias("hops")), "is2")
    found, hop = 1, 0
    # a message has few parents, so the steps of the ten threads are a few rows; several are taken before the frontier is looked at
    while found:
        steps, front = None, here
        for _ in range(HOPS_AT_ONCE):
            front = front.join(reply, "at").select("message", F.col("next").alias("at"), (F.col("hops") + 1).alias("hops")).distinct()
            steps = front if steps is None else steps.unionByName(front)
        seen = Observation()
        new = steps.groupBy("message", "at").agg(F.min("hops").alias("hops")).join(walked.select("message", "at"), ["message", "at"], "left_anti")
        hop += HOPS_AT_ONCE
        new = stage(new.observe(seen, F.count_if(F.col("hops") == hop).alias("n")), "is2")
        found, here = seen.get["n"], new.filter(F.col("hops") == hop)
        walked = walked.unionByName(new)
    roots = walked.join(posts, "at", "left_semi").groupBy("message").agg(F.min(F.struct("hops", "at")).alias("r")).select("message", F.col("r.at").alias("postId"))
    author = _creators(g).select(F.col("message").alias("postId"), "creator").join(_people(g, "creator", first="firstName", last="lastName"), "creator")
    return top.join(roots, "message", "left").join(author, "postId", "left").select(
        F.col("message").alias("messageId"), F.col("date").alias("messageCreationDate"), "postId", F.col("creator").alias("personId"), F.col("first").alias("personFirstName"), F.col("last").alias("personLastName")
    )


def replies_of(g: PropertyGraph, message: int) -> DataFrame:
    """IS7: the comments replying to a message, their authors, and whether the message's author knows them."""
    replies = g.pattern("Comment", "replyOf", message).select(F.col("src").alias("message")).distinct().join(_messages(g, "message", "Comment"), "message").join(_creators(g), "message")
    author = _creators(g).filter(F.col("message") == message).select(F.col("creator").alias("src"))
    known = g.edges_of("knows").join(author, "src", "left_semi").select(F.col("dst").alias("creator"), F.lit(True).alias("known")).distinct()
    rows = replies.join(_people(g, "creator", first="firstName", last="lastName"), "creator").join(known, "creator", "left")
    return rows.select(
        F.col("message").alias("commentId"), F.col("content").alias("commentContent"), F.col("date").alias("commentCreationDate"), F.col("creator").alias("replyAuthorId"), F.col("first").alias("replyAuthorFirstName"), F.col("last").alias("replyAuthorLastName"),
        F.coalesce("known", F.lit(False)).alias("replyAuthorKnowsOriginalMessageAuthor"),
    ).orderBy(F.col("commentCreationDate").desc_nulls_last(), "replyAuthorId", "commentId")


def add_like(g: PropertyGraph, person: int, post: int, at: int) -> PropertyGraph:
    """IU2."""
    return dml.add_edge(g, person, post, "likes", {"creationDate": str(at)})


def add_friendship(g: PropertyGraph, a: int, b: int, at: int) -> PropertyGraph:
    """IU8: both directions, as friendships are loaded."""
    return dml.add_edge(g, a, b, "knows", {"creationDate": str(at)}, undirected=True)


def remove_like(g: PropertyGraph, person: int, post: int) -> tuple[PropertyGraph, DataFrame]:
    """ID2: also a row with the number of likes removed."""
    return dml.rm_edge(g, person, post, "likes"), dml.count_edges(g, person, post, "likes")


def remove_replies(g: PropertyGraph, message: int) -> tuple[PropertyGraph, DataFrame]:
    """ID7: remove every direct reply comment with its edges; also the ids removed."""
    gone = g.pattern("Comment", "replyOf", message).select(F.col("src").alias("vid")).distinct()
    return dml.rm_vertices(g, gone), gone


def remove_friendship(g: PropertyGraph, a: int, b: int) -> tuple[PropertyGraph, DataFrame]:
    """ID8: also a row with the number of friendships removed."""
    return dml.rm_undirected(g, a, b, "knows")
