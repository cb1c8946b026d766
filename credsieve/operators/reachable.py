"""Commits that a start ref reaches, over a table of (commit, parent).

History is mostly chains: commits with one parent that is no other's.  A walk step by step
would take as many joins as the longest chain has commits.  Chains are therefore contracted
first by pointer doubling, in a number of rounds that is the logarithm of their length: each
commit learns its chain's top (the commit nearest to now) and how far below it lies.  Then a
frontier of chains is walked, one join for each merge or fork on the way.

The state is a table that is written in each round; nothing but its number of new rows reaches
the driver.  Parents that are not commits themselves (a shallow history), repeated edges and
null parents are allowed.  A graph with a cycle, which no history is, is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.operators.joins import skewed_join
from credsieve.session import settled

#: Rounds of doubling: chains of up to 2 ** 40 commits.
MOST_DOUBLINGS = 40


def chains(edges: DataFrame) -> DataFrame:
    """(``commit``, ``top``, ``below``) of every commit of (``commit``, ``parent``) edges."""
    commits = settled(edges.select(F.explode(F.array("commit", "parent")).alias("commit")).where("commit is not null").distinct())
    edges = edges.where("parent is not null").select("commit", "parent").distinct()
    # An inner link of a chain: the only parent of its child, and the only child of its parent.
    only_parent = edges.groupBy("commit").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).where("n = 1").drop("n")
    only_child = edges.groupBy("parent").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    links = only_parent.join(only_child, "parent").select(F.col("parent").alias("commit"), F.col("commit").alias("up"))
    # Each commit points up its chain; the top points nowhere.
    state = settled(
        commits.join(links, "commit", "left").selectExpr("commit", "coalesce(up, commit) as top", "if(up is null, 0L, 1L) as below", "up is null as done")
    )
    for _ in range(MOST_DOUBLINGS):
        if state.where("not done").isEmpty():
            return state.drop("done")
        upper = state.selectExpr("commit as top", "top as next", "below as more", "done as ends")
        state = settled(
            state.join(upper, "top").selectExpr("commit", "next as top", "below + more as below", "done or ends as done")
        )
    raise ValueError("the commits' parents form a cycle")


def reachable_commits(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """The distinct ``commit`` of all that ``refs`` (``commit``) reach along (``commit``, ``parent``), refs included.

    Refs that are in no edge are commits without parents.
    """
    refs = refs.select("commit").where("commit is not null").distinct()
    edges = settled(edges.select("commit", "parent"))
    placed = settled(chains(edges.unionByName(refs.withColumn("parent", F.lit(None).cast(edges.schema["parent"].dataType)))))
    # What a chain leads to beyond its last commit; a link within a chain is no way out of it.
    child = placed.selectExpr("commit", "top as chain")
    parent = placed.selectExpr("commit as parent", "top as next")
    ways = settled(
        edges.where("parent is not null").distinct().join(child, "commit").join(parent, "parent").where("chain <> next").select("chain", "next").distinct()
    )
    # A chain is entered at its top, but for the refs: from there on all of it is reached.
    entered = settled(refs.join(placed, "commit").groupBy(F.col("top").alias("chain")).agg(F.min("below").alias("below")))
    frontier = entered
    while True:
        met = frontier.join(ways, "chain").selectExpr("next as chain", "0L as below").distinct()
        known = entered.where("below = 0").select("chain")
        new = settled(met.join(known, "chain", "left_anti"))
        if new.isEmpty():
            break
        # A chain that a ref lies in may be entered again, higher up; its ways out are known then.
        frontier = settled(new.join(entered.select("chain"), "chain", "left_anti"))
        entered = settled(entered.unionByName(new).groupBy("chain").agg(F.min("below").alias("below")))
    found = skewed_join(placed.withColumnRenamed("top", "chain"), entered.withColumnRenamed("below", "first"), ["chain"], "inner")
    return found.where("below >= first").select("commit")
