"""Who reaches what in a directed graph of memberships, for every node at once.

Each round joins paths of the last length with all known ones, so the lengths that are known double and a
chain of a million memberships takes twenty rounds. Every round is written: a lost executor costs one step, and
a node with a third of all edges is a join's key between written tables, which is split.

Defined cases: nobody is said to reach itself, in cycles either; repeated edges count once; edges with a null end
are left out; no edges give no rows. The result has a row for each two nodes of which one reaches the other,
which is what is asked; nothing of it comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.shared import materialize, release, written


def closure(edges: DataFrame) -> DataFrame:
    """(member, role) of every role that a member reaches over ``edges`` (member, role), by paths of any length."""
    last = known = materialize(edges.select("member", "role").filter("member <> role").distinct(), "reach")
    while True:
        first = written()
        onward = known.select(F.col("member").alias("role"), F.col("role").alias("next"))
        further = last.join(onward, "role").select("member", F.col("next").alias("role")).filter("member <> role").distinct()
        last = materialize(further.join(known, ["member", "role"], "left_anti"), "reach")
        if last.isEmpty():
            release(first, written())
            return known
        known = materialize(known.unionByName(last), "reach")


def grantees(members: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, grantee): of every one of ``roles`` (rolname) itself, what it is a member of by any path, and PUBLIC."""
    own = roles.select(F.col("rolname").alias("role")).filter("role IS NOT NULL").distinct()
    reached = closure(members).select(F.col("member").alias("role"), F.col("role").alias("grantee")).join(own, "role", "left_semi")
    return own.select("role", F.col("role").alias("grantee")).unionByName(reached).unionByName(own.select("role", F.lit("PUBLIC").alias("grantee")))


def effective(acl: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """``acl`` (grantee and what is granted) for every role that holds it: its own, inherited or PUBLIC's grants."""
    held = materialize(grantees(members, roles), "grantees")
    return held.join(acl, "grantee").distinct()
