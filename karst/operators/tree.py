"""Walks over flattened trees as joins: subtrees, children, sends, path conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BODY = ["file", "script", "owner", "body"]


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every node below each root, itself included. roots: the body columns, root. Within a body it is a range join."""
    at = nodes.select(*BODY, F.col("node").alias("root"), F.col("post").alias("_end"))
    return nodes.join(roots.join(at, [*BODY, "root"]), BODY).where("node between root and _end").drop("_end")


def children(nodes: DataFrame) -> DataFrame:
    """parent and kids, the array of children in order, of each node that has any."""
    kids = nodes.where("parent is not null").groupBy(*BODY, "parent").agg(F.sort_array(F.collect_list(F.struct("ord", "node", "t"))).alias("kids"))
    return kids.withColumn("kids", F.transform("kids", lambda k: k["node"]))


def send_pairs(nodes: DataFrame) -> DataFrame:
    """send, receiver, message, ord, selector: each message of each send, in order."""
    send = nodes.where("t = 'Send'").select(*BODY, F.col("node").alias("send"))
    kid = nodes.select(*BODY, F.col("parent").alias("send"), "node", "ord", "t")
    receiver = kid.where("ord = 0").select(*BODY, "send", F.col("node").alias("receiver"))
    message = kid.where("t = 'SendMessage'").select(*BODY, "send", F.col("node").alias("message"), "ord")
    selector = nodes.where("ord = 0").select(*BODY, F.col("parent").alias("message"), F.col("name").alias("selector"))
    return send.join(receiver, [*BODY, "send"], "left").join(message, [*BODY, "send"]).join(selector, [*BODY, "message"], "left")


def arms(nodes: DataFrame) -> DataFrame:
    """arm, test, holds: what must hold (or fail) for control to come into an arm of If, Cond or Switch.

    The second child of If runs where its test holds, the third where it fails. An arm of Cond also needs that all earlier tests
    fail. A case of a Switch over a global is an arm by its label: then test is the label's node.
    """
    kid = nodes.select(*BODY, "parent", "node", "ord", "t")
    top = nodes.select(*BODY, F.col("node").alias("parent"), F.col("t").alias("form"))
    of = kid.join(top, [*BODY, "parent"])
    test = of.where("form = 'If' and ord = 0").select(*BODY, "parent", F.col("node").alias("test"))
    two = of.where("form = 'If' and ord in (1, 2)").select(*BODY, "parent", F.col("node").alias("arm"), (F.col("ord") == 1).alias("holds"))
    plain = two.join(test, [*BODY, "parent"]).select(*BODY, "arm", "test", "holds")

    case = of.where("form in ('Cond', 'Switch') and t in ('Case', 'Else')").select(*BODY, F.col("parent").alias("top"), F.col("node").alias("case"), "ord", "t", "form")
    label = kid.where("ord = 0").select(*BODY, F.col("parent").alias("case"), F.col("node").alias("test"), F.col("t").alias("kind"))
    head = nodes.where("ord = 0").select(*BODY, F.col("parent").alias("top"), (F.col("vtype") == "Global").alias("valued"))
    case = case.join(label, [*BODY, "case"], "left").join(head, [*BODY, "top"], "left")
    guards = (F.col("t") == "Case") & ((F.col("form") == "Cond") | (F.coalesce("valued", F.lit(False)) & (F.col("kind") == "Number")))
    case = case.withColumn("guards", guards)
    body = kid.select(*BODY, F.col("parent").alias("case"), F.col("node").alias("arm"), F.col("ord").alias("place"))
    own = case.where("guards").join(body.where("place = 1"), [*BODY, "case"]).select(*BODY, "arm", "test", F.lit(True).alias("holds"))
    before = Window.partitionBy(*BODY, "top").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    priors = case.withColumn("priors", F.collect_list(F.when(F.col("guards"), F.col("test"))).over(before)).where("guards or t = 'Else'")
    earlier = priors.join(body, [*BODY, "case"]).where("place = if(t = 'Else', 0, 1)").select(*BODY, "arm", F.explode("priors").alias("test"), F.lit(False).alias("holds"))
    return plain.unionAll(own).unionAll(earlier)


def spans(nodes: DataFrame) -> DataFrame:
    """The body columns, arm, test, holds, and _end: the arms with the last node of each."""
    return arms(nodes).join(nodes.select(*BODY, F.col("node").alias("arm"), F.col("post").alias("_end")), [*BODY, "arm"])


def path_conditions(nodes: DataFrame, leaves: DataFrame, spanned: DataFrame | None = None) -> DataFrame:
    """For each leaf the tests on the way to it: leaf, test, holds. leaves: the body columns, leaf. spanned: spans(nodes), where they are at hand."""
    return leaves.join(spans(nodes) if spanned is None else spanned, BODY).where("leaf between arm and _end").select(*BODY, "leaf", "test", "holds").distinct()
