"""Markets: consumers that must each be paid with a token of their own, and payments that leave one of them unpaid.

consumers: market, consumer, tokens (array: what it accepts; each token is there once). spends: market, spend, token, satisfies (array of the
consumers that the payment settles). A market can be met if each consumer can have a token of its own. A payment is fatal if the rest of a
market that could be met no longer can be: its token is gone, and so are the consumers that it settles.

Markets are the unit of distribution. A market is matched once; a payment takes one token from the matching, and only the consumer that held it
looks for another along alternating paths, so a payment costs one search and not one matching.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from karst.plans.fixpoint import ROWS_OUT, dealt, whole_groups


def matching(wants: dict) -> dict:
    """token -> consumer for as many consumers as can be served. wants: consumer -> tokens."""
    owner: dict = {}
    for consumer in sorted(wants):
        path = search(wants, owner, consumer)[0]
        for c, token in path or ():
            owner[token] = c
    return owner


def search(wants: dict, owner: dict, consumer, gone=None, settled=frozenset()) -> tuple[list | None, set]:
    """Breadth first from a consumer without token: the hand-overs (consumer, token) that would serve it, and all consumers that were asked.

    gone: a token that is not there; settled: consumers that give theirs away freely.
    """
    came: dict = {}
    queue, held = [consumer], {c: t for t, c in owner.items()}
    for c in queue:
        for token in wants[c]:
            if token in came or token == gone:
                continue
            came[token] = c
            if token in owner and owner[token] not in settled:
                queue.append(owner[token])
                continue
            path = []
            while token is not None:
                c = came[token]
                path.append((c, token))
                token = held.get(c) if c != consumer else None
            return path, set(queue)
    return None, set(queue)


def _solved(wants: dict, spends: list[tuple]):
    """spend, token and the starved consumers of each fatal spend; None if the market can't be met to begin with."""
    owner = matching(wants)
    if len(owner) < len(wants):
        return None
    out = []
    for spend, token, satisfies in spends:
        settled = set(satisfies) & set(wants)
        loser = owner.get(token)
        if loser is None or loser in settled:
            continue
        path, asked = search(wants, {t: c for t, c in owner.items() if t != token}, loser, token, settled)
        if path is None:
            out.append((spend, token, sorted(asked)))
    return out


def squeezes(consumers: DataFrame, spends: DataFrame) -> DataFrame:
    """market, spend, token, starves (sorted array): the fatal payments, with every consumer that could be the one left unpaid.

    A market that can't be met to begin with says nothing of its payments and gives no rows (see unmet()). Null tokens, consumers and markets are
    ignored, repeated rows count once; a token that nobody accepts harms nobody.
    """
    wanted = consumers.where("market is not null and consumer is not null").groupBy("market", "consumer").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.filter(F.coalesce("tokens", F.array().cast(dict(consumers.dtypes)["tokens"])), lambda t: t.isNotNull()))))).alias("tokens"))
    paid = spends.where("market is not null and token is not null").select("market", "spend", "token", F.sort_array("satisfies").alias("satisfies")).distinct()
    null = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = wanted.select("market", F.lit(False).alias("pays"), "consumer", "tokens", *(null(paid, c) for c in ("spend", "token", "satisfies")))
    both = both.unionAll(paid.select("market", F.lit(True).alias("pays"), *(null(wanted, c) for c in ("consumer", "tokens")), "spend", "token", "satisfies"))

    def each(batches):
        found: list = []
        for market, rows in whole_groups(batches, "market"):
            many = rows["pays"].index(True) if True in rows["pays"] else len(rows["pays"])
            if not 0 < many < len(rows["pays"]):
                continue
            wants = dict(zip(rows["consumer"][:many], rows["tokens"][:many], strict=True))
            payments = sorted(zip(rows["spend"][many:], rows["token"][many:], rows["satisfies"][many:], strict=True), key=str)
            found.extend((market, *row) for row in _solved(wants, [(s, t, x or []) for s, t, x in payments]) or ())
            if len(found) >= ROWS_OUT:
                yield out(found)
                found = []
        if found:
            yield out(found)

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), shape, strict=True)], schema=shape)

    schema = T.StructType([both.schema["market"], both.schema["spend"], both.schema["token"], T.StructField("starves", T.ArrayType(both.schema["consumer"].dataType))])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    shape = to_arrow_schema(schema)
    return dealt(both, "market", "pays").mapInArrow(each, schema)


def unmet(consumers: DataFrame) -> DataFrame:
    """market: markets in which not every consumer can have a token of its own."""
    from karst.operators.graph import saturating

    return saturating(consumers).where("not saturated").select("market")
