"""Mixing sources to target weights (2): temperature mixing.  Native.

A source with token share ``p`` gets the weight ``p**a / sum(p**a)``.  The exponent ``a`` in
[0, 1] is bisected on the whole source table: the smallest one that keeps every source within
``max_repeats`` epochs, or the largest one that reaches a ``target_entropy`` (nats).  The
weights become token targets of a budget.  Each source is dealt into hash blocks; an epoch is
a permutation of its blocks, whole epochs are taken first, then blocks of the next permutation
in order, and the block at the budget's edge up to its last document that still fits.  That
edge is one pair (block order, document order) per source, so the documents themselves join
a table of one row per source and are never shuffled.

``budget``: a number of tokens; None: as many as there are; ``"cover"``: the least budget that
gives every source at least one whole epoch, so that no document is left out.

Defined results: tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none); a null source
is a source of its own; sources without tokens keep one copy of each document; documents of
equal order in a block stay or go together; repeated rows are mixed like any others; an empty
table gives no rows.  Extra columns are carried along unchanged (names that start with
``__mix_`` are reserved).  Sums of shares use decimals, so results don't hang on task order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgrid.llm.common import documents, sized_broadcast

MAX_REPEATS = 1.2
SEED = 17
#: The exponent is a multiple of 2**-20, found in five rounds of sixteen-way bisection.
BITS, WAYS = 20, 16
SHARE = "decimal(38,18)"
WEIGHT = "decimal(20,12)"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(*parts) -> Column:
    """60-bit pseudo-random order of the parts, the same in any engine that has md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def find_exponent(sources: DataFrame, max_repeats: float | None, target_entropy: float | None,
                  cover: bool, budget_ratio: float = 1.0) -> float:
    """Bisect the exponent over ``sources(share)``; one small row a candidate goes to the driver."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give either max_repeats or target_entropy")

    def holds(steps: list[int]) -> dict[int, bool]:
        power = F.pow(F.col("share"), F.col("step") / F.lit(float(1 << BITS)))
        over = F.pow(F.col("share"), F.col("step") / F.lit(float(1 << BITS)) - 1)
        rows = (sources.select("share", F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
                .groupBy("step").agg(
                    F.sum(power.cast(SHARE)).cast("double").alias("z"),
                    F.sum((power * F.log("share")).cast(SHARE)).cast("double").alias("zl"),
                    F.max(over).alias("most"), F.min(over).alias("least")).collect())
        out = {}
        for r in rows:
            if target_entropy is not None:
                out[r.step] = math.log(r.z) - r.step / (1 << BITS) * r.zl / r.z >= target_entropy
            else:
                out[r.step] = (r.most / r.least if cover else r.most / r.z * budget_ratio) <= max_repeats
        return out

    # repeats fall and entropy falls with the exponent: look for the edge of the condition
    rising = max_repeats is not None
    low, high = 0, 1 << BITS
    ends = holds([low, high])
    if ends.get(low if rising else high, True):
        return (low if rising else high) / (1 << BITS)
    if not ends[high if rising else low]:
        return (high if rising else low) / (1 << BITS)
    while high - low > 1:
        steps = sorted({low + (high - low) * k // WAYS for k in range(1, WAYS)} - {low, high})
        ok = holds(steps)
        if rising:
            low, high = max([low, *(s for s in steps if not ok[s])]), min([high, *(s for s in steps if ok[s])])
        else:
            low, high = max([low, *(s for s in steps if ok[s])]), min([high, *(s for s in steps if not ok[s])])
    return (high if rising else low) / (1 << BITS)


def mix(docs: DataFrame, *, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
        budget: int | str | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with one row per copy: its columns plus ``__mix_tokens, __mix_source, __mix_epoch,
    __mix_block, __mix_block_order, __mix_order`` (the copies of a source in the order of the last
    three, epoch by epoch, are its block permutations)."""
    key = F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source")))
    keyed = (docs.withColumn("__mix_tokens", n_tokens(F.col("text"))).withColumn("__mix_source", key)
             .withColumn("__mix_order", _order(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    slim = keyed.select("__mix_source", "__mix_tokens", "__mix_order")
    per_source = (slim.groupBy("__mix_source").agg(F.sum("__mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
                  .checkpoint())
    n_sources, n_docs, total = per_source.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)),
                                              F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # blocks per source and documents per block both grow with the square root of the table
    blocks = max(16, math.isqrt(n_docs))
    shares = (per_source.where("tokens > 0")
              .withColumn("share", F.col("tokens") / F.lit(float(max(1, total)))))
    cover = budget == "cover"
    ratio = 1.0 if budget is None or cover else budget / max(1, total)
    a = find_exponent(shares, max_repeats, target_entropy, cover, ratio)
    z = shares.agg(F.sum(F.pow("share", F.lit(a)).cast(SHARE)).cast("double")).first()[0] or 1.0
    weighted = shares.withColumn("weight", (F.pow("share", F.lit(a)) / F.lit(z)).cast(WEIGHT))
    if cover:
        # the least budget whose share covers each source once
        size = weighted.agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0] or 0
        wanted = F.greatest(F.floor(F.col("weight") * F.lit(int(size)).cast("decimal(18,0)")).cast("long"), F.col("tokens"))
    else:
        size = total if budget is None else budget
        wanted = F.floor(F.col("weight") * F.lit(int(size)).cast("decimal(18,0)")).cast("long")
    targets = (weighted.withColumn("wanted", wanted)
               .select("__mix_source", F.expr("wanted div tokens").alias("epochs"),
                       (F.col("wanted") % F.col("tokens")).alias("rest")))

    # the last, partial epoch: its permutation of blocks, and where the budget ends in it
    block = F.pmod(F.col("__mix_order"), F.lit(blocks))
    by_block = (slim.withColumn("block", block).groupBy("__mix_source", "block")
                .agg(F.sum("__mix_tokens").alias("tokens"))
                .join(sized_broadcast(targets, n_sources), "__mix_source")
                .withColumn("block_order", _order(F.lit(seed), F.col("__mix_source"), F.col("epochs"), F.col("block")))
                .withColumn("upto", F.sum("tokens").over(
                    Window.partitionBy("__mix_source").orderBy("block_order", "block")
                    .rowsBetween(Window.unboundedPreceding, 0))))
    edge = (by_block.where("upto > rest").groupBy("__mix_source")
            .agg(F.min(F.struct("block_order", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")))
                 .alias("e")).select("__mix_source", "e.*"))
    in_edge = (slim.withColumn("block", block)
               .join(sized_broadcast(edge, n_sources), ["__mix_source", "block"])
               .withColumn("upto", F.sum("__mix_tokens").over(
                   Window.partitionBy("__mix_source", "block").orderBy("__mix_order"))))
    last = in_edge.where("upto <= left").groupBy("__mix_source").agg(F.max("__mix_order").alias("last_order"))
    plan = (per_source.select("__mix_source").join(targets, "__mix_source", "left")
            .join(edge.withColumnRenamed("block", "edge_block").withColumnRenamed("block_order", "edge_order"),
                  "__mix_source", "left")
            .join(last, "__mix_source", "left")
            .select("__mix_source", F.coalesce("epochs", F.lit(1)).cast("long").alias("__mix_epochs"),
                    F.struct(F.col("edge_order"), F.col("edge_block"),
                             F.coalesce("last_order", F.lit(-1)).alias("last")).alias("__mix_edge"),
                    F.col("edge_order").isNotNull().alias("__mix_partial")).checkpoint())

    placed = keyed.join(sized_broadcast(plan, n_sources), "__mix_source").withColumn("__mix_block", block)

    def block_order(epoch: Column) -> Column:
        return _order(F.lit(seed), F.col("__mix_source"), epoch, F.col("__mix_block"))

    taken = F.col("__mix_partial") & (
        F.struct(block_order(F.col("__mix_epochs")), F.col("__mix_block"), F.col("__mix_order")) <= F.col("__mix_edge"))
    copies = F.col("__mix_epochs") + taken.cast("int")
    return (placed.withColumn("__mix_copies", copies).where("__mix_copies > 0")
            .withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_copies") - 1)))
            .withColumn("__mix_block_order", block_order(F.col("__mix_epoch")))
            .select(*docs.columns, "__mix_tokens", "__mix_source", "__mix_epoch", "__mix_block", "__mix_block_order",
                    "__mix_order"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: ``documents`` mixed so that no source is repeated more than ``MAX_REPEATS`` times, on a
    budget of as many tokens as there are; one row per copy."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", F.col("__mix_tokens").alias("n_tokens"),
                            F.col("__mix_epoch").alias("epoch"), F.col("__mix_block").alias("block"),
                            F.col("__mix_block_order").alias("block_order"), F.col("__mix_order").alias("doc_order"))


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tok,
             CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS k,
             ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o FROM documents),
s0 AS (SELECT k, sum(tok)::BIGINT AS tokens FROM d GROUP BY k),
g AS (SELECT sum(tokens)::BIGINT AS total FROM s0), c AS (SELECT greatest(16, floor(sqrt(count(*)))::BIGINT) AS blocks FROM d),
s AS (SELECT k, tokens, tokens / total::DOUBLE AS share FROM s0, g WHERE tokens > 0),
grid AS (SELECT i, i / {float(1 << BITS)} AS a FROM range({(1 << BITS) + 1}) r(i)),
ok AS (SELECT min(i) AS i FROM (SELECT i FROM grid, s GROUP BY i, a
        HAVING max(pow(share, a - 1)) / sum(pow(share, a)::DECIMAL(38,18))::DOUBLE <= {MAX_REPEATS})),
a AS (SELECT i / {float(1 << BITS)} AS a FROM ok),
z AS (SELECT sum(pow(share, a)::DECIMAL(38,18))::DOUBLE AS z FROM s, a),
t AS (SELECT k, tokens, floor((pow(share, a) / z)::DECIMAL(18,12) * total::DECIMAL(18,0))::BIGINT AS wanted
      FROM s, a, z, g),
e AS (SELECT k, wanted // tokens AS epochs, wanted % tokens AS rest FROM t),
b AS (SELECT d.k, o % blocks AS block, sum(tok)::BIGINT AS tokens, any_value(epochs) AS epochs, any_value(rest) AS rest
      FROM d, c JOIN e ON d.k = e.k GROUP BY ALL),
bo AS (SELECT *, ('0x' || substr(md5('{SEED}|' || k || '|' || epochs || '|' || block), 1, 15))::BIGINT AS bord FROM b),
bu AS (SELECT *, sum(tokens) OVER (PARTITION BY k ORDER BY bord, block ROWS UNBOUNDED PRECEDING) AS upto FROM bo),
di AS (SELECT d.*, bu.upto - bu.tokens + sum(tok) OVER (PARTITION BY d.k, bu.block ORDER BY o) AS cum, rest
       FROM d, c JOIN bu ON bu.k = d.k AND bu.block = d.o % c.blocks),
cp AS (SELECT doc_id, source, tok, d.k, o, o % blocks AS block, coalesce(epochs, 1) AS epochs FROM d LEFT JOIN e ON d.k = e.k, c),
al AS (SELECT doc_id, source, tok, k, o, block, unnest(range(epochs)) AS epoch FROM cp
       UNION ALL SELECT di.doc_id, di.source, di.tok, di.k, di.o, di.o % c.blocks, e.epochs
       FROM di JOIN e ON di.k = e.k, c WHERE cum <= di.rest)
SELECT doc_id, source, tok AS n_tokens, epoch::BIGINT AS epoch, block,
       ('0x' || substr(md5('{SEED}|' || k || '|' || epoch || '|' || block), 1, 15))::BIGINT AS block_order, o AS doc_order FROM al
"""
