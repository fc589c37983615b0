"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their id, form blocks of
``block_rows``.  A source with integer share s of a period of D slots has for
its j-th block the release floor(j*D/s) and the deadline ceil((j+1)*D/s); in
each slot the released block with the earliest deadline runs (ties to the first
source).  A period therefore serves each source exactly s blocks, and at every
slot each source is less than one block from its fluid share.

Nothing is dropped or repeated: a source that runs out has a last period with
the blocks that it has left, and later periods are shared by the others in
proportion.  Periods between two such changes are alike, so only one template
for each change is scheduled (at most 2 changes a source); a block's slot is
its period's offset, in closed form, plus its slot in the template.  Sources
that are not named in the weights, null included, share one entry.

Everything here is DataFrame expressions; the template is an ``aggregate`` over
the slots of a period.  Its size is bounded by the weights alone.

Nulls: a null id ranks first in its source; a null source belongs to the
unnamed ones.  Empty table: empty result.  Repeated rows keep a place each;
rows with the same id are ordered by their text's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import ranked

OTHER = "*"


def id_hash(doc_id: str = "doc_id") -> Column:
    """First 8 hex digits of the MD5 of the id as text."""
    return F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8)


def periods(blocks: DataFrame) -> DataFrame:
    """Templates of all distinct periods, one row per (period range, source,
    block of the period).

    ``blocks``: (name, share, n_blocks), one row per source with blocks.
    Returns name, p_from, p_to (periods, half open), j, size (blocks of the
    source in the period), release, deadline, t (slot in the period), d (slots
    of the period), start (first slot of period p_from).
    """
    one = blocks.agg(F.sort_array(F.collect_list(F.struct("name", "share", "n_blocks"))).alias("s"))
    full = F.transform("s", lambda x: F.floor(x.n_blocks / x.share))
    some = F.transform("s", lambda x: F.ceil(x.n_blocks / x.share))
    one = one.withColumn("p", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), full, some))))
    one = one.select("s", "p", F.posexplode("p").alias("k", "p_from")).withColumn("p_to", F.try_element_at("p", F.col("k") + 2))
    one = one.filter(F.col("p_to").isNotNull()).drop("p", "k")
    size = lambda x: F.greatest(F.lit(0).cast("long"), F.least(x.share, x.n_blocks - F.col("p_from") * x.share))
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    one = one.withColumn("c", F.transform("s", size))
    one = one.withColumn("d", sum_of(F.col("c")))
    one = one.withColumn("start", sum_of(F.transform("s", lambda x: F.least(x.n_blocks, F.col("p_from") * x.share))))
    # a generator keeps these from being worked out anew wherever they are used
    one = one.select("s", "p_from", "p_to", F.explode(F.array(F.struct("c", "d", "start"))).alias("x")).select("s", "p_from", "p_to", "x.c", "x.d", "x.start")

    # EDF: the state holds how many blocks each source has run; each slot picks
    # the least (deadline, source) among the released ones.
    def step(state: Column, t: Column) -> Column:
        ready = F.transform(
            state.done,
            lambda j, i: F.when(
                (j < F.get("c", i)) & (F.floor(j * F.col("d") / F.get("c", i)) <= t),
                F.struct(F.ceil((j + 1) * F.col("d") / F.get("c", i)).alias("deadline"), i.cast("int").alias("i"), j.alias("j")),
            ),
        )
        run = lambda pick: F.struct(
            F.transform(state.done, lambda j, i: j + (i == pick.i).cast("long")).alias("done"),
            F.concat(state.ran, F.array(F.struct(t.alias("t"), pick.i.alias("i"), pick.j.alias("j"), pick.deadline.alias("deadline")))).alias("ran"),
        )
        return F.get(F.transform(F.array(F.array_min(ready)), run), 0)  # the pick is bound once

    first = F.struct(
        F.transform("c", lambda x: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<struct<t:bigint,i:int,j:bigint,deadline:bigint>>").alias("ran"),
    )
    one = one.withColumn("ran", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("d") - 1), first, step, lambda s: s.ran))
    one = one.select("s", "c", "p_from", "p_to", "d", "start", F.explode("ran").alias("r"))
    return one.select(
        F.get("s", F.col("r.i")).getField("name").alias("name"),
        "p_from", "p_to", F.col("r.j").alias("j"), F.get("c", F.col("r.i")).alias("size"),
        F.floor(F.col("r.j") * F.col("d") / F.get("c", F.col("r.i"))).alias("release"),
        F.col("r.deadline").alias("deadline"), F.col("r.t").alias("t"), "d", "start",
    )


#: The columns that ``mix`` adds.
PLACE = ("mix_source", "share", "block", "release", "deadline", "slot", "slot_row")


def _placed(docs: DataFrame, weights: dict[str, int], other: int, block_rows: int, doc_id: str, source: str, text: str) -> DataFrame:
    """(row, *PLACE): every row of ``docs`` as a struct, with its place."""
    if any(v < 1 for v in weights.values()) or other < 1 or OTHER in weights:
        raise ValueError("shares are positive integers; '*' is the unnamed sources' own name")
    names = F.array(*[F.lit(k) for k in weights])
    share = F.create_map(*[F.lit(x) for k, v in {**weights, OTHER: other}.items() for x in (k, v)])
    mixed = F.when(F.array_contains(names, F.coalesce(F.col(source), F.lit(OTHER))), F.col(source)).otherwise(F.lit(OTHER))
    tie = F.xxhash64(text) if text in docs.columns else F.lit(0).cast("long")
    named = docs.select(F.struct(*docs.columns).alias("row"), mixed.alias("mix_source"), F.col(doc_id).alias("id"), tie.alias("tie"), id_hash(doc_id).alias("h"))
    named = named.withColumn("share", F.element_at(share, F.col("mix_source")).cast("long")).withColumn("s", F.substring("h", 1, 3))
    named = ranked(named, ["mix_source"], ["s"], [F.col("h"), F.col("id"), F.col("tie")], "i")
    named = named.withColumn("block", F.floor(F.col("i") / block_rows)).withColumn("slot_row", F.col("i") % block_rows)
    named = named.withColumn("p", F.floor(F.col("block") / F.col("share")))
    sizes = docs.select(mixed.alias("name")).groupBy("name").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("n_blocks"))
    sizes = sizes.withColumn("share", F.element_at(share, F.col("name")).cast("long"))
    # Bounded by the weights: (2 * sources + 1) periods of at most sum(shares) slots.
    plan = F.broadcast(periods(sizes).select("name", "p_from", "p_to", "j", F.col("release").alias("r"), F.col("deadline").alias("e"), "t", "d", "start"))
    on = (F.col("mix_source") == F.col("name")) & (F.col("block") - F.col("p") * F.col("share") == F.col("j")) & (F.col("p") >= F.col("p_from")) & (F.col("p") < F.col("p_to"))
    base = F.col("start") + (F.col("p") - F.col("p_from")) * F.col("d")
    out = named.join(plan, on, "left").withColumn("release", base + F.col("r")).withColumn("deadline", base + F.col("e")).withColumn("slot", base + F.col("t"))
    return out.select("row", *PLACE)


def mix(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = 4, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Place every document in the mixture.

    ``weights``: integer share of each named source; ``other``: the share of all
    others together.  Adds to ``docs``: mix_source, share, block (of its
    source), release, deadline, slot (one block each, gapless from 0) and
    slot_row (place in the block).  Input columns with these names give way.
    """
    out = _placed(docs, weights, other, block_rows, doc_id, source, text)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in PLACE], *PLACE)


def mixed_order(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = 4, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, sorted by the mixture."""
    out = _placed(docs, weights, other, block_rows, doc_id, source, text)
    return out.orderBy("slot", "slot_row").select("row.*")
