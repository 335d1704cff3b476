"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

The mix is built from equal blocks of ``BLOCK_WORDS`` words. The number of blocks is fixed first; they go
to the sources by highest quotients target/(k - 1/2). A source's blocks are dealt to its shards in the same
way by their words, in two steps (groups of shards, then shards), so that no contest holds more than about
the square root of a source's shards. A shard holds about ``SHARD_ROWS`` documents, so the largest source
has the most shards and no window holds more rows than that on average. In a shard, documents stand in a
seeded order and the shard's blocks are taken from that stream, round and round if the quota is larger than
the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_COPIES = 2
BLOCK_WORDS = 16
SHARD_ROWS = 256
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST_COPIES) -> DataFrame:
    """One row per source (null is one, and the last): source, source_size, source_rows, rank, target.

    ``budget`` times all words is shared by weight; a target stops at ``most`` times its source's
    words and what is above is reshared among the others. Sources in order of cap/weight fill up one
    after another, so one running sum finds the level at which the rest share.
    The windows run over one row per source, never over documents.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
        .withColumn("w", w)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fill", F.col("cap").cast("double") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double") * F.lit(budget))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast("double"))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("pos", F.row_number().over(Window.orderBy("fill", "rank")))
        .withColumn("level", F.col("left") / F.col("left_w"))
        .withColumn("first_open", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("pos"))).over(everything))
        .withColumn("open_level", F.max(F.when(F.col("pos") == F.col("first_open"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("pos") < F.col("first_open"), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("w"))
    target = F.when(F.col("first_open").isNull(), F.col("cap").cast("double")).otherwise(target)
    return sources.select("source", "source_size", "source_rows", "rank", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], weight: str, seats: str, order: list[str]) -> DataFrame:
    """``parties`` with ``quota``: each contest's ``seats`` go to its parties by the highest quotients weight/(k - 1/2).

    ``within`` names a contest; ties go to the party that is first in ``order``, then to the lower k. A party's
    exact share tells its quota but for a few seats: over all parties of a contest the shares, rounded, miss
    ``seats`` by half a seat a party at most. So only quotients near the share are ranked, in numbers that add
    up to a few for each party, and what lies below is certain. Parties without weight get nothing, and nothing
    is given in a contest without weight.
    """
    all_of = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    w = F.col(weight).cast("double")
    near = (
        parties.withColumn("_all", F.sum(w).over(all_of))
        .withColumn("_n", F.count("*").over(all_of))
        .withColumn("_part", F.when(F.col("_all") > 0, w / F.col("_all")).otherwise(F.lit(0.0)))
        .withColumn("_share", F.floor(F.col("_part") * F.col(seats) + 0.5))
        .withColumn("_reach", F.ceil(F.col("_part") * F.col("_n") * 1.5) + 2)
        .withColumn("_sure", F.when(F.col("_part") > 0, F.greatest(F.lit(0), F.col("_share") - F.col("_reach"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("_last", F.when(F.col("_part") > 0, F.col("_share") + F.col("_reach")).otherwise(F.lit(0)).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(all_of))
    )
    # A party without weight keeps one row, without a k.
    k = F.when(F.col("_last") > 0, F.sequence(F.col("_sure") + 1, F.col("_last")))
    contest = near.select(*parties.columns, "_sure", "_open", F.explode_outer(k).alias("_k"))
    rank = F.row_number().over(all_of.orderBy(F.desc_nulls_last(w / (F.col("_k") - 0.5)), *order, "_k"))
    won = F.count(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")), 1))
    return contest.withColumn("_rank", rank).groupBy(*parties.columns, "_sure").agg(won.alias("_won")).select(*parties.columns, (F.col("_sure") + F.col("_won")).cast("long").alias("quota"))


def shard_quotas(sizes: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """``(rank, shard, cell_size, quota)``: every shard's blocks; a source's add up to the source's own.

    ``sizes`` has ``rank`` (the source's), ``shard, of_shards, size``; ``targets`` has ``rank, target``. The
    blocks of the mix are the targets' sum in blocks.
    """
    every = targets.withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words + 0.5))
    by_source = apportion(every, [], "target", "seats", ["rank"]).select("rank", F.col("quota").alias("seats"))
    # Shards of a group have numbers that leave the same remainder.
    group = F.col("shard") % F.ceil(F.sqrt("of_shards"))
    cells = cut(sizes.groupBy("rank", "shard", group.alias("group")).agg(F.sum("size").alias("cell_size")))
    groups = cells.groupBy("rank", "group").agg(F.sum("cell_size").alias("group_size")).join(by_source, "rank")
    dealt = apportion(groups, ["rank"], "group_size", "seats", ["group"]).select("rank", "group", F.col("quota").alias("seats"))
    quotas = apportion(cells.join(dealt, ["rank", "group"]), ["rank", "group"], "cell_size", "seats", ["shard"])
    return quotas.select("rank", "shard", "cell_size", "quota")


def takings(docs: DataFrame, seed: str = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` counts the words the mix takes of the row, repeats included: whole copies plus at most
    one part, never more than twice the size. Null and empty texts have size 0 and give 0. Rows with
    a null or repeated doc_id are rows of their own (order: seeded hash, then doc_id, then size); an
    empty table gives no rows; other columns are not read. A rerun takes the same.
    """
    sizes = cut(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ).withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    )
    targets = cut(source_targets(sizes))
    named = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    named = named.withColumn("of_shards", F.ceil(F.col("source_rows") / SHARD_ROWS))
    named = named.withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("of_shards"))
    quotas = shard_quotas(named, targets, block_words)
    stream = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(quotas, ["rank", "shard"])
    copies = F.expr("cell_taken div cell_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return (
        named.withColumn("cell_taken", F.least(F.col("quota") * block_words, F.col("cell_size") * MOST_COPIES))
        .withColumn("copies", F.when(F.col("cell_size") > 0, copies).otherwise(F.lit(0)))
        .withColumn("rest", F.col("cell_taken") - F.col("copies") * F.col("cell_size"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + part).cast("long").alias("taken"))
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed rows of ``docs`` with its columns: each row as often as the mix takes it whole, and
    once more with its first words where the mix takes a part (``n_chars`` then follows the text).

    Rows with a null or repeated doc_id are rows of their own; among rows of one doc_id, source and
    size, which ``takings`` can't tell apart, the hash of the text says which is first. Rows without
    words have no words to take, and one copy of them stays.
    """

    def numbered(df: DataFrame, key: Column, order: list) -> DataFrame:
        own = Window.partitionBy("key").orderBy(*order)
        return df.withColumn("key", key).withColumn("nth", F.row_number().over(own))

    def key(doc_id: Column, source: Column, size: Column) -> Column:
        return F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(":"), size.cast("string"), F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit("")))

    taken = numbered(takings(docs), key(F.col("doc_id"), F.col("source"), F.col("size")), ["taken"]).select("key", "nth", "size", "taken")
    # The row travels as a struct: no name of its columns can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    words = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = numbered(rows, key(F.col("row.doc_id"), F.col("row.source"), words), [F.xxhash64("row.text")]).join(taken, ["key", "nth"])
    whole = F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(F.lit(1))
    part = F.when(F.col("size") > 0, F.expr("taken % size")).otherwise(F.lit(0))
    counts = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("row", F.explode(counts).alias("part"))
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    is_part = F.col("part") > 0
    text = F.when(is_part, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), "")).otherwise(F.col("row.text"))
    rows = rows.withColumn("text", text)
    own = {"text": F.col("text"), "n_chars": F.when(is_part, F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return rows.select(*((own[c].cast(kinds[c]) if own.get(c) is not None else F.col("row")[c]).alias(c) for c in docs.columns))


def _contest(name: str, parties: str, within: str, weight: str, order: str) -> str:
    """SQL of ``apportion``: tables ``{name}_near`` (parties with their certain seats) and ``{name}`` (with quota)."""
    over = f"partition by {within}" if within else ""
    keys = [k.strip() for k in (within.split(",") if within else [])] + [order]
    parties = parties.format(BLOCK_WORDS=BLOCK_WORDS)
    return f"""{name}_parts as (
  select *, case when sum({weight}) over ({over}) > 0 then {weight}::double / (sum({weight}) over ({over}))::double else 0 end as part, count(*) over ({over}) as n
  from ({parties})),
{name}_near as (
  select *, case when part > 0 then greatest(0, floor(part * seats + 0.5) - (ceil(part * n * 1.5) + 2)) else 0 end::bigint as sure,
         case when part > 0 then floor(part * seats + 0.5) + ceil(part * n * 1.5) + 2 else 0 end::bigint as upto
  from {name}_parts),
{name}_open as (select *, seats - sum(sure) over ({over}) as open_seats from {name}_near),
{name}_won as (
  select {", ".join(keys)}, count(*) as won from (
    select {", ".join(keys)}, open_seats, row_number() over ({over} order by {weight}::double / (k - 0.5) desc, {order}, k) as place
    from (select *, unnest(range(sure + 1, upto + 1)) as k from {name}_open))
  where place <= open_seats group by all),
{name} as (
  select *, (sure + coalesce(won, 0))::bigint as quota from {name}_open left join {name}_won using ({", ".join(keys)}))"""


ORACLE_SQL = f"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('{SEED}:' || coalesce(doc_id::varchar, '')) as key
  from documents),
ranked as (
  select *, case (rank - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, source_size * {MOST_COPIES} as cap
  from (select source, sum(size)::bigint as source_size, count(*) as source_rows,
               row_number() over (order by source nulls last) as rank
        from sizes group by source)),
filled as (
  select *, row_number() over (order by cap::double / w, rank) as pos,
         (sum(source_size) over ())::double * {BUDGET}
           - coalesce(sum(cap) over (order by cap::double / w, rank rows between unbounded preceding and 1 preceding), 0)::double as left_words,
         (sum(w) over () - coalesce(sum(w) over (order by cap::double / w, rank rows between unbounded preceding and 1 preceding), 0))::double as left_w
  from ranked),
opened as (
  select *, min(case when (left_words / left_w) * w <= cap then pos end) over () as first_open from filled),
targets as (
  select source, source_size, source_rows, rank,
         case when first_open is null or pos < first_open then cap::double
              else max(case when pos = first_open then left_words / left_w end) over () * w end as target
  from opened),
named as (
  select d.*, t.rank, t.source_size, t.target, ceil(t.source_rows / {SHARD_ROWS})::bigint as of_shards,
         ('0x' || substr(key, 1, 8))::bigint % ceil(t.source_rows / {SHARD_ROWS})::bigint as shard
  from sizes d join targets t on d.source is not distinct from t.source),
{_contest("by_source", "select *, floor(sum(target) over () / {BLOCK_WORDS} + 0.5)::bigint as seats from targets", "", "target", "rank")},
cells as (
  select rank, shard, shard % ceil(sqrt(of_shards))::bigint as grp, sum(size)::bigint as cell_size
  from named group by rank, shard, of_shards),
{_contest("by_group", "select * from (select rank, grp, sum(cell_size)::bigint as group_size from cells group by rank, grp) join (select rank, quota as seats from by_source) using (rank)", "rank", "group_size", "grp")},
{_contest("by_shard", "select * from cells join (select rank, grp, quota as seats from by_group) using (rank, grp)", "rank, grp", "cell_size", "shard")},
streams as (
  select *, coalesce(sum(size) over (partition by rank, shard order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from named),
copied as (
  select s.*, q.cell_size, least(q.quota * {BLOCK_WORDS}, q.cell_size * {MOST_COPIES})::bigint as cell_taken,
         case when q.cell_size > 0 then least(q.quota * {BLOCK_WORDS}, q.cell_size * {MOST_COPIES})::bigint // q.cell_size else 0 end as copies
  from streams s join by_shard q on s.rank = q.rank and s.shard = q.shard)
select doc_id, size, source_size, target,
       (copies * size + greatest(0, least(size, cell_taken - copies * cell_size - start)))::bigint as taken
from copied
"""
