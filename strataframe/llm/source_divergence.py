"""How far the sources of a language differ in their terms: counts and partial sums in DuckDB, by shard."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import LOWER, UPPER, Workspace, leanly, runs_of_texts, shuffle_parts

#: Rows of counts that a task holds before it sends them, bytes of text whose counts go to one shard, and kept rows of a shard.
HELD = 300_000
TEXT = 8_000_000
SHARD = 300_000
#: Bytes of terms: letters, A-Z as a-z, and all beyond ASCII; any other byte ends a term.
_TERM = bytes(32 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_COUNTS = "lang string, source string, term string, n long, docs long"


def database() -> duckdb.DuckDBPyConnection:
    """One thread and bounded memory, without files: tasks share a machine and may leave nothing on it."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": "", "preserve_insertion_order": False})


def share(n: str, total: str, terms: str, scale: int) -> str:
    """p of a term that occurs n times among ``total``, smoothed by one for each of the terms; exact, in SQL of either engine."""
    return f"1 + cast(({n} + 1) * cast({scale} as hugeint) // greatest({total} + {terms}, 1) as bigint)"


def gap(p: str, q: str) -> str:
    """How much p lies off q; both are between 1 and 1 + scale, so that the square fits in 64 bits."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) // ({q})"


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, source, text): occurrences and documents of each term of each group of the task's rows.

    Counts of several batches are added up before they are sent.
    """
    con = database()
    held, rows = [], 0

    def added() -> pa.Table:
        con.register("held", pa.concat_tables(held))
        out = con.sql("select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by all").to_arrow_table()
        con.unregister("held")
        return out

    for batch in batches:
        texts = [t.translate(_TERM) for t in batch.column(2).cast(pa.binary()).to_pylist()]
        for a, b in runs_of_texts(texts, 4_000_000):
            part = batch.slice(a, b - a)
            groups = pa.table({"lang": part.column(0), "source": part.column(1), "doc": np.arange(b - a, dtype=np.int32)})
            words = [t.split() for t in texts[a:b]]
            terms = pa.table({
                "doc": np.repeat(np.arange(b - a, dtype=np.int32), [len(w) for w in words]),
                "term": pa.array([w for ws in words for w in ws], pa.binary()).cast(pa.string()),
            })
            con.register("groups", groups)
            con.register("terms", terms)
            made = con.sql("""
                with t as (select doc, term, count(*) as n from terms group by all)
                select lang, source, term, sum(n)::bigint as n, count(*) as docs from t join groups using (doc) group by all""").to_arrow_table()
            held.append(made)
            rows += len(made)
            if rows > HELD:
                held = [added()]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from added().to_batches()


def kept_terms(min_docs: int):
    """A shard's terms in at least so many documents of their language: counts by source, and with a null source the language's."""

    @leanly
    def run(shard: pa.Table) -> pa.Table:
        con = database()
        con.register("shard", shard)
        return con.sql(f"""
            with t as (select lang, source, term, sum(n)::bigint as n, sum(docs) as docs from shard group by all),
            k as (select lang, term, sum(n)::bigint as n from t group by all having sum(docs) >= {min_docs})
            select lang, source, term, t.n from t join k using (lang, term)
            union all select lang, null, term, n from k""").to_arrow_table()

    return run


def partial_sums(top: int, scale: int):
    """A shard's part of the audit, as rows (kind, lang, source, item, n, value).

    "term": its ``top`` terms of each group. "both": for two sources, over the terms that both
    have, the gap less what each source's own sums (below) count for that term. "seen": how many
    terms a group has n times. Sums over terms that one source lacks follow from the latter, so
    no row is made for a term that a source doesn't have.
    """
    p, q = share("n", "total", "terms", scale), share("lang_n", "lang_total", "terms", scale)
    p0 = share("0", "total", "terms", scale)

    @leanly
    def run(shard: pa.Table) -> pa.Table:
        con = database()
        con.register("shard", shard)
        con.sql(f"create temp table own as select lang, source, term, n, total, terms, {p} as p, {p0} as none from shard where source is not null")
        con.sql("create temp table whole as select lang, term, n as lang_n, total as lang_total from shard where source is null")
        return con.sql(f"""
            with ranked as (select lang, source, term, {gap("p", "q")} as value from (select *, {q} as q from own join whole using (lang, term)) where p > q
                qualify row_number() over (partition by lang, source order by value desc, term) <= {top})
            select 'term' as kind, lang, source, term as item, null::bigint as n, value::decimal(38, 0) as value from ranked
            union all
            select 'both', a.lang, a.source, b.source, count(*), sum(({gap("a.p", "b.p")})::hugeint - {gap("a.p", "b.none")} - {gap("a.none", "b.p")} + {gap("a.none", "b.none")})::decimal(38, 0)
            from own a join own b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
            union all
            select 'seen', lang, source, null, n, count(*)::decimal(38, 0) from own group by all""").to_arrow_table()

    return run


def _share(n: Column, total: Column, terms: Column, scale: int) -> Column:
    whole = F.greatest(total + terms, F.lit(1)).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(19,0)") * F.lit(scale).cast("decimal(19,0)"), whole)


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(38,0)")


def source_divergence(docs: DataFrame, top: int = 200, min_docs: int = 3, scale: int = 10**9, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): what sets each source of a language apart.

    Terms are runs of letters, with A-Z lowered, and of all beyond ASCII. A language keeps those
    in at least ``min_docs`` of its rows. With n occurrences among the total of a group's kept
    terms, p = 1 + scale (n + 1) / (total + kept terms), rounded down; q is another's p, and
    the value (p - q)^2 / q, rounded down. Part "pair": for each other source of the language,
    the sum over all kept terms. Part "term": the ``top`` terms whose p is above the language's.
    Ranks run from 1 by value, then by the item's bytes. Whole numbers throughout.

    Null text, language and source are read as empty. Repeated rows count each time; a group
    without terms has pairs, and a language without kept terms has pairs of value 0. An empty
    table gives none. Only the three named columns are read. Very long texts are a run of their
    own. Scale to 3,037,000,498 is allowed, so that squares fit in 64 bits.

    Each task counts in DuckDB before anything is shuffled; shards are by language and term, so
    a frequent term is a row a task and source there, not one an occurrence. Pairs are made of
    the sources of a language, which the result holds, and of those that share a term.
    """
    if not 0 < scale < 3_037_000_499:
        raise ValueError("scale is beyond what squares in 64 bits allow")
    spark, work = docs.sparkSession, Workspace(docs.sparkSession, "source-divergence")
    rows = docs.select(*(F.coalesce(docs[f"`{c}`"], F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    groups = work.write(rows.select("lang", "source").distinct(), "groups")

    def by_shard(df: DataFrame, shards: int) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(max(shuffle_parts(spark), shards)))).groupBy("shard")

    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    counts = by_shard(rows.mapInArrow(term_counts, _COUNTS), size // TEXT + 1)
    kept = work.write(counts.applyInArrow(kept_terms(min_docs), "lang string, source string, term string, n long"), "kept")

    # The totals of every group, and of each language (with a null source there).
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    langs = sums.where("source is null").select("lang", F.col("own").alias("terms"))
    totals = sums.join(langs, "lang").select("lang", "source", "total", "terms", "own")
    known = kept.withColumn("at", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    known = known.join(totals.select("lang", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("at"), "total", "terms"), ["lang", "at"]).drop("at")
    parts = by_shard(known, kept.count() // SHARD + 1).applyInArrow(partial_sums(top, scale), "kind string, lang string, source string, item string, n long, value decimal(38,0)")
    parts = work.write(parts, "parts")

    sized = groups.join(totals.where("source is not null"), ["lang", "source"], "left").join(langs.withColumnRenamed("terms", "V"), "lang", "left")
    sized = sized.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("V", F.lit(0)).cast("long").alias("terms"), F.coalesce("own", F.lit(0)).cast("long").alias("own"))
    sized = sized.withColumn("none", _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), scale))
    sized = work.write(sized, "sized")
    other = sized.select("lang", F.col("source").alias("item"), F.col("own").alias("other_own"), F.col("none").alias("other_none"))
    pairs = sized.join(other, "lang").where("source <> item")
    # Over all kept terms, as if each had only the one source's occurrences.
    seen = parts.where("kind = 'seen'").groupBy("lang", "source", "n").agg(F.sum("value").cast("decimal(19,0)").alias("times"))
    seen = seen.join(sized, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"), scale))
    seen = seen.select("lang", "source", "p", "times").join(other.select("lang", "item", "other_none"), "lang").where("source <> item")
    zero = F.lit(0).cast("decimal(38,0)")
    alone = seen.select("lang", "source", "item", (_gap(F.col("p"), F.col("other_none")) * F.col("times")).cast("decimal(38,0)").alias("value"))
    turned = seen.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (_gap(F.col("other_none"), F.col("p")) * F.col("times")).cast("decimal(38,0)").alias("value"))
    both = parts.where("kind = 'both'").select("lang", "source", "item", "value")
    # Terms that neither has, and the pairs themselves.
    rest = pairs.select("lang", "source", "item", (_gap(F.col("none"), F.col("other_none")) * (F.col("terms") - F.col("own") - F.col("other_own")).cast("decimal(19,0)")).cast("decimal(38,0)").alias("value"))
    value = rest.unionByName(alone).unionByName(turned).unionByName(both).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), zero).cast("long").alias("value"))
    terms = parts.where("kind = 'term'").select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)).where(limit).withColumn("part", F.lit(part)) for part, df, limit in (("pair", value, F.lit(True)), ("term", terms, F.col("rank") <= top))]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
