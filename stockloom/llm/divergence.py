"""Source divergence: how far the sources of a language are apart in their use of terms.

``CountVectorizer`` with a least document frequency and the largest integer as vocabulary size turns
documents into exact sparse vectors. A term carries its language, so one fit holds the vocabulary of
every language as a fit for each would, in one pass. The vectors' entries are summed by language and source (exactly, as
whole numbers; ``Summarizer`` has means in floating point), and sources are compared over sparse entries:
a task holds a block of at most ``BLOCK`` terms of a language, and for each source walks the entries of
the others; what neither has an entry for costs nothing. The number of pairs is that of the result.

As with any ``CountVectorizer``, the kept vocabulary is on the driver and in each executor; it holds terms of at least
30 documents of a language, nothing of single documents.

Nulls: a null text, language or source is an empty string. Repeated rows are documents of their own. A source without
terms, or in a language without kept terms, is a group all the same, at value 0 from the others where nothing is kept. Ties are broken by the item's
bytes. An empty table gives no rows; columns other than ``text, lang, source`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import shared_dir, slices, written

LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Entries of vectors that a task holds before it adds them up.
GATHER = 1 << 22
#: Terms of a block in which sources are compared.
BLOCK = 512
#: Code points below 128 that belong to no term.
_OUTSIDE = [*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def _spaces() -> bytes:
    table = bytearray(range(256))
    for byte in _OUTSIDE:
        table[byte] = 0x20
    return bytes(table)


_SPACES = _spaces()


def _strings(docs: DataFrame, *names: str) -> list[Column]:
    return [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]


def terms(docs: DataFrame, once: bool = False) -> DataFrame:
    """``lang, source, terms``: each document's terms, every one after its language and a zero byte; with ``once`` each of them a single time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            spaced = [t.lower().translate(_SPACES) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            if once:
                spaced = [b" ".join(set(t.split())) for t in spaced]
            found = pc.split_pattern(pa.array(spaced, pa.binary()).cast(pa.string()), " ")
            values, sizes = found.flatten(), pc.list_value_length(found).to_numpy()
            full = pc.greater(pc.binary_length(values), 0)
            document = np.repeat(np.arange(len(sizes)), sizes)[full.to_numpy(zero_copy_only=False)]
            lang = pc.take(pc.binary_join_element_wise(batch.column(0), "", "\0"), pa.array(document))
            named = pc.binary_join_element_wise(lang, values.filter(full), "")
            offsets = np.append(0, np.cumsum(np.bincount(document, minlength=len(sizes)))).astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), named)], names=["lang", "source", "terms"])

    return docs.select(*_strings(docs, "lang", "source", "text")).mapInArrow(run, "lang string, source string, terms array<string>")


def group_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """``lang, source, number, count`` above zero of every kept term, and ``lang, number, term`` of the vocabulary."""
    spark = docs.sparkSession
    read = terms(docs)
    # A vocabulary may not be empty: so many more documents hold a term that no text can hold.
    none = spark.range(least).select(F.array(F.lit("\0")).alias("terms"))
    counting = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least), vocabSize=2**31 - 1)
    # A vocabulary follows from which documents have a term, not from how often.
    model = counting.fit(terms(docs, once=True).select("terms").unionAll(none))
    kept = [(i, t) for i, t in enumerate(model.vocabulary) if t != "\0"]
    listed = spark.createDataFrame(pa.table({"number": pa.array([i for i, _ in kept], pa.int32()), "named": pa.array([t for _, t in kept], pa.string())}))
    term = F.substring_index("named", "\0", -1)
    lang = F.expr("substring(named, 1, length(named) - length(substring_index(named, '\\0', -1)) - 1)")
    vectors = model.transform(read).select("lang", "source", F.unwrap_udt("vector").alias("v"))
    entries = vectors.mapInArrow(_added, "lang string, source string, number int, count long")
    sums = entries.groupBy("lang", "source", "number").agg(F.sum("count").alias("count"))
    return sums, listed.select(lang.alias("lang"), "number", term.alias("term"))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of sparse vectors by language and source, handed on whenever ``GATHER`` entries are held."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    groups: dict[tuple[str, str], int] = {}

    def handed() -> pa.RecordBatch:
        group, number, count = (np.concatenate(x) for x in zip(*held))
        held.clear()
        key, place = np.unique(group << 32 | number, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, place, count)
        names, own = list(groups), key >> 32
        lang, source = (pc.take(pa.array([n[i] for n in names], pa.string()), pa.array(own)) for i in (0, 1))
        return pa.record_batch([lang, source, pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], names=["lang", "source", "number", "count"])

    size = 0
    for batch in batches:
        vectors = batch.column(2)
        number, count = vectors.field("indices"), vectors.field("values")
        own = [groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        lengths = pc.list_value_length(number).to_numpy()
        held.append((np.repeat(np.array(own, np.int64), lengths), number.flatten().to_numpy().astype(np.int64), count.flatten().to_numpy().astype(np.int64)))
        size += int(lengths.sum())
        if size >= GATHER:
            yield handed()
            size = 0
    if size:
        yield handed()


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(scale * (count + 5) / (total + 5 * kept)) of the named columns, exact for counts of any size; null where nothing is kept."""
    top = f"(CAST({count} AS DECIMAL(20,0)) + {SMOOTHING}) * CAST({SCALE} AS DECIMAL(10,0))"
    below = f"(CAST({total} AS DECIMAL(20,0)) + CAST({kept} AS DECIMAL(20,0)) * {SMOOTHING})"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + {top} DIV {below} END")


def apart(entries: pa.Table) -> pa.Table:
    """Sums of absolute differences over a block's terms, for every two sources of its language (``a < b``).

    Rows ``lang, source, number, p``; a source's row with a negative number has the share of its absent terms.
    """
    source, number, p = (entries[c].to_numpy() for c in ("place", "number", "p"))
    absent = number < 0
    places = source[absent]
    order = np.argsort(places)
    places, floor = places[order], p[absent][order]
    row, (term, column) = np.searchsorted(places, source[~absent]), np.unique(number[~absent], return_inverse=True)
    value = p[~absent]
    by_row = np.argsort(row, kind="stable")
    row, column, value = row[by_row], column[by_row], value[by_row]
    starts = np.searchsorted(row, np.arange(len(places) + 1))
    first, second, total = [], [], []
    for a in range(len(places) - 1):
        own = np.full(len(term), floor[a])
        own[column[starts[a] : starts[a + 1]]] = value[starts[a] : starts[a + 1]]
        # Were all terms absent from b: the own shares against b's floor, by sums over the sorted shares.
        ranked = np.sort(own)
        sums = np.append(0, np.cumsum(ranked))
        others = np.arange(a + 1, len(places))
        below = np.searchsorted(ranked, floor[others])
        base = floor[others] * below - sums[below] + (sums[-1] - sums[below]) - floor[others] * (len(own) - below)
        # What b's own entries change.
        at = slice(starts[a + 1], len(row))
        against = own[column[at]]
        change = np.abs(against - value[at]) - np.abs(against - floor[row[at]])
        changed = np.append(0, np.cumsum(change))
        ends = starts[a + 1 :] - starts[a + 1]
        first.append(np.full(len(others), places[a]))
        second.append(places[others])
        total.append(base + np.diff(changed[ends]))
    joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, second, total)]
    lang = pa.array([entries["lang"][0].as_py()] * len(joined[0]), pa.string())
    return pa.table([lang, *map(pa.array, joined)], names=["lang", "a", "b", "value"])


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the terms a source has more of than its language."""
    base = shared_dir(docs.sparkSession, "divergence")
    counts, listed = group_counts(docs, least)
    sums, vocabulary = written(counts, f"{base}/sums"), written(listed, f"{base}/vocabulary")
    kept = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = sums.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select(*_strings(docs, "lang", "source")).distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.fillna(0, ["total", "kept"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    groups = written(groups.withColumn("absent", F.lit(0)).withColumn("floor", share("absent", "total", "kept")).drop("absent"), f"{base}/groups")
    shares = sums.join(groups.select("lang", "source", "place", "total", "kept"), ["lang", "source"]).withColumn("p", share("count", "total", "kept"))
    return _pairs(shares, groups, block).unionByName(_terms(shares, sums, kept, vocabulary, top))


def _pairs(shares: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Every other source of the language with the sum of differences."""
    number = F.col("number").cast("long")
    entries = shares.select("lang", F.floor(number / block).alias("block"), "place", number.alias("number"), "p")
    absent = entries.select("lang", "block").distinct().join(groups.select("lang", "place", F.lit(-1).cast("long").alias("number"), F.col("floor").alias("p")), "lang")
    parts = entries.unionByName(absent).groupBy("lang", "block").applyInArrow(apart, "lang string, a long, b long, value long")
    found = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = found.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "value").select("lang", "e.a", "e.b", "value")
    named = groups.select("lang", F.col("source"), F.col("place").alias("a"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    # The pairs of sources are the rows of the result.
    rows = named.join(others, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    rows = rows.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(shares: DataFrame, sums: DataFrame, kept: DataFrame, vocabulary: DataFrame, top: int) -> DataFrame:
    """The terms with the largest excess of a source's share over its language's."""
    of_lang = sums.groupBy("lang", "number").agg(F.sum("count").alias("all"))
    whole = sums.groupBy("lang").agg(F.sum("count").alias("whole"))
    q = of_lang.join(whole, "lang").join(kept, "lang").withColumn("q", share("all", "whole", "kept")).select("lang", "number", "q")
    more = shares.join(q, ["lang", "number"]).filter("p > q").join(vocabulary, ["lang", "number"])
    rows = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def op13_divergence(docs: DataFrame) -> DataFrame:
    """The audit of the contract, of all texts."""
    return audit(docs)


#: Dense tables of shares; whole numbers throughout.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), grps AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM grps g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)::HUGEINT) // ((sum(c) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p FROM dense JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (sum(c) + 5)::HUGEINT) // ((sum(sum(c)) OVER (PARTITION BY lang))::HUGEINT + 5 * any_value(v)) AS q FROM dense JOIN sizes USING (lang) GROUP BY lang, term
), found AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN found f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, s.p - w.q FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.c > 0 AND s.p > w.q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""
