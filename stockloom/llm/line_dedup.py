r"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its lines; a line with spaces for ``min_words`` words is cut further where
a sentence begins, so that a passage inside a long line is found too. A sentence begins at a word
after a single space if the word before ends with ``.``, ``!`` or ``?`` or the word itself begins with
a capital letter; never at a word in capitals (its first two letters), nor between two equal words, so
that shouted lines and repeated words do not fall apart. Lines without words belong to the one before. A
line's (or sentence's) id is a 128-bit hash of it without surrounding white space.

Ranks of the suffixes by their first h lines come from the ranks at h / 2 by sorting pairs of ranks
over ranges of them (prefix doubling), so equal ranks at h are a longest-common-prefix interval of
depth h: the suffixes in it, neighbours in the suffix array, share their first h lines. An interval of
any depth m between h and 2h is named by two ranks at h, those of the first and of the last h lines.

A run counts if it has at least ``min_words`` words. Every maximal repeated run is the union of its
least runs: such as have enough words, but not if their first or their last line is taken away. So it is
enough to look up the least runs; where the interval of one has an earlier suffix (in ascending doc_id,
then line order), the run is a later copy and its lines are deleted.

A run of lines that occur once cannot repeat, so suffixes are ranked only inside stretches of
repeated lines that have enough words, and only as deep as the runs go: at most ``min_words`` lines.

Nulls: a null text stays null, an empty one empty. A null ``doc_id`` comes before all others; rows that
share a ``doc_id`` are ordered by a hash of their text, and rows equal in both are one document: they
all get its text. Extra columns of any name are kept. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import as_row, row_columns, row_key, shared_dir, written

MIN_WORDS = 50
#: The break before a line, unless only white space is left of it. It begins with the break itself: a look behind at every character is slow.
LINE = r"\n(?=[^\n])(?![ \t\r]*(?:\n|\z))"
#: The space before a sentence; equal words are recognised up to 60 characters.
SENTENCE = r" (?=\p{Lu}(?!\p{Lu})|(?<=[.!?] )(?!\p{Lu}\p{Lu})[^ \n])(?!(?<=(?:^|\s)(\S{1,60}) )\1(?:\s|$))"
BLANK = " \n\t\r"


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _many_spaces(text: Column, n: int) -> Column:
    """Whether there are ``n`` spaces or more; they are not counted in shorter texts."""
    return (F.octet_length(text) >= n) & (_spaces(text) >= n)


def _trimmed(text: Column) -> Column:
    """Without white space around it; most lines have none, and Spark's trim lists every character."""
    ends = [f(text, F.lit(x)) for x in BLANK for f in (F.startswith, F.endswith)]
    return F.when(reduce(lambda a, b: a | b, ends), F.trim(text, F.lit(BLANK))).otherwise(text)


def _ended(parts: Column, mark: str) -> Column:
    """The mark at which they were split behind all parts but the last."""

    def ended(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.transform(parts, lambda x, i: F.when(i < last, F.concat(x, F.lit(mark))).otherwise(x))

    # As a lambda's argument, the parts are made once and not again for each of them.
    return F.element_at(F.transform(F.array(parts), ended), 1)


def units(text: Column, min_words: int = MIN_WORDS) -> Column:
    """The lines, long ones as sentences, each with the white space behind it; joined together they are the text."""

    def cut(line: Column) -> Column:
        long = _many_spaces(F.substring_index(line, "\n", 1), min_words - 1)
        return F.when(long, _ended(F.split(line, SENTENCE, -1), " ")).otherwise(F.array(line))

    return F.flatten(F.transform(_ended(F.split(text, LINE, -1), "\n"), cut))


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, row_key, lines``: of each document the lines that have words, with two hashes for an id.

    They are numbered as ``units`` are, but for a first one without words.
    """
    cut = F.transform(F.split("text", "\n", -1), lambda x: F.when(_many_spaces(x, min_words - 1), F.split(x, SENTENCE, -1)).otherwise(F.array(x)))
    own = F.filter(F.transform(F.flatten(cut), _trimmed), lambda x: x != "")
    # Where all white space is single spaces and breaks, a line's words follow from its spaces.
    odd = reduce(lambda a, b: a | b, [F.contains("text", F.lit(x)) for x in ("  ", "\t", "\r", "\f", "\v")])
    words = lambda x, odd: F.when(odd, F.regexp_count(x, F.lit(r"\S+"))).otherwise(_spaces(x) + 1)
    line = lambda odd: lambda x, i: F.struct(i.alias("place"), words(x, odd).alias("n_words"), F.xxhash64(x).alias("l1"), F.xxhash64(F.lit("second"), x).alias("l2"))
    # As a lambda's argument, a text is looked at once and not again for each line.
    own = F.element_at(F.transform(F.array(odd), lambda odd: F.transform(own, line(odd))), 1)
    return docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), own.alias("lines"))


def runs(documents: DataFrame, min_words: int, base: str) -> DataFrame:
    """Lines of stretches of repeated lines with enough words, and the least runs that begin at each.

    Lines of a stretch have consecutive places. A run from a line has ``ahead`` lines at least (null:
    none has enough words) and ``most`` at most; ``deepest`` is the most of the stretch.
    """
    rows = documents.select("doc_id", "row_key", F.explode("lines").alias("line")).select("doc_id", "row_key", "line.*")
    # One hash is enough here: a line that is taken for a repeated one has a rank of its own later.
    repeated = rows.groupBy("l1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("l1")
    # Written first, so that Spark may split the rows of a line that very many documents hold.
    found = rows.join(written(repeated, f"{base}/repeated").hint("shuffle_hash"), "l1")
    doc = Window.partitionBy("doc_id", "row_key").orderBy("place")
    found = found.withColumn("before", F.lag("place").over(doc)).filter("before IS NULL OR before <> place")
    # Words are counted over the document's repeated lines, so that one order serves all that follows.
    counted = F.sum("n_words").over(doc.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumns({"stretch": F.col("place") - F.row_number().over(doc), "upto": counted})
    found = found.withColumn("start", F.col("upto") - F.col("n_words")).drop("before", "n_words")
    order = Window.partitionBy("doc_id", "row_key", "stretch").orderBy("start")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumns({"end": F.max("upto").over(whole), "first": F.min("start").over(whole), "final": F.max("place").over(whole)})
    found = found.filter(F.col("end") - F.col("first") >= min_words)
    # Lines that begin within the next min_words words: the last of them completes the run, or the stretch is too short.
    near = F.count(F.lit(1)).over(order.rangeBetween(0, min_words - 1)).cast("int")
    found = found.withColumn("ahead", F.when(F.col("end") - F.col("start") >= min_words, near))
    # Runs that would lose enough words with their first line: up to where the next line's least run ends.
    left = (F.col("final") - F.col("place") + 1).cast("int")
    found = found.withColumn("most", F.when(F.col("ahead").isNotNull(), F.greatest("ahead", F.coalesce(F.lead("ahead").over(order), left))))
    found = found.withColumn("deepest", F.max("most").over(whole))
    return found.select("doc_id", "row_key", "stretch", "place", "l1", "l2", "ahead", "most", "deepest")


def _ranked(pairs: DataFrame, first: str, second: str, path: str) -> DataFrame:
    """``first, second, rank`` of the distinct pairs: ranks are ascending in (first, second).

    Pairs are dealt by ranges; a rank is the number of the range, then the place in it. Each pair is
    one row however often it occurs.
    """

    def number(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(np.arange(at, at + n))], names=[first, second, "rank"])
            at += n

    distinct = pairs.select(first, second).distinct()
    ordered = distinct.repartitionByRange(first, second).sortWithinPartitions(first, second)
    return written(ordered.mapInArrow(number, f"{first} long, {second} long, rank long"), path)


def _level(now: DataFrame, h: int, path: str) -> DataFrame:
    """Suffixes with their ranks at depth h; ``next``, the rank h lines on; ``runs`` (m, r2) of h to 2h - 1 lines."""
    order = Window.partitionBy("doc_id", "row_key", "stretch").orderBy("place")
    now = now.withColumns({"here": F.collect_list("rank").over(order.rowsBetween(0, h - 1)), "next": F.lead("rank", h).over(order)})
    lengths = F.filter(F.sequence("ahead", "most"), lambda m: (m >= h) & (m < 2 * h))
    own = F.transform(lengths, lambda m: F.struct(m.alias("m"), F.element_at("here", m - h + 1).alias("r2")))
    return written(now.select("doc_id", "row_key", "stretch", "place", "ahead", "most", "deepest", "rank", "next", own.alias("runs")), path)


def named_runs(documents: DataFrame, min_words: int, base: str) -> DataFrame:
    """``doc_id, row_key, first, m, r1, r2``: every least run with the name of its interval."""
    rows = written(runs(documents, min_words, base), f"{base}/runs")
    longest = rows.agg(F.max("deepest")).collect()[0][0] or 0
    # Depth 1: the order of lines is that of their ids.
    now = rows.join(_ranked(rows, "l1", "l2", f"{base}/rank-1").hint("shuffle_hash"), ["l1", "l2"])
    h, found = 1, []
    while True:
        level = _level(now, h, f"{base}/level-{h}")
        found.append(level.filter(F.size("runs") > 0).select("doc_id", "row_key", F.col("place").alias("first"), F.col("rank").alias("r1"), F.explode("runs").alias("run")))
        if 2 * h > longest:
            break
        # Depth 2h, in the stretches where a run still needs it; ranks end h - 1 lines before a stretch, without gaps.
        further = level.filter((F.col("deepest") >= 2 * h) & F.col("next").isNotNull()).drop("runs")
        pairs = further.select(F.col("rank").alias("r_a"), F.col("next").alias("r_b"))
        ranks = _ranked(pairs, "r_a", "r_b", f"{base}/rank-{2 * h}").withColumnRenamed("rank", "deep").hint("shuffle_hash")
        now = further.join(ranks, (F.col("rank") == F.col("r_a")) & (F.col("next") == F.col("r_b")))
        now = now.select("doc_id", "row_key", "stretch", "place", "ahead", "most", "deepest", F.col("deep").alias("rank"))
        h *= 2
    names = found[0]
    for more in found[1:]:
        names = names.unionByName(more)
    return written(names.select("doc_id", "row_key", "first", F.col("run.m").alias("m"), "r1", F.col("run.r2").alias("r2")), f"{base}/names")


def later_copies(names: DataFrame, base: str) -> DataFrame:
    """``doc_id, row_key, gone``: of each document the places (lo, hi) that lie in later copies."""
    at = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row_key", "first")
    # The earliest suffix of an interval: one row per interval, reduced before it is shuffled.
    earliest = names.groupBy("m", "r1", "r2").agg(F.min(at).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = names.join(written(earliest, f"{base}/earliest").hint("shuffle_hash"), ["m", "r1", "r2"]).filter(at > F.col("origin"))
    copies = copies.select("doc_id", "row_key", "first", (F.col("first") + F.col("m") - 1).alias("last"))
    # Runs that overlap or touch become one span.
    order = Window.partitionBy("doc_id", "row_key").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    copies = copies.withColumn("begins", F.coalesce((F.col("first") > reached + 1).cast("int"), F.lit(1)))
    copies = copies.withColumn("span", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = copies.groupBy("doc_id", "row_key", "span").agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    return spans.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies: their columns, and ``n_lines_removed``, ``words_before``, ``words_left``.

    Those three replace columns of the same names. White space at the end goes with a removed line; a
    document that loses all its words gets an empty text.
    """
    base = shared_dir(docs.sparkSession, "line-dedup")
    documents = written(lines(docs, min_words), f"{base}/lines")
    gone = written(later_copies(named_runs(documents, min_words, base), base), f"{base}/gone")
    total = F.aggregate("lines", F.lit(0), lambda n, x: n + x["n_words"])
    counted = documents.select("doc_id", "row_key", total.alias("words")).groupBy("doc_id", "row_key").agg(F.max("words").cast("long").alias("words"))
    both = counted.join(gone.withColumnsRenamed({"doc_id": "d", "row_key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), "left").drop("d", "k")
    both = both.withColumnRenamed("row_key", "key")
    own = as_row(docs)
    met = own.join(both, own["row.doc_id"].eqNullSafe(both["doc_id"]) & (own["row_key"] == both["key"]), "left")
    blank = F.rlike(F.col("row.text"), F.lit(r"^[ \t\r]*\n")).cast("int")  # a first unit without words has no place
    stays = lambda skip: lambda x, i: ~F.exists("gone", lambda s: (i - skip).between(s["lo"], s["hi"]))
    kept = F.element_at(F.transform(F.array(blank), lambda skip: F.filter(units(F.col("row.text"), min_words), stays(skip))), 1)
    met = met.withColumn("rest", F.when(F.col("gone").isNotNull(), F.rtrim(F.array_join(kept, ""), F.lit(BLANK))))
    met = met.withColumn("left", F.when(F.col("gone").isNotNull(), F.regexp_count("rest", F.lit(r"\S+"))).cast("long"))
    text = F.when(F.col("left") == 0, F.lit("")).when(F.col("gone").isNotNull(), F.col("rest")).otherwise(F.col("row.text"))
    removed = F.aggregate("gone", F.lit(0), lambda n, s: n + s["hi"] - s["lo"] + 1)
    before = F.coalesce("words", F.lit(0).cast("long"))
    added = {"n_lines_removed": F.coalesce(removed, F.lit(0)), "words_before": before, "words_left": F.coalesce("left", before)}
    columns = [c for c, name in zip(row_columns(docs, text=text), docs.columns) if name not in added]
    return met.select(*columns, *[c.alias(name) for name, c in added.items()])


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    """All documents without later copies of runs of at least 50 words."""
    return deduplicated(docs.select("doc_id", "text"))


ORACLE_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(regexp_replace(text, '(\n(?:[ \t\r]*\n)*)([^\n])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ls FROM documents WHERE text IS NOT NULL),
a0 AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM raw),
a AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS nw FROM a0),
aa AS (SELECT *, len(string_split(line, chr(10))[1]) - len(replace(string_split(line, chr(10))[1], ' ', '')) >= 49 AS long FROM a),
x0 AS (SELECT doc_id, i, string_split(line, ' ') AS ws FROM aa WHERE long),
x AS (SELECT doc_id, i, unnest(ws) AS word, generate_subscripts(ws, 1) AS j, len(ws) AS n FROM x0),
y AS (SELECT *, lag(word) OVER (PARTITION BY doc_id, i ORDER BY j) AS prev FROM x),
z AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND word <> '' AND word[1] <> chr(10) AND regexp_replace(word, '\s+$', '') <> prev
      AND NOT regexp_matches(word, '^\p{Lu}\p{Lu}') AND (regexp_matches(prev, '[.!?]$') OR regexp_matches(word, '^\p{Lu}')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, i ORDER BY j) AS s FROM y),
u AS (SELECT doc_id, i, s, string_agg(word, ' ' ORDER BY j) || CASE WHEN max(j) < max(n) THEN ' ' ELSE '' END AS line FROM z GROUP BY doc_id, i, s
      UNION ALL SELECT doc_id, i, 0, line FROM aa WHERE NOT long),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, s) AS pos, line, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS own, len(regexp_extract_all(line, '\S+')) AS nw FROM u),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM b WHERE nw > 0),
d AS (SELECT x.doc_id, x.k, min(y.k) AS e FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k AND x.k + 49 AND y.upto - (x.upto - x.nw) >= 50 GROUP BY 1, 2),
f AS (SELECT x.doc_id, x.k AS e, max(y.k) AS k FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.k BETWEEN x.k - 49 AND x.k AND x.upto - (y.upto - y.nw) >= 50 GROUP BY 1, 2),
r AS (SELECT doc_id, k, e, 1 AS sign FROM d UNION ALL SELECT doc_id, k, e, -1 FROM f),
t AS (SELECT r.doc_id, r.k, r.e, r.sign, string_agg(c.own, chr(10) ORDER BY c.k) AS content FROM r JOIN c ON c.doc_id = r.doc_id AND c.k BETWEEN r.k AND r.e GROUP BY ALL),
m AS (SELECT content, min((doc_id, k)) AS origin FROM t GROUP BY content),
g AS (SELECT t.* FROM t JOIN m USING (content) WHERE (t.doc_id, t.k) > m.origin),
h AS (SELECT DISTINCT c.doc_id, c.pos FROM c JOIN g ON c.doc_id = g.doc_id AND (g.sign = 1 AND c.k BETWEEN g.k AND g.e OR g.sign = -1 AND c.k = g.e)),
o AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT b.doc_id, string_agg(b.line, '' ORDER BY b.pos) FILTER (h.pos IS NULL) AS rest, coalesce(sum(b.nw) FILTER (h.pos IS NULL), 0) AS words_left, sum(b.nw) AS words_before
      FROM b LEFT JOIN h ON h.doc_id = b.doc_id AND h.pos = b.pos GROUP BY b.doc_id)
SELECT q.doc_id, CASE WHEN o.n IS NULL THEN q.text WHEN p.words_left = 0 THEN '' ELSE regexp_replace(p.rest, '[ \n\t\r]+$', '') END AS text,
       CAST(coalesce(o.n, 0) AS INTEGER) AS n_lines_removed, CAST(coalesce(p.words_before, 0) AS BIGINT) AS words_before, CAST(coalesce(p.words_left, 0) AS BIGINT) AS words_left
FROM documents q LEFT JOIN p ON p.doc_id = q.doc_id LEFT JOIN o ON o.doc_id = q.doc_id
"""
