"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of source, language and topic; a value without a target of its own counts
as ``other``. So there are at most the product of (targets + 1) cells, whatever the number of
documents: a size that the parameters prove. Token counts per cell are raked to the marginals, one
dimension after the other, for a fixed number of sweeps. A cell's raked weight per token is its
documents' weight; the largest becomes probability 1, and a document is sampled if a hash of its id
falls below its probability, so no document is repeated and the sample does not depend on the plan.

Targets hold as given: what they leave of 1 is the target of ``other``. Only where a value with a target
has no token, that target is shared out over the other values in proportion. A value with target 0 (or
``other``, where the named targets sum to 1) gets weight 0. Nulls: a null source or language is ``other``; a null text
is empty; rows with equal (or null) ids are sampled together. Documents without tokens belong to
their cell, or to probability 1 where no document of the cell has tokens. Extra columns are kept; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
#: Topics by what a text holds; the first that applies. Both engines read these conditions.
TOPICS = {"table": "text LIKE '%|%'", "legal": "lower(text) LIKE '%licen%'", "contact": "text LIKE '%@%'"}
PLAIN = "prose"


@dataclass(frozen=True)
class Mix:
    """Targets of each dimension by value (shares of tokens), sweeps of the fitting, seed of the sample.

    The default gives the largest source the share that an even split over twenty sources gives it.
    """

    source: dict[str, float] = field(default_factory=lambda: {"src0": 0.05})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.61, "de": 0.14, "fr": 0.14, "es": 0.10})
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 0.89, "table": 0.04, "legal": 0.03, "contact": 0.03})
    sweeps: int = 40
    seed: str = "mix-1"

    def __post_init__(self) -> None:
        for name in ("source", "lang", "topic"):
            shares = getattr(self, name).values()
            if any(x < 0 for x in shares) or sum(shares) > 1 + 1e-9 or (OTHER in getattr(self, name) and abs(sum(shares) - 1) > 1e-9):
                raise ValueError(f"targets of {name} must be shares that sum to 1, or to less where {OTHER} has none")

    def dimensions(self) -> dict[str, dict[str, float]]:
        """The targets of every dimension, that of ``other`` among them."""
        given = {"source": self.source, "lang": self.lang, "topic": self.topic}
        return {name: {OTHER: max(0.0, 1 - sum(targets.values()))} | targets for name, targets in given.items()}


def topic_of() -> Column:
    found = F.lit(PLAIN)
    for name, condition in reversed(TOPICS.items()):
        found = F.when(F.expr(condition), F.lit(name)).otherwise(found)
    return found


def _cell(name: str, targets: dict[str, float]) -> Column:
    return F.when(F.col(name).isin(*targets), F.col(name)).otherwise(F.lit(OTHER))


def with_cells(docs: DataFrame, mix: Mix) -> DataFrame:
    """Adds ``n_tokens`` (runs of non-spaces), ``topic`` unless there is one, and the cell's three values."""
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", F.coalesce(topic_of(), F.lit(PLAIN)))
    docs = docs.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long"))
    return docs.withColumns({f"_cell_{k}": _cell(k, v) for k, v in mix.dimensions().items()})


def raked(cells: DataFrame, mix: Mix) -> DataFrame:
    """``_cell_source, _cell_lang, _cell_topic, weight, probability`` from the cells' ``tokens``.

    ``weight`` is the raked share of tokens over the share there is.
    """
    dimensions = mix.dimensions()
    one = cells.filter("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("_cell_source", "_cell_lang", "_cell_topic", F.col("tokens").cast("double").alias("tokens")))).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["tokens"])
    one = one.withColumn("total", total)
    for name, targets in dimensions.items():
        one = _with_targets(one, name, targets)
    weights = F.transform("c", lambda x: x["tokens"] / F.col("total"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(mix.sweeps)), weights, lambda w, _: _sweep(w, list(dimensions)))
    one = one.withColumn("w", state)
    one = one.withColumn("weight", F.zip_with("c", "w", lambda x, w: w * F.col("total") / x["tokens"])).withColumn("most", F.array_max("weight"))
    rows = one.select(F.explode(F.arrays_zip("c", "weight")).alias("z"), "most").select("z.c.*", F.col("z.weight").alias("weight"), "most")
    return rows.select("_cell_source", "_cell_lang", "_cell_topic", "weight", (F.col("weight") / F.col("most")).alias("probability"))


def _total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _with_targets(one: DataFrame, name: str, targets: dict[str, float]) -> DataFrame:
    """Adds the dimension's target per value that occurs (``t_``) and each cell's value as a number (``i_``)."""
    own, v, o, t = f"_cell_{name}", f"v_{name}", f"o_{name}", f"t_{name}"
    one = one.withColumn(v, F.array_sort(F.array_distinct(F.transform("c", lambda x: x[own]))))
    tokens = lambda value: F.transform(F.filter("c", lambda x: x[own] == value), lambda x: x["tokens"])
    one = one.withColumn(o, F.transform(v, lambda value: _total(tokens(value)) / F.col("total")))
    table = F.create_map(*[x for k, share in targets.items() for x in (F.lit(k), F.lit(float(share)))])
    one = one.withColumn(t, F.transform(v, lambda value: F.try_element_at(table, value)))
    # What absent values would have had is shared out; where only values of target 0 occur, they keep their shares.
    one = one.withColumn(f"sum_{name}", _total(t))
    one = one.withColumn(t, F.when(F.col(f"sum_{name}") > 0, F.transform(t, lambda x: x / F.col(f"sum_{name}"))).otherwise(F.col(o)))
    return one.withColumn(f"i_{name}", F.transform("c", lambda x: F.array_position(v, x[own]).cast("int")))


def _sweep(weights: Column, dimensions: list[str]) -> Column:
    """One round of raking: each dimension's cells are scaled so that its values meet their targets."""
    for name in dimensions:
        weights = _scaled(weights, F.col(f"i_{name}"), F.col(f"t_{name}"))
    return weights


def _let(value: Column, body) -> Column:
    """The body with the value computed once: a lambda's argument is not computed again where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scaled(weights: Column, index: Column, targets: Column) -> Column:
    def held(cells: Column, k: Column) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, z: a + F.when(z["i"] == k + 1, z["w"]).otherwise(F.lit(0.0)))

    def by_factors(w: Column) -> Column:
        cells = F.zip_with(w, index, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        # A value whose weights are all 0 keeps them.
        factors = _let(cells, lambda c: F.transform(targets, lambda t, k: F.coalesce(F.try_divide(t, held(c, k)), F.lit(0.0))))
        return _let(factors, lambda f: F.zip_with(w, index, lambda x, i: x * F.element_at(f, i)))

    return _let(weights, by_factors)


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest; the same in any engine."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Every document with ``topic, n_tokens, weight, probability, selected``.

    A ``topic`` column of the documents is used as it is; the others replace columns of those names.
    """
    rows = with_cells(docs, mix)
    cells = ["_cell_source", "_cell_lang", "_cell_topic"]
    table = raked(rows.groupBy(*cells).agg(F.sum("n_tokens").alias("tokens")), mix)
    # As many rows as there are cells: the parameters bound them.
    rows = rows.drop("weight", "probability", "selected")
    met = rows.join(F.broadcast(table), cells, "left").drop(*cells)
    met = met.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(1.0))})
    return met.withColumn("selected", uniform(mix.seed, F.col("doc_id")) < F.col("probability"))


def op6_mixing(docs: DataFrame) -> DataFrame:
    """All documents with their weight and whether they are sampled."""
    found = mixed(docs.select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def oracle(mix: Mix = Mix()) -> str:
    """DuckDB SQL of ``op6_mixing``: the sweeps are written out."""
    topic = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in TOPICS.items()) + f" ELSE '{PLAIN}' END"
    names = list(mix.dimensions())
    kept = {k: ", ".join(f"'{v}'" for v in t) for k, t in mix.dimensions().items()}
    cells = ", ".join(f"CASE WHEN {k} IN ({kept[k]}) THEN {k} ELSE '{OTHER}' END AS c_{k}" for k in names)
    out = [
        f"d AS (SELECT *, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n_tokens FROM documents)",
        f"e AS (SELECT *, {cells} FROM d)",
        "g AS (SELECT c_source, c_lang, c_topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "h AS (SELECT *, tokens / sum(tokens) OVER () AS w0 FROM g)",
    ]
    before = "h"
    for k, targets in mix.dimensions().items():
        given = " ".join(f"WHEN '{v}' THEN {float(t)}" for v, t in targets.items())
        out.append(f"t_{k} AS (SELECT c_{k}, CASE c_{k} {given} END AS t, sum(w0) AS o FROM h GROUP BY c_{k})")
        out.append(f"s_{k} AS (SELECT c_{k}, CASE WHEN sum(t) OVER () > 0 THEN t / sum(t) OVER () ELSE o END AS t_{k} FROM t_{k})")
    out.append("r AS (SELECT h.*, w0 AS w, t_source, t_lang, t_topic FROM h JOIN s_source USING (c_source) JOIN s_lang USING (c_lang) JOIN s_topic USING (c_topic))")
    before = "r"
    for i in range(mix.sweeps):
        for k in names:
            out.append(f"r{i}_{k} AS MATERIALIZED (SELECT * EXCLUDE (w), w * coalesce(t_{k} / nullif(sum(w) OVER (PARTITION BY c_{k}), 0), 0) AS w FROM {before})")
            before = f"r{i}_{k}"
    out.append(f"z AS (SELECT *, w / w0 AS weight FROM {before})")
    out.append("y AS (SELECT *, weight / max(weight) OVER () AS probability FROM z)")
    draw = f"CAST(('0x' || substr(md5('{mix.seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0"
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT e.doc_id, e.source, e.lang, e.topic, e.n_tokens, round(coalesce(weight, 1), 6) AS weight, round(coalesce(probability, 1), 6) AS probability, "
        f"{draw} < coalesce(probability, 1) AS selected FROM e LEFT JOIN y USING (c_source, c_lang, c_topic)"
    )
