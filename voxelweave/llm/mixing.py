"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed for each cell (source, language, topic). The cell weights are
raked: scaled to the target shares of one dimension after the other until all
hold to a tolerance; targets that cannot all hold raise an error. A document is
then sampled with a probability in proportion to its cell's multiplier (its
weight over its share), on a scale at which a stated share of all tokens is
expected. A cell whose probability would be above one is kept whole and the
others make up for it, so one rare cell does not thin out the rest; where no cell
is kept whole, the expected tokens have the target marginals.

Defined cases: a null dimension is the value ``(none)``; a null text has no
tokens, and a cell without tokens has multiplier one; a target for a
value that no document has plays no part; documents that repeat an id share one
draw; all input columns stay, except that the result columns replace columns of
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions.draws import PRIME, uniform
from voxelweave.session import materialize

DIMENSIONS = ("source", "lang", "topic")
#: Targets are shares of tokens to this power, made to add up to one.
POWERS = {"source": 0.9, "lang": 0.95, "topic": 0.97}
NONE = "(none)"
SHARE = 0.75  # of all tokens
PATIENCE = 20  # rounds without a smaller gap


def tokens(text: Column) -> Column:
    """Words between blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by the marks that a text carries."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.contains(" | "), "table").when(text.contains("icense") | text.contains("CC BY"), "notice")
            .when(text.contains("@") | text.contains("+1 ("), "contact").when(text.contains("!!"), "shout").otherwise("prose"))


def tempered(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Target shares (value, target) of each dimension: its token shares to a power."""
    out = {}
    for name, power in powers.items():
        sums = cells.filter("tokens > 0").groupBy(F.col(name).alias("value")).agg(F.sum("tokens").alias("n"))
        out[name] = sums.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-12) -> DataFrame:
    """Cells with ``weight``, which add up to one and have the target shares in every dimension.

    Goes on until the gap is within the tolerance, or raises an error with the gap
    when it has not shrunk for ``PATIENCE`` rounds.
    """
    now = cells.filter("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for name, target in targets.items():
        now = now.join(target.select(F.col("value").alias(name), F.col("target").alias(f"t_{name}")), name)
    # A target share is a value's target over the targets of all values present.
    now = materialize(now, "cells")
    for name in targets:
        present = now.select(name, f"t_{name}").distinct().agg(F.sum(f"t_{name}")).first()[0]
        now = now.withColumn(f"t_{name}", F.col(f"t_{name}") / F.lit(present or 1.0))
    least, waited = float("inf"), 0
    while waited <= PATIENCE:
        for name in targets:
            share = F.col("weight") / F.sum("weight").over(Window.partitionBy(name))
            now = now.withColumn("weight", share * F.col(f"t_{name}"))
        now = materialize(now, "raked")
        off = [now.groupBy(name).agg(F.abs(F.sum("weight") - F.first(f"t_{name}")).alias("d")).agg(F.max("d")).first()[0]
               for name in targets]
        gap = max(x or 0.0 for x in off)
        if gap <= tolerance:
            return now.select(*targets, "tokens", "weight")
        least, waited = (gap, 0) if gap < least else (least, waited + 1)
    raise ValueError(f"the targets cannot all hold: a share stays {gap:.3g} away from its target")


def scale(cells: DataFrame, share: float) -> float:
    """The factor at which min(1, factor * multiplier) is expected to keep this share of the cells' tokens.

    ``cells`` has multiplier and tokens. Each step leaves out the cells that are
    kept whole; the factor rises, and with it those, until none is added.
    """
    factor, whole = 0.0, -1
    while True:
        over = F.col("multiplier") * F.lit(factor) >= 1
        n, kept, rest, total = cells.agg(
            F.count_if(over), F.sum(F.when(over, F.col("tokens")).otherwise(0)),
            F.sum(F.when(over, 0.0).otherwise(F.col("tokens") * F.col("multiplier"))), F.sum("tokens")).first()
        if n == whole or not rest:
            return factor if factor else 1.0
        whole, factor = n, (share * total - kept) / rest


def mixture(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", powers: dict[str, float] | None = None,
            targets: dict[str, DataFrame] | None = None, seed: int = 11, share: float = SHARE) -> DataFrame:
    """All documents with topic, tokens, multiplier, probability and ``sampled``.

    ``targets`` gives (value, target) for each dimension; without it the targets
    are the token shares to the ``powers``. ``share`` of all tokens is expected in
    the sample.
    """
    made = ("topic", "tokens", "multiplier", "probability", "sampled")
    rows = docs.drop(*made).withColumns({"topic": topic(F.col(text_col)), "tokens": tokens(F.col(text_col))})
    keys = {f"__{d}": F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in DIMENSIONS}
    cells = rows.select("tokens", *[c.alias(k[2:]) for k, c in keys.items()])
    cells = materialize(cells.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "counts")
    raked = rake(cells, targets or tempered(cells, powers or POWERS))
    total = float(raked.agg(F.sum("tokens")).first()[0] or 1)
    ratio = raked.withColumn("multiplier", F.col("weight") * F.lit(total) / F.col("tokens"))
    factor = scale(materialize(ratio.select("multiplier", "tokens"), "multipliers"), share)
    cell = cells.select(*DIMENSIONS).join(ratio.select(*DIMENSIONS, "multiplier"), list(DIMENSIONS), "left")
    cell = cell.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.coalesce("multiplier", F.lit(1.0)).alias("multiplier"))
    cell = cell.withColumn("probability", F.least(F.lit(1.0), F.col("multiplier") * F.lit(factor)))
    drawn = uniform(seed, F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(PRIME)))
    rows = rows.withColumns(keys).join(materialize(cell, "cell"), list(keys))
    return rows.withColumn("sampled", drawn < F.col("probability")).drop(*keys)
