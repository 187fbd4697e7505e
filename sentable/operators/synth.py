"""GEN-13: synthesise a table from a real one, as one operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentable.functions.hashing import row_key
from sentable.functions.fmt import formatted, quoted
from sentable.operators import experts as X
from sentable.operators.domain import domains, in_domain
from sentable.operators.encode import decode_labels, encode_labels, fit_labels
from sentable.operators.parsing import parse_strict
from sentable.operators.prep import check_roles, fill_na, to_numeric, typed_output
from sentable.operators.split import split
from sentable.operators.starts import start_prompts
from sentable.sources.io import materialize


@dataclass(frozen=True)
class Contract:
    """Roles of a table's columns: categorical, numeric and target columns."""
    ords: list[str]
    nums: list[str]
    labs: list[str]
    task: str                       # "classification" or "regression"

    def encoded(self, wanted: bool) -> list[str]:
        """Columns that are label-encoded: of a regression the categorical ones
        only (so none, if there are none), else the targets as well."""
        return [] if not wanted else self.ords + (self.labs if self.task == "classification" else [])


def synthesize(real: DataFrame, contract: Contract, n: int | None = None, seed=42, key: str = "row_key",
               bins: int = 20, encode_categories: bool = False, order: str = "schema", cond: str | None = None,
               temperature: float = 1.0, start_col: str | None = None, start_dist=None, drop_nan: bool = False,
               value_spaces: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Real table (with a ``key`` column) → split → fill → fit on train → sample →
    text → strict parse → label decode → domain check → typed rows.

    ``n`` rows are drawn (or one for each of ``keys`` (sid), or as many as the
    training split has).  ``start_col`` with ``start_dist`` (see ``start_prompts``) fixes the
    first column's draws.  ``drop_nan`` drops rows with a missing number;
    ``value_spaces`` parses values with spaces, which strict parsing refuses."""
    cols = [c for c in real.columns if c != key]
    check_roles(cols, contract.ords, contract.nums, contract.labs)
    cond = cond or cols[-1]
    enc_cols = contract.encoded(encode_categories)
    enc = fit_labels(real.drop(key), enc_cols) if enc_cols else None
    train = split(real, seed, F.col(quoted(key))).filter("split = 'train'").drop("split", "idx")
    train = fill_na(train)
    train = materialize(encode_labels(train, enc, enc_cols) if enc else train, "train")
    model = X.fit(train.drop(key), cols, cond=cond, bins=bins,
                  order="conditional" if start_col and order == "schema" else order, seed=seed)
    if keys is None:
        spark = real.sparkSession
        keys = (train.select(F.col(quoted(key)).alias("sid")) if n is None else
                spark.range(n).select(F.col("id").cast("string").alias("sid")))
    given = {}
    if start_col:
        prompts = start_prompts(keys, cols, seed, start_col=start_col, start_dist=start_dist)
        keys = prompts.select("sid", F.substring("prompt", len(start_col) + 5, 1 << 30).alias("_start"))
        given = {start_col: F.col("_start")}
    if len(model.orders) > 1:
        which = F.pmod(F.xxhash64(F.lit(str(seed)), "sid"), F.lit(len(model.orders)))
        rows = X.sample(model, keys, seed, temperature=temperature, order_of=which, given=given)
    else:
        rows = X.sample(model, keys, seed, temperature=temperature, given=given)
    lines = X.sampled_lines(rows.select("sid", *[quoted(c) for c in cols]), model)
    out = parse_strict(lines, cols, value_spaces=value_spaces)
    if enc:
        out = decode_labels(out, enc, enc_cols)
    if contract.ords:
        out = in_domain(out, domains(real, contract.ords), contract.ords)
    if drop_nan:
        nums = [c for c in cols if c in model.numeric and c not in enc_cols]
        for c in nums:
            x = to_numeric(F.col(quoted(c)))
            out = out.filter(x.isNotNull() & ~F.isnan(x))
    types = {f.name: f.dataType.simpleString() for f in real.schema.fields
             if f.name != key and f.dataType.simpleString() != "string"}
    return typed_output(out, types)


def exact_copies(rows: DataFrame, real: DataFrame, cols: list[str]) -> DataFrame:
    """Share of ``rows`` that are copies of a row of ``real`` on ``cols`` (as text):
    (n_rows, n_copies, share).  Both sides are cut to a hash of the row, and equal hashes of both are counted by one
    aggregation without a join."""
    digest = lambda df: F.unhex(row_key(list(formatted(df, cols, None, upcast=False).values()))).alias("h")
    both = rows.select(digest(rows), F.lit(1).cast("long").alias("n"), F.lit(False).alias("known")) \
        .unionByName(real.select(digest(real), F.lit(0).cast("long").alias("n"), F.lit(True).alias("known")))
    both = both.groupBy("h").agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                    F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("n_copies")) \
               .withColumn("share", F.round(F.col("n_copies") / F.greatest("n_rows", F.lit(1)), 9))
