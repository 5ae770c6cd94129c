"""Joins on normalised keys, and a preview that never runs the join.

Keys compare as trimmed, lower-case text, and every kind of missing cell is one key unless ``missing_match`` is off.

Skew. Adaptive execution splits a hot key of a shuffled inner join on both sides, but of an outer join only on the
preserved side. Before an outer join, one sketch pass over the key columns of the other side looks for a key holding a
large share of its rows. If there is one, the join is built from parts that all split: the inner join, plus the
unmatched rows found by anti joins against the *distinct* keys. Both plans give the same rows; the shuffles of the two
inputs are shared between the parts.

Pairs. Adaptive execution sees bytes, not pairs: a few thousand short rows of one key on either side stay in one task,
whose pairs grow with the square of the input. A sketch of both sides finds keys that may make more than ``BLOCK_PAIRS``
pairs, these are counted exactly, and their rows are joined apart in blocks of about that many pairs, each block once.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from millrace.functions.cells import Cell, col, name_folder, to_str
from millrace.operators.types import logical_type
from millrace.sources.scratch import settled

# The join types and the suffix of clashing right-hand columns.
JOIN_TYPES = ("inner", "left", "right", "full", "cross")
SUFFIX = "_right"

MISSING_KEY = "\x01"
HOT_ROWS = 1_000_000  # rows of one key that one task joins without trouble
HOT_SHARE = 0.05
SKETCH_ITEMS = 10_000
MISSING_PAIRS = 100_000_000  # rows that missing keys alone may make unless they are asked for
BLOCK_PAIRS = 4_000_000  # pairs of one key that a task makes
HEAVY_KEYS = 100  # most frequent keys of a side that are looked at; pairs of more keys spread over tasks anyway
MAX_TASKS = 32_768
CROSS_RIGHT_ROWS = 10_000  # an explicit cross product needs a right side no larger than this,
CROSS_RIGHT_BYTES = 64 << 20  # in rows and in bytes of text


def _pairs(keys) -> list[tuple[str, str]]:
    items = [keys] if isinstance(keys, str) else list(keys)
    return [(k, k) if isinstance(k, str) else (k["left"], k["right"]) if isinstance(k, dict) else tuple(k) for k in items]


def _key_columns(df: DataFrame, names: list[str], missing_match: bool) -> list[Column]:
    keys = [Cell(df, n).join_key for n in names]
    if missing_match:
        keys = [F.coalesce(k, F.lit(MISSING_KEY)) for k in keys]
    return [k.alias(f"_k{i}") for i, k in enumerate(keys)]


def _hot(df: DataFrame, keys: list[Column]) -> bool:
    """Whether one key holds more than ``HOT_SHARE`` of the rows, or more than ``HOT_ROWS``.

    A mergeable heavy-hitter sketch tells; its error is the rows over ``SKETCH_ITEMS``, and an estimate that could hide
    more than ``HOT_ROWS`` counts as hot too. The answer changes the plan only.
    """
    joined = F.concat_ws("\x02", *[F.coalesce(k, F.lit("\x03")) for k in keys])
    top = F.call_function("approx_top_k", joined, F.lit(1), F.lit(SKETCH_ITEMS)).alias("top")
    found = df.agg(F.count(F.lit(1)).alias("n"), top).head()
    most = found["top"][0]["count"] if found["top"] else 0
    return most > min(HOT_SHARE * found["n"], HOT_ROWS) or found["n"] / SKETCH_ITEMS > HOT_ROWS


def _joined(names: list[str]) -> Column:
    return F.concat_ws("\x02", *[F.coalesce(F.col(n), F.lit("\x03")) for n in names])


def _heavy(left: DataFrame, right: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """Keys of more than ``BLOCK_PAIRS`` pairs, and into how many parts to cut their left and their right rows.

    ``left`` and ``right`` hold the key columns ``names`` alone. Which keys are found changes the plan only.
    """
    sides = [df.dropna(subset=names).select(_joined(names).alias("key")) for df in (left, right)]
    top = F.call_function("approx_top_k", F.col("key"), F.lit(HEAVY_KEYS), F.lit(SKETCH_ITEMS)).alias("top")
    found = [{t["item"]: t["count"] for t in r["top"] or []} for r in sides[0].agg(top).union(sides[1].agg(top)).collect()]
    if len(found) < 2 or not all(found):
        return {}
    # A key that is not among a side's most frequent ones is at most as frequent as the last of these.
    rest = [min(f.values()) if len(f) == HEAVY_KEYS else 0 for f in found]
    likely = [k for k in {**found[0], **found[1]} if found[0].get(k, rest[0]) * found[1].get(k, rest[1]) > BLOCK_PAIRS]
    if not likely:
        return {}
    counted = [df.where(F.col("key").isin(likely)).groupBy("key").agg(F.count(F.lit(1)).alias(n)) for df, n in zip(sides, ("nl", "nr"))]
    out, edge = {}, int(BLOCK_PAIRS**0.5)
    for key, nl, nr in counted[0].join(counted[1], "key").collect():
        if nl * nr > BLOCK_PAIRS:
            across = ceil(nr / edge)
            out[key] = ceil(nl * ceil(nr / across) / BLOCK_PAIRS), across
    return out


def _in_blocks(left: DataFrame, right: DataFrame, names: list[str], heavy: dict[str, tuple[int, int]]) -> DataFrame:
    """The pairs of heavy keys. Each part of a key's left rows meets each part of its right rows in a block of its own."""
    tasks = min(MAX_TASKS, sum(a * b for a, b in heavy.values()))

    def parts(at: int) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for key, n in heavy.items() for x in (key, n[at])]), F.col("_joined"))

    def dealt(df: DataFrame, own: list[str], side: int, name: str) -> DataFrame:
        void = [c.name for c in df.schema if isinstance(c.dataType, NullType)]
        chosen = df.drop(*void).withColumns({"_joined": _joined(own), "_n": F.monotonically_increasing_id()})
        # Written once, so that a row is in the same part wherever it is read.
        kept = settled(chosen.where(F.col("_joined").isin(list(heavy))), name).withColumns({c: F.lit(None) for c in void})
        mine, others = F.pmod("_n", parts(side)).cast("int"), F.explode(F.sequence(F.lit(0), parts(1 - side) - 1))
        placed = kept.withColumns({f"_mine{side}": mine, f"_other{side}": others}).drop("_joined", "_n")
        return placed.repartition(tasks, *own, *[f"_{w}{side}" for w in (("mine", "other") if side == 0 else ("other", "mine"))])

    rights = [f"_r{n}" for n in names]
    ls, rs = dealt(left, names, 0, "heavy-left"), dealt(right, rights, 1, "heavy-right")
    same = [ls[n] == rs[r] for n, r in zip(names, rights)]
    return ls.join(rs.hint("merge"), [*same, F.col("_mine0") == F.col("_other1"), F.col("_other0") == F.col("_mine1")])


def _check_missing(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> None:
    """Refuse a join in which missing keys, which match each other, would multiply beyond ``MISSING_PAIRS`` rows."""
    counts = []
    for df, names in ((left, [a for a, _ in pairs]), (right, [b for _, b in pairs])):
        gone = reduce(lambda a, b: a & b, [Cell(df, n).missing for n in names])
        counts.append(df.agg(F.count_if(gone).alias("n")))
    a, b = (r["n"] for r in counts[0].union(counts[1]).collect())
    if a * b > MISSING_PAIRS:
        raise ValueError(f"{a} x {b} rows have no key at all and would all be paired: use missing_match=False, or True if all these pairs are wanted")


def _output(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Right-hand columns of the result as (source name, output name)."""
    fold = name_folder(left)
    dropped, taken = {fold(r) for _, r in pairs}, {fold(c) for c in left.columns}
    out = [(c, c + SUFFIX if fold(c) in taken else c) for c in right.columns if fold(c) not in dropped]
    names = [fold(c) for c in (*left.columns, *[o for _, o in out])]
    if len(set(names)) < len(names):
        raise ValueError(f"joined column names clash: {sorted({n for n in names if names.count(n) > 1})}")
    return out


def join_tables(
    left: DataFrame, right: DataFrame, keys=(), how: str = "inner", missing_match: bool | None = None, skew: str = "auto"
) -> DataFrame:
    """Equi-join with all left columns and the right non-key columns (clashes get ``_right``).

    ``keys`` holds column names or ``(left, right)`` pairs. Rows only on the right take their key from the right side.
    Missing keys match each other unless ``missing_match`` is off. More than ``MISSING_PAIRS`` such pairs are an error unless
    ``missing_match=True`` asks for them all. ``how='cross'`` takes no keys and needs a small right side. ``skew`` is ``auto``
    (look for a hot key before an outer join), ``split`` or ``plain``; keys with very many pairs are joined in blocks unless it
    is ``plain``, for which their rows are written below ``spark.checkpoint.dir``.
    """
    pairs = _pairs(keys)
    if how not in JOIN_TYPES:
        raise ValueError(f"how is one of {JOIN_TYPES}")
    if how == "cross":
        return _cross(left, right, pairs)
    if not pairs:
        raise ValueError("a join needs at least one key pair; ask for how='cross' to combine every row")
    rights = _output(left, right, pairs)
    if missing_match is None:
        _check_missing(left, right, pairs)
        missing_match = True
    lk = _key_columns(left, [a for a, _ in pairs], missing_match)
    rk = _key_columns(right, [b for _, b in pairs], missing_match)
    names = [f"_k{i}" for i in range(len(pairs))]
    # Both sides get private names, so that the same table can stand on both sides.
    left_in = left.select(*lk, *[col(c).alias(f"_l{i}") for i, c in enumerate(left.columns)])
    right_in = right.select(
        *[k.alias(f"_r{n}") for n, k in zip(names, rk)], *[col(c).alias(f"_r{i}") for i, (c, _) in enumerate(rights)],
        *[col(b).alias(f"_rkey{i}") for i, (_, b) in enumerate(pairs)],
    )
    heavy = _heavy(left.select(*lk), right.select(*rk), names) if skew != "plain" else {}
    pieces = _in_blocks(left_in, right_in, names, heavy) if heavy else None
    if heavy:
        left_in = left_in.where(~_joined(names).isin(list(heavy)))
        right_in = right_in.where(~_joined([f"_r{n}" for n in names]).isin(list(heavy)))
    match = [left_in[n] == right_in[f"_r{n}"] for n in names]
    if skew == "auto":
        check_right, check_left = how in ("left", "full"), how in ("right", "full")
        split = (check_right and _hot(right, rk)) or (check_left and _hot(left, lk))
    else:
        split = skew == "split" and how != "inner"

    key_of = {a: i for i, (a, _) in enumerate(pairs)}

    def left_value(i: int, c: str, only_right: Column | bool) -> Column:
        """The output cell of a left column; a key column also shows the key of rows only on the right."""
        here = F.col(f"_l{i}") if only_right is not True else F.lit(None).cast(left.schema[c].dataType)
        if how in ("right", "full") and c in key_of:
            other = pairs[key_of[c]][1]
            there = F.col(f"_rkey{key_of[c]}")
            if left.schema[c].dataType != right.schema[other].dataType:
                there = to_str(there, right.schema[other].dataType)
                here = to_str(here, left.schema[c].dataType)
            here = there if only_right is True else here if only_right is False else F.when(only_right, there).otherwise(here)
        return here.alias(c, metadata=left.schema[c].metadata)

    def project(df: DataFrame, only_right: Column | bool, with_right: bool = True) -> DataFrame:
        ls = [left_value(i, c, only_right) for i, c in enumerate(left.columns)]
        rs = [
            (F.col(f"_r{i}") if with_right else F.lit(None).cast(right.schema[c].dataType)).alias(
                o, metadata=right.schema[c].metadata
            )
            for i, (c, o) in enumerate(rights)
        ]
        return df.select(*ls, *rs)

    def whole(out: DataFrame) -> DataFrame:
        """With the pairs of heavy keys, which occur on both sides and so leave no row alone."""
        return out if pieces is None else out.unionByName(project(pieces, False))

    if not split:
        flagged = left_in.withColumn("_in_left", F.lit(True)) if how in ("right", "full") else left_in
        joined = flagged.join(right_in, [flagged[n] == right_in[f"_r{n}"] for n in names], how)
        return whole(project(joined, F.col("_in_left").isNull() if how in ("right", "full") else False))
    # Matched keys are equal, so this never holds. It keeps the right key among the columns the inner join reads, as the
    # anti join below does, and the two can share one shuffle of the right side.
    keys_differ = F.col(names[0]) != F.col(f"_r{names[0]}") if how in ("right", "full") else False
    out = project(left_in.join(right_in, match, "inner"), keys_differ)
    if how in ("left", "full"):
        known = right_in.select(*[F.col(f"_r{n}") for n in names]).distinct()
        alone = left_in.join(known, [left_in[n] == known[f"_r{n}"] for n in names], "left_anti")
        out = out.unionByName(project(alone, False, with_right=False))
    if how in ("right", "full"):
        known = left_in.select(*names).distinct()
        alone = right_in.join(known, [right_in[f"_r{n}"] == known[n] for n in names], "left_anti")
        out = out.unionByName(project(alone, True))
    return whole(out)


def _cross(left: DataFrame, right: DataFrame, pairs: list) -> DataFrame:
    """Every left row with every row of a right side whose size was checked to be small."""
    if pairs:
        raise ValueError("a cross product takes no keys")
    if right.limit(CROSS_RIGHT_ROWS + 1).count() > CROSS_RIGHT_ROWS:
        raise ValueError(f"the right side of a cross product may have at most {CROSS_RIGHT_ROWS} rows")
    text = F.length(F.to_json(F.struct(*[col(c) for c in right.columns]))) if right.columns else F.lit(0)
    if (right.agg(F.sum(text)).head()[0] or 0) > CROSS_RIGHT_BYTES:
        raise ValueError(f"the right side of a cross product may hold at most {CROSS_RIGHT_BYTES} bytes")
    renamed = right.select(*[col(c).alias(o) for c, o in _output(left, right, [])])
    return left.crossJoin(F.broadcast(renamed))


def join_preview(left: DataFrame, right: DataFrame, keys, how: str = "inner", missing_match: bool = True) -> DataFrame:
    """One row of what a join would do: matches, unmatched rows, repeated keys and the number of resulting rows.

    Only per-key counts are joined. They are combined before the shuffle and unique per key, so hot keys do no harm.
    """
    pairs = _pairs(keys)
    names = [f"_k{i}" for i in range(len(pairs))]

    def counts(df: DataFrame, columns: list[str], n: str) -> DataFrame:
        return df.groupBy(*_key_columns(df, columns, missing_match)).agg(F.count(F.lit(1)).alias(n))

    both = counts(left, [a for a, _ in pairs], "nl").join(counts(right, [b for _, b in pairs], "nr"), names, "full")
    nl, nr = F.col("nl"), F.col("nr")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    in_both, only_l, only_r = nl.isNotNull() & nr.isNotNull(), nr.isNull(), nl.isNull()
    product = nl.cast("decimal(19,0)") * nr.cast("decimal(19,0)")  # counts multiplied may outgrow a bigint
    row = both.agg(
        total(nl, nl.isNotNull()).alias("left_rows"),
        total(nr, nr.isNotNull()).alias("right_rows"),
        total(nl, in_both).alias("matching_rows"),
        total(nl, only_l).alias("only_in_left"),
        total(nr, only_r).alias("only_in_right"),
        F.count_if(nl > 1).alias("duplicate_keys_left"),
        F.count_if(nr > 1).alias("duplicate_keys_right"),
        total(product, in_both).cast("decimal(38,0)").alias("_matched"),
    )
    extra = F.lit(0)
    if how in ("left", "full"):
        extra = extra + F.col("only_in_left")
    if how in ("right", "full"):
        extra = extra + F.col("only_in_right")
    return row.withColumn("estimated_rows", (F.col("_matched") + extra).cast("decimal(38,0)")).drop("_matched")


def join_warnings(left: DataFrame, right: DataFrame, keys, how: str = "inner", missing_match: bool = True) -> DataFrame:
    """The preview's findings as rows of ``code`` and ``message``."""
    p = join_preview(left, right, keys, how, missing_match)
    dup_l, dup_r = F.col("duplicate_keys_left") > 0, F.col("duplicate_keys_right") > 0
    unmatched = F.col("only_in_left") + F.col("only_in_right")

    def warn(condition: Column, code: str, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(condition, F.struct(F.lit(code).alias("code"), text.alias("message")))

    found = [
        warn(dup_l & dup_r, "many_to_many", "Keys repeat on both sides: rows multiply."),
        warn(dup_l != dup_r, "repeated_keys", "Keys repeat on one side: the other side's rows are repeated."),
    ]
    for a, b in _pairs(keys):
        ta, tb = logical_type(left, a), logical_type(right, b)
        if ta != tb:
            found.append(warn(F.lit(True), "type_mismatch", f"{a} is {ta} but {b} is {tb}: values may not match."))
    if how == "inner":
        dropped = F.concat(unmatched.cast("string"), F.lit(" unmatched rows are dropped by the inner join."))
        found.append(warn(unmatched > 0, "unmatched_dropped", dropped))
    large = F.col("estimated_rows") > (F.col("left_rows") + F.col("right_rows")) * 3
    found.append(warn(large, "large_result", "The result is much larger than the inputs: check the keys."))
    return p.select(F.inline(F.filter(F.array(*found), lambda w: w.isNotNull())))
