"""Set-at-a-time record updates.

Single-row edits become a batch merge: the change batch is reduced to the
winning change(s) per key, then joined onto the record table. "Latest" is
decided by an explicit (event time, sequence) order, never by arrival, so
replays and out-of-order batches give the same table.

Scale notes: the latest change per key is ``max_by`` of a struct and the last
N per key are ``row_number() <= n``, which Spark limits to n rows per key and
task before the shuffle (``WindowGroupLimit``): a key that owns a third of all
changes sends n rows per task. Changes are reduced to one row per key before
they are joined onto the record table, and the first record of each key is
found once. Keys are compared as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens.functions.text import py_strip

ORDER_COL = "_input_order"


def _order_struct(order_cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)])


def latest_per_key(changes: DataFrame, key: str, order_cols: Sequence[str],
                   value_cols: Sequence[str]) -> DataFrame:
    """The last change per key by ``order_cols`` (ties impossible when a sequence is included)."""
    return (changes.groupBy(key)
            .agg(F.max_by(F.struct(*[F.col(c) for c in value_cols]), _order_struct(order_cols))
                 .alias("_v"))
            .select(key, "_v.*"))


def top_n_per_key(changes: DataFrame, key: str, order_cols: Sequence[str],
                  value_cols: Sequence[str], n: int) -> DataFrame:
    """Long form ``(key, slot, values...)``: slot 1 = newest, up to ``n`` per key.

    One scan and one exchange whatever ``n`` is.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order_cols])
    return (changes.select(key, *dict.fromkeys([*order_cols, *value_cols]))
            .withColumn("slot", F.row_number().over(newest)).where(F.col("slot") <= n)
            .select(key, "slot", *value_cols))


def _key_text(df: DataFrame, key: str, other: DataFrame) -> Column:
    """The key as text, or as it is if both sides have one type; a bucketed table then stays where it is."""
    plain = df.schema[key].dataType == other.schema[key].dataType
    return F.col(key) if plain else F.col(key).cast("string")


def first_row_marker(base: DataFrame, key: str, keys: DataFrame,
                     order: str = ORDER_COL) -> DataFrame:
    """(_wanted, _first): the first input order of the keys in ``keys`` (only those get updated)."""
    wanted = keys.select(_key_text(keys, key, base).alias("_wanted"))
    rows = base.select(_key_text(base, key, keys).alias("_wanted"), order).join(wanted, "_wanted", "left_semi")
    return rows.groupBy("_wanted").agg(F.min(order).alias("_first"))


def merge_into(base: DataFrame, key: str, target: DataFrame, set_cols: dict[str, Column],
               order: str | None = ORDER_COL) -> DataFrame:
    """Apply ``set_cols`` (expressions over ``target`` columns, prefixed ``t_``)
    to the **first** base row of each key present in ``target``; other rows keep
    their values. ``target`` has one row per key.

    Both joins are on the key alone, so a base bucketed by it isn't shuffled.
    """
    t = target.select(_key_text(target, key, base).alias("_tk"), *[F.col(c).alias(f"t_{c}") for c in target.columns if c != key])
    if order is not None:
        marker = first_row_marker(base, key, target, order)
        t = t.join(marker, F.col("_tk") == F.col("_wanted")).drop("_wanted")
    b = base.withColumn("_bk", _key_text(base, key, target))
    hit = F.col("t._tk").isNotNull()
    if order is not None:
        hit = hit & (F.col(f"b.{order}") == F.col("t._first"))
    out_cols = []
    for c in base.columns:
        if c in set_cols:
            out_cols.append(F.when(hit, set_cols[c]).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out_cols.append(F.col(f"b.{c}"))
    for c, e in set_cols.items():
        if c not in base.columns:
            out_cols.append(F.when(hit, e).alias(c))
    return b.alias("b").join(t.alias("t"), F.col("b._bk") == F.col("t._tk"), "left").select(*out_cols)


def record_update_merge(base: DataFrame, updates: DataFrame, key: str = "animal_id",
                        order_cols: Sequence[str] = ("ts", "seq"),
                        order: str | None = ORDER_COL) -> DataFrame:
    """Last edit per key overwrites symptoms, suggestion and special care.

    Values are stripped; blank overwrites; special care is 'Yes' when the
    flag is present and non-empty, else 'No'. Keys without a record are
    ignored (inner semantics of the merge).
    """
    latest = latest_per_key(updates, key, order_cols,
                            ["symptom_1", "symptom_2", "suggestion", "special_care"])
    return merge_into(_with_blank(base, _RECORD_SETS), key, latest, _update_sets(), order)


_RECORD_SETS = ("doctor_suggestion", "special_care")


def _update_sets() -> dict[str, Column]:
    flag = F.coalesce(F.col("t.t_special_care"), F.lit(""))
    return {
        "symptom_1": F.coalesce(py_strip(F.col("t.t_symptom_1")), F.lit("")),
        "symptom_2": F.coalesce(py_strip(F.col("t.t_symptom_2")), F.lit("")),
        "doctor_suggestion": F.coalesce(py_strip(F.col("t.t_suggestion")), F.lit("")),
        "special_care": F.when(flag != F.lit(""), F.lit("Yes")).otherwise(F.lit("No")),
    }


def _last_two(entries: DataFrame, key: str, order_cols: Sequence[str]) -> DataFrame:
    top = top_n_per_key(entries, key, order_cols, ["text"], 2)
    return (top.groupBy(key)
            .agg(F.max(F.when(F.col("slot") == 1, F.col("text"))).alias("v1"),
                 F.max(F.when(F.col("slot") == 2, F.col("text"))).alias("v2")))


def _with_blank(base: DataFrame, cols: Sequence[str]) -> DataFrame:
    return base.withColumns({c: F.lit("") for c in cols if c not in base.columns})


def apply_changes(base: DataFrame, edits: DataFrame, entries: DataFrame, key: str = "animal_id",
                  order_cols: Sequence[str] = ("ts", "seq"), order: str | None = ORDER_COL) -> DataFrame:
    """U1 and U2 in one merge: each key's last edit and last two vaccinations meet before
    the record table is joined, so its first rows are found and joined once."""
    base = _with_blank(base, [*_RECORD_SETS, "vaccination_1", "vaccination_2"])
    latest = latest_per_key(edits, key, order_cols, ["symptom_1", "symptom_2", "suggestion", "special_care"])
    target = (latest.withColumn("edited", F.lit(True))
              .join(_last_two(entries, key, order_cols), key, "full_outer"))
    sets = {c: F.when(F.col("t.t_edited"), e).otherwise(F.col(f"b.{c}")) for c, e in _update_sets().items()}
    pushed = F.col("t.t_v1").isNotNull()
    sets["vaccination_1"] = F.when(pushed, F.col("t.t_v1")).otherwise(F.col("b.vaccination_1"))
    sets["vaccination_2"] = F.when(pushed, F.coalesce(F.col("t.t_v2"), F.col("b.vaccination_1"), F.lit(""))
                                   ).otherwise(F.col("b.vaccination_2"))
    return merge_into(base, key, target, sets, order)


def vaccination_text(vaccine: str = "vaccine", date: str = "vaccine_date") -> Column:
    return F.concat(py_strip(F.col(vaccine)), F.lit(" ("), py_strip(F.col(date)), F.lit(")"))


def vaccination_push(base: DataFrame, entries: DataFrame, key: str = "animal_id",
                     order_cols: Sequence[str] = ("ts", "seq"),
                     order: str | None = ORDER_COL) -> DataFrame:
    """After all accepted entries, V1 = newest entry, V2 = the one before it
    (or the record's previous V1 when only one entry exists; missing -> '').
    ``entries`` must already be validated (P3) and carry ``text``.
    """
    base = _with_blank(base, ["vaccination_1", "vaccination_2"])
    sets = {
        "vaccination_1": F.col("t.t_v1"),
        "vaccination_2": F.coalesce(F.col("t.t_v2"), F.col("b.vaccination_1"), F.lit("")),
    }
    return merge_into(base, key, _last_two(entries, key, order_cols), sets, order)
