"""Joins of partial records, logs and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_matching_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails when either side has keys the other lacks."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    lonely = F.col("_l").isNull() | F.col("_r").isNull()
    guard = F.when(lonely, F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast("int")).otherwise(F.lit(1))
    return joined.withColumn("_ok", guard).where(F.col("_ok") == 1).drop("_l", "_r", "_ok")


def still_to_do(wanted: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a successful log line; failed ones are tried again."""
    return wanted.join(log.where(F.col("error") == "").select(*keys).distinct(), keys, "left_anti")


def by_precedence(specialist: DataFrame, ensemble: DataFrame, value: str) -> DataFrame:
    """Specialist rows by (image, dimension); the ensemble fills missing ``overall`` rows only."""
    keys = ["image_id", "dimension"]
    filler = ensemble.where(F.col("dimension") == "overall").select(*keys, F.col(value).alias("_e"))
    joined = specialist.select(*keys, value).join(filler, keys, "full_outer")
    origin = F.when(F.col(value).isNotNull(), "specialist").otherwise("ensemble")
    return joined.select(*keys, F.coalesce(value, "_e").alias(value), origin.alias("origin"))


def wide_inner(tables: dict[str, DataFrame], value: str) -> DataFrame:
    """One column per dimension for images that every table has."""
    out = None
    for name, df in tables.items():
        part = df.select("image_id", F.col(value).alias(name))
        out = part if out is None else out.join(part, "image_id")
    return out


def wide_outer(long: DataFrame, value: str, order: str, dimensions) -> DataFrame:
    """One column per dimension for images that any row has; the last row of a cell wins."""
    last = F.max_by(value, order)
    return long.groupBy("image_id").pivot("dimension", list(dimensions)).agg(last)


# ---- merging of nested records -----------------------------------------------------------

OPTIONAL = ("split", "image_path_ori", "image_detection_id", "document", "ood", "spread", "pipeline_run_id")


def _merged_map(old: Column, new: Column) -> Column:
    empty_old, empty_new = F.coalesce(old, new), F.coalesce(new, old)
    return F.map_zip_with(empty_old, empty_new, lambda _, a, b: F.coalesce(b, a))


def _merged_dimensions(old: Column, new: Column, fields) -> Column:
    def pick(_, a, b):
        return F.struct(*[F.coalesce(b[f], a[f]).alias(f) for f in fields])

    return F.map_zip_with(F.coalesce(old, new), F.coalesce(new, old), pick)


def _merged_evals(old: Column, new: Column) -> Column:
    """Judge entries by model id; the update replaces an entry and appends new ones."""
    return F.map_values(_merged_map(_by_model(old), _by_model(new)))


def _by_model(entries: Column) -> Column:
    """Entries by model id; of several for one model the last stands."""
    names = F.array_distinct(F.transform(entries, lambda e: e["model_id"]))
    return F.map_from_arrays(names, F.transform(names, lambda m: F.element_at(F.filter(entries, lambda e: e["model_id"] == m), -1)))


def merge_records(existing: DataFrame, update: DataFrame, on=("canonical_id",)) -> DataFrame:
    """Upsert of partial image records, one row per key on either side (see ``fold_records``).

    Seven optional fields, dimension fields and judge entries of the update win
    where they are set, tags of the update win, flags are or-ed. One full outer
    join; everything else is row-local.
    """
    fields = [f.name for f in existing.schema["dimensions"].dataType.valueType.fields]
    o, u = existing.alias("o"), update.alias("u")
    joined = o.join(u, [F.col(f"o.{k}") == F.col(f"u.{k}") for k in on], "full_outer")
    cols = []
    for name in existing.columns:
        old, new = F.col(f"o.{name}"), F.col(f"u.{name}")
        if name in OPTIONAL:
            merged = F.coalesce(new, old)
        elif name == "dimensions":
            merged = _merged_dimensions(old, new, fields)
        elif name == "tags":
            merged = _merged_map(old, new)
        elif name == "vlm_evals":
            merged = F.when(old.isNotNull() & new.isNotNull(), _merged_evals(old, new)).otherwise(F.coalesce(old, new))
        elif name == "is_pseudo_labeled":
            merged = F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
        else:
            merged = F.coalesce(old, new)
        cols.append(merged.alias(name))
    return joined.select(*cols)


def fold_records(updates: DataFrame, order: str) -> DataFrame:
    """Several partial records per id as one, as if merged one after the other by ``order``.

    Merging is associative, so neighbours are merged in pairs: the number of joins grows
    with the logarithm of the most updates of one id.
    """
    w = Window.partitionBy("canonical_id").orderBy(order)
    rows = updates.withColumn("_slot", (F.row_number().over(w) - 1).cast("long")).drop(order)
    names = [c for c in rows.columns if c != "_slot"]
    last = rows.agg(F.max("_slot")).first()[0] or 0
    while last:
        even, odd = (rows.where(F.col("_slot") % 2 == k).select(*names, F.shiftright("_slot", 1).alias("_slot")) for k in (0, 1))
        rows = merge_records(even, odd, ("canonical_id", "_slot"))
        last //= 2
    return rows.drop("_slot")


def _given(name: str) -> tuple[Column, Column]:
    """Records of ``r`` with the field, and its values."""
    given = F.filter("r", lambda x: x[name].isNotNull())
    return given, F.transform(given, lambda x: x[name])


def _dimension_merger(fields: list[str]):
    return lambda a, x: _merged_dimensions(a, x, fields)


def build_master(layers: list[tuple[str, DataFrame, bool]], order: str | None = None) -> DataFrame:
    """One record per id from partial records in ordered layers, in one pass.

    ``layers``: name, records, and whether the layer may bring new ids (others only add to
    ids of those that do). Later layers win like updates of ``merge_records``; several records of an id in a
    layer follow ``order``. Adds ``provenance``: the layer each optional field and each dimension comes
    from last, and ``layers``: the names of all that had the id. A field that a layer lacks is NULL there.
    """
    kinds = {f.name: f.dataType for _, df, _ in layers for f in df.schema.fields if f.name not in ("canonical_id", order)}
    parts = None
    for nth, (_, df, creates) in enumerate(layers):
        fields = [(F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]
        at = F.col(order).cast("string") if order and order in df.columns else F.lit("")
        part = df.select("canonical_id", F.struct(F.lit(nth).alias("_nth"), at.alias("_at"), F.lit(creates).alias("_creates"), *fields).alias("r"))
        parts = part if parts is None else parts.unionByName(part)
    place = lambda r: F.struct(r["_nth"], r["_at"])
    after = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    rows = parts.groupBy("canonical_id").agg(F.array_sort(F.collect_list("r"), after).alias("r")).where(F.exists("r", lambda x: x["_creates"]))
    names = F.array(*[F.lit(name) for name, _, _ in layers])
    out, source = [], []
    for name, kind in kinds.items():
        given, values = _given(name)
        last = F.try_element_at(given, F.lit(-1))
        none = F.lit(None).cast(kind)
        if name == "dimensions":
            inner = [f.name for f in kind.valueType.fields]
            value = F.aggregate(values, none, _dimension_merger(inner))
        elif name == "tags":
            value = F.aggregate(values, none, _merged_map)
        elif name == "vlm_evals":
            value = F.aggregate(values, none, lambda a, x: F.when(a.isNull(), x).otherwise(_merged_evals(a, x)))
        elif name == "is_pseudo_labeled":
            value = F.exists(values, lambda x: x)
        else:
            value = last[name]
            source.append(F.when(last.isNotNull(), F.struct(F.lit(name).alias("field"), F.element_at(names, last["_nth"] + 1).alias("layer"))))
        out.append(value.alias(name))
    held = [F.array_compact(F.array(*source))]
    if "dimensions" in kinds:
        by_dimension = F.flatten(F.transform("r", lambda x: F.transform(F.coalesce(F.map_keys(x["dimensions"]), F.array().cast("array<string>")), lambda d: F.struct(F.concat(F.lit("dimensions."), d).alias("field"), F.element_at(names, x["_nth"] + 1).alias("layer")))))
        known = F.array_distinct(F.transform(by_dimension, lambda e: e["field"]))
        held.append(F.transform(known, lambda d: F.struct(d.alias("field"), F.element_at(F.filter(by_dimension, lambda e: e["field"] == d), -1)["layer"].alias("layer"))))
    seen = F.array_distinct(F.transform("r", lambda x: F.element_at(names, x["_nth"] + 1)))
    return rows.select("canonical_id", *out, F.map_from_entries(F.concat(*held)).alias("provenance"), seen.alias("layers"))


def coverage(master: DataFrame) -> DataFrame:
    """what, name, n: records in all, per split, per dimension, with a document context, with ratings, and per layer."""
    one = lambda what, name: F.struct(F.lit(what).alias("what"), name.alias("name"))
    each = lambda what, names: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(F.lit(what).alias("what"), n.alias("name")))
    facts = [F.array(one("records", F.lit("all")), one("split", F.coalesce("split", F.lit("unknown"))))]
    facts += [each("dimension", F.map_keys("dimensions")), each("layer", F.col("layers"))]
    for what, there in (("document", F.col("document").isNotNull()), ("ratings", F.size("vlm_evals") > 0)):
        facts.append(F.when(there, F.array(one(what, F.lit("any")))).otherwise(F.array().cast("array<struct<what: string, name: string>>")))
    rows = master.select(F.inline(F.concat(*facts)))
    return rows.groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))
