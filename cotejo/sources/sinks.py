"""Record shapes for output, and table changes as whole-snapshot transformations.

A change returns the new snapshot as a DataFrame; the caller writes it to a new path (or a table format) and switches
over. Snapshots are never overwritten in place while being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cotejo.functions.account import clean_email


def to_id_records(df: DataFrame) -> DataFrame:
    """Identifier, confidence as a percent, index."""
    return df.select(F.col("id_number").alias("cedula"), (F.col("confidence") * 100).alias("confidence"),
                     F.col("pos").alias("index"))


def to_text_records(df: DataFrame) -> DataFrame:
    return df.select("text", "confidence", F.struct("x", "y").alias("position"))


def to_validation_records(df: DataFrame) -> DataFrame:
    """Enum names in lower case and the per-field matches as a map."""
    matches = F.map_from_entries(F.transform("matches", lambda m: F.struct(m["field_name"], m)))
    return df.select(
        F.lower("status").alias("status"), F.lower("action").alias("action"), "confidence", "details",
        F.col("written_names").alias("manuscrito_nombres"), F.col("digital_names").alias("digital_nombres"),
        matches.alias("matches"),
    )


def write_records(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.mode(mode).format(fmt).save(path)


def reject_bad_scopes(new_keys: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split keys (key_id, ..., scopes array) into accepted ones and (key_id, bad_codes). A key is refused when any of
    its codes is unknown or inactive, or when it has none."""
    asked = new_keys.select("key_id", F.explode_outer("scopes").alias("code"))
    known = catalog.filter("is_active").select("code", F.lit(True).alias("known"))
    bad = asked.join(known, "code", "left").filter(F.col("known").isNull())
    bad = bad.groupBy("key_id").agg(F.sort_array(F.collect_set("code")).alias("bad_codes"))
    return new_keys.join(bad, "key_id", "left_anti"), bad


def insert_keys(new_keys: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append to the key table and to the key-scope table."""
    accepted, _ = reject_bad_scopes(new_keys, catalog)
    codes = accepted.select("key_id", F.explode(F.array_distinct("scopes")).alias("code"))
    links = codes.join(catalog.select("code", F.col("id").alias("scope_id")), "code").select("key_id", "scope_id")
    return accepted.drop("scopes"), links


def apply_key_changes(keys: DataFrame, changes: DataFrame, key: str = "key_id") -> DataFrame:
    """New key snapshot. Only ``is_active``, ``last_used_at`` and ``revoked_at`` change; scopes never do.

    A NULL in ``changes`` leaves a column alone unless a boolean column ``set_<name>`` says that it is to be written. Of
    several changes of one key the latest use, the first revocation and any deactivation count."""
    pick = {"is_active": F.min, "last_used_at": F.max, "revoked_at": F.min}
    mutable = [c for c in pick if c in changes.columns]
    told = {c: F.col(f"set_{c}") if f"set_{c}" in changes.columns else F.col(c).isNotNull() for c in mutable}
    new = changes.groupBy(key).agg(
        *[pick[c](F.when(told[c], F.col(c))).alias(f"new_{c}") for c in mutable],
        *[F.coalesce(F.bool_or(told[c]), F.lit(False)).alias(f"told_{c}") for c in mutable])
    joined = keys.join(new, key, "left")
    return joined.withColumns(
        {c: F.when(F.col(f"told_{c}"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in mutable}).select(*keys.columns)


def delete_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def split_upserts(users: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming users that can be written, and the others with their ``reason``: ``malformed`` e-mail, ``repeated`` (not the
    first e-mail of an id that comes more than once) or ``taken`` (another user of the snapshot has the e-mail, or a
    smaller incoming id claims it)."""
    cleaned = incoming.withColumn("clean", clean_email(F.col("email")))
    malformed = cleaned.filter(F.col("clean").isNull()).drop("clean").withColumn("reason", F.lit("malformed"))
    fresh = cleaned.filter(F.col("clean").isNotNull()).withColumn("email", F.col("clean")).drop("clean")
    turn = Window.partitionBy("user_id").orderBy("email", *[c for c in fresh.columns if c not in ("user_id", "email")])
    ranked = fresh.withColumn("turn", F.row_number().over(turn))
    repeated = ranked.filter("turn > 1").drop("turn").withColumn("reason", F.lit("repeated"))
    single = ranked.filter("turn = 1").drop("turn")
    owners = users.groupBy("email").agg(F.min("user_id").alias("owner"))
    claims = single.groupBy("email").agg(F.min("user_id").alias("claimant"))
    judged = single.join(owners, "email", "left").join(claims, "email")
    free = F.coalesce(F.col("owner") == F.col("user_id"), F.col("claimant") == F.col("user_id"))
    columns = incoming.columns
    taken = judged.filter(~free).select(*columns).withColumn("reason", F.lit("taken"))
    return judged.filter(free).select(*columns), malformed.unionByName(repeated).unionByName(taken)


def upsert_users(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """New user snapshot: known ids take the incoming mutable fields (a NULL leaves one alone), unknown ids are added.
    Only the rows that :func:`split_upserts` accepts are written."""
    return merge_users(users, split_upserts(users, incoming)[0])


def merge_users(users: DataFrame, accepted: DataFrame) -> DataFrame:
    """The users with rows that have been accepted already."""
    mutable = [c for c in users.columns if c not in ("user_id", "created_at")]
    changes = accepted.select("user_id", *[F.col(c).alias(f"new_{c}") for c in mutable])
    updated = users.join(changes, "user_id", "left").withColumns(
        {c: F.coalesce(f"new_{c}", c) for c in mutable}
    ).select(*users.columns)
    added = accepted.join(users.select("user_id"), "user_id", "left_anti").select(*users.columns)
    return updated.unionByName(added)


def with_changes(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return df.withColumns(changes)
