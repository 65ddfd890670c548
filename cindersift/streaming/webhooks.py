"""Webhook payloads as a source (S13): signatures checked, pushes to the default branch and pull requests become scans.

Works on batches and streams alike, as every row is judged alone; the signature needs no Python either, since a keyed
hash is two plain hashes over constant paddings.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

PAYLOAD = "ref string, after string, action string, number long, repository struct<full_name:string,default_branch:string>, pull_request struct<head:struct<ref:string,sha:string>>"
#: The actions of a pull request that are scanned.
ACTIONS = ("opened", "synchronize", "reopened")


def hmac_sha256(key: bytes, body: Column) -> Column:
    """The keyed hash of a text or binary column, as lower-case hex."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in key)), body.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def verified(rows: DataFrame, secret: bytes) -> DataFrame:
    """Rows (body, signature, ...) whose signature is ``sha256=`` and the body's keyed hash."""
    return rows.where(F.col("signature") == F.concat(F.lit("sha256="), hmac_sha256(secret, F.col("body"))))


def triggered(rows: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Each payload (event, body, ...) as what it does: status, repository, trigger, branch and commit of the scan.

    status: ok (pings, installations), ignored (other events), skipped (other branches, other actions, and, if ``repos``
    with full_name is given, unknown repositories), invalid (a body that is no JSON object), scan_triggered.
    """
    p = F.from_json("body", PAYLOAD)
    out = rows.withColumn("p", p)
    name = F.coalesce("p.repository.full_name", F.lit(""))
    default = F.coalesce("p.repository.default_branch", F.lit("main"))
    push = F.col("event") == "push"
    pull = F.col("event") == "pull_request"
    valid = F.rlike(F.trim("body"), F.lit(r"^\{(?s:.*)\}$")) & F.col("p").isNotNull()
    wanted = (push & (F.coalesce("p.ref", F.lit("")) == F.concat(F.lit("refs/heads/"), default))) | (pull & F.coalesce("p.action", F.lit("")).isin(*ACTIONS))
    status = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("event").isin("ping", "installation"), "ok").when(~(push | pull), "ignored").when(wanted, "scan_triggered").otherwise("skipped")
    out = out.withColumns({"status": status, "repository": name})
    if repos is not None:
        known = repos.select(F.col("full_name").alias("repository"), F.lit(True).alias("__known")).distinct()
        out = out.join(known, "repository", "left").withColumn("status", F.when((F.col("status") == "scan_triggered") & F.col("__known").isNull(), "skipped").otherwise(F.col("status"))).drop("__known")
    scan = F.col("status") == "scan_triggered"
    number = F.coalesce("p.number", F.lit(0)).cast("string")
    return out.withColumns(
        {
            "trigger": F.when(scan & push, "webhook_push").when(scan, F.concat(F.lit("webhook_pr_"), number)),
            "branch": F.when(scan & push, default).when(scan, F.coalesce("p.pull_request.head.ref", F.lit(""))),
            "commit": F.when(scan & push, F.substring(F.coalesce("p.after", F.lit("")), 1, 40)).when(scan, F.substring(F.coalesce("p.pull_request.head.sha", F.lit("")), 1, 40)),
        }
    ).drop("p")
