"""The review queue: what enters it, and how decisions close its items."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.settings import DEFAULTS, Settings


def item_id(doc_id, field_name):
    return F.concat(F.substring(F.regexp_replace(doc_id.cast("string"), "[^A-Za-z0-9._-]+", "_"), 1, 80), F.lit(":"), field_name)


def enqueue(classified: DataFrame, fields: DataFrame, queue: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """New items: one __document__ item for an abstained document; else missing required fields, then values below the
    confidence floor, then values with a validator's error. Items that the queue has, decided or not, aren't added again.

    classified: (doc_id, abstained); fields: (doc_id, name, value, confidence, validator_error, required, pii, checksum)."""
    docs = classified.where("abstained").select(F.col("doc_id"), F.lit("__document__").alias("field_name"), F.lit("abstained").alias("reason"), F.lit(1).alias("required_approvals"))
    has = F.coalesce(F.col("value"), F.lit("")) != ""
    reason = F.when(~has & F.col("required"), "missing_required").when(has & (F.col("confidence") < settings.accept_confidence), "below_confidence_threshold").when(has & (F.coalesce("validator_error", F.lit("")) != ""), "validator_error")
    open_ = fields.join(classified.where("not abstained").select("doc_id"), "doc_id", "left_semi").withColumn("reason", reason).where("reason is not null")
    values = open_.select("doc_id", F.col("name").alias("field_name"), "reason", F.when(F.col("pii") & F.col("checksum"), 2).otherwise(1).alias("required_approvals"))
    new = docs.unionByName(values).withColumn("id", item_id(F.col("doc_id"), F.col("field_name")))
    return new if queue is None else new.join(queue.select("id"), "id", "left_anti")


@dataclass
class Item:
    """An item's state; decide() applies one decision and says whether it counted."""

    required: int = 1
    status: str = "pending"
    approvals: list = field(default_factory=list)
    entered: str | None = None
    reviewer: str | None = None

    def decide(self, decision: str, reviewer: str | None, value: str | None = None) -> str:
        who, value = (reviewer or "").strip(), (value or "").strip()
        if self.status != "pending":
            return "already_decided"
        if not who:
            return "no_reviewer"
        if decision == "reject":
            self.status, self.reviewer = "rejected", who
            return "ok"
        if decision == "correct" and not value:
            return "no_value"
        if who in self.approvals:
            return "same_reviewer"
        if decision == "approve":
            self.approvals.append(who)
            if len(self.approvals) >= self.required:
                self.status, self.reviewer = "approved", who
            return "ok"
        if decision != "correct":
            return "unknown_decision"
        if self.required > 1 and not self.approvals:
            self.approvals, self.entered = [who], value
            return "ok"
        if self.required > 1 and self.entered != value:
            self.approvals, self.entered = [], None
            return "mismatch"
        self.approvals.append(who)
        self.status, self.reviewer, self.entered = "corrected", who, value
        return "ok"


STATE = "id string, status string, approvals array<string>, corrected_value string, reviewer string, refused int"


def fold(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items (id, required_approvals) after their decisions (item_id, seq, decision, reviewer, value), each in the order of seq.

    A decision that doesn't count is refused, not an error. Items without decisions stay pending."""

    def run(key, ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(ours):
            return pd.DataFrame([], columns=["id", "status", "approvals", "corrected_value", "reviewer", "refused"])
        item, refused = Item(int(ours.required_approvals.iloc[0])), 0
        for r in theirs.sort_values("seq").itertuples():
            refused += item.decide(r.decision, r.reviewer, r.value) != "ok"
        return pd.DataFrame([(key[0], item.status, item.approvals, item.entered, item.reviewer, refused)], columns=["id", "status", "approvals", "corrected_value", "reviewer", "refused"])

    return items.groupBy("id").cogroup(decisions.withColumnRenamed("item_id", "id").groupBy("id")).applyInPandas(run, STATE)


def fold_single(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """The same for items that need one approval, as a window: the first decision with a reviewer (and a value, if it
    corrects) counts, the rest is refused."""
    valid = decisions.where("trim(coalesce(reviewer, '')) != '' and (decision in ('approve', 'reject') or decision = 'correct' and trim(coalesce(value, '')) != '')")
    first = valid.withColumn("_k", F.row_number().over(Window.partitionBy("item_id").orderBy("seq"))).where("_k = 1")
    status = F.element_at(F.create_map(F.lit("approve"), F.lit("approved"), F.lit("reject"), F.lit("rejected"), F.lit("correct"), F.lit("corrected")), F.col("decision"))
    n = decisions.groupBy("item_id").agg(F.count("*").alias("n"))
    j = items.join(first.select(F.col("item_id").alias("id"), status.alias("status"), "reviewer", F.when(F.col("decision") == "correct", F.trim("value")).alias("corrected_value")), "id", "left").join(n.withColumnRenamed("item_id", "id"), "id", "left")
    return j.select("id", F.coalesce("status", F.lit("pending")).alias("status"), "reviewer", "corrected_value", (F.coalesce("n", F.lit(0)) - F.col("status").isNotNull().cast("int")).cast("long").alias("refused"))


def waiting(items: DataFrame, now) -> DataFrame:
    """Depth, and the mean and longest wait in seconds, of pending items (id, status, created_at)."""
    wait = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("created_at")
    return items.where("status = 'pending'").agg(F.count("*").alias("depth"), F.avg(wait).alias("mean_wait"), F.max(wait).alias("longest_wait"))
