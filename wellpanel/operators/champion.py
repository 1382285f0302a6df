"""Which model version serves: registration, approval, promotion, rollback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellpanel.operators.latest import latest_per_key


class NotApproved(RuntimeError):
    """The version did not pass its blocking gates."""


class MissingMetadata(RuntimeError):
    """The version lacks what a promotion needs to know."""


def registered_versions(runs: DataFrame) -> DataFrame:
    """One version per model and run: registering a run again returns the first version."""
    return latest_per_key(runs, ["model", "run_id"], [F.asc("registered_at"), F.asc("version")])


def with_decision(versions: DataFrame) -> DataFrame:
    """Add ``decision``: promotable, rejected or incomplete."""
    has_metrics = F.coalesce(F.size("metrics") > 0, F.lit(False))
    complete = F.col("as_of_date").isNotNull() & F.col("gates_passed").isNotNull() & has_metrics
    return versions.withColumn(
        "decision",
        F.when(~complete, "incomplete").when(F.col("gates_passed"), "promotable").otherwise("rejected"),
    )


def champion_history(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """Promotion events that took effect, in order; asking for an older version is a rollback.

    ``promotions`` holds (requested_at, model, version), as labels are only unique within a model; events for
    versions that are not promotable leave the champion unchanged.  Version labels are ordered by when
    they were registered.
    """
    approved = with_decision(registered_versions(versions)).filter(F.col("decision") == "promotable")
    events = promotions.join(approved, ["model", "version"])
    # promotions are decisions of people, a handful per month
    w = Window.partitionBy("model").orderBy("requested_at")
    previous = F.lag("registered_at").over(w)
    return events.withColumn("rollback", F.coalesce(F.col("registered_at") < previous, F.lit(False)))


def current_champion(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """The last version promoted per model."""
    return latest_per_key(champion_history(versions, promotions), ["model"], [F.desc("requested_at")])


def require_promotable(versions: DataFrame, model: str, version: str) -> None:
    """Raise unless ``version`` of ``model`` may be promoted."""
    wanted = (F.col("model") == model) & (F.col("version") == version)
    row = with_decision(registered_versions(versions)).filter(wanted).first()
    if row is None or row.decision == "incomplete":
        raise MissingMetadata(f"{model} {version}: a promotion needs cutoff, metrics and gates")
    if row.decision == "rejected":
        raise NotApproved(f"{model} {version}: a blocking gate failed")
