"""Reason codes: what each flag means, how severe it is and whether it counts as a defect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationproof.functions.columns import literal_table

# Code, name, category, severity, counts toward the defect rate, sentence.
REASON_CODES = (
    ("R01", "ROW_ABSENT", "structural", "low", True, "No reading was recorded for this hour."),
    ("R02", "COMM_GAP", "structural", "high", True, "No readings for {duration} - the station stopped transmitting."),
    ("R03", "DUPLICATE_TIMESTAMP", "structural", "medium", True, "Two different readings claim the same timestamp."),
    ("R04", "TIMESTAMP_OUT_OF_ORDER", "structural", "medium", True, "This reading is timestamped earlier than the one before it."),
    ("R05", "COUNTER_RESET", "structural", "low", True, "The cumulative counter reset from {previous} to {current}."),
    ("R06", "COUNTER_NONMONOTONIC", "structural", "medium", True, "The cumulative counter went backwards without a reset."),
    ("R07", "EXCEEDS_PHYSICAL_MAX", "physical", "critical", True, "Value of {value} {unit} exceeds the physical maximum for {parameter}."),
    ("R08", "BELOW_PHYSICAL_MIN", "physical", "high", True, "Value of {value} {unit} is below the physical minimum for {parameter}."),
    ("R09", "CROSS_PARAM_INVERSION", "physical", "critical", True, "PM2.5 ({pm25}) exceeds PM10 ({pm10}), which is physically impossible."),
    ("R10", "UNIT_INCONSISTENT", "physical", "high", True, "Declared unit ({declared}) does not match the observed value range, which is consistent with {inferred}."),
    ("R11", "DETECTION_LIMIT_FLOOR", "physical", "medium", True, "Value is pinned at the instrument's detection limit ({limit} {unit}) and is left-censored, not a measurement."),
    ("R12", "ZERO_VARIANCE", "statistical", "high", True, "Reading has not changed for {duration} - likely a frozen sensor."),
    ("R13", "LOW_VARIANCE_DEGRADED", "statistical", "medium", True, "Variation over {window} is far below this sensor's normal range."),
    ("R14", "STEP_CHANGE", "statistical", "medium", True, "The series shifted by {magnitude} {unit} and did not return."),
    ("R15", "CALIBRATION_EPOCH_DISCONTINUITY", "statistical", "medium", True, ""),
    ("R16", "DRIFT_VS_CONSENSUS", "statistical", "medium", True, ""),
    ("R17", "SPATIAL_INCONSISTENCY", "statistical", "high", True, "This reading contradicts {n} physically connected neighbours."),
    ("R18", "PARAMETER_ABSENT_STRUCTURAL", "coverage", "info", False, "This station does not carry a {parameter} sensor."),
    ("R19", "SOURCE_ABSENT", "coverage", "info", False, "No {source} data exists for this station."),
    ("R20", "METEO_ARTEFACT_SUSPECTED", "statistical", "info", False, ""),
    ("R21", "SENSOR_DEAD", "statistical", "critical", True, "This sensor has reported nothing usable since {since}."),
    ("R22", "PLUME_CORROBORATED", "adjudication", "info", False, "The rise is corroborated by {n} downwind neighbour(s), consistent with a real plume."),
    ("R23", "ADJUDICATION_AMBIGUOUS", "adjudication", "medium", False, "Evidence is mixed; this event is routed to human review."),
    ("T00", "TRUST_NOMINAL", "trust", "info", False, "All trust components are within their nominal range."),
    ("T01", "TRUST_LOW_HEALTH", "trust", "medium", False, "Trust is reduced by {n_defects} active defect(s) in the trailing window."),
    ("T02", "TRUST_IMPUTATION_PLACEHOLDER", "trust", "info", False, "Imputation uncertainty is a placeholder ({pct}% of readings absent); no imputation model exists yet."),
    ("T03", "TRUST_CROSS_SENSOR_DISAGREEMENT", "trust", "medium", False, "Trust is reduced by disagreement with {n} neighbouring station(s)."),
    ("T04", "TRUST_IMPLAUSIBLE_VALUE", "trust", "high", False, "Trust is reduced by readings near or beyond their physical bounds."),
    ("T05", "TRUST_INSUFFICIENT_NEIGHBOURS", "trust", "info", False, "Cross-sensor consistency is unavailable: fewer than {min_peers} comparable neighbours were found."),
)

SEVERITY = {r[0]: r[3] for r in REASON_CODES}
COUNTING = [r[0] for r in REASON_CODES if r[4]]
SENTENCE = {r[0]: r[5] for r in REASON_CODES}
PLACEHOLDERS = (
    "duration", "previous", "current", "value", "unit", "parameter", "pm25", "pm10", "declared",
    "inferred", "limit", "window", "magnitude", "n", "source", "since", "n_defects", "pct",
    "min_peers",
)


def reason_codes(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        REASON_CODES,
        "reason_code string, name string, category string, severity string, counts boolean, sentence string",
    )


def counts(code) -> Column:
    return (F.col(code) if isinstance(code, str) else code).isin(COUNTING)


def counting_codes(codes: DataFrame) -> DataFrame:
    return codes.where("counts")


def coverage_codes(codes: DataFrame) -> DataFrame:
    return codes.where("category = 'coverage'")


def render(sentence: Column, evidence: Column, parameter: Column) -> Column:
    """Fill `{placeholders}` from the evidence map; if any is missing the template stays as it is."""
    filled = reduce(
        lambda text, p: F.replace(
            text,
            F.lit("{" + p + "}"),
            F.coalesce(parameter if p == "parameter" else F.try_element_at(evidence, F.lit(p)), F.lit("{" + p + "}")),
        ),
        PLACEHOLDERS,
        sentence,
    )
    return F.when(filled.rlike(r"\{[a-z0-9_]+\}"), sentence).otherwise(filled)
