"""Verdict policies over stage-1 and stage-2 probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from netloom.functions import constants as K


def probability_map(classes: list[str], probabilities: Column) -> Column:
    """class -> probability."""
    return F.map_from_arrays(F.array(*map(F.lit, classes)), probabilities)


def argmax_with_unknown(df: DataFrame, probabilities: str, classes: list[str],
                        threshold: float = K.UNKNOWN_THRESHOLD) -> DataFrame:
    """First maximal class, its confidence, and ``Unknown`` below the threshold."""
    best = F.array_max(probabilities)
    place = F.array_position(F.col(probabilities), best).cast("int")
    out = df.withColumns({
        "confidence": best,
        "predicted_class": F.element_at(F.array(*map(F.lit, classes)), place),
    })
    return out.withColumn("model_class", F.when(F.col("confidence") < threshold, "Unknown")
                          .otherwise(F.col("predicted_class")))


def passes_gate(p_attack: str, threshold: float = K.STAGE1_THRESHOLD) -> Column:
    return F.col(p_attack) >= threshold


def gate(df: DataFrame, p_attack: str, threshold: float = K.STAGE1_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(verdicts that stop at stage 1, rows that go on): two filters, so the costly
    stage never sees the stopped rows."""
    stopped = df.filter(F.col(p_attack) < threshold).withColumns({
        "verdict": F.lit("BENIGN"), "attack_type": F.lit("Normal Traffic"),
        "final_confidence": F.round(1 - F.col(p_attack), 4),
        "stage_reached": F.lit("Stage 1 (ML)"), "model_class": F.lit(None).cast("string"),
    })
    return stopped, df.filter(passes_gate(p_attack, threshold))


def display_name(label: Column) -> Column:
    pairs = [F.lit(x) for item in K.DISPLAY_NAMES.items() for x in item]
    return F.element_at(F.create_map(*pairs), label)


def fuse(df: DataFrame, p_attack: str) -> DataFrame:
    """Final verdict of rows scored by stage 2 (``model_class``, ``confidence``)."""
    label = F.col("model_class")
    return df.withColumns({
        "verdict": F.when(label == "Benign", "BENIGN").otherwise("MALICIOUS"),
        "attack_type": F.when(label == "Unknown", "Unknown Attack").otherwise(display_name(label)),
        "final_confidence": F.round(F.when(label == "Unknown", F.col(p_attack)).otherwise(F.col("confidence")), 4),
        "stage_reached": F.lit("Stage 2 (DL)"),
    })


def verdicts(df: DataFrame, p_attack: str, probabilities: str, classes: list[str] = K.OUTPUT_CLASSES,
             gate_threshold: float = K.STAGE1_THRESHOLD, unknown_threshold: float = K.UNKNOWN_THRESHOLD) -> DataFrame:
    """Gate, argmax and fusion in one narrow plan, for probabilities already present."""
    scored = argmax_with_unknown(df, probabilities, classes, unknown_threshold)
    fused = fuse(scored, p_attack)
    on = passes_gate(p_attack, gate_threshold)
    return fused.withColumns({
        "verdict": F.when(on, F.col("verdict")).otherwise("BENIGN"),
        "attack_type": F.when(on, F.col("attack_type")).otherwise("Normal Traffic"),
        "final_confidence": F.when(on, F.col("final_confidence")).otherwise(F.round(1 - F.col(p_attack), 4)),
        "stage_reached": F.when(on, F.col("stage_reached")).otherwise("Stage 1 (ML)"),
        "model_class": F.when(on, F.col("model_class")),
    })


def attack_mask(predicted: str, confidence: str, threshold: Column | float) -> Column:
    """What the running system alerts on: another winner than Benign, or low confidence."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    return (F.col(predicted) != "Benign") | (F.col(confidence) < limit)
