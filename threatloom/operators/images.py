"""Image checks over what is known of an image: alternative text, recognised
text, metadata and size.  ``threatloom.sources.images`` reads metadata and sizes of files.

Null texts, metadata and sizes are not checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.functions.regex import Pattern
from threatloom.operators.detection import BLOCK, CHALLENGE, QUARANTINE, Rule, decided, detection, present, worst_level
from threatloom.operators.settings import DEFAULT, Settings

LAYER = "multimodal"

# The patterns of these rules.
RULES = [
    Rule("MM-INJECT", Pattern(r"(?:ignore|override|bypass|disable)\s+(?:all\s+)?(?:previous|prior|safety|security|filter|restriction|instruction)"), "image text against safeguards", "high", "indirect_injection", LAYER, 0.85),
    Rule("MM-ROLE", Pattern(r"(?:you\s+are\s+now|act\s+as|pretend\s+to\s+be|switch\s+to)\s+(?:an?\s+)?(?:unrestricted|unfiltered|jailbroken|evil|DAN)"), "image text gives a role", "high", "indirect_injection", LAYER, 0.85),
    Rule("MM-SYSOVR", Pattern(r"(?:system|admin|root)\s*(?:prompt|instruction|command)\s*[:=]"), "image text speaks as the system", "high", "indirect_injection", LAYER, 0.85),
]


def image_detections(alt: Column, ocr: Column, metadata: Column, width: Column, height: Column) -> Column:
    texts = F.concat(F.coalesce(F.map_values(metadata), F.array().cast("array<string>")), F.array(alt, ocr))
    hits = F.flatten(F.transform(texts, lambda t: present(r.column(t) for r in RULES)))
    pixel = F.when((width == 1) & (height == 1), detection("MM-STEG", "indirect_injection", "medium", CHALLENGE, "image of one pixel", F.lit("1x1"), LAYER, 0.60))
    return F.concat(hits, present([pixel]))


def check_images(df: DataFrame, settings: Settings = DEFAULT, unreadable: Column | None = None) -> DataFrame:
    """``df`` (``alt_text, ocr_text, metadata, width, height``) with the columns of a
    decision.  Where ``unreadable`` holds, a file could not be looked into: that
    alone is the answer, a challenge.  Without it such files pass as if empty."""
    seen = image_detections(*map(F.col, ("alt_text", "ocr_text", "metadata", "width", "height")))
    if unreadable is not None:
        degraded = F.array(detection("MM-DEGRADE", "indirect_injection", "medium", CHALLENGE, "image file that can't be read", F.lit(""), LAYER, 0.5))
        seen = F.when(F.coalesce(unreadable, F.lit(False)), degraded).otherwise(seen)
    found = df.withColumn("detections", seen)
    level = worst_level(F.col("detections"))
    high = (level == "critical") if settings.ordinal else level >= "critical"
    closed = F.exists("detections", lambda d: d["signature_id"] == "MM-DEGRADE")
    call = F.when(F.size("detections") == 0, "allow").when(closed, CHALLENGE).when(high, BLOCK).otherwise(QUARANTINE)
    return found.select(*df.columns, *decided(F.col("detections"), call))
