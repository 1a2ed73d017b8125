"""Signature catalogs: folders of JSON files, their checks, and detections by them.

A file is ``{"signatures": [{"id", "category", "name", "description", "patterns",
"severity", "confidence", "false_positive_rate", "references", "enabled"}]}``.
The folder is a parameter; a small one comes with the package.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.functions.columns import let, match, small
from threatloom.functions.regex import Pattern
from threatloom.functions.screens import MayMatch
from threatloom.operators.detection import BLOCK, CHALLENGE, QUARANTINE, SANITIZE, detection, gated, present

STARTER = str(Path(__file__).parent.parent / "data" / "starter_catalog")
#: Files of a catalog folder that hold no signatures.
SIDE_FILES = ("catalog_version.json", "integrity.json")
SIGNATURE = "struct<id:string,category:string,name:string,description:string,patterns:array<string>,severity:string,confidence:double,false_positive_rate:double,references:array<string>,enabled:boolean>"

# Categories and what else they are called.
CATEGORIES = ("prompt_injection", "indirect_injection", "unicode_smuggling", "tool_exploitation", "data_exfiltration", "memory_poisoning", "behavioral_anomaly", "wallet_attack", "denial_of_service", "ascii_art_bypass", "chain_attack")
ALIASES = {"exfiltration": "data_exfiltration", "wallet": "wallet_attack", "wallet_attacks": "wallet_attack", "memory": "memory_poisoning", "tool": "tool_exploitation", "unicode": "unicode_smuggling", "ascii_art": "ascii_art_bypass", "indirect_prompt_injection": "indirect_injection"}
VERDICTS = {"critical": BLOCK, "high": QUARANTINE, "medium": CHALLENGE}

#: Patterns that backtrack without end on some texts; they look at so many
#: characters only.  (None of the starter catalog's; add to it for others.)
SLOW: dict[tuple[str, int], int] = {}


@dataclass(frozen=True)
class Signature:
    id: str
    category: str
    description: str
    patterns: tuple[str, ...]
    severity: str = "medium"
    confidence: float = 0.8
    enabled: bool = True

    def column(self, low: Column, plain: Column) -> Column:
        """The detection of the first pattern that matches the lower-case text, or null;
        ``plain`` is the text for gates."""
        verdict = VERDICTS.get(self.severity, SANITIZE)
        texts = [F.substring(low, 1, SLOW[self.id, k]) if (self.id, k) in SLOW else low for k in range(len(self.patterns))]
        patterns = [Pattern(p, dot_all=True, multi_line=True) for p in self.patterns]
        found = F.coalesce(*[gated(match(t, p), plain, p) for t, p in zip(texts, patterns, strict=True)], F.lit(None).cast("string"))
        return let(found, lambda m: F.when(m.isNotNull(), detection(self.id, self.category, self.severity, verdict, self.description, m, "threat_catalog", self.confidence)))


def table(spark: SparkSession, path: str) -> DataFrame:
    """A catalog folder as a table, one row for each signature, in file order;
    unknown categories are dropped, missing fields get their defaults, and a file
    that can't be parsed adds nothing."""
    files = spark.read.schema(f"signatures array<{SIGNATURE}>").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    files = files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode("signatures").alias("pos", "s")).where(~F.col("file").isin(*SIDE_FILES))
    rows = files.select("file", "pos", "s.*")
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), F.lower("category")), F.lower("category"))
    return rows.select(
        "file", "pos", "id", named.alias("category"), "name", "description", "patterns",
        F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"),
        F.coalesce("false_positive_rate", F.lit(0.01)).alias("false_positive_rate"), "references", F.coalesce("enabled", F.lit(True)).alias("enabled"),
    ).where(F.col("category").isin(*CATEGORIES))


#: Most signatures that are compiled into one plan.
MOST_SIGNATURES = 2000


def load(spark: SparkSession, path: str = STARTER) -> list[Signature]:
    """The catalog on the driver, to be compiled into columns; its size is checked."""
    rows = table(spark, path).orderBy("file", "pos").limit(MOST_SIGNATURES + 1).collect()
    if len(rows) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} signatures")
    return [Signature(r["id"], r["category"], r["description"] or "", tuple(r["patterns"] or ()), r["severity"], r["confidence"], r["enabled"]) for r in rows]


def reload(spark: SparkSession, path: str, current: list[Signature]) -> tuple[list[Signature], bool]:
    """The folder's catalog as it is now, to compile new plans with, and whether it
    was taken; a folder that can't be read, or gives no signature, leaves the current one."""
    try:
        found = load(spark, path)
    except Exception:  # noqa: BLE001  whatever is wrong with the folder, checks go on
        return current, False
    return (found, True) if found else (current, False)


def chosen(signatures: list[Signature], categories: list[str] | None = None) -> list[Signature]:
    return [s for s in signatures if s.enabled and s.patterns and (categories is None or s.category in categories)]


def catalog_detections(text: Column, signatures: list[Signature], categories: list[str] | None = None) -> Column:
    """A detection for each signature that matches.  Patterns are literals, so
    Spark compiles each once."""
    picked = chosen(signatures, categories)
    return let(F.lower(text), lambda low: let(small(low), lambda plain: present(s.column(low, plain) for s in picked))) if picked else present([])


def screen_test(signatures: list[Signature], categories: list[str] | None = None) -> MayMatch:
    """For screens: whether one of the signatures may match."""
    return MayMatch.of(Pattern(p) for s in chosen(signatures, categories) for p in s.patterns)


def stats(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("category").agg(F.count(F.lit(1)).alias("signatures"), F.sum(F.size("patterns")).alias("patterns"), F.sum(F.col("enabled").cast("int")).alias("enabled"))


def integrity(spark: SparkSession, path: str, expected: dict[str, str], any_newline: bool = True) -> DataFrame:
    """``file, ok`` for the files of a catalog: whether their SHA-256 is the
    expected one; with ``any_newline`` also that of the text with CRLF ends."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    body = F.col("content").cast("string")
    crlf = F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), "\n", "\r\n")
    want = spark.createDataFrame(list(expected.items()) or [("", "")], "file string, sha string")
    sums = files.select(name.alias("file"), F.sha2(body, 256).alias("raw"), F.sha2(crlf, 256).alias("crlf"))
    same = (F.col("raw") == F.col("sha")) | (F.col("crlf") == F.col("sha") if any_newline else F.lit(False))
    return sums.join(want, "file").select("file", same.alias("ok"))


def version(path: str = STARTER) -> dict:
    """The version file of a catalog folder, if it has one."""
    file = Path(path) / SIDE_FILES[0]
    return json.loads(file.read_text()) if file.exists() else {}


def newer(version_a: Column, version_b: Column) -> Column:
    """Whether the first dotted version is above the second, number by number."""
    numbers = lambda v: F.transform(F.split(F.regexp_replace(v, "^v", ""), "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return numbers(version_a) > numbers(version_b)
