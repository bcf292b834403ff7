"""Dictionary of the static executable features: names, groups and descriptions, from a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (group, number of features, description with {n} = ordinal, {x} = ordinal as hex byte).
FEATURE_GROUPS = [
    ("byte_histogram", 256, "relative frequency of byte {x}"),
    ("byte_entropy", 256, "joint byte-entropy statistic for byte {x}"),
    ("string", 104, "printable-string statistic {n}"),
    ("general_file", 10, "general PE file statistic {n}"),
    ("header", 62, "COFF or Optional Header field {n}"),
    ("section", 255, "PE section statistic {n}"),
    ("import", 1280, "import table feature {n}"),
    ("export", 128, "export table feature {n}"),
    ("datadir", 30, "PE data-directory feature {n}"),
]
FEATURE_COUNT = sum(size for _, size, _ in FEATURE_GROUPS)


def feature_names() -> list[str]:
    return [f"{group}_{n}" for group, size, _ in FEATURE_GROUPS for n in range(size)]


def feature_descriptions() -> dict[str, str]:
    return {
        f"{group}_{n}": text.format(n=n, x=f"0x{n:02X}")
        for group, size, text in FEATURE_GROUPS
        for n in range(size)
    }


def feature_dim(spark: SparkSession) -> DataFrame:
    """(pos, name, group, ord, description), 2,381 rows in file order."""
    parts, start = [], 0
    for group, size, text in FEATURE_GROUPS:
        ordinal = F.col("id").cast("int")
        pattern = text.replace("{n}", "%d").replace("{x}", "0x%02X")
        parts.append(
            spark.range(size).select(
                (ordinal + start).alias("pos"),
                F.concat(F.lit(f"{group}_"), ordinal).alias("name"),
                F.lit(group).alias("group"),
                ordinal.alias("ord"),
                F.format_string(pattern, ordinal).alias("description"),
            )
        )
        start += size
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
