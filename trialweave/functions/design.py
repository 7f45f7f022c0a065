"""Design constants and recodes shared by every plan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sessions, codes, windows, sensor regions and label texts of the study design.
SESSIONS = (2, 3, 4, 6)
WINDOWS = (("200_500", 200, 498), ("300_600", 300, 598), ("400_900", 400, 898))
EPOCH_MS = (-100, 1098)
SAMPLE_STEP_MS = 2
SAMPLES_PER_TRIAL = 600
RT_SCREEN_MS = (200, 4000)
NULL_TOKENS = ("", "NA", "undefined")
CONTROL, VIOLATION = "Grammatical", "Ungrammatical"
GROUP_ODD, GROUP_EVEN = "Mini-English", "Mini-Norwegian"
REGIONS = {
    "left anterior": ("Fp1", "F3", "F7", "FT9", "FC5"),
    "midline anterior": ("Fz", "FC1", "FC2"),
    "right anterior": ("Fp2", "F4", "F8", "FT10", "FC6"),
    "left medial": ("T7", "C3", "CP5"),
    "midline medial": ("Cz", "CP1", "CP2"),
    "right medial": ("T8", "C4", "CP6"),
    "left posterior": ("P7", "P3", "O1"),
    "midline posterior": ("Pz", "Oz"),
    "right posterior": ("P8", "P4", "O2"),
}
NON_SCALP = ("x_dir", "y_dir", "z_dir", "TP9", "TP10")
REFERENCE_PAIR = ("TP9", "TP10")
BOUNDARY_CODES = (5, 6, 7, 8, 254, 255)
PROPERTY_CODES = (1, 2, 3)
WORD_CODES = (40, 99)
CONDITION_CODES = (101, 102, 103)
SENTENCE_CODES = (110, 253)


def sum_code(col: Column, plus: str, minus: str) -> Column:
    """+0.5 / -0.5 contrast; other values stay null."""
    return F.when(col == plus, F.lit(0.5)).when(col == minus, F.lit(-0.5))


def level_index(col: Column, levels) -> Column:
    """0-based position of a value in its design order (null when absent)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(pos > 0, (pos - 1).cast("double"))


def group_from_parity(id_col: Column) -> Column:
    return F.when(id_col % 2 == 1, F.lit(GROUP_ODD)).otherwise(F.lit(GROUP_EVEN))


def composite_key(*cols: str, sep: str = "|") -> Column:
    """Joined key that is null as soon as one part is null."""
    whole = F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return F.when(ok, whole)


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, whatever the session time zone is."""
    day = F.datediff(ts, F.lit("1970-01-01")).cast("bigint") * 86_400_000_000
    clock = F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000
    return day + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
