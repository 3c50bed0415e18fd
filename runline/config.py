"""Parameters of the two stages. Fixed values; the operators take all of them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

# Sensor groups, in natural order.
STATIC = ["CabinDoorLockFront", "CabinDoorLockSide", "DNCMode", "ChipCleaningGunStatus", "OverrideSpindle", "SpindleApproval", "RapidTraverseKey", "Warmup"]
PROGRAM = ["ProgramStatus", "ProgramDetail", "ToolNumber", "DriveStatus", "DoorStatusMain"]
PHYSICAL = ["CoolantFlow", "OverrideFeed", "FeedRate", "SpindleSpeed", "SpindleCleaning"]
#: Experiments of stage one: the sensors that each reads.
EXPERIMENTS = {
    "EXP01_all": STATIC + PROGRAM + PHYSICAL,
    "EXP02_static_only": STATIC,
    "EXP03_program_only": PROGRAM,
    "EXP04_physical_only": PHYSICAL,
    "EXP05_static_program": STATIC + PROGRAM,
    "EXP06_static_physical": STATIC + PHYSICAL,
    "EXP07_program_physical": PROGRAM + PHYSICAL,
}
#: Branches of stage two: sensors and the weight of jumps in the boundary signal.
BRANCHES = {"program": (PROGRAM, 0.65), "physical": (PHYSICAL, 0.25), "program_physical": (PROGRAM + PHYSICAL, 0.45)}
TIME_COLUMNS = ["TIME_IN_MS", "DateTime", "Timestamp", "Time", "time", "Datetime", "timestamp"]
SESSION_FILES = {"data_from_2021-11-26.csv": 1, "data_from_2021-12-07.csv": 2, "data_from_2022-04.csv": 13}


@dataclass(frozen=True)
class Stage1:
    """Production intervals."""

    windows: tuple = (25, 101)
    smooth: int = 301
    merge_gap: int = 250
    min_len: int = 400
    thresholds: tuple = tuple(round(0.2 + 0.025 * k, 3) for k in range(25))
    best_iou_weight: float = 0.7
    f1_weight: float = 0.3
    max_train_rows: int = 8000
    match_iou: float = 0.10
    empty_iou: float | None = 1.0


@dataclass(frozen=True)
class Stage2:
    """Changeover intervals after production rows are gone."""

    windows: tuple = (15, 51)
    valid_phases: tuple = (1, 2, 3, 4, 6)
    target_phase: int = 2
    max_train_rows: int | None = None
    smooth: int = 51
    merge_gap: int = 40
    min_len: int = 20
    blob_thresholds: tuple = (0.50, 0.35)
    peak_quantile: float = 0.88
    max_splits: int = 30
    nms_iou: float = 0.88
    select_iou: float = 0.55
    backfill_iou: float = 0.75
    refine_radius: int = 50
    empty_iou: float | None = None
