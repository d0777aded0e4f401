"""Closed vocabularies and default parameters. These are fixed values: results depend on them."""

from __future__ import annotations

ACTION_GROUPS = {
    "approach_retract": ["reach", "move", "retract", "hover"],
    "acquire_release": ["grasp", "pick", "lift", "place", "put_down", "release", "drop"],
    "transport_exchange": ["transfer", "handover", "carry", "reposition"],
    "object_state": ["open", "close", "fold", "unfold", "insert", "remove", "rotate", "flip", "pour", "press", "push", "pull", "slide", "stack", "unstack", "twist", "tie", "untie", "tear", "cut", "wipe", "shake", "squeeze", "write", "wrap", "unwrap"],
    "bimanual": ["hold_steady", "align", "assemble", "disassemble"],
    "neutral": ["hold", "idle", "adjust_grip"],
    "escape": ["other"],
}
ACTIONS = [a for group in ACTION_GROUPS.values() for a in group]
HANDS = ["left", "right", "both", "both_coordinating"]
CONFIDENCES = ["low", "medium", "high"]  # by rank, from 0
NEEDS_GRASP = ["grasp", "pick", "lift"]
NEEDS_RELEASE = ["place", "put_down", "release", "drop"]
EVENT_NEAR_FRAMES = 15
GRASP_START_VERBS = ["pick", "grasp", "lift", "hold", "carry", "transfer", "insert", "remove", "open", "close", "adjust_grip"]
RELEASE_END_VERBS = ["place", "put_down", "release", "drop", "insert", "pour", "stack", "push", "close", "transfer"]
#: Priority of boundary sources in the merge of candidates.
PRIORITY = {"release": 4, "grasp": 3, "pause": 2, "gaze": 1}
STYLES = 6
#: Sentences for inserted idle segments; a segment takes one by its key and place.
IDLE_SENTENCES = ["Nothing is being manipulated.", "Both hands are at rest.", "The hands wait without touching an object."]

FPS = 30.0
CONFIDENCE_VALID_MIN = 0.5
MAX_GAP, SMOOTH_WINDOW, SMOOTH_DEGREE = 10, 15, 3
PAUSE_PROMINENCE, PAUSE_SPEED_MAX, APERTURE_SPEED = 0.05, 0.08, 0.15
GAZE_PERCENTILE, GAZE_FLOOR = 90, 0.25
MERGE_WINDOW, MIN_SEGMENT, MOVE_SPEED = 15, 30, 0.15
MERGE_GAP_S, IDLE_GAP_S, SHORT_SHARE = 0.5, 1.0, 0.34
WINDOW_FRAMES, STORY, IOU = 48, 3, 0.5
