"""Fixed values of the event and tracking domain: vocabularies, pitch, windows and weights."""

from __future__ import annotations

# Fixed values.
PITCH_X, PITCH_Y = 105.0, 68.0
GOAL_WIDTH = 7.32
FPS = 25

# Action types in their usual order.
ACTION_TYPES = (
    "pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed", "corner_short", "take_on", "second_take_on", "foul", "tackle", "interception", "shot",
    "shot_penalty", "shot_freekick", "keeper_save", "keeper_claim", "keeper_punch", "keeper_pick_up", "clearance", "bad_touch", "goalkick", "shot_block", "ball_recovery", "keeper_sweeper", "dispossessed",
)
PASSES = ("pass", "cross")
VALUE_GRID_TYPES = ("pass", "cross", "shot")
SHOTS = ("shot", "shot_freekick", "shot_penalty")
INCOMING = ("interception", "ball_recovery", "shot_block", "keeper_save", "keeper_punch", "keeper_claim", "keeper_pick_up", "keeper_sweeper")
DEFENSIVE_TOUCH = ("interception", "bad_touch", "shot_block", "keeper_save", "keeper_punch")
RESTART_OUT = ("throw_in", "goalkick", "corner_short", "corner_crossed")
RESTART_FOUL = ("freekick_short", "freekick_crossed", "shot_freekick", "shot_penalty")
RESTARTS = RESTART_OUT + RESTART_FOUL
MINOR = ("tackle", "take_on", "second_take_on", "foul", "bad_touch", "dispossessed")
SYNC_PASS_LIKE = ("pass", "cross", "shot", "clearance", "keeper_punch", "shot_block")
SYNC_INCOMING = ("interception", "keeper_save", "keeper_claim", "keeper_pick_up", "keeper_sweeper", "ball_recovery")
RECEIVE_TYPES = ("pass", "cross", "throw_in", "freekick_crossed", "freekick_short", "corner_crossed", "corner_short", "goalkick")

# Seconds searched on either side of an event.
WINDOW_KICKOFF, WINDOW_PASS_LIKE, WINDOW_RESTART, WINDOW_INCOMING, WINDOW_MINOR = 5, 10, 15, 10, 10

# What the synchroniser scores, from where to where, and whether more is better; distances and heights below which a frame counts, of the ball to a player in general and for dribbles.
SYNC_SCORES = {"gap": (0, 3, False), "speed": (0, 5, True), "change": (0, 20, True), "kick": (0, 5, True), "turn": (-1, 1, False), "delay": (0, 125, False)}
SYNC_NEAR, SYNC_LOW = 3.0, 3.5
DRIBBLE_NEAR, DRIBBLE_LOW = 1.5, 2.0
RECEIPT_NEAR, RECEIPT_LOW = 2.0, 3.0

# The baseline synchroniser's kinds, with seconds searched, largest player-ball distance, largest ball height, least and largest ball acceleration.
BASELINE_KINDS = {
    "pass_like": (SYNC_PASS_LIKE, 10, 2.5, 3, -1, None), "set_piece": (RESTARTS, 15, 2.5, 3, -1, None), "incoming": (SYNC_INCOMING, 10, 2, 3, None, 1),
    "bad_touch": (("bad_touch",), 5, 3, 3, None, None), "fault_like": (("foul", "tackle"), 5, 3, 4, None, None),
}

# Constants of the credit model.
PENALTY_VALUE = 0.7884
CORNER_VALUE = 0.02
SHOT_OUT_SHARE = 2380 / 6950

# Value grid.
GRID_COLUMNS, GRID_ROWS = 12, 8
DESTINATION_COLUMNS, DESTINATION_ROWS = 105, 68
