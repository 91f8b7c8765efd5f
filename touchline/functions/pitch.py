"""Fixed values of the pitch and the vocabularies of lines, labels and classes."""

from __future__ import annotations

import math

# fixed values: metres, centre origin
HALF_LENGTH, HALF_WIDTH = 52.5, 34.0
PENALTY_WIDTH, PENALTY_DEPTH = 40.32, 16.5
GOAL_AREA_WIDTH, GOAL_AREA_DEPTH = 18.32, 5.5
CIRCLE_RADIUS, SPOT, GOAL_WIDTH = 9.15, 11.0, 7.32
MAX_SPEED, TYPICAL_SPEED, OUTLIER_SPEED, VELOCITY_CAP = 12.0, 6.0, 15.0, 10.0
FPS = 30.0

# fixed values: the line classes in index order; one of them ends in a space
LINE_CLASSES = [
    "Big rect. left bottom", "Big rect. left main", "Big rect. left top",
    "Big rect. right bottom", "Big rect. right main", "Big rect. right top",
    "Circle central", "Circle left", "Circle right",
    "Goal left crossbar", "Goal left post left ", "Goal left post right",
    "Goal right crossbar", "Goal right post left", "Goal right post right",
    "Goal unknown", "Line unknown", "Middle line",
    "Side line bottom", "Side line left", "Side line right", "Side line top",
    "Small rect. left bottom", "Small rect. left main", "Small rect. left top",
    "Small rect. right bottom", "Small rect. right main", "Small rect. right top",
]
CIRCLES = ("Circle central", "Circle left", "Circle right")

# fixed values: detector classes and export labels use different id orders
DETECTOR_CLASSES = {0: "player", 1: "goalkeeper", 2: "referee", 3: "ball"}
EXPORT_LABELS = {"player": 0, "referee": 1, "goalkeeper": 2, "ball": 3}


def template() -> list[tuple[str, int, float, float]]:
    """(line class, point index, x, y) of the points that a homography is fitted to."""
    box = HALF_LENGTH - PENALTY_DEPTH
    ends = {
        "Side line top": ((-HALF_LENGTH, HALF_WIDTH), (HALF_LENGTH, HALF_WIDTH)),
        "Side line bottom": ((-HALF_LENGTH, -HALF_WIDTH), (HALF_LENGTH, -HALF_WIDTH)),
        "Side line left": ((-HALF_LENGTH, -HALF_WIDTH), (-HALF_LENGTH, HALF_WIDTH)),
        "Side line right": ((HALF_LENGTH, -HALF_WIDTH), (HALF_LENGTH, HALF_WIDTH)),
        "Middle line": ((0.0, -HALF_WIDTH), (0.0, HALF_WIDTH)),
        "Big rect. left main": ((-box, -PENALTY_WIDTH / 2), (-box, PENALTY_WIDTH / 2)),
        "Big rect. right main": ((box, -PENALTY_WIDTH / 2), (box, PENALTY_WIDTH / 2)),
    }
    rows = [(name, k, *point) for name, points in ends.items() for k, point in enumerate(points)]
    turn = [2 * math.pi * k / 9 for k in range(9)]
    return rows + [("Circle central", k, CIRCLE_RADIUS * math.cos(a), CIRCLE_RADIUS * math.sin(a)) for k, a in enumerate(turn)]


# fixed values: the lines of the pitch and goals in metres from a corner, heights negative
LINES_3D = [
    ((0.0, 54.16, 0.0), (16.5, 54.16, 0.0)), ((16.5, 13.84, 0.0), (16.5, 54.16, 0.0)), ((16.5, 13.84, 0.0), (0.0, 13.84, 0.0)),
    ((88.5, 54.16, 0.0), (105.0, 54.16, 0.0)), ((88.5, 13.84, 0.0), (88.5, 54.16, 0.0)), ((88.5, 13.84, 0.0), (105.0, 13.84, 0.0)),
    ((0.0, 37.66, -2.44), (0.0, 30.34, -2.44)), ((0.0, 37.66, 0.0), (0.0, 37.66, -2.44)), ((0.0, 30.34, 0.0), (0.0, 30.34, -2.44)),
    ((105.0, 37.66, -2.44), (105.0, 30.34, -2.44)), ((105.0, 30.34, 0.0), (105.0, 30.34, -2.44)), ((105.0, 37.66, 0.0), (105.0, 37.66, -2.44)),
    ((52.5, 0.0, 0.0), (52.5, 68.0, 0.0)), ((0.0, 68.0, 0.0), (105.0, 68.0, 0.0)), ((0.0, 0.0, 0.0), (0.0, 68.0, 0.0)),
    ((105.0, 0.0, 0.0), (105.0, 68.0, 0.0)), ((0.0, 0.0, 0.0), (105.0, 0.0, 0.0)),
    ((0.0, 43.16, 0.0), (5.5, 43.16, 0.0)), ((5.5, 43.16, 0.0), (5.5, 24.84, 0.0)), ((5.5, 24.84, 0.0), (0.0, 24.84, 0.0)),
    ((99.5, 43.16, 0.0), (105.0, 43.16, 0.0)), ((99.5, 43.16, 0.0), (99.5, 24.84, 0.0)), ((99.5, 24.84, 0.0), (105.0, 24.84, 0.0)),
]
