"""Fixed values of the glyph operators, for rows and for streams."""

ROTATION, BASELINE_TOLERANCE = 5.0, 0.3
SPACE_RATIO, SUPER_RISE, SUPER_SIZE = 0.25, 0.2, 0.85
OPEN, CLOSE = "", ""
BINS, LEAST_ROWS, CLEAR = 512, 8, 0.6
