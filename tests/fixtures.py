"""Small tables with known results."""

from veilcell import Interval, SynthConfig

NOISELESS = SynthConfig(low_threshold=3, low_layer_sd=0, low_mean_gap=0, noise_sd=0, outliers=Interval(1, 1), top=Interval(1, 1),
                        singularity_threshold=4, range_threshold=8, clustering=False, salt="s")
NOISY = SynthConfig(low_threshold=2, singularity_threshold=4, range_threshold=8, clustering=False, salt="s")

# Inputs of the published test cases.
SKEWED = [1, 5, 2, 7, 21, 4, 21, 28, 19, 2, 1, 13, 25, 30, 6, 2, 15, 24, 9, 100, 0]
GROUPS = [0] * 10 + [1] * 9 + [0, -5]
PAIR_ROWS = list(zip(GROUPS, [1, 5, 2, 7, 21, 4, 21, 28, 19, 2, 1, 13, 25, 30, 6, 2, 15, 24, 9, 100, 0]))
ONE_ID = [(1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (4, 1), (11, 2), (12, 2), (13, 2), (14, 2), (15, 2), (16, 2), (16, 2), (16, 2),
          (17, 2), (17, 2), (17, 2), (17, 2), (17, 2)]
TWO_IDS = [(101, 201, 1), (102, 202, 1), (103, 203, 1), (104, 204, 1), (104, 205, 1), (104, 206, 1), (301, 401, 2), (302, 402, 2),
           (303, 403, 2), (304, 404, 2), (305, 405, 2), (306, 406, 2), (307, 406, 2), (308, 406, 2), (309, 406, 2), (310, 406, 2)]
LOW_ONE = [(i, "show") for i in range(1, 6)] + [(6, "suppress_1"), (7, "suppress_1")] + [(i, "suppress_2") for i in (8, 8, 8, 9, 9, 9)]
LOW_TWO = ([(101, 201, "show"), (102, 202, "show"), (103, 203, "show")] + [(301, 401, "suppress_1")] * 3
           + [(501, 600 + i, "suppress_2") for i in (1, 2, 3)] + [(700 + i, 801, "suppress_3") for i in (1, 2, 3)])
CHECKERS = [(0.5, 1.5), (1.5, 0.5), (2.5, 1.5), (3.5, 0.5)] * 8
STREETS = ([f"Leopoldstraße {n}" for n in (92, 1, 108, 27, 34, 15, 1, 27)]
           + [f"Potsdamer Straße {n}" for n in (47, 17, 2, 31, 2, 17, 2, 17)]
           + [f"Spandauer Str. {n}" for n in (84, 4, 1, 21, 41, 40, 44, 49)]
           + [f"Gerichtstraße {n}" for n in (3, 1, "2a", "2b", 20, 12, 9, 4)])
SYSTEM = {
    "two groups": [(1, y) for y in (0, 6, 12, 7, 21, 12, 17, 31)] + [(0, y) for y in (5, 2, 7, 19, 24, 16, 8, 2)],
    "four blobs": list(zip((2, 3, 1, 3, 8, 7, 8, 3, 3, 4, 3, 5, 2, 8, 6, 7, 8, 9, 8, 8),
                           (3, 4, 3, 5, 3, 3, 2, 12, 11, 10, 13, 11, 11, 3, 3, 12, 12, 11, 10, 13))),
    "step": [(x, 7 if x < 12 else 17) for x in range(1, 26)],
}


def expected_snaps():
    """(min, max, lo, hi) of snapped ranges, as published."""
    return [(1, 2, 1, 2), (3, 7, 0, 8), (11, 21, 8, 24), (11, 14, 10, 14), (-1, 2, -2, 2), (-3, -2, -3, -2), (-7, 0, -8, 0),
            (0, 5, 0, 8), (-5, -2, -6, -2), (-5, 7, -8, 8), (-6, 2, -8, 8), (21, 23, 21, 23), (0, 0, 0, 1), (0.2, 0.4, 0, 0.5),
            (0.01, 0.1, 0, 0.125), (-1.4, -0.3, -2, 0), (0.333, 0.78, 0, 1), (0.002, 0.01, 0, 0.015625), (0.66, 0.9, 0.5, 1),
            (10.001, 10.002, 10.0009765625, 10.0029296875), (158.88434124351295, 158.94684124353768, 158.875, 159),
            (0, 1e-17, 0, 2.0 ** -56), (0, 2.0 ** -1073, 0, 2.0 ** -1073), (0, 2.0 ** -1073 + 2.0 ** -1074, 0, 2.0 ** -1072),
            (6437971547.0, 6474891187.0, 6408896512.0, 6476005376.0)]
