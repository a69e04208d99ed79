"""Recursive rules against their wording on small cases."""

import numpy as np
import pandas as pd

from pitchflow.operators import helpers as h


def test_jumps_count_from_the_last_kept_point():
    frame = np.array([0, 1, 2, 3])
    x = np.array([0.0, 50.0, 9.0, 51.0])
    assert h.kept_after_jumps(frame, x, np.zeros(4)).tolist() == [True, False, True, False]


def test_motion_caps():
    frame = np.arange(30)
    x, _ = h.capped(frame, np.cumsum(np.full(30, 3.0)), np.zeros(30))
    v = np.diff(x) * h.FPS
    assert v.max() <= 11.5 + 1e-9 and (np.diff(v) <= 5.0 / h.FPS + 1e-9).all()
    same, _ = h.capped(frame, np.full(30, 4.0), np.zeros(30))
    assert (same == 4.0).all()


def test_kalman_follows_a_line_and_fills():
    v = np.arange(60, dtype=float)
    v[30] = np.nan
    out = h.kalman(v)
    assert abs(out[30] - 30) < 1 and abs(out[-1] - 59) < 0.5
    assert np.isnan(h.kalman(np.full(3, np.nan))).all()


def test_possession_changes_after_three():
    rows = np.array([1, 1, 2, 2, 1, 2, 2, 2, -1, 2])
    want = [1, 1, 1, 1, 1, 1, 1, 2, 2, 2]
    assert h.held_possession(rows)[0].tolist() == want
    for cut in range(len(rows)):  # a stream goes on where a batch ended
        first, state = h.held_possession(rows[:cut])
        assert first.tolist() + h.held_possession(rows[cut:], state=state)[0].tolist() == want


def test_sprint_intervals():
    t = np.arange(0, 12, 0.5)
    v = np.full(len(t), 3.0)
    v[4:8] = 8.0  # 2.0 to 3.5 s, ends at 4.0
    v[10:14] = 9.0  # starts 1 s after, and so is merged
    v[20:] = 7.5  # still open at the end
    assert h.sprints(t, v) == [(2.0, 7.0, 9.0), (10.0, 11.5, 7.5)]
    assert h.sprints(t, np.full(len(t), 5.0)) == []


def test_spectrum_of_a_constant_is_the_mean_alone():
    assert h.spectrum(np.full(16, 2.0)) == (0.0, 0.0)


def test_two_means_is_deterministic_and_ordered():
    f = np.array([[90.0, 1, 1], [10, 1, 1], [88, 1, 1], [12, 1, 1]])
    assert h.two_means(f).tolist() == [1, 0, 1, 0]


def test_drift_resets_after_five():
    v = np.array([[1.0, 0]] * 2 + [[0.0, 1]] * 6)
    sims, resets = h.drift(v)
    assert resets.tolist() == [False] * 6 + [True, False] and sims[-1] == 1.0


def test_stitch_takes_the_nearest_and_each_once():
    p = pd.DataFrame({"match_id": "m", "track_id": [1, 2, 3], "team_id": 0, "first_seen": [0, 12, 13], "last_seen": [10, 20, 20], "x0": [0.0, 5.0, 1.0], "y0": 0.0, "x1": [0.0, 5.0, 1.0], "y1": 0.0})
    assert h.stitched(p).thread.tolist() == [1, 2, 1]


def test_maps_are_filtered_together():
    """Against the filter written with matrices; a map without scale stays as it is."""
    rng = np.random.default_rng(2)
    maps = rng.normal(size=(40, 9)) + np.eye(3).ravel() * 9
    maps[7, 8] = 0.0
    x, p, want = None, np.eye(9), maps.copy()
    for i, m in enumerate(maps):
        if abs(m[8]) < 1e-9:
            continue
        z = m / m[8]
        if x is None:
            x = z
        else:
            p = p + np.eye(9) * 1e-4
            k = p @ np.linalg.inv(p + np.eye(9) * 1e-2)
            x, p = x + k @ (z - x), (np.eye(9) - k) @ p
        want[i] = x
    assert np.allclose(h.smoothed_matrices(maps), want) and (h.smoothed_matrices(maps)[7] == maps[7]).all()
    assert h.smoothed_matrices(np.zeros((0, 9))).shape == (0, 9)
