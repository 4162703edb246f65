"""The check verb reads contents, not sizes alone."""

import numpy as np
import pytest

from pointlake import cli

CAR = 10


def sequence(root, frames, labels=True):
    """Frames as (x of the points, semantic ids, instance ids)."""
    folder = root / "sequences" / "00"
    (folder / "velodyne").mkdir(parents=True)
    if labels:
        (folder / "labels").mkdir()
    for k, (x, semantic, instance) in enumerate(frames):
        points = np.zeros((len(x), 4), "<f4")
        points[:, 0] = x
        points.tofile(folder / "velodyne" / f"{k:06d}.bin")
        if labels:
            (np.array(semantic, "<u4") | np.array(instance, "<u4") << 16).tofile(folder / "labels" / f"{k:06d}.label")
    return ["check", "--root", f"file://{root}"]


GOOD = ([1, 2, 3], [CAR, CAR, 40], [1, 2, 0])


@pytest.mark.parametrize(
    ("second", "printed"),
    [
        (GOOD, ""),
        (([1, np.nan, 3], *GOOD[1:]), "frame 1: non_finite"),
        (([1, np.inf, 3], *GOOD[1:]), "frame 1: non_finite"),
        ((GOOD[0], [CAR, CAR, 7], GOOD[2]), "label 7: unknown, 1 points"),
        ((GOOD[0], GOOD[1], [3, 4, 0]), "instance continuity 0.000: 0 of 2"),
    ],
)
def test_check(spark, tmp_path, capsys, second, printed):
    assert cli.main(sequence(tmp_path, [GOOD, second])) == int(bool(printed))
    out = capsys.readouterr().out
    assert printed in out and bool(out) == bool(printed)


def test_check_without_labels(spark, tmp_path):
    assert cli.main(sequence(tmp_path, [GOOD, GOOD], labels=False)) == 0
