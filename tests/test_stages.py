from pathlib import Path

import pytest

from voxloom.session import materialised, own_stages, shared_folder, stage_folder


def here(folder):
    return Path(folder.removeprefix("file:"))


def test_own_stages_go_when_they_end(spark):
    base = shared_folder(spark)
    with own_stages(spark) as outer:
        assert outer == base
        materialised(spark.range(3))
        first = stage_folder(spark)
        with own_stages(spark) as middle:
            kept = materialised(materialised(spark.range(5)).filter("id > 1"), middle)
            second = stage_folder(spark)
        assert middle == first and kept.count() == 3 and not here(second).exists() and here(first).exists()
        out = materialised(kept, outer)
    assert not here(first).exists() and stage_folder(spark) == base and out.count() == 3


def test_own_stages_go_after_an_error(spark):
    with pytest.raises(ValueError), own_stages(spark):
        materialised(spark.range(3))
        folder = stage_folder(spark)
        assert here(folder).exists()
        raise ValueError
    assert not here(folder).exists() and stage_folder(spark) == shared_folder(spark)
