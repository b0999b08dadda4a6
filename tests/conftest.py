import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plumbline.session import local_session

    session = local_session(8, "plumbline-tests", shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture()
def rng():
    return np.random.default_rng(7)


@pytest.fixture(scope="session")
def manifest(spark):
    """4 subjects x 6 trials x 3 windows; the two rating targets disagree."""
    rows, index = [], 0
    for s in range(4):
        for t in range(1, 7):
            for c in range(3):
                rows.append((index, s, t, f"c{c}", 7.0 if t % 2 else 3.0, 7.0 if t <= 3 else 2.0, "deap_provider_participant_ratings"))
                index += 1
    return spark.createDataFrame(
        rows, "row_index long, subject_id long, trial_id long, clip_id string, valence double, arousal double, rating_source string"
    )
